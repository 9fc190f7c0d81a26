"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman alignment scores the copies.

The test items, a stated query set, are taken in blocks of at most ITEMS; a block's seeds (pairs of words) are a table
of bounded size that goes to every task, so no text is shuffled. A copy that reaches the least score by replaced or
dropped words leaves so many pairs of its item whole that one of the item's rarest must be among them: only those are its
seeds. Rare is what few items hold; how often a seed stands in the documents plays no part, so a copy is found however
many others there are. An item is aligned with each stretch of a document that holds one of its seeds, and enough of its
words to reach the least score. Copies with a word put in between nearly all pairs aren't sure to be found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordPrints, documents, shingles

SEED = 2
#: Items in a block, and the words of an item from which it counts as evidence.
ITEMS, LEAST_WORDS = 20_000, 5
#: Alignment: each equal word counts 1; what a differing and what a missing word costs; the least share of the item's words.
DIFFER, MISSING, SHARE = 0.5, 0.5, 0.5
#: Words that an alignment must score at least (an item with fewer must be there whole).
LEAST_SCORE = 8

SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())


class PlainWords(WordPrints):
    """The lower-cased words without ASCII signs."""

    def __init__(self):
        super().__init__(SIGNS)

    def of(self, text: str | None) -> np.ndarray:
        return super().of((text or "").lower())


@dataclass
class Block:
    ids: list[int | None]
    words: list[np.ndarray]  # fingerprints
    seeds: np.ndarray  # sorted, each once
    owner: np.ndarray  # rows (seed index, item, first or last position of the seed in it), by seed index
    filter: np.ndarray  # of 2 ** 20 flags by a seed's first bits

    def __post_init__(self):
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.least = np.array([least_score(len(w)) for w in self.words])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.vocabulary, self.numbers = np.unique(np.concatenate([np.empty(0, np.uint64), *self.words]), return_inverse=True)

    @staticmethod
    def of(rows: list[tuple[int | None, str | None]]) -> Block:
        prints = PlainWords()
        kept = [(i, w) for i, t in rows if len(w := prints.of(t)) >= LEAST_WORDS]
        flat = [shingles(w, SEED) for _, w in kept]
        item = np.repeat(np.arange(len(kept)), [len(s) for s in flat])
        pos = np.concatenate([np.empty(0, np.int64), *[np.arange(len(s)) for s in flat]]).astype(np.int64)
        seeds, at = np.unique(np.concatenate([np.empty(0, np.uint64), *flat]), return_inverse=True)
        # how many items hold each seed, and each item's places by that
        pairs = np.unique(np.stack([at, item], axis=1), axis=0) if len(at) else np.empty((0, 2), np.int64)
        held_by = np.bincount(pairs[:, 0], minlength=len(seeds))[at]
        order = np.lexsort((pos, at, held_by, item))
        rank = np.arange(len(item)) - np.searchsorted(item, item)  # items are in order
        rare = order[rank < np.array([seeds_needed(len(w)) for _, w in kept], np.int64)[item]]
        # a seed that stands in an item more than once counts by its first and last place among those
        rare = rare[np.lexsort((pos[rare], item[rare], at[rare]))]
        edge = (np.diff(at[rare]) != 0) | (np.diff(item[rare]) != 0)
        rare = rare[np.append(True, edge) | np.append(edge, True)] if len(rare) else rare
        used, index = np.unique(at[rare], return_inverse=True)
        seeds, owner = seeds[used], np.stack([index, item[rare], pos[rare]], axis=1).astype(np.int64)
        return Block([i for i, _ in kept], [w for _, w in kept], seeds, owner, flags(seeds))

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in grams a seed stands, and which."""
        if not len(self.seeds):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(self.filter[(grams >> np.uint64(44)).astype(np.int64)])
        k = np.searchsorted(self.seeds, grams[at])
        k[k == len(self.seeds)] = 0
        same = self.seeds[k] == grams[at]
        return at[same], k[same]

    def present(self, words: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many words of each item stand anywhere in its stretch of the text."""
        k = np.searchsorted(self.vocabulary, words)
        k[k == len(self.vocabulary)] = 0
        at = np.flatnonzero(self.vocabulary[k] == words)
        width = len(words) + 1
        places = np.sort(k[at] * width + at)
        out = []
        for a in range(0, len(item), 1 << 14):
            part = slice(a, a + (1 << 14))
            size = self.lengths[item[part]]
            before = np.cumsum(size) - size
            rows = np.repeat(self.starts[item[part]] - before, size) + np.arange(size.sum())
            line = self.numbers[rows] * width
            there = np.searchsorted(places, line + np.repeat(start[part], size)) < np.searchsorted(places, line + np.repeat(end[part], size))
            out.append(np.add.reduceat(there.astype(np.int64), before))
        return np.concatenate(out)

    def matches(self, words: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, last word) of every item that the words hold a copy of."""
        at, k = self.find(shingles(words, SEED))
        if not len(at):
            return []
        low, high = np.searchsorted(self.owner[:, 0], k), np.searchsorted(self.owner[:, 0], k, "right")
        size = high - low
        rows = self.owner[np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        item, diagonal = rows[:, 1], np.repeat(at, size) - rows[:, 2]
        order = np.lexsort((diagonal, item))
        item, diagonal = item[order], diagonal[order]
        length = self.lengths
        slack = length[item]  # as far apart may the diagonals of one copy seem, where a seed repeats in the item
        cut = np.flatnonzero((np.diff(item) != 0) | (np.diff(diagonal) > slack[1:])) + 1
        first, after = np.append(0, cut), np.append(cut, len(item))
        item, n = item[first], length[item[first]]
        start, end = np.maximum(0, diagonal[first] - n), np.minimum(len(words), diagonal[after - 1] + 2 * n)
        likely = self.present(words, item, start, end) >= self.least[item]  # no alignment scores more
        best: dict[int, tuple[float, int, int]] = {}
        for i, start, end in zip(item[likely].tolist(), start[likely].tolist(), end[likely].tolist(), strict=True):
            n = len(self.words[i])
            for part in range(start, end, 4 * n + 200):  # a long run of copies is aligned stretch by stretch
                found = align(self.words[i], words[part : min(end, part + 6 * n + 200)])
                if found and found[0] > best.get(i, (0,))[0]:
                    best[i] = (found[0], part + found[1], part + found[2])
        return [(i, *x) for i, x in sorted(best.items())]


def least_score(n: int) -> float:
    """What an alignment with an item of n words must score, in words."""
    return max(SHARE * n, min(LEAST_SCORE, n))


def seeds_needed(n: int) -> int:
    """So many pairs of an item of n words that one of them is whole in any copy of replaced or dropped words.

    An edit costs its word and DIFFER or MISSING, and breaks two pairs; a word cut off at an end costs itself and breaks one.
    """
    broken = int(2 * (n - least_score(n)) / (1 + min(DIFFER, MISSING)))
    return min(n - SEED + 1, broken + 1)


def flags(seeds: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(seeds >> np.uint64(44)).astype(np.int64)] = True
    return out


def scores(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Smith-Waterman: the best score of an alignment that ends with each of the words and any word of the item."""
    slope = MISSING * np.arange(1, len(words) + 1)
    above, best = np.zeros(len(words) + 1), np.zeros(len(words))
    for w in item:
        here = np.maximum(above[:-1] + np.where(words == w, 1.0, -DIFFER), above[1:] - MISSING)
        here = np.maximum.accumulate(np.maximum(here, 0) + slope) - slope  # words of the text that the item lacks
        best = np.maximum(best, here)
        above = np.concatenate([[0.0], here])
    return best


def align(item: np.ndarray, words: np.ndarray) -> tuple[float, int, int] | None:
    """(score as a share of the item, first, last word) of the best alignment, if that is good enough."""
    least = least_score(len(item))
    if np.isin(item, words).sum() < least:  # no alignment scores more than the words that are there at all
        return None
    ends = scores(item, words)
    last = int(ends.argmax())
    if ends[last] < least:
        return None
    back = scores(item[::-1], words[: last + 1][::-1])
    return float(ends[last] / len(item)), last - int(back.argmax()), last


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    count = items.count()
    blocks = max(1, -(-2 * count // ITEMS)) if count > ITEMS else 1
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        yield Block.of(sorted(map(tuple, part.collect()), key=repr))


def find_copies(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every row of docs as `row` (struct of all its columns) with copies: array<struct<item_id, score, first, last>>.

    score is the alignment's share of the item's words (1 for an exact copy), first and last the words of the document
    that it spans. Null and empty texts hold no copy; null, empty and shorter items (LEAST_WORDS) have none; equal items
    and rows each count. An empty benchmark or table gives empty arrays or an empty table.
    """
    spark = docs.sparkSession
    struct = "struct<item_id:bigint,score:double,first:bigint,last:bigint>"
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.array().cast(f"array<{struct}>").alias("copies"))
    for block in blocks_of(benchmark, item_id, item_text):
        if not block.words:
            continue
        shared = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, prints = shared.value, PlainWords()
            for batch in batches:
                out = []
                for text, old in zip(batch.column(2), batch.column(1).to_pylist(), strict=True):
                    got = known.matches(prints.of(text.as_py()))
                    out.append(old + [{"item_id": known.ids[i], "score": s, "first": a, "last": b} for i, s, a, b in got])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["row", "copies"])

        row = found.schema["row"].dataType.simpleString()
        found = found.select("row", "copies", F.col(f"row.`{text_col}`").alias("text")).mapInArrow(find, f"row {row}, copies array<{struct}>")
    return found


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_copies(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("row.doc_id", F.explode("copies").alias("copy")).select("doc_id", "copy.item_id", "copy.score", "copy.first", "copy.last")


QUERIES = {"op3_decontamination": op3_decontamination}
ORACLES: dict[str, str] = {}
