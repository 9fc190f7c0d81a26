"""Cross-tokenizer alignment: where two tokenizers cut the same bytes, and which of their tokens overlap.

Tokens are runs of one text's bytes, so a tokenizer is a bitset over the bytes with a bit at each token's last byte. The
bitsets of many texts lie behind each other, packed in 64-bit words. AND yields the shared cuts, which part the tokens
into groups; the bits of OR are the links, as each piece between two cuts of either side lies in one token of each.
Popcounts summed over the words rank a byte among a side's cuts, which is the number of its token.

How many documents link two ids is counted over the corpus. Documents are read in blocks; a block ships its distinct
pairs once, with the number of its documents that hold each, and meets the corpus-wide counts again as a block.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters, merge_word
from .common import discard, documents, table

U64 = np.uint64
#: A block of documents ends at so many characters or rows; texts are tokenized so many characters at a time.
BLOCK_CHARS, BLOCK_ROWS, STEP_CHARS = 4 << 20, 4096, 1 << 19


class Bits:
    """A packed bitset with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(ones)])

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        marks = np.zeros((size + 64) // 64 * 64, np.uint8)
        marks[places] = 1
        return cls(np.packbits(marks, bitorder="little").view("<u8").astype(U64, copy=False))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word, bit = places >> 6, (places & 63).astype(U64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((U64(1) << bit) - U64(1)))

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Side:
    """One tokenizer: the bytes of each id, and how an id is written in a group."""

    def __init__(self, shown: list[bytes], last: str):
        self.bytes = shown
        self.lengths = np.array([len(b) for b in shown], np.int64)
        self.inner = np.array([f"{i}," for i in range(len(shown))], object)
        self.last = np.array([f"{i}{last}" for i in range(len(shown))], object)

    def spells(self, ids: list[int], data: bytes) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids)) == data


#: How byte-level BPE files of this kind part a text before merging (a fixed value, public with the vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe(Side):
    """A byte-level BPE file; texts get a space in front.

    It is read as ranks: neighbours are merged whose bytes together are a token, lowest number first, which is several
    times faster than by the list of pairs. Both agree if the listed merges, in the order of the numbers, make every
    token from its own bytes (what happens within a token's bytes doesn't depend on what stands around); that is checked.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, special = spec["model"]["vocab"], spec["model"]["merges"], {t["content"] for t in spec["added_tokens"]}
        byte = {letter: k for k, letter in enumerate(byte_letters())}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        ranked = {vocab[x] << 32 | vocab[y]: (vocab[x + y] << 32, vocab[x + y]) for x, y in pairs}
        shown = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            if token in special:
                shown[i] = token.encode()
            else:
                shown[i] = bytes(byte[c] for c in token)
                if merge_word([vocab[c] for c in token], ranked) != [i]:
                    raise ValueError(f"{path}: its merges don't make token {i}")
        ranks = {shown[i]: i for token, i in vocab.items() if token not in special}
        self.codec = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        super().__init__(shown, "|")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.codec.encode_ordinary(" " + t) for t in texts]


class Pieces(Side):
    """A model of pieces with byte fallback, which puts a space in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.codec = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.codec.id_to_piece(i) for i in range(self.codec.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        super().__init__([bytes([int(m[1], 16)]) if (m := byte.fullmatch(n)) else n.replace("▁", " ").encode() for n in names], ";")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.codec.encode(texts, num_threads=1)


@lru_cache(maxsize=1)
def sides(a: str, b: str) -> tuple[ByteBpe, Pieces]:
    return ByteBpe(a), Pieces(b)


def stepwise(side: Side, texts: list[str]) -> Iterator[list[int]]:
    """The ids of each text; the codec sees some texts at a time."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= STEP_CHARS or k == len(texts) - 1:
            yield from side.encode(texts[start : k + 1])
            start, size = k + 1, 0


class Alignment:
    """The alignment of a block of texts. Those without tokens on both sides (null, empty, or not spelt by them) have none."""

    def __init__(self, texts: list[str | None], a: Side, b: Side):
        some = [k for k, t in enumerate(texts) if t]
        found = []
        whole = [texts[k] for k in some]
        for k, text, ids_a, ids_b in zip(some, whole, stepwise(a, whole), stepwise(b, whole), strict=True):
            data = b" " + text.encode()
            if a.spells(ids_a, data) and b.spells(ids_b, data):
                found.append((k, len(data), ids_a, ids_b))
        self.n, self.docs = len(texts), np.array([f[0] for f in found], np.int64)
        self.n_a, self.n_b = (np.array([len(f[k]) for f in found], np.int64) for k in (2, 3))
        self.a, self.b = (np.fromiter((i for f in found for i in f[k]), np.int64, int(n.sum())) for k, n in ((2, self.n_a), (3, self.n_b)))
        size = sum(f[1] for f in found)
        self.sides, self.stops = (a, b), np.cumsum([f[1] for f in found], dtype=np.int64)
        self.bits_a, self.bits_b = (Bits.at(np.cumsum(side.lengths[ids]) - 1, size) for side, ids in ((a, self.a), (b, self.b)))
        self.cuts, self.either = Bits(self.bits_a.words & self.bits_b.words), Bits(self.bits_a.words | self.bits_b.words)

    def per_doc(self, bits: Bits) -> np.ndarray:
        """How many bits each text with tokens has set."""
        return np.diff(bits.rank(self.stops), prepend=0)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(index of the text, id of a << 32 | id of b) of each link, in the order of bytes."""
        places = self.either.select()
        return np.repeat(self.docs, self.per_doc(self.either)), self.a[self.bits_a.rank(places)] << 32 | self.b[self.bits_b.rank(places)]

    def groups(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text; a side's tokens up to a cut are those of rank below the cut's."""
        stops = self.cuts.select() + 1
        upto_a, upto_b = self.bits_a.rank(stops), self.bits_b.rank(stops)
        shown = np.empty(len(self.a) + len(self.b), object)
        for side, ids, own, other in ((self.sides[0], self.a, upto_a, np.concatenate([np.zeros(1, np.int64), upto_b[:-1]]) if len(upto_b) else upto_b), (self.sides[1], self.b, upto_b, upto_a)):
            texts = side.inner[ids]
            texts[own - 1] = side.last[ids[own - 1]]
            shown[np.arange(len(ids)) + np.repeat(other, np.diff(own, prepend=0))] = texts
        out, at = [""] * self.n, 0
        for k, n in zip(self.docs.tolist(), (self.n_a + self.n_b).tolist(), strict=True):
            out[k] = "".join(shown[at : at + n].tolist())[:-1]
            at += n
        return out

    def spread(self, values: np.ndarray) -> np.ndarray:
        """A value for each text; 0 of those without tokens."""
        out = np.zeros(self.n, np.int64)
        out[self.docs] = values
        return out


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def read_blocks(docs: DataFrame, a: str, b: str, whole: bool) -> DataFrame:
    """A row for each document (its counts, groups, and the places of its distinct pairs in its block with their numbers),
    and one for each block (pairs, and how many of its documents hold each)."""
    kind = docs.schema["doc_id"].dataType
    schema = f"block long, doc_id {kind.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, groups string, at array<int>, times array<int>, pairs array<long>, docs array<int>"

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs, block = sides(a, b), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, start, size = batch.column(1), 0, 0
            for k in range(len(texts)):
                size += len(texts[k].as_py() or "")
                if size >= BLOCK_CHARS or k - start >= BLOCK_ROWS or k == len(texts) - 1:
                    found = Alignment(texts.slice(start, k + 1 - start).to_pylist(), *codecs)
                    doc, pair = found.links()
                    pairs, place = np.unique(pair, return_inverse=True)
                    each, times = np.unique(doc * max(1, len(pairs)) + place, return_counts=True)
                    doc, at = np.divmod(each, max(1, len(pairs)))
                    counts = [found.spread(v) for v in (found.n_a, found.n_b, found.per_doc(found.cuts), found.per_doc(found.either))]
                    shown = found.groups()
                    sizes = np.bincount(doc, minlength=found.n)
                    n = found.n
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, block)), batch.column(0).slice(start, n), *map(pa.array, counts), pa.array(shown if whole else [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in shown], pa.string()), lists(at, sizes), lists(times, sizes), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))],
                        names,
                    )
                    own = [pa.array([block]), pa.nulls(1, batch.schema.types[0]), *[pa.nulls(1, pa.int64()) for _ in COUNTS], pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32()))]
                    held = np.bincount(at, minlength=len(pairs))
                    yield pa.RecordBatch.from_arrays([*own, pa.array([pairs], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.int32()))], names)
                    block, start, size = block + 1, k + 1, 0

    names = [c.split()[0] for c in schema.split(", ")]
    return docs.mapInArrow(read, schema)


def align(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups (its text if `whole`, else its sha256).

    `a` and `b` are paths that every executor has: of a byte-level BPE file and of a model of pieces. An id pair counts
    the rows that hold it linked; rows that repeat an id count each. Null and empty texts, and those that the tokens of
    one side don't spell, have zeros and ''; an empty table gives no rows; other columns aren't read.
    """
    kept = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    blocks = table(read_blocks(kept, a, b, whole), "blocks")
    held = blocks.where("pairs IS NOT NULL").select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "e")).select("of", "at", F.col("e.pairs").alias("pair"), F.col("e.docs").alias("docs"))
    # an id of a has at most as many partners as b has ids
    best = F.max("count").over(Window.partitionBy("first"))
    counts = held.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("first", F.shiftright("pair", 32))
    counts = table(counts.select("pair", "count", (F.col("count") == best).alias("best")), "counts")
    known = held.join(counts, "pair").select("of", "at", "count", "best")

    kept_columns = ["doc_id", *COUNTS, "groups"]

    def add(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        at = pairs.column("at").to_numpy()
        count[at], best[at] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
        at, times = (rows.column(c).combine_chunks() for c in ("at", "times"))
        stops = np.asarray(at.offsets).astype(np.int64) - at.offsets[0].as_py()
        at, times = np.asarray(at.flatten()), np.asarray(times.flatten()).astype(np.int64)
        sums = [np.concatenate([[0], np.cumsum(times * v[at])])[stops] for v in (best, count)]
        return pa.table([*[rows.column(c) for c in kept_columns], *[pa.array(np.diff(s)) for s in sums]], names=[*kept_columns, "n_best", "count_sum"])

    kind = kept.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups string, n_best long, count_sum long"
    rows = blocks.where("pairs IS NULL").select("block", *kept_columns, "at", "times")
    out = table(rows.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(add, schema), "aligned")
    discard(blocks, counts)
    return out


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", *COUNTS, "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLES: dict[str, str] = {}
