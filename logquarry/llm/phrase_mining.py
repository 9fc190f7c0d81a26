"""Phrase collocations by pivot partitioning.

Every n-gram belongs to its rarest word, its pivot. A first pass counts the words of each language exactly. The second
rewrites the texts: around each frequent word it keeps the neighbours that are more frequent (rarer ones end the
fragment, as no n-gram of this pivot holds them), three words at most on each side. A fragment is counted once for each
flush of a task and sent to its pivot, where the n-grams that hold the pivot are counted. No n-gram has two owners, so
counts are whole where they arise and rare n-grams go no further.

A word's rarity is its class in a table of fixed size by hash; words that share a place there share a class, which moves
n-grams to other owners but never splits one. A pivot too frequent for one task is dealt by n-gram: its fragments are
cut into their n-grams before they are sent, which are few different ones among words still more frequent.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, table

U64 = np.uint64
#: Words of the longest phrase; places of the table of classes (2 ** bits, a byte each) and its slices.
LONGEST, CLASS_BITS, SLICES = 4, 22, 64
#: A task's words are counted and sent when so many have come, or so many different ones; and how often a word may occur
#: that is counted in one group.
FLUSH_WORDS, FLUSH_DISTINCT, GROUP = 1 << 21, 1 << 20, 1 << 17
#: A-Z count as a-z; the signs that end a piece count as a line end, the tabulator as a space.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
#: First and last place, around the pivot, of the n-grams that hold it.
AROUND = [(s, e) for s in range(1 - LONGEST, 1) for e in range(LONGEST) if 2 <= e - s + 1 <= LONGEST]


class Words(dict):
    """Numbers of the words of one language; 0 is the end of a piece and 1 the gap between two spaces."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": 1})
        self.known = [b"\n", b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self.known)
        self.known.append(word)
        return k


def flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(language, words by number, numbers of the running words) of a task's texts; bounded but for single texts."""
    words: dict[str, Words] = defaultdict(Words)
    runs: dict[str, list[np.ndarray]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, text = lang.as_py(), text.as_py()
            own = words[lang]
            tokens = (text or "").encode().translate(FOLD).replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(own.__getitem__, tokens), np.int32, len(tokens))
            runs[lang] += [ids[ids != 1], np.zeros(1, np.int32)]
            sizes[lang] += len(ids)
            if sum(sizes.values()) >= FLUSH_WORDS or sum(map(len, words.values())) >= FLUSH_DISTINCT:
                for one in runs:
                    yield one, words[one].known, np.concatenate(runs[one])
                words.clear(), runs.clear(), sizes.clear()
    for one in runs:
        yield one, words[one].known, np.concatenate(runs[one])


def texts_of(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n): all occurrences of every word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, known, ids in flushes(batches):
            n = np.bincount(ids, minlength=len(known))[2:]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(known[2:], pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    return texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_print(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word)


def class_table(frequent: DataFrame, bits: int) -> Broadcast:
    """For each place of a table of 2 ** bits the highest class of its frequent words (n is at most 2 ** (class / 4)), or 0."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            place = np.array([word_print(lang, word.encode()) for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], U64) & U64((1 << bits) - 1)
            np.maximum.at(classes, place.astype(np.int64), np.ceil(4 * np.log2(batch.column(2).to_numpy().astype(float)) + 1e-9).astype(np.uint8))
        parts = classes.reshape(SLICES, -1)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["slice", "classes"])

    def join(rows: pa.Table) -> pa.Table:
        best = np.zeros((1 << bits) // SLICES, np.uint8)
        for part in rows.column("classes"):
            np.maximum(best, np.frombuffer(part.as_py(), np.uint8), out=best)
        return pa.table({"slice": rows.column("slice")[:1], "classes": pa.array([best.tobytes()])})

    schema = "slice int, classes binary"
    whole = np.zeros((SLICES, (1 << bits) // SLICES), np.uint8)
    for r in frequent.select("lang", "word", "n").mapInArrow(fill, schema).groupBy("slice").applyInArrow(join, schema).collect():
        whole[r["slice"]] = np.frombuffer(r["classes"], np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(whole.reshape(-1))


class Fragments:
    """The fragments of one flush: rows of word numbers around a pivot (-1: none), equal ones counted once."""

    def __init__(self, lang: str, known: list[bytes], ids: np.ndarray, classes: np.ndarray):
        self.lang, self.known = lang, known
        self.prints = np.array([word_print(lang, w) for w in known], U64)
        self.classes = classes[(self.prints & U64(len(classes) - 1)).astype(np.int64)].astype(np.int64)
        self.classes[:2] = 0
        # rarity: by class, then by hash; places that can't be part of a frequent n-gram are rarer than all
        self.keys = np.where(self.classes > 0, self.classes << 32 | (self.prints >> U64(32)).astype(np.int64), -1)
        edge = np.zeros(LONGEST - 1, np.int32)
        self.ids = np.concatenate([edge, ids, edge]).astype(np.int64)

    def around(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the pivots, and how far their fragments reach; of equal words in an n-gram the first is its pivot."""
        key, n, reach = self.keys[self.ids], len(self.ids) - 2 * (LONGEST - 1), LONGEST - 1
        own = key[reach : reach + n]
        left, right, on_left, on_right = np.zeros(n, np.int8), np.zeros(n, np.int8), own > 0, own > 0
        for d in range(1, LONGEST):
            on_left &= key[reach - d : reach - d + n] > own
            on_right &= key[reach + d : reach + d + n] >= own
            left += on_left
            right += on_right
        some = np.flatnonzero(left + right > 0)
        return some + reach, left[some], right[some]

    def rows(self) -> Iterator[pa.RecordBatch]:
        at, left, right = self.around()
        pivot = self.ids[at]
        parts = np.ceil(2.0 ** (self.classes / 4) / GROUP).astype(np.int64)
        hot = parts[pivot] > 1
        offsets = np.arange(1 - LONGEST, LONGEST)

        def take(chosen: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            inside = (offsets >= low[:, None]) & (offsets <= high[:, None])
            return np.where(inside, self.ids[at[chosen][:, None] + offsets], -1)

        calm = np.flatnonzero(~hot)
        if len(calm):
            grid, times = distinct(take(calm, -left[calm], right[calm]))
            yield self.packed(grid, times, (grid[:, : LONGEST - 1] >= 0).sum(axis=1).astype(str), grid[:, LONGEST - 1], np.zeros(len(grid), np.int64))
        hot = np.flatnonzero(hot)
        grids = []
        for s, e in AROUND if len(hot) else ():
            held = hot[(left[hot] >= -s) & (right[hot] >= e)]
            grids.append(take(held, np.full(len(held), s), np.full(len(held), e)))
        if grids and sum(map(len, grids)):
            grid, times = distinct(np.concatenate(grids))
            owner = grid[:, LONGEST - 1]
            # by its words in order, wherever the pivot stands
            print_, place = np.zeros(len(grid), U64), np.zeros(len(grid), np.int64)
            factors = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(LONGEST)], U64)
            for column in grid.T:
                print_ += np.where(column >= 0, self.prints[column] * factors[np.minimum(place, LONGEST - 1)], U64(0))
                place += column >= 0
            salt = ((print_ >> U64(20)) % parts[owner].astype(U64)).astype(np.int64)
            order = np.lexsort((salt, owner))
            yield self.packed(grid[order], times[order], np.full(len(grid), "-"), owner[order], salt[order])

    def packed(self, grid: np.ndarray, times: np.ndarray, left: np.ndarray, owner: np.ndarray, salt: np.ndarray) -> pa.RecordBatch:
        """A row for each run of one owner and salt: a line `times left words` for each fragment (`-` for left: an n-gram)."""
        words = pa.array(self.known, pa.binary()).cast(pa.string())
        columns = [words.take(pa.array(c, pa.int32(), mask=c < 0)) for c in grid.T]
        lines = pc.binary_join_element_wise(pc.cast(pa.array(times), pa.string()), pa.array(left.tolist(), pa.string()), *columns, " ", null_handling="skip")
        lines = pc.binary_join_element_wise(lines, "", "\n")
        starts = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (salt[1:] != salt[:-1])]))
        stops = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
        runs = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate([stops[starts], stops[-1:]]).astype(np.int32).tobytes()), lines.buffers()[2])
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(starts), pa.string()), pa.array(self.keys[owner[starts]]), pa.array(salt[starts]), runs], ["lang", "pivot", "salt", "fragments"])


def distinct(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, by pivot, and how often each is there. Numbers are below 2 ** 21, three to an integer."""
    shifted = (grid + 1).astype(U64)
    middle = LONGEST - 1
    packed = [shifted[:, k] << U64(42) | shifted[:, k + 1] << U64(21) | shifted[:, k + 2] for k in (0, middle)] + [shifted[:, 2 * middle]]
    order = np.lexsort((packed[2], packed[0], packed[1]))
    new = np.concatenate([[True], np.any([p[order[1:]] != p[order[:-1]] for p in packed], axis=0)])
    starts = np.flatnonzero(new)
    return grid[order[starts]], np.diff(np.append(starts, len(grid)))


class Pivot:
    """The n-grams of one pivot: its fragments are kept until all are there, GROUP occurrences or so.

    An n-gram occurs no oftener than the pair of the pivot and the word beside it that it holds, and all occurrences of
    that pair are here too. So fragments are cut where such a pair is too rare before their n-grams are counted.
    """

    def __init__(self):
        self.counts: dict[str, int] = defaultdict(int)
        self.fragments: list[tuple[int, int, list[str]]] = []
        self.left: dict[str, int] = defaultdict(int)
        self.right: dict[str, int] = defaultdict(int)

    def add(self, fragments: str) -> None:
        """Lines `times left words`; `-` for left: an n-gram."""
        for line in fragments.split("\n")[:-1]:
            times, left, words = line.split(" ", 2)
            times = int(times)
            if left == "-":
                self.counts[words] += times
                continue
            at, words = int(left), words.split(" ")
            if at:
                self.left[words[at - 1]] += times
            if at + 1 < len(words):
                self.right[words[at + 1]] += times
            self.fragments.append((times, at, words))

    def frequent(self, min_count: int) -> list[tuple[str, int]]:
        counts = self.counts
        for times, at, words in self.fragments:
            first, end = at, at + 1
            if at and self.left[words[at - 1]] >= min_count:
                first = 0
            if end < len(words) and self.right[words[end]] >= min_count:
                end = len(words)
            if end - first > 1:
                for s in range(max(first, at - LONGEST + 1), at + 1):
                    for e in range(max(at + 1, s + 2), min(end, s + LONGEST) + 1):
                        counts[" ".join(words[s:e])] += times
        return [(p, n) for p, n in counts.items() if n >= min_count]


def phrases(texts: DataFrame, frequent: DataFrame, min_count: int, bits: int) -> DataFrame:
    """(lang, phrase, n_words, a) of all phrases of 2 to LONGEST words that occur min_count times."""
    classes = class_table(frequent, bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flush in flushes(batches):
            yield from Fragments(*flush, classes.value).rows()

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivot = None, Pivot()

        def found() -> pa.RecordBatch:
            kept = pivot.frequent(min_count)
            return pa.RecordBatch.from_arrays([pa.array([group[0]] * len(kept), pa.string()), pa.array([p for p, _ in kept], pa.string()), pa.array([p.count(" ") + 1 for p, _ in kept], pa.int32()), pa.array([n for _, n in kept], pa.int64())], ["lang", "phrase", "n_words", "a"])

        for batch in batches:
            for lang, key, salt, fragments in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, key, salt) != group:
                    if group is not None:
                        yield found()
                    group, pivot = (lang, key, salt), Pivot()
                pivot.add(fragments)
        if group is not None:
            yield found()

    sent = texts.mapInArrow(send, "lang string, pivot long, salt long, fragments string")
    return sent.repartition("lang", "pivot", "salt").sortWithinPartitions("lang", "pivot", "salt").mapInArrow(mine, "lang string, phrase string, n_words int, a long")


#: The contiguous parts of two words and more that a phrase holds, itself left out.
INNER = "flatten(transform(sequence(2, n_words - 1), k -> transform(sequence(1, n_words - k + 1), s -> array_join(slice(words, s, k), ' '))))"


def collocations(docs: DataFrame, min_count: int = 30, top: int = 2000, lang_col: str = "lang", text_col: str = "text", bits: int = CLASS_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases.

    a, l and r count the phrase and the two parts of its weakest cut, n all words of the language; score is
    floor(2000000 * a / (l + r)). Phrases inside a longer one that has 80 % of their occurrences are left out. Null text
    has no words, null lang is `und`; equal rows count each; ties are in the order of the phrase's UTF-8 bytes; an empty
    table gives no rows; other columns aren't read. Texts are read twice.
    """
    texts = texts_of(docs, lang_col, text_col)
    words = table(word_counts(texts), "words")
    frequent = words.where(F.col("n") >= min_count)
    found = table(phrases(texts, frequent, min_count, bits), "phrases")
    known = frequent.select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionAll(found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    known = table(known, "known")
    cuts = found.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, n_words - 1)")).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    for part, f in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("part").alias(part), F.col("f").alias(f)), ["lang", part])
    wide = "CAST({} AS DECIMAL(20, 0))".format
    score = F.expr(f"CAST(({wide(2000000)} * {wide('a')}) div ({wide('l')} + {wide('r')}) AS BIGINT)")
    weakest = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = found.where("n_words > 2").select("lang", "a", "n_words", F.split("phrase", " ").alias("words")).select("lang", "a", F.explode(F.expr(INNER)).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR {wide(100)} * {wide('longer')} < {wide(80)} * {wide('a')}")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    # first within shares of a language, so that no task sorts all phrases of one
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*best))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    out = table(kept.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(words, found, known)
    return out


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
runs AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM runs, (SELECT unnest(range(1, 5)) AS k)),
counted AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c
  JOIN counted x ON x.lang = c.lang AND x.k = c.j AND x.phrase = array_to_string(c.w[1 : c.j], ' ')
  JOIN counted y ON y.lang = c.lang AND y.k = c.k - c.j AND y.phrase = array_to_string(c.w[c.j + 1 : c.k], ' ')),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, m, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
    FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates)) GROUP BY ALL),
kept AS (
  SELECT w.* FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
  WHERE i.longer IS NULL OR 100 * CAST(i.longer AS HUGEINT) < 80 * CAST(w.a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""

QUERIES = {"op13_phrase_mining": op13_phrase_mining}
ORACLES = {"op13_phrase_mining": OP13_SQL}
