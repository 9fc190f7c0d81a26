"""Exact Jaccard join of the documents' sets of word shingles, by set-relation skipping.

Index skipping: every set's rarest shingles (its prefix) go into an index whose lists are sorted by set size and hold
positions; pairs are skipped by block of size and by what their positions leave possible. Rarity is a count of every
shingle of every document, gathered in a sketch of fixed size; frequent shingles come last, and their lists are salted.
Equal sets form a class and are linked to its smallest id; each list links its sets to one pivot. A list whose sets are
in one component by then is skipped whole; a short one that isn't has its pairs compared.

Answer skipping: in a long list that is still open, the pivot's answer (its overlap with every member) is computed, and
each member's answer is derived from it. Two members share at most what the one of smaller overlap shares with the
pivot, and what both have outside of the pivot. So members meet again only where the pivot's answer alone could link
them (intervals of sizes), or under a shingle that both have outside of the pivot, by prefix again. Short lists of that kind
have their pairs compared. The members of a pivot's long ones are compared in blocks of bounded size, whose task returns
a spanning forest of the links; no pairs are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordPrints, discard, documents, mix, shingles, table, thinned
from .components import components

#: Counters of the sketch (2 ** bits), in slices that are summed apart; and the list length at which salting begins.
SKETCH_BITS, SLICES, LIST = 22, 64, 256
#: Sizes are blocked by powers of this; linked sets are at most one block apart as it exceeds 1 / 0.8.
BLOCK = 1.26
#: An open list of at most so many sets has its pairs counted; a longer one is handled by a pivot's answer.
SHORT = 512
#: Shingles and sets in a block, about; and the columns and rows of the stripes in which two blocks are multiplied.
FILL, SETS, STRIPE, ROWS = 200_000, 2048, 4096, 512
INT = np.int64


def shingle_set(prints: WordPrints, text: str | None, width: int) -> np.ndarray:
    return np.unique(shingles(prints.of(text), width))


def scan(docs: DataFrame, width: int) -> DataFrame:
    """Rows of kind 0: doc, n and two fingerprints of each row's set; of kind 1: a task's counts of shingles (a byte each), by slice."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, counts = WordPrints(), np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["kind", "doc", "n", "f1", "f2", "counts"]
        for batch in batches:
            found = []
            for text in batch.column(1):
                s = shingle_set(prints, text.as_py(), width)
                at = (s >> np.uint64(64 - SKETCH_BITS)).astype(INT)
                np.add.at(counts, at, 1)
                found.append((len(s), int(s.sum(dtype=np.uint64).view(INT)), int(np.bitwise_xor.reduce(s, initial=0).view(INT))))
            k = len(found)
            n, f1, f2 = (pa.array(np.array([x[i] for x in found], INT)) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), batch.column(0).cast(pa.int64()), n, f1, f2, pa.nulls(k, pa.binary())], names)
        if counts.any():
            parts = [p.astype(np.uint8).tobytes() for p in np.minimum(counts, 255).reshape(SLICES, -1)]
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(SLICES, np.int32)), none, pa.array(np.arange(SLICES)), none, none, pa.array(parts, pa.binary())], names)

    return docs.mapInArrow(read, "kind int, doc long, n long, f1 long, f2 long, counts binary")


def salt_levels(scanned: DataFrame) -> np.ndarray:
    """A byte for each counter: 0, or the salt's number of bits where the count exceeds what even spreading explains.

    The result has 2 ** SKETCH_BITS bytes whatever the corpus, so it may go through the driver and be broadcast.
    """
    usual = (scanned.where("kind = 0").agg(F.sum("n")).first()[0] or 0) / (1 << SKETCH_BITS)
    most = int(usual + 8 * np.sqrt(usual))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(part.as_py(), np.uint8).astype(INT)
                sums[k] = sums[k] + part if k in sums else part
        for k, total in sums.items():
            over = np.maximum(0, total - most) // LIST
            level = np.where(over > 0, np.ceil(np.log2(over + 1)), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([level.tobytes()], pa.binary())], ["n", "levels"])

    levels = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint8)
    for row in scanned.where("kind = 1").select("n", "counts").repartition(16, "n").mapInArrow(add, "n long, levels binary").collect():
        levels[row.n] = np.frombuffer(row.levels, np.uint8)
    return levels.ravel()


def rest(n, percent: int):
    """How many of a set's shingles stand after its prefix."""
    return (percent * n + 99) // 100 - 1


def prefix(s: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The set's first shingles in the common order (rare first), so many that linked sets share one; and their levels."""
    level = levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(INT)]
    keep = len(s) - rest(len(s), percent)
    order = np.argsort(level, kind="stable")[:keep] if level.any() else np.arange(keep)
    return s[order], level[order]


def postings(docs: DataFrame, levels: np.ndarray, width: int, percent: int) -> DataFrame:
    """Rows (h, salt, doc, n, pos), salt -1 where the list isn't salted; of equal sets in a batch only the first."""
    shared = docs.sparkSession.sparkContext.broadcast(levels.tobytes())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, known = WordPrints(), np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            seen, parts = set(), []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(prints, text.as_py(), width)
                key = (len(s), int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(s, initial=0)))
                if doc is None or not len(s) or key in seen:
                    continue
                seen.add(key)
                h, level = prefix(s, known, percent)
                own = int(mix(np.array([doc], INT).view(np.uint64))[0] >> np.uint64(32))
                salt = np.where(level > 0, own % (1 << level.astype(INT)), -1).astype(np.int32)
                parts.append((h, salt, np.full(len(h), doc, INT), np.full(len(h), len(s), np.int32), np.arange(len(h), dtype=np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts]).view(INT) if i == 0 else np.concatenate([p[i] for p in parts])) for i in range(5)], ["h", "salt", "doc", "n", "pos"])

    return docs.mapInArrow(read, "h long, salt int, doc long, n int, pos int")


def possible(na, nb, pa_, pb, percent: int):
    """Can sets of sizes na <= nb, whose first common shingle stands at pa_ and pb, link? For numpy and for columns."""
    rest_a, rest_b = na - pa_, nb - pb
    both = (100 + percent) * np.minimum(rest_a, rest_b)
    return (100 * na >= percent * nb) & (both >= percent * (na + nb))


def lists(found: DataFrame, percent: int) -> DataFrame:
    """Streams the sorted lists. Kind 0: pairs (a, b) of a pivot and a member, and in how many of the task's lists (pos); 1: members (h, a = doc, n, pos) of lists
    of two or more or of salted ones; 2: heads (h, a, n, pos) of salted lists, which are linked across salts."""

    names = ["kind", "h", "a", "b", "n", "pos"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pairs = None, []
        for batch in batches:
            x = [c.to_numpy() for c in batch.columns]
            if held is not None:
                x = [np.concatenate([a, b]) for a, b in zip(held, x, strict=True)]
            new = np.flatnonzero((np.diff(x[0]) != 0) | (np.diff(x[1]) != 0)) + 1
            if not len(new) and len(x[0]) < 2_000_000:
                held = x
                continue
            cut = new[-1] if len(new) else len(x[0])  # a list longer than that goes on with a new pivot
            held = [a[cut:] for a in x]
            yield from whole([a[:cut] for a in x], pairs)
            if sum(len(p[0]) for p in pairs) > 1_000_000:
                yield counted(pairs)
                pairs = []
        if held is not None and len(held[0]):
            yield from whole(held, pairs)
        if pairs:
            yield counted(pairs)

    def counted(pairs: list[tuple]) -> pa.RecordBatch:
        """Each pair once, with the number of lists in `pos`."""
        a, b, n = (np.concatenate(c) for c in zip(*pairs, strict=True))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0)])[: len(a)])
        times = np.diff(np.append(at, len(a))).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int32)), pa.array(np.zeros(len(at), INT)), pa.array(a[at]), pa.array(b[at]), pa.array(n[at]), pa.array(times)], names)

    def whole(x: list[np.ndarray], pairs: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, salt, doc, n, pos = x
        starts = np.concatenate([[0], np.flatnonzero((np.diff(h) != 0) | (np.diff(salt) != 0)) + 1])
        size = np.diff(np.append(starts, len(h)))
        at = np.repeat(np.arange(len(starts)), size)
        # the pivot is the set that stands in the most and longest lists here: what copies have in common, it has
        _, who = np.unique(doc, return_inverse=True)
        weight = np.bincount(who, np.where(size[at] > 1, size[at], 0))[who]
        order = np.lexsort((doc, -weight, at))
        top = order[starts]
        first = top[at]
        low, high = np.where(n <= n[first], np.arange(len(h)), first), np.where(n <= n[first], first, np.arange(len(h)))
        pair = (np.arange(len(h)) != first) & (doc != doc[first]) & possible(n[low].astype(INT), n[high].astype(INT), pos[low], pos[high], percent)
        a, b = doc[first][pair], doc[pair]
        pairs.append((np.minimum(a, b), np.maximum(a, b), n[low][pair]))
        m, k = (size[at] > 1) | (salt >= 0), top[salt[starts] >= 0]
        for kind, part in ((1, m), (2, k)):
            if len(doc[part]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc[part]), kind, np.int32)), *(pa.array(c[part]) for c in (h, doc, doc, n, pos))], names)

    sorted_lists = found.repartition("h", "salt").sortWithinPartitions("h", "salt", "n", "doc")
    return sorted_lists.mapInArrow(read, "kind int, h long, a long, b long, n int, pos int")


def meetings(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different components that meet in short lists: (a, b, na, nb, k, pa, pb), a the smaller set.

    k counts the lists, pa and pb are the last positions. members: (home, h, doc, n, pos, component); home is the smallest
    member of the list, so that lists of the same sets lie together and their pairs are summed before they are shuffled.
    """
    names = ["a", "b", "na", "nb", "k", "pa", "pb"]

    def pairs_of(x: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        h, doc, n, pos, component = x
        starts = np.concatenate([[0], np.flatnonzero(np.diff(h) != 0) + 1])
        sizes = np.diff(np.append(starts, len(h)))
        for m in np.unique(sizes[sizes > 1]).tolist():
            first, second = np.triu_indices(m, 1)
            own = starts[sizes == m]
            step = max(1, 1_000_000 // len(first))
            for k in range(0, len(own), step):
                i, j = ((own[k : k + step, None] + side).ravel() for side in (first, second))
                apart = (component[i] != component[j]) & (doc[i] != doc[j])
                i, j = i[apart], j[apart]
                i, j = (np.where((n[i] < n[j]) | (n[i] == n[j]) & (doc[i] < doc[j]), *p) for p in ((i, j), (j, i)))
                near = 100 * n[i].astype(INT) >= percent * n[j].astype(INT)
                i, j = i[near], j[near]
                yield doc[i], doc[j], n[i], n[j], pos[i], pos[j]

    def summed(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b, na, nb, pos_a, pos_b = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        at = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0)])[: len(a)])
        last = [np.maximum.reduceat(p[order], at) if len(at) else p for p in (pos_a, pos_b)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (a[at], b[at], na[order][at].astype(INT), nb[order][at].astype(INT), np.diff(np.append(at, len(a))), *(p.astype(INT) for p in last))], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, count = None, [], 0
        for batch in batches:
            x = [c.to_numpy() for c in batch.columns]
            held = x if held is None else [np.concatenate(p) for p in zip(held, x, strict=True)]
            new = np.flatnonzero(np.diff(held[0]) != 0) + 1
            if not len(new):
                continue
            for part in pairs_of([c[: new[-1]] for c in held[1:]]):
                found.append(part)
                count += len(part[0])
                if count > 2_000_000:
                    yield summed(found)
                    found, count = [], 0
            held = [c[new[-1] :] for c in held]
        if held is not None and len(held[0]):
            for part in pairs_of(held[1:]):
                found.append(part)
        if found:
            yield summed(found)

    placed = members.select("home", "h", "doc", "n", "pos", "component").repartition("home").sortWithinPartitions("home", "h")
    parts = placed.mapInArrow(read, "a long, b long, na long, nb long, k long, pa long, pb long")
    return parts.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("k").alias("k"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc, shingles) of the wanted ids: the sorted set, packed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = WordPrints()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([shingle_set(prints, t.as_py(), width).tobytes() for t in batch.column(1)], pa.binary())], ["doc", "shingles"])

    wanted = thinned(docs, ids, "doc").join(ids.withColumnRenamed("id", "doc").hint("shuffle_hash"), "doc", "left_semi")
    return wanted.select("doc", "text").mapInArrow(read, "doc long, shingles binary")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link: 100 * intersection >= percent * union."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), "a")
    two = one.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(read, "a long, b long")


def derive(family: DataFrame, levels: np.ndarray, percent: int) -> DataFrame:
    """Members' answers from their pivot's. family: (fam, doc, x, y) with the sets of the pivot, which names it, and of doc.

    Kind 0: links (fam, doc). Kind 1: where members meet again: (fam, key, doc, n, o, linked), o being the overlap with the
    pivot and linked whether that links them.
    """
    shared = family.sparkSession.sparkContext.broadcast(levels.tobytes())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            parts = []
            for fam, doc, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                outside = y[~np.isin(y, x, assume_unique=True)]
                n, o = len(y), len(y) - len(outside)
                linked = o > 0 and 100 * o >= percent * (len(x) + n - o)
                keys = prefix_of(outside, n - (-(-percent * n // 100)) + 1, known).view(INT)
                # by size: the sizes of sets that it may link to for all that the pivot tells
                most = (100 + percent) * o // percent - n
                if 100 * most >= percent * n:
                    low, high = (int(np.floor(np.log(v) / np.log(BLOCK))) for v in (n, max(n, most)))
                    keys = np.concatenate([keys, np.arange(low, high + 1, dtype=INT)])
                if linked:
                    parts.append((0, fam, 0, doc, n, o, True))
                parts += [(1, fam, k, doc, n, o, linked) for k in keys.tolist()]
            columns = list(zip(*parts, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["kind", "fam", "key", "doc", "n", "o", "linked"]
    return family.select("fam", "doc", "x", "y").mapInArrow(read, "kind int, fam long, key long, doc long, n long, o long, linked boolean")


def prefix_of(s: np.ndarray, keep: int, levels: np.ndarray) -> np.ndarray:
    """The first `keep` of the shingles in the common order."""
    level = levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(INT)]
    return s[np.argsort(level, kind="stable")[:keep]] if level.any() else s[:keep]


def block_links(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets of two blocks; y's numbers follow x's. The same block twice: y = []."""
    sets = x + y
    n = np.array([len(s) for s in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    row, column = row[times[column] > 1], column[times[column] > 1]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    right = slice(len(x), None) if y else slice(0, len(x))
    cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + STRIPE, STRIPE))
    label, out = np.arange(len(sets)), []
    for top in range(0, len(x), ROWS):
        rows = slice(top, min(len(x), top + ROWS))
        both = np.zeros((rows.stop - top, len(n[right])), np.float32)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            stripe = np.zeros((len(sets), STRIPE), np.float32)
            stripe[row[a:b], column[a:b] - k * STRIPE] = 1
            both += stripe[rows] @ stripe[right].T
        link = (both > 0) & ((100 + percent) * both.astype(INT) >= percent * (n[rows, None] + n[right][None, :]))
        for i in range(top, rows.stop):
            j = np.flatnonzero(link[i - top]) + (len(x) if y else 0)
            apart, first = np.unique(label[j], return_index=True)
            for lab, k in zip(apart.tolist(), first.tolist(), strict=True):
                if lab != label[i]:
                    out.append((i, int(j[k])))
                    label[label == lab] = label[i]
    return out


def in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what links among the members (fam, doc, n) of each fam."""
    enough = F.greatest(F.ceil(F.sum("n") / FILL), F.ceil(F.count("*") / SETS)).cast("int")
    cuts = members.groupBy("fam").agg(enough.alias("cuts"))
    placed = members.join(cuts, "fam").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("cuts")).cast("int")).join(sets.select("doc", "shingles"), "doc")
    blocks = table(placed.groupBy("fam", "block").agg(F.collect_list(F.struct("doc", "shingles")).alias("sets")), "blocks")
    other = blocks.select("fam", F.col("block").alias("other"), F.col("sets").alias("others"))
    met = blocks.join(other, "fam").where("block <= other")

    def read(pair: pa.Table) -> pa.Table:
        same = pair.column("block")[0].as_py() == pair.column("other")[0].as_py()
        sides = [pair.column(c)[0].values for c in (["sets"] if same else ["sets", "others"])]
        ids, packed = ([v.field(f).to_pylist() for v in sides] for f in (0, 1))
        parts = [[np.frombuffer(s, np.uint64) for s in p] for p in packed]
        names = [i for part in ids for i in part]
        found = block_links(parts[0], [] if same else parts[1], percent)
        return pa.table({c: pa.array([names[f[k]] for f in found], pa.int64()) for k, c in enumerate("ab")})

    # a pair of blocks is a group, so that a task holds one at a time
    return met.groupBy("fam", "block", "other").applyInArrow(read, "a long, b long")


def answers(long_lists: DataFrame, sets: DataFrame, levels: np.ndarray, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links, and pairs left to compare, of the long lists (key, doc, n, rep, degree); both as tables (a, b).

    A list's pivot is the best-connected of its components' representatives (in the list or not); it answers for all
    members. Lists of one pivot make one family, so a group of near copies is answered for once.
    """
    tops = long_lists.groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("last"))).alias("top"))
    family = long_lists.join(tops, "key").select((-F.col("top.last")).alias("fam"), "doc").where("doc <> fam").distinct()
    packed = sets.select("doc", "shingles")
    owned = family.join(packed.withColumnRenamed("shingles", "y"), "doc")
    derived = table(derive(owned.join(packed.select(F.col("doc").alias("fam"), F.col("shingles").alias("x")), "fam"), levels, percent), "derived")
    links = derived.where("kind = 0").select(F.col("fam").alias("a"), F.col("doc").alias("b"))
    met = derived.where("kind = 1").drop("kind")
    sizes = met.groupBy("fam", "key").agg(F.count("*").alias("k"), F.bool_and("linked").alias("done")).where("k > 1 AND NOT done").drop("done")
    again = table(met.join(sizes, ["fam", "key"]), "met-again")
    few = again.where(f"k <= {SHORT}")
    left, right = (few.select("fam", "key", F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("o").alias(f"o{x}"), F.col("linked").alias(f"l{x}")) for x in "ab")
    could = f"a < b AND NOT (la AND lb) AND 100L * least(na, nb) >= {percent} * greatest(na, nb) AND {100 + percent}L * (least(oa, ob) + least(na - oa, nb - ob)) >= {percent}L * (na + nb)"
    pairs = table(left.join(right, ["fam", "key"]).where(could).select("a", "b").distinct(), "pairs-again")
    many = table(again.where(f"k > {SHORT}").select("fam", "doc", "n").distinct(), "members-again")
    links = table(links if many.isEmpty() else links.union(in_blocks(many, sets, percent)), "pivot-links")
    discard(derived, again, many)
    return links, pairs


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc, n (size of its set), component (smallest id reachable by links, itself included).

    Null and empty texts have empty sets and link with nothing; rows without id link with nothing and have no component;
    rows that repeat an id are one document, whose links are those of all its texts. Texts of any length are read whole,
    in stretches. Ids are integers. Any other column is left aside, and an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    scanned = table(scan(docs, width), "sets")
    rows = scanned.where("kind = 0")
    levels = salt_levels(scanned)

    full = rows.where("n > 0 AND doc IS NOT NULL")
    classes = full.groupBy("n", "f1", "f2").agg(F.min("doc").alias("a"), F.count("*").alias("k")).where("k > 1")
    equal = full.join(classes, ["n", "f1", "f2"]).where("doc <> a").select("a", F.col("doc").alias("b"))

    listed = table(lists(postings(docs, levels, width, percent), percent), "lists")
    members = listed.where("kind = 1").select("h", F.col("a").alias("doc"), "n", "pos")
    heads = listed.where("kind = 2")
    tops = heads.groupBy("h").agg(F.min(F.struct("n", "a")).alias("top"))
    across = heads.join(tops, "h").where(f"a <> top.a AND 100L * least(n, top.n) >= {percent} * greatest(n, top.n)").select(F.least("a", "top.a").alias("a"), F.greatest("a", "top.a").alias("b"), F.least("n", "top.n").alias("n"))
    # a pivot's pairs are worth a comparison where it shares much of a prefix; what that leaves out stays open below
    tried = listed.where("kind = 0").select("a", "b", "n", F.col("pos").alias("times")).union(across.withColumn("times", F.lit(1)))
    tried = tried.groupBy("a", "b").agg(F.sum("times").alias("shared"), F.min("n").alias("n"))
    pairs = table(tried.where(f"shared * 250 >= {100 - percent} * n").select("a", "b"), "pairs")
    ids = table(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = table(sets_of(docs, ids, width), "candidates")
    links = table(verify(pairs, sets, percent).union(equal), "links")
    discard(ids, sets)
    known = components(links)

    # what the pivots' links leave open: lists of several components
    labelled = members.join(known, members.doc == known.id, "left").select("h", "doc", "n", "pos", F.coalesce("component", "doc").alias("component"))
    named = table(labelled, "members")
    discard(listed)
    mixed = named.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("k"), F.min("doc").alias("home")).where("low < high").select("h", "k", "home")
    open_lists = table(named.join(mixed, "h"), "open-lists")
    discard(named)
    # all that two prefixes share is in their lists: beyond it the sets can share what stands after the last of it, and
    # what stands after the prefix that ends first. A pair that also meets in a long list is found there.
    shared = meetings(open_lists.where(f"k <= {SHORT}"), percent)
    after = f"least(na - pa - 1, nb - pb - 1, ({percent}L * nb + 99) div 100 - 1)"  # nb is the larger set, and has more after its prefix
    could = shared.where(f"{100 + percent}L * (k + {after}) >= {percent}L * (na + nb)")
    short_pairs = table(could.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "open-pairs")

    degree = links.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("degree"))
    reps = degree.join(known, F.col("doc") == F.col("id")).groupBy("component").agg(F.max(F.struct("degree", (-F.col("doc")).alias("last"))).alias("top"))
    long_lists = open_lists.where(f"k > {SHORT}").join(reps, "component", "left")
    long_lists = table(long_lists.select(F.col("h").alias("key"), "doc", "n", F.coalesce(-F.col("top.last"), "doc").alias("rep"), F.coalesce("top.degree", F.lit(0)).alias("degree")), "long-lists")
    discard(open_lists)
    ids = table(short_pairs.select(F.explode(F.array("a", "b")).alias("id")).union(long_lists.select(F.explode(F.array("doc", "rep")))).distinct(), "ids")
    if not ids.isEmpty():
        sets = table(sets_of(docs, ids, width), "candidates")
        found, again = answers(long_lists, sets, levels, percent)
        more = table(short_pairs.union(again).distinct().join(pairs, ["a", "b"], "left_anti"), "late-pairs")
        every = table(verify(more, sets, percent).union(found).union(links), "all-links")
        discard(sets, more, found, again, known)
        known = components(every)
        discard(every)
    discard(ids, long_lists, short_pairs, pairs, links)
    return rows.join(known, rows.doc == known.id, "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLES: dict[str, str] = {}
