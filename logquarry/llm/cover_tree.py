"""Embedding near-dedup: exact pairs of cosine >= threshold by dual traversal of cover trees.

On unit vectors cosine is a distance, d^2 = 2 - 2 cos. Vectors fall into the cells of a bounded number of pivots; a cell
is cut into chunks of bounded size by a hash, and each chunk becomes one cover tree: nested levels whose radii halve.
Only chunk pairs whose pivots and radii allow a link meet in a task, which walks both trees at once: node pairs out of
reach are pruned by their covering radii, node pairs wholly within reach are counted without being opened, and the rest
are opened level by level, as long as opening costs less than comparing the points below. A task returns counts and one
root for each linked vector, never the pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .components import components

#: Vectors of a chunk (one tree), about; and the most pivots, which go to every task.
CHUNK, PIVOTS = 8192, 1024
#: Allowance for rounding: of a distance in double precision, and of a squared distance in single precision.
SLACK, SINGLE_SLACK = 1e-6, 1e-4
#: Vectors of cosine 1 in double precision may be so far apart: the radius of several points is never less.
ROUNDING = 1e-6
#: Node pairs of at most so many point pairs are compared point by point instead of being opened further; and what a
#: visit to a node pair costs, in point pairs.
SMALL, VISIT = 1 << 14, 1 << 13
#: Points of a side that are compared at once.
STRIP = 2048


def unit(rows) -> np.ndarray:
    x = np.asarray(rows if isinstance(rows, np.ndarray) else np.stack([np.asarray(r, np.float64) for r in rows]), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cos))


def above(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Where x reaches least; quick where that is rare."""
    hit = x >= least
    rows = np.flatnonzero(hit.any(axis=1))
    i, j = np.nonzero(hit[rows])
    return rows[i], j


def covered(x: np.ndarray, points: np.ndarray, centre: int, reach: float) -> Iterator[tuple[int, np.ndarray]]:
    """Greedy cover: (centre, points within reach of it that no centre before it has), `centre` first, the others in order."""
    points = np.concatenate([[centre], points[points != centre]])
    free = np.ones(len(points), bool)
    for start in range(0, len(points), 256):
        block = np.flatnonzero(free[start : start + 256]) + start
        near = x[points[block]] @ x[points].T >= 1 - reach * reach / 2 if reach >= 1e-6 else np.zeros((len(block), len(points)), bool)
        for row, k in enumerate(block.tolist()):
            if free[k]:
                near[row, k] = True
                own = near[row] & free
                free &= ~own
                yield int(points[k]), points[own]


class CoverTree:
    """Nodes as arrays: centre (a point), radius (covers the subtree), lo and hi (its points, in depth-first order), kids."""

    def __init__(self, raw: np.ndarray, weight: np.ndarray, ids: np.ndarray, reps: np.ndarray | None = None):
        x = unit(raw)
        self.centre, self.radius, self.lo, self.hi, self.kids, order = [], [], [], [], [], []
        waiting = [(np.arange(len(x)), 0, 2.0, -1)]
        while waiting:
            points, centre, reach, parent = waiting.pop()
            d = distance(x[points] @ x[centre])
            d[points == centre] = 0
            node, radius = len(self.centre), float(d.max())
            self.centre.append(centre)
            self.radius.append(float(np.hypot(radius, ROUNDING)) if len(points) > 1 else 0.0)
            self.lo.append(len(order))
            self.hi.append(len(order) + len(points))
            self.kids.append([])
            if parent >= 0:
                self.kids[parent].append(node)
            if len(points) == 1:
                order.append(centre)
                continue
            while reach / 2 >= radius and reach > 1e-6:
                reach /= 2
            reach /= 2
            parts = [(p, c, reach, node) for c, p in covered(x, points, centre, reach)]
            waiting += parts[::-1]
        order = np.array(order)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        short = raw.astype(np.float32)
        self.raw, self.weight, self.ids = (short if (short == raw).all() else raw)[order], weight[order], ids[order]
        self.reps = self.ids if reps is None else reps[order]
        self.centre, self.radius, self.lo, self.hi = back[self.centre], np.array(self.radius), np.array(self.lo), np.array(self.hi)
        kids = [k if k else [i] for i, k in enumerate(self.kids)]
        self.kids, self.kids_from = np.array([k for ks in kids for k in ks]), np.cumsum([0, *map(len, kids)])
        self.before = np.concatenate([[0], np.cumsum(self.weight)])
        self.fill()

    def fill(self) -> None:
        """What follows from the rest, and isn't shuffled."""
        self.x = unit(self.raw)
        self.single = self.x.astype(np.float32)
        k = max(1, self.x.shape[1] // 2)
        self.half = np.concatenate([self.x[:, :k], np.linalg.norm(self.x[:, k:], axis=1, keepdims=True)], axis=1).astype(np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("x", "single", "half")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.fill()

    def kids_of(self, node: int) -> np.ndarray:
        return self.kids[self.kids_from[node] : self.kids_from[node + 1]]

    def total(self, nodes: np.ndarray) -> np.ndarray:
        return self.before[self.hi[nodes]] - self.before[self.lo[nodes]]


def walk(a: CoverTree, b: CoverTree, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted number of links of each point of a and of b, and a root of each (points of a, then of b) under the links."""
    reach = float(distance(np.array(threshold)))
    links_a, links_b = np.zeros(len(a.ids) + 1), np.zeros(len(b.ids) + 1)
    root = np.arange(len(a.ids) + len(b.ids))
    shift = 0 if same else len(a.ids)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i: int, j: int) -> None:
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)

    def all_link(m: int, n: int) -> None:
        links_a[a.lo[m]] += b.total(n)
        links_a[a.hi[m]] -= b.total(n)
        links_b[b.lo[n]] += a.total(m)
        links_b[b.hi[n]] -= a.total(m)
        unite(np.arange(a.lo[m], a.hi[m]), np.full(a.hi[m] - a.lo[m], shift + b.lo[n]))
        unite(shift + np.arange(b.lo[n], b.hi[n]), np.full(b.hi[n] - b.lo[n], a.lo[m]))

    def unite(p: np.ndarray, q: np.ndarray) -> None:
        """Join p[i] with q[i] for all i; a round joins one pair for each component that is still apart from another."""
        while len(p):
            top = root
            while (top[top] != top).any():
                top = top[top]
            root[:] = top
            p, q = top[p], top[q]
            apart = p != q
            p, q = p[apart], q[apart]
            _, first = np.unique(p, return_index=True)
            for i in first:
                join(int(p[i]), int(q[i]))

    def decide(i: np.ndarray, j: np.ndarray) -> None:
        """Of these points of a and of b, those that link in double precision."""
        keep = np.concatenate([np.empty(0, bool), *[np.einsum("ij,ij->i", a.x[i[k : k + 65536]], b.x[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)]])
        i, j = i[keep], j[keep]
        if len(i):
            count(links_a, i, b.weight[j])
            count(links_b, j, a.weight[i])
            unite(i, j + shift)

    def count(links: np.ndarray, at: np.ndarray, gain: np.ndarray) -> None:
        sums = np.bincount(at, gain, len(links))
        links += sums
        links[1:] -= sums[:-1]

    def leaves(m: int, n: int) -> None:
        """All points below two nodes: half of the dimensions bound the cosine from above (Cauchy-Schwarz), in single
        precision; double precision decides."""
        for p in range(a.lo[m], a.hi[m], STRIP):
            for q in range(b.lo[n], b.hi[n], STRIP):
                pe, qe = min(p + STRIP, a.hi[m]), min(q + STRIP, b.hi[n])
                i, j = above(a.half[p:pe] @ b.half[q:qe].T, threshold - SINGLE_SLACK)
                if len(i) > 0.02 * (pe - p) * (qe - q):  # the first dimensions don't tell much here
                    i, j = above(a.single[p:pe] @ b.single[q:qe].T, threshold - SINGLE_SLACK)
                decide(i + p, j + q)

    waiting = [(0, 0)]
    while waiting:
        m, n = waiting.pop()
        points = int(a.hi[m] - a.lo[m]) * int(b.hi[n] - b.lo[n])
        kids_a, kids_b = a.kids_of(m), b.kids_of(n)
        if points <= SMALL or 2 * len(kids_a) * len(kids_b) > points:
            leaves(m, n)
            continue
        # kid pairs: out of reach, wholly within reach, or to be opened; unless the latter cost as much as all points
        size_a, size_b = a.hi[kids_a] - a.lo[kids_a], b.hi[kids_b] - b.lo[kids_b]
        whole, near, cost = [], [], 0.0
        for start in range(0, len(kids_a), STRIP):
            part = slice(start, start + STRIP)
            squared = np.maximum(0, 2 - 2 * (a.single[a.centre[kids_a[part]]] @ b.single[b.centre[kids_b]].T))
            both = (a.radius[kids_a[part]][:, None] + b.radius[kids_b][None, :]).astype(np.float32)
            inside = (both < reach) & (squared <= (reach - both) ** 2 - SINGLE_SLACK)
            i, j = np.nonzero(~inside & (squared <= (reach + both) ** 2 + SINGLE_SLACK))
            near.append((i + start, j))
            whole.append(tuple(x + y for x, y in zip(np.nonzero(inside), (start, 0), strict=True)))
            pairs = size_a[i + start].astype(float) * size_b[j]
            cost += (pairs + VISIT * (pairs > 1)).sum() + VISIT * len(whole[-1][0])
            if cost > points:
                break
        if cost > points:
            leaves(m, n)
            continue
        for i, j in whole:
            for ka, kb in zip(kids_a[i].tolist(), kids_b[j].tolist(), strict=True):
                all_link(ka, kb)
        i, j = (np.concatenate(x) for x in zip(*near, strict=True))
        single = (size_a[i] == 1) & (size_b[j] == 1)
        decide(a.centre[kids_a[i[single]]], b.centre[kids_b[j[single]]])
        waiting += zip(kids_a[i[~single]].tolist(), kids_b[j[~single]].tolist(), strict=True)
    roots = np.array([find(i) for i in range(len(root))])
    return np.rint(np.cumsum(links_a[:-1])), np.rint(np.cumsum(links_b[:-1])), roots


def chunk_links(a: CoverTree, b: CoverTree, threshold: float, same: bool) -> pd.DataFrame:
    """class, links (of other vectors, by weight), rep, and the rep of a class of the same component."""
    links_a, links_b, roots = walk(a, b, threshold, same)
    ids, reps = (np.concatenate([x, x[:0] if same else y]) for x, y in ((a.ids, b.ids), (a.reps, b.reps)))
    links = links_a - a.weight if same else np.concatenate([links_a, links_b])  # a vector's own class is counted elsewhere
    found = pd.DataFrame({"class": ids, "links": links.astype(np.int64), "rep": reps, "root": reps[roots[: len(ids)]]})
    return found[found.links > 0]


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row of vectors: vec, n_links (other rows linked directly), component (smallest id reachable).

    Null or zero vectors, and such with a null or non-finite component or of another length than they meet, link with
    nothing; so do rows without id, whose component is null. Equal rows link with each other. Rows that repeat an id with
    different vectors are counted each for itself and share one component, that of all they link with. Other columns
    aren't read. Empty tables give none. Lengths should be few: each takes jobs of its own.
    """
    double = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec"), double.alias("x"))
    good = F.col("vec").isNotNull() & F.coalesce(F.size("x") > 0, F.lit(False)) & F.expr("forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity'))") & F.expr("exists(x, v -> v <> 0)")
    hashed = rows.select("vec", F.when(good, F.col("x")).alias("x"))
    keyed = table(hashed.select("vec", "x", *[F.when(F.col("x").isNotNull(), F.xxhash64(F.lit(k), "x")).alias(f"k{k}") for k in (1, 2)]), "vectors")
    equal = keyed.where("x IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec").alias("rep"), F.count("*").alias("weight"), F.first("x").alias("x"))
    classes = table(equal.withColumn("class", F.monotonically_increasing_id()), "classes")

    n = classes.count()
    wanted = min(PIVOTS, max(1, -(-n // CHUNK)))
    found = None
    for (size,) in classes.select(F.size("x").alias("s")).distinct().collect():  # vectors of different lengths aren't comparable
        part = classes.where(F.size("x") == size).select("class", "rep", "weight", "x")
        pivots = unit([r.x for r in part.select("x", "class").orderBy(F.xxhash64("class"), "class").limit(wanted).collect()])
        links = links_of(part, pivots, threshold)
        found = links if found is None else found.union(links)
    if found is None:
        return keyed.select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component"))
    found = table(found, "links")
    # an id of several classes joins them
    twice = keyed.where("x IS NOT NULL").select("vec", "k1", "k2").distinct().join(classes.select("k1", "k2", "rep"), ["k1", "k2"])
    twice = twice.groupBy("vec").agg(F.count("*").alias("k"), F.collect_set("rep").alias("reps")).where("k > 1").select(F.col("vec").alias("a"), F.explode("reps").alias("b"))
    known = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(twice).where("a <> b"))
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    by_class = classes.join(counts, "class", "left").join(known, F.col("rep") == F.col("id"), "left")
    by_class = by_class.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    return keyed.join(by_class, ["k1", "k2"], "left").select("vec", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec").alias("component"))


def links_of(part: DataFrame, pivots: np.ndarray, threshold: float) -> DataFrame:
    """(class, links, rep, root) of the classes that link, once for each chunk pair that finds any."""
    spark = part.sparkSession
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                d = distance(unit(list(rows.x)) @ shared.value.T)
                cell = d.argmin(axis=1)
                yield rows.assign(cell=cell.astype(np.int32), away=d[np.arange(len(rows)), cell])

    placed = table(part.mapInPandas(place, "class long, rep long, weight long, x array<double>, cell int, away double"), "cells")
    cells = {r.cell: (r.n, r.radius) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    reach = float(distance(np.array(threshold)))
    apart = distance(pivots @ pivots.T)
    near = [(i, j) for i in cells for j in cells if i <= j and (i == j or apart[i, j] <= cells[i][1] + cells[j][1] + reach + SLACK)]
    cuts = spark.createDataFrame([(i, -(-n // CHUNK)) for i, (n, _) in cells.items()], "cell int, cuts long")
    chunked = placed.join(F.broadcast(cuts), "cell").withColumn("chunk", F.expr("cell * 4294967296L + pmod(xxhash64(class), cuts)"))

    def plant(rows: pd.DataFrame) -> pd.DataFrame:
        tree = CoverTree(np.stack(list(rows.x)), rows.weight.to_numpy(np.float64), rows["class"].to_numpy(np.int64), rows.rep.to_numpy(np.int64))
        return pd.DataFrame({"chunk": [rows.chunk[0]], "cell": [rows.cell[0]], "tree": [pickle.dumps(tree)]})

    trees = table(chunked.groupBy("chunk").applyInPandas(plant, "chunk long, cell int, tree binary"), "trees")
    cell_pairs = spark.createDataFrame(near, "cell int, other int")  # at most PIVOTS ** 2 / 2 rows
    names = trees.select("chunk", "cell")
    pairs = names.join(cell_pairs, "cell").join(names.select(F.col("chunk").alias("b"), F.col("cell").alias("other")), "other").where("cell <> other OR chunk <= b").select(F.col("chunk").alias("a"), "b")
    met = pairs.join(trees.select(F.col("chunk").alias("a"), F.col("tree").alias("tree_a")), "a").join(trees.select(F.col("chunk").alias("b"), F.col("tree").alias("tree_b")), "b")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for a, b, x, y in zip(rows.a, rows.b, rows.tree_a, rows.tree_b, strict=True):
                tree = pickle.loads(x)
                yield chunk_links(tree, tree if a == b else pickle.loads(y), threshold, a == b)

    n = max(1, -(-len(near) // 8))
    spread = met.repartition(max(n, 8), "a", "b") if len(near) > 8 else met.repartition(8, "a", "b")
    return spread.mapInPandas(meet, "class long, links long, rep long, root long")


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("vec").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("vec") == F.col("component")).alias("kept"))


QUERIES = {"op9_cover_tree": op9_cover_tree}
ORACLES: dict[str, str] = {}
