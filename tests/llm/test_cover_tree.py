import numpy as np
from logquarry.llm import cover_tree as ct


def brute(rows, threshold):
    good = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    top = {i: i for i, _ in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    n = {i: 0 for i, _ in rows}
    for a, (i, x) in enumerate(good):
        for b, (j, y) in enumerate(good):
            if a != b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                n[i] += 1
                p, q = find(i), find(j)
                top[max(p, q)] = min(p, q)
    return sorted(((i, n[i], None if i is None else find(i)) for i, _ in rows), key=repr)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ct, "CHUNK", 40)  # several cells, chunks and pairs of them
    monkeypatch.setattr(ct, "SMALL", 16)
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(12).tolist()) for k in range(150)]
    for c in range(4):
        base = rng.standard_normal(12)
        rows += [(1000 * c + 200 + k, (base + rng.standard_normal(12) * 0.12 * (c + 1)).tolist()) for k in range(30)]
    rows += [(5001, rows[3][1]), (5002, rows[3][1]), (5003, (np.array(rows[3][1]) * 7).tolist())]  # equal, and equal in direction
    rows += [(6000, None), (6001, []), (6002, [0.0] * 12), (6003, [1.0, None] + [0.0] * 10), (6004, [float("nan")] + [1.0] * 11), (6005, [float("inf")] + [1.0] * 11), (None, rows[0][1]), (6006, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "7 AS rep", "'x' AS chunk", "1 AS n_links")
    got = sorted((tuple(r) for r in ct.near_vectors(vectors).collect()), key=repr)
    assert got == brute(rows, 0.95)


def test_an_id_with_several_vectors(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01]), (7, [0.01, 1.0]), (8, [-1.0, 0.0]), (8, [-1.0, 0.0]), (9, [0.0, -1.0])]
    got = sorted(tuple(r) for r in ct.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5), (8, 1, 8), (8, 1, 8), (9, 0, 9)]


def test_no_vectors(spark):
    assert ct.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert [tuple(r) for r in ct.near_vectors(spark.createDataFrame([(3, None)], "vec_id long, embedding array<float>")).collect()] == [(3, 0, 3)]


def test_whole_nodes_are_counted_without_opening():
    rng = np.random.default_rng(1)
    x = rng.standard_normal(16) + rng.standard_normal((300, 16)) * 0.01
    tree = ct.CoverTree(x, np.ones(300), np.arange(300))
    found = ct.chunk_links(tree, tree, 0.95, True)
    assert (found.links == 299).all() and found.root.nunique() == 1


def test_copies_of_equal_direction_at_the_default_sizes():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 24))
    scaled = np.concatenate([x[:40] * k for k in (2, 3, 0.1, 7, 1 / 3)])
    last_bit = x[40:140].copy()
    last_bit[:, 5] = np.nextafter(last_bit[:, 5], 9)
    x = np.concatenate([x, scaled, last_bit])
    y = ct.unit(x)
    want = (y @ y.T >= 0.95).sum(axis=1) - 1
    tree = ct.CoverTree(x, np.ones(len(x)), np.arange(len(x)))
    found = ct.chunk_links(tree, tree, 0.95, True)
    assert dict(zip(found["class"], found.links, strict=True)) == {k: n for k, n in enumerate(want) if n}
    assert all(found.root[found["class"] == 400 + k].item() == found.root[found["class"] == k].item() for k in range(40))
