import random

from logquarry.operators.intervals import asof_join, interval_join


def test_asof_against_brute_force(spark):
    rng = random.Random(4)
    key = lambda: rng.choice([1] * 8 + [2, 3, None])
    left = [(k, key(), rng.choice([rng.randrange(-500, 500), None]) if k % 20 == 0 else rng.randrange(-500, 500)) for k in range(300)]
    left += [(5, 1, 7), (5, 1, 7)]
    right = [(1000 + k, key(), rng.randrange(-500, 500) if k % 15 else None) for k in range(120)]
    a = spark.createDataFrame(left, "id long, user long, t long")
    b = spark.createDataFrame(right, "rid long, user long, t long")
    want = []
    for i, u, t in left:
        best = max(((rt, rid) for rid, ru, rt in right if ru == u and u is not None and t is not None and rt is not None and rt <= t), default=(None, None))
        want.append((i, u, t, best[1]))
    for bucket in (1, 7, 100, 10**6):
        got = [(r.id, r.user, r.t, r.match and r.match.rid) for r in asof_join(a, b, "user", "t", "rid", bucket).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert asof_join(a, b.where("false"), "user", "t", "rid", 10).where("match IS NULL").count() == len(left)
    assert asof_join(a.where("false"), b, "user", "t", "rid", 10).count() == 0


def test_intervals_against_brute_force(spark):
    rng = random.Random(5)
    spans = []
    for k in range(200):
        start = rng.randrange(-3000, 3000)
        spans.append((k, rng.choice([1, 1, 1, 2, None]), start, rng.choice([start, start + 1, start + rng.randrange(5), start + rng.randrange(2000), start - 3, None])))
    points = [(k, rng.choice([1, 1, 2, 3, None]), rng.choice([rng.randrange(-3000, 5000), None]) if k % 9 == 0 else rng.randrange(-3000, 5000)) for k in range(300)]
    got = interval_join(spark.createDataFrame(spans, "sid long, user long, s long, e long"), spark.createDataFrame(points, "pid long, user long, at long"), "user", "s", "e", "at")
    want = sorted((a, p) for a, u, s, e in spans for p, v, t in points if u == v and None not in (u, s, e, t) and s <= t <= e)
    assert sorted((r.sid, r.pid) for r in got.collect()) == want
    none = spark.createDataFrame([], "sid long, user long, s long, e long")
    assert interval_join(none, spark.createDataFrame(points, "pid long, user long, at long"), "user", "s", "e", "at").count() == 0


def test_a_hot_key_is_spread(spark):
    rows = spark.range(20_000).selectExpr("id", "1L AS user", "id * 10 AS t")
    sizes = asof_join(rows, rows.selectExpr("id AS rid", "user", "t - 5 AS t"), "user", "t", "rid", 1000)
    assert sizes.where("match.rid = id").count() == 20_000
    spans = rows.selectExpr("id AS sid", "user", "t AS s", "t + 15 AS e")
    assert interval_join(spans, rows.selectExpr("id AS pid", "user", "t AS at"), "user", "s", "e", "at").count() == 39_999
