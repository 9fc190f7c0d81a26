import os
import random
from datetime import datetime, timedelta

from logquarry.streaming.tail import user_sessions

SCHEMA = "user_id long, event_type string, event_record_id long, written timestamp"
START = datetime(2024, 1, 1)


def brute(rows):
    out, by_user = [], {}
    for user, kind, _, at in {r for r in rows if r[0] is not None and r[3] is not None}:
        by_user.setdefault(user, []).append((at, kind))
    for user, events in by_user.items():
        events.sort(key=lambda e: e[0])
        groups = [[events[0]]]
        for e in events[1:]:
            if e[0] - groups[-1][-1][0] <= timedelta(minutes=30):
                groups[-1].append(e)
            else:
                groups.append([e])
        for g in groups:
            out.append((user, g[0][0], g[-1][0] + timedelta(minutes=30), len(g), min((t for t, k in g if k == "login"), default=None), max((t for t, k in g if k == "logout"), default=None)))
    return sorted(out, key=repr)


def made(rng, n):
    """Rows in order of time, each up to eight minutes out of place; one user has most."""
    rows = [(rng.choice([1] * 6 + [2, 3, None]), rng.choice(["login", "logout", "view", None]), k, START + timedelta(minutes=4 * k)) for k in range(n)]
    return sorted(rows, key=lambda r: r[3] + timedelta(minutes=rng.randrange(8)))


def test_table(spark):
    rows = made(random.Random(1), 400)
    rows += [(1, "view", 9999, None), *rows[:50], (5, "login", 1, START), (5, "login", 2, START + timedelta(minutes=30))]
    got = user_sessions(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows) and [r.n for r in got if r.user_id == 5] == [2]
    assert user_sessions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_equals_table(spark, tmp_path):
    """Out of order, repeated and late input, stopped after every file and started again from its checkpoint."""
    rows = made(random.Random(2), 200)
    late = (2, "login", 7777, START)  # its time has long passed when it comes
    last = (9, "view", 8888, START + timedelta(days=30))
    files = [rows[:70], rows[60:140], [late, *rows[135:]], [last], [(9, "view", 8889, START + timedelta(days=60))]]
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    os.mkdir(source)
    for k, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = user_sessions(spark.readStream.schema(SCHEMA).parquet(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None, k
    got = sorted(map(tuple, spark.read.parquet(out).collect()), key=repr)
    assert got == brute([*rows, last])
