import hashlib
import re

import pytest
from fixtures import documents
from logquarry.llm import exact_dedup
from logquarry.llm.exact_dedup import exact_duplicates
from pyspark.sql import functions as F

SEPARATORS = re.compile(r"[\x20\x09-\x0D]")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SEPARATORS.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: m[:3])
        kept = False
        for m in members:
            stays, kept = m == best and not kept, kept or m == best
            out.append((m[3], best[3], len(members), stays, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [
    (1, "a b c"), (2, "abc"), (3, "a  b  c"), (4, "a\tb\nc"), (5, "ab c"), (6, ""), (7, None), (8, " \x0b\x0c\r\n"), (9, "ABC"), (10, "a"), (11, "é \U0001f600" * 9), (12, "é\U0001f600" * 9), (13, "é\U0001f600" * 8),
    (None, "abc"), (None, "a  b  c"), (None, "only here"), (20, "abc"), (20, "abc"), (20, "other"), (30, "z" * 64), (31, "z" * 63), (32, "z" * 65), (33, "z" * 128), (34, ("z" * 40 + " ") * 5), (35, "z" * 200), (36, "z" * 31 + "y" + "z" * 168),
]


def got(docs, **options):
    found = exact_duplicates(docs, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    return sorted(map(tuple, found), key=repr)


@pytest.mark.parametrize("block", [8, 1024])
def test_against_brute_force(spark, block):
    rows = [*ROWS, *[(100 + k, f"copy of {k % 7}  " * 40) for k in range(60)]]
    assert got(documents(spark, rows), block=block) == brute(rows)


def test_long_texts_differ_by_one_byte(spark):
    long = "lorem ipsum " * 40_000
    rows = [(1, long), (2, long + " "), (3, long[:-2] + "n"), (4, "n" + long), (5, long[: len(long) // 2])]
    assert got(documents(spark, rows)) == brute(rows)


def test_hash_collisions_start_afresh(spark, monkeypatch):
    sound, seeds = exact_dedup.prints, []

    def weak(seed, block):
        seeds.append(seed)
        few = F.struct(F.pmod(F.xxhash64(block), F.lit(3)).alias("h1"), F.lit(0).cast("long").alias("h2"))
        return few if seed < 2 else sound(seed, block)

    monkeypatch.setattr(exact_dedup, "prints", weak)
    assert got(documents(spark, ROWS), block=4) == brute(ROWS)
    assert set(seeds) == {0, 1, 2}
    monkeypatch.setattr(exact_dedup, "SEEDS", 2)
    with pytest.raises(RuntimeError):
        exact_duplicates(documents(spark, ROWS), block=4)


def test_empty_table(spark):
    assert got(documents(spark, [])) == []


def test_no_python_in_the_plan(spark):
    texts = exact_dedup.cut(documents(spark, ROWS), "doc_id", "text", 4)
    blocks = texts.select(F.explode("blocks").alias("block")).groupBy(exact_dedup.prints(0, F.col("block")).alias("h")).agg(F.collect_set("block"))
    shown = blocks._jdf.queryExecution().toString()
    assert "Python" not in shown and "Pandas" not in shown and "Arrow" not in shown
