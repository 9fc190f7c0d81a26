import hashlib

from fixtures import documents
from logquarry.llm.line_dedup import dedup_lines
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least):
    seen = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            seen.setdefault(line.strip(SPACES).translate(FOLD), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key := x.strip(SPACES).translate(FOLD)) or len(seen[key]) < least]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rows = [(i, f"own {i}\n  Common LINE\t\nrare {i % 4}\n\nÄ É\nä é") for i in range(12)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, "common line"), (None, "common line\nx"), (3, rows[3][1]), (3, "another\ncommon line"), (24, "\n".join(f"l{k}" for k in range(3000)) + "\ncommon line\nend\nCOMMON LINE ")]
    got = dedup_lines(documents(spark, rows)).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 10)


def test_first_occurrence_stays_and_empty_table(spark):
    rows = [(i, f"a\nb{i}\na") for i in range(5)]
    got = {r.doc_id: r.kept for r in dedup_lines(documents(spark, rows), min_docs=3, keep_first=True).select("row.doc_id", "kept").collect()}
    assert got == {0: "a\nb0", 1: "b1", 2: "b2", 3: "b3", 4: "b4"}
    assert dedup_lines(documents(spark, [])).count() == 0
