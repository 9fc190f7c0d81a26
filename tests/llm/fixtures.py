"""Small tables with the awkward rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

CLASHING = "row string, n long, h long, doc long, key string, component string, label string, path string"


def words(seed, n, size=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def documents(spark, rows, clash=True):
    """rows: (doc_id, text) -> documents with the driver's columns and, if asked, columns whose names operators may use too."""
    full = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        for c in CLASHING.split(", "):
            name, kind = c.split()
            docs = docs.selectExpr("*", f"CAST(7 AS {kind}) AS {name}")
    return docs
