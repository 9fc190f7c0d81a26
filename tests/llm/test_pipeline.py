import corpus_pipeline as cp
from fixtures import documents, words
from pyspark.sql import functions as F


def test_awkward_tables(spark, tmp_path):
    """Clashing columns, repeated rows, null ids and texts, a long text; and no rows at all."""
    body = lambda s, n=60: " ".join(words(s, n, 9000))
    rows = [(i, body(i)) for i in range(8)] + [(3, body(3)), (None, body(90)), (None, None), (9, None), (10, ""), (11, body(11, 60_000)), (12, body(1))]
    for name, part in (("full", rows), ("empty", [])):
        sf = f"{tmp_path}/{name}"
        documents(spark, part).coalesce(1).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, body(5, 60)), (None, None), (2, "")][: len(part)], "item_id long, text string").coalesce(1).write.parquet(f"{sf}/benchmark.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for stage, f in cp.STAGES[:-1]:
            docs = cp.table(f(spark, docs, sf), stage)
            assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
        left = sorted((r.doc_id for r in docs.collect()), key=repr)
        assert left == sorted([*(i for i in range(8) if i != 5), 3, None, 11], key=repr) * bool(part)
        assert cp.tokens(spark, docs, sf).count() == len(left)


def test_stages(spark, tmp_path):
    sf = str(tmp_path)
    item = " ".join(words(900, 40, 9000))
    body = lambda s: " ".join(words(s, 60, 9000))
    rows = [(i, f"common line\n{body(i)}") for i in range(12)] + [(20, f"{body(0)} x"), (21, f"{body(50)} {item}"), (22, None), (23, "12 !! 34"), (24, body(60))]
    documents(spark, rows, clash=False).coalesce(1).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").coalesce(1).write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = cp.language(spark, docs, sf)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(12), 20, 21, 24}
    cut = cp.lines(spark, kept, sf)
    assert cut.columns == docs.columns and cut.where(F.col("text").contains("common line") | (F.col("n_chars") != F.length("text"))).count() == 0 and cut.count() == 15
    one = cp.near_copies(spark, cut, sf)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {*range(12), 21, 24}
    clean = cp.decontaminate(spark, one, sf)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {*range(12), 24}
    assert cp.run(spark, sf).count() == 13
