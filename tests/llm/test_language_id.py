import zlib

from fixtures import documents
from logquarry.llm import language_id as lid
from pyspark.sql import functions as F

A, B = "the and of with this that shall ", "der die und nicht auch eine über "


def corpus(spark):
    rows = [(i, (A if i % 2 else B) * (1 + i % 5)) for i in range(120)]
    docs = documents(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    odd = documents(spark, [(1000, None), (1001, ""), (1002, "123 !!"), (None, A), (1003, A * 3000), (1004, "über eine")]).withColumn("lang", F.lit(None).cast("string"))
    return docs.union(odd)


def test_predictions_and_rejection(spark):
    docs = corpus(spark)
    seen = lid.sample(docs)
    assert len(seen) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(120))
    got = {r.doc_id: r for r in lid.identify(docs, lid.train(seen)).select("row.doc_id", "lang_pred", "score", "rejected", lid.held_out("row.doc_id").alias("held")).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and not got[i].rejected and 0.5 < got[i].score <= 1 for i in range(120))
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (1000, 1001, 1002))
    assert got[None].lang_pred == got[1003].lang_pred == "en" and got[1004].lang_pred == "de"
    assert all(got[i].held == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(120)) and got[None].held is False


def test_nothing_to_learn_from(spark):
    empty = documents(spark, [])
    model = lid.train(lid.sample(empty))
    assert model.languages == [] and lid.identify(empty, model).count() == 0
    assert [r.lang_pred for r in lid.identify(documents(spark, [(1, "abc")]), model).collect()] == ["und"]


def test_sample_is_bounded(spark):
    assert len(lid.sample(corpus(spark), rows=20)) <= 20
