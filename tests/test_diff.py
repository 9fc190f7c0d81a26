import os

import pytest
from logquarry.functions.tables import register_tables
from logquarry.operators.diff import canonical_json, canonical_xml, log_diff, read_events
from logquarry.operators.records import decode
from logquarry.plans.event_table import event_chunks
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def one(spark, function, text):
    return spark.createDataFrame([(text,)], "t string").select(function(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "left, right",
    [
        ('<?xml version="1.0"?>\n<a y="2" x=\'1\'>\n  <b/>t t</a>', "<a x = '1'   y=\"2\"><b></b>t t</a>"),
        ("Record 7\n<a><b c='>'></b></a>", "<a>\n<b c='>' />\n</a>"),
        ("<a>é<b>x</b>\n</a>", "<a>é<b >x</b ></a>"),
    ],
)
def test_xml_that_is_the_same(spark, left, right):
    assert one(spark, canonical_xml, left) == one(spark, canonical_xml, right) != ""


def test_xml_that_differs(spark):
    texts = ["<a x='1'/>", "<a x='2'/>", "<a>x</a>", "<a>x y</a>", "<a><b/><c/></a>", "<a><c/><b/></a>", "<a>&lt;</a>"]
    assert len({one(spark, canonical_xml, t) for t in texts}) == len(texts) and one(spark, canonical_xml, None) is None


def test_json(spark):
    assert one(spark, canonical_json, '{"b": {"d":1,"c":[2, 1]}, "a":"x"}') == one(spark, canonical_json, '{"a":"x","b":{"c":[2,1],"d":1}}') == '{"a":"x","b":{"c":[2,1],"d":1}}'
    assert one(spark, canonical_json, '{"a":[1,2]}') != one(spark, canonical_json, '{"a":[2,1]}')
    assert one(spark, canonical_json, "{") == "{" and one(spark, canonical_json, None) is None


def test_multiset_difference(spark):
    left = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "c")], "n long, t string").withColumn("l", F.lit("x"))
    right = spark.createDataFrame([(9, "a"), (3, "b"), (7, None), (8, None), (6, "d")], "n long, t string").withColumn("id", F.lit("y"))
    got = sorted((r.id, r.left_n, r.right_n) for r in log_diff(left, right, "t", "n").collect())
    assert got == [(1, 2, 1), (4, 1, 2), (5, 1, 0), (6, 0, 1)]
    assert log_diff(left, left, "t", "n").count() == 0 and log_diff(left.limit(0), right.limit(0), "t", "n").count() == 0


def test_two_dumps_that_differ_in_one_record(spark, tmp_path):
    xml = [r.xml for r in decode(event_chunks(spark, SF), json=False).select("xml").limit(300).collect()]
    turned = [x.replace('<Data Name="user_id">', "<Data   Name='user_id' >".replace("'", '"')).replace("\n", "\n\n") for x in reversed(xml)]
    changed = turned[17].replace("host", "other")
    turned[17] = changed
    for name, texts in (("one", xml), ("two", turned)):
        os.mkdir(tmp_path / name)
        (tmp_path / name / "dump.xml").write_text('<?xml version="1.0" encoding="utf-8"?>\n' + "\n".join(f"Record {k}\n{x}" for k, x in enumerate(texts)))
    sides = [read_events(spark, str(tmp_path / name)).withColumn("canonical", canonical_xml(F.col("xml"))) for name in ("one", "two")]
    assert [s.count() for s in sides] == [300, 300]
    assert sorted((r.left_n, r.right_n) for r in log_diff(*sides, "canonical", "xml").collect()) == [(0, 1), (1, 0)]


def test_table_function(spark):
    register_tables(spark)
    chunks = event_chunks(spark, SF).unionByName(spark.createDataFrame([("none", 0, None), ("short", 0, b"abc")], "path string, chunk_index int, data binary"))
    chunks.createOrReplaceTempView("all_chunks")
    got = spark.sql("SELECT c.path, c.chunk_index, r.* FROM all_chunks c, LATERAL eventlog_records(c.data) r")
    want = decode(chunks)
    assert got.schema.names == want.schema.names
    both = [{tuple(str(v) for v in r) for r in df.collect()} for df in (got, want)]
    assert both[0] == both[1] and len(both[0]) > 900
