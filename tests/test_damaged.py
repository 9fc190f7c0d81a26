import random
import struct

import pytest
from logquarry.operators import records as rec
from logquarry.plans.event_table import TEMPLATE
from logquarry.sources.encoder import Element, chunks, value_bytes
from logquarry.sources.eventlog import files_of

SCHEMA = "path string, chunk_index int, data binary"


def chunk(template=TEMPLATE, values=((0x06, 1), (0x11, 10**17), (0x09, 5), (0x01, "click"), (0x0C, 1.5), (0x01, "{}")), ids=(1, 2, 3)):
    return next(chunks(template, iter([(i, 10**17, [(k, value_bytes(k, v)) for k, v in values]) for i in ids])))


def decoded(spark, data):
    rows = [("f", k, bytes(d)) for k, d in enumerate(data)]
    return rec.decode(spark.createDataFrame(rows, SCHEMA)).collect()


def test_flipped_bytes_never_fail_the_job(spark):
    rng, whole, damaged = random.Random(3), chunk(), []
    end = struct.unpack_from("<I", whole, 48)[0]
    for _ in range(1500):
        d = bytearray(whole)
        for _ in range(rng.randrange(1, 4)):
            d[rng.randrange(40, end)] = rng.choice((0, 1, 0x7F, 0x80, 0xFF, rng.randrange(256)))
        damaged.append(d)
    got = decoded(spark, damaged)
    assert len(got) > 1500 and all(r.error or (r.xml and r.json) for r in got)
    assert sum(r.error is None for r in got) > 500 < sum(r.error is not None for r in got)


def test_short_chunks_and_large_numbers(spark):
    data = bytearray(chunk())
    struct.pack_into("<Q", data, 512 + 8, 1 << 63)
    got = decoded(spark, [b"", b"x" * 51, data])
    assert [(r.event_record_id, r.error) for r in got] == [(None, "OutOfBounds"), (2, None), (3, None)]
    odd = Element("Event", {}, [Element("System", {}, [Element("EventID", {}, ["\u00b2"])])])
    assert [(r.event_id, r.error) for r in decoded(spark, [chunk(odd, (), (1,))])] == [(None, None)]


def test_data_of_one_name_all_stay(spark):
    twice = Element("Event", {}, [Element("EventData", {}, [Element("Data", {"Name": "x"}, [t]) for t in "abc"])])
    assert decoded(spark, [chunk(twice, (), (1,))])[0].data == {"x": "a", "x.2": "b", "x.3": "c"}


def test_record_modes_and_ids(spark):
    data = bytearray(chunk())
    struct.pack_into("<Q", data, 512 + 8, 1 << 63)
    frame = spark.createDataFrame([("f", 0, bytes(data)), ("f", 1, chunk(ids=(70, 71)))], SCHEMA)
    records = rec.decode(frame)
    assert records.count() == 5 and rec.valid_records(records, "DROPMALFORMED").count() == 4
    with pytest.raises(Exception, match="OutOfBounds: f chunk 0"):
        rec.valid_records(records, "FAILFAST").collect()
    with pytest.raises(ValueError, match="InvalidArgs"):
        rec.valid_records(records, "ANY")
    near = rec.chunks_with_id(frame, 71)
    assert [r.chunk_index for r in near.collect()] == [1] and [r.event_record_id for r in rec.decode(near, record_id=71).collect()] == [71]


def test_paths(tmp_path):
    for name in ("a.evtx", "b.evtx", "c.txt"):
        (tmp_path / name).write_bytes(b"")
    assert files_of(str(tmp_path)) == [f"{tmp_path}/{n}" for n in ("a.evtx", "b.evtx", "c.txt")]
    assert files_of(f"file://{tmp_path}/*.evtx") == [f"file://{tmp_path}/{n}" for n in ("a.evtx", "b.evtx")]
    assert files_of(f"{tmp_path}/none") == [f"{tmp_path}/none"]
