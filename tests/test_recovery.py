import struct
import zlib

import pytest
from logquarry.operators import records as rec
from logquarry.operators import recovery
from logquarry.plans.event_table import TEMPLATE
from logquarry.sources import chunk_index
from logquarry.sources.encoder import CHUNK, HEADER, chunks, log_file, value_bytes
from logquarry.sources.eventlog import load_chunks
from pyspark.sql import functions as F

SCHEMA = "path string, chunk_index int, data binary"
TICKS = 133_485_408_071_795_750


def parts(ids, text="x"):
    values = lambda i: [(k, value_bytes(k, v)) for k, v in ((0x06, 1), (0x11, TICKS + i), (0x09, i), (0x01, text), (0x0C, 1.5), (0x01, "{}"))]
    return list(chunks(TEMPLATE, ((i, TICKS + i, values(i)) for i in ids)))


def records_at(data):
    return [(start - 24, end + 4) for _, _, start, end in rec.frames(bytes(data))]


def freed(data, keep):
    """The chunk with only the first `keep` records live; the others' bytes stay as slack. Checksums are made good."""
    d = bytearray(data)
    at = records_at(d)
    free = at[keep][0] if keep else 512
    struct.pack_into("<I", d, 48, free)
    struct.pack_into("<I", d, 52, zlib.crc32(bytes(d[512:free])))
    struct.pack_into("<I", d, 124, zlib.crc32(bytes(d[128:512]), zlib.crc32(bytes(d[:120]))))
    return d


def recovered(spark, rows, **options):
    got = recovery.recover(spark.createDataFrame([(p, k, bytes(d) if d is not None else None) for p, k, d in rows], SCHEMA), **options)
    return sorted((r.path, r.chunk_index, r.event_record_id, r.origin, r.data and r.data["user_id"], r.error) for r in got.collect())


def test_slack_damage_and_lost_chunks(spark):
    a, b, c, d = (parts(range(k, k + 8))[0] for k in (1, 11, 21, 31))
    slack = freed(a, 5)
    broken = bytearray(b)
    third = records_at(b)[2]
    broken[third[0] : third[1]] = bytes(third[1] - third[0])  # a block of zeros in the middle
    copy = bytearray(c)
    struct.pack_into("<I", copy, records_at(c)[4][1] - 4, 7)  # a size that differs from its copy
    header = bytearray(d)
    header[:8] = bytes(8)
    rows = [("f", 0, slack), ("f", 1, broken), ("f", 2, copy), ("f", 3, header), ("f", 4, None), ("f", 5, b"short")]
    want = [("f", 0, i, "slack", str(i), None) for i in (6, 7, 8)] + [("f", 1, i, "damaged", str(i), None) for i in range(14, 19)]
    want += [("f", 2, i, "damaged", str(i), None) for i in (26, 27, 28)] + [("f", 3, i, "chunk", str(i), None) for i in range(31, 39)]
    assert recovered(spark, rows, checksums=False) == want


def test_live_records_and_former_versions_come_once(spark):
    whole = parts(range(1, 9))[0]
    older = parts(range(1, 12), "old")[0]
    rows = [("f", 0, whole), ("f", 1, freed(whole, 0)), ("f", 2, freed(older, 0)), ("f", 3, freed(older, 0)), ("g", 0, freed(whole, 6))]
    got = recovered(spark, rows)
    # of file f only ids that aren't live, once though two chunks hold them; of file g, its own
    assert [(p, i, o) for p, _, i, o, _, _ in got] == [("f", 9, "slack"), ("f", 10, "slack"), ("f", 11, "slack"), ("g", 7, "slack"), ("g", 8, "slack")]


def test_chunks_of_wrong_checksum(spark):
    d = bytearray(parts(range(1, 5))[0])
    d[700] ^= 1
    assert [r[3] for r in recovered(spark, [("f", 0, d)])] == ["chunk"] * 4
    assert recovered(spark, [("f", 0, d)], checksums=False) == []
    assert recovered(spark, []) == []


@pytest.fixture
def dirty(tmp_path):
    """A log of three chunks whose header says one, with a stale chunk and one that goes on behind it."""
    ours = [p for k in range(3) for p in parts(range(100 * k + 1, 100 * k + 40))]
    stale, later = parts(range(50, 60))[0], parts(range(900, 910))[0]
    data = bytearray(log_file([*ours, stale, later]))
    struct.pack_into("<H", data, 42, 1)
    struct.pack_into("<I", data, 124, zlib.crc32(bytes(data[:120])))
    (tmp_path / "a.evtx").write_bytes(bytes(data) + b"rest")
    (tmp_path / "b.evtx").write_bytes(log_file(parts(range(5000, 5040))))
    return str(tmp_path)


def ids(chunks):
    return sorted(r.event_record_id for r in rec.decode(chunks, xml=False, json=False).collect())


def test_extra_chunks_are_read_and_stale_ones_refused(spark, dirty):
    index = chunk_index.build(spark, dirty)
    assert index.count() == 6
    want = [*range(1, 40), *range(5000, 5040)]
    assert ids(chunk_index.read(chunk_index.in_file(index))) == want
    assert ids(chunk_index.read(chunk_index.with_extra(index))) == sorted([*want, *range(101, 140), *range(201, 240)])
    assert ids(load_chunks(spark, dirty)) == want
    assert ids(chunk_index.load(spark, dirty, extra=True)) == sorted([*want, *range(101, 140), *range(201, 240)])


def test_index_prunes_by_ids_and_times_and_reads_only_what_it_names(spark, dirty, tmp_path):
    chunk_index.build(spark, dirty).write.parquet(f"{tmp_path}/index")
    index = chunk_index.with_extra(spark.read.parquet(f"{tmp_path}/index"))
    chosen = chunk_index.pruned(index, ids=(120, 130))
    assert [(r.chunk_index, r.first_id, r.last_id) for r in chosen.collect()] == [(1, 101, 139)]
    assert chunk_index.read(chosen).count() == 1 and set(range(120, 131)) <= set(ids(chunk_index.read(chosen)))
    times = chunk_index.pruned(index, ticks=(TICKS + 5000, TICKS + 5001))
    assert [r.first_id for r in times.collect()] == [5000]
    assert chunk_index.pruned(index, ids=(40, 100)).count() == 0
    # what isn't named isn't opened
    (tmp_path / "b.evtx").unlink()
    assert ids(chunk_index.read(chosen)) == list(range(101, 140))
    with pytest.raises(Exception, match="b.evtx"):
        chunk_index.read(times).collect()


def test_damaged_files_in_the_index(spark, tmp_path):
    (tmp_path / "no.evtx").write_bytes(bytes(HEADER + CHUNK))
    (tmp_path / "short.evtx").write_bytes(b"ElfFile\0")
    bad = bytearray(log_file(parts(range(1, 5))))
    bad[HEADER + 60] ^= 1
    (tmp_path / "sum.evtx").write_bytes(bad)
    rows = {r.path.rpartition("/")[2]: (r.sound, r.num_chunks, r.first_id) for r in chunk_index.build(spark, str(tmp_path)).collect()}
    assert rows == {"no.evtx": (False, None, None), "sum.evtx": (False, 1, 1)}
    assert chunk_index.with_extra(chunk_index.build(spark, str(tmp_path))).count() == 1


def test_chunks_are_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "long.evtx").write_bytes(log_file([parts([k])[0] for k in range(1, 25)], 1))
    got = chunk_index.load(spark, str(tmp_path), extra=True).select("chunk_index", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.chunk_index for r in got) == list(range(24))
    assert len({r.task for r in got}) > 1  # the rows that name chunks are small, the chunks aren't
    assert chunk_index.tasks(spark, 1000, 64) == 16 and chunk_index.tasks(spark, 0, 64) == 1
