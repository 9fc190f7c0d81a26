import json
import struct

import pytest
from logquarry import api
from logquarry.operators import records as rec
from logquarry.sources import binxml, encoder, eventlog
from logquarry.sources.encoder import Element

TICKS = 133_485_408_071_795_750
TEMPLATE = Element("Event", {"xmlns": "u"}, [Element("System", {}, [Element("EventID", {}, [(0, 0x06)]), Element("TimeCreated", {"SystemTime": (1, 0x11)})]), Element("EventData", {}, [Element("Data", {"Name": "a"}, [(2, 0x01)]), Element("Data", {"Name": "b"}, [(3, 0x07)])])])
XML = """<Event xmlns="u">
  <System>
    <EventID>7</EventID>
    <TimeCreated SystemTime="2024-01-01T00:00:07.179575Z"></TimeCreated>
  </System>
  <EventData>
    <Data Name="a">x &amp; y</Data>
    <Data Name="b">5</Data>
  </EventData>
</Event>
"""


def row(k=1, text="x & y"):
    return k, TICKS, [(0x06, struct.pack("<H", 7)), (0x11, struct.pack("<Q", TICKS)), (0x01, text.encode("utf-16-le")), (0x07, struct.pack("<i", 5))]


def log_of(n, text="x & y"):
    return list(encoder.chunks(TEMPLATE, (row(k, text) for k in range(1, n + 1))))


def test_worked_example(spark):
    data = encoder.log_file(log_of(3))
    assert list(api.iter_bytes(spark, data, "xml")) == [XML + "\n"] * 3
    first = json.loads(next(iter(api.iter_bytes(spark, data, "jsonl"))))
    assert first == {"event_record_id": 1, "timestamp_filetime": TICKS, "Event": {"@xmlns": "u", "System": {"EventID": "7", "TimeCreated": {"@SystemTime": "2024-01-01T00:00:07.179575Z"}}, "EventData": {"Data": [{"@Name": "a", "#text": "x & y"}, {"@Name": "b", "#text": "5"}]}}}


def test_source_skip_limit_and_pruning(spark, tmp_path):
    parts = log_of(1800)
    assert len(parts) >= 3
    (tmp_path / "a.log").write_bytes(encoder.log_file(parts))
    path = str(tmp_path / "a.log")
    chunks = eventlog.load_chunks(spark, path, chunksPerPartition=1)
    assert chunks.rdd.getNumPartitions() == len(parts)
    assert chunks.where("chunk_index = 1").count() == 1 and chunks.count() == len(parts)
    assert eventlog.load_chunks(spark, path, chunkStart=1, chunkEnd=2).count() == 1
    ids = lambda **o: [r.event_record_id for r in api.read_eventlog(spark, path, "json", **o).orderBy("chunk_index", "ordinal").collect()]
    assert ids() == list(range(1, 1801))
    assert ids(skip=700, limit=1000) == list(range(701, 1701))
    assert ids(skip=1799, limit=5) == [1800] and ids(skip=1800, limit=5) == []
    assert api.dump_file(spark, path, str(tmp_path / "out.xml"), "xml", limit=2) == 2
    assert (tmp_path / "out.xml").read_text() == (XML + "\n") * 2
    with pytest.raises(ValueError):
        api.read_eventlog(spark, path, "csv")


def test_checksums_and_headers(spark, tmp_path):
    parts = log_of(1300)
    bad = bytearray(parts[0])
    bad[700] ^= 1
    data = encoder.log_file([bytes(bad), *parts[1:]])
    kept = rec.decode(rec.valid_chunks(eventlog.chunks_of_bytes(spark, data)))
    assert kept.where("chunk_index = 0").count() == 0 and kept.count() > 0
    assert rec.valid_chunks(eventlog.chunks_of_bytes(spark, data), "PERMISSIVE").count() == len(parts)
    with pytest.raises(Exception, match="ChecksumMismatch"):
        rec.valid_chunks(eventlog.chunks_of_bytes(spark, data), "FAILFAST").collect()
    with pytest.raises(eventlog.BadLog, match="BadSignature"):
        eventlog.header(b"x" * 4096)
    with pytest.raises(eventlog.BadLog, match="BadChecksum"):
        eventlog.header(data[:100] + b"\x01" + data[101:4096])
    with pytest.raises(eventlog.BadLog, match="UnexpectedEof"):
        eventlog.chunks_of_bytes(spark, data[:-1])


@pytest.mark.parametrize("damage", ["signature", "size", "copy", "zero"])
def test_framing_stops_at_damage(damage):
    data = bytearray(log_of(5)[0])
    second = list(rec.frames(bytes(data)))[1][2] - 24
    if damage == "signature":
        data[second] = 0
    elif damage == "size":
        struct.pack_into("<I", data, second + 4, 31)
    elif damage == "copy":
        size = struct.unpack_from("<I", data, second + 4)[0]
        struct.pack_into("<I", data, second + size - 4, size + 1)
    else:
        data[second : second + 24] = bytes(24)
    assert len(list(rec.frames(bytes(data)))) == 1


def test_damaged_payload_is_an_error_column(spark):
    data = bytearray(log_of(3)[0])
    start = list(rec.frames(bytes(data)))[1][2]
    data[start + 4] = 0x1F
    got = rec.decode(spark.createDataFrame([("p", 0, bytes(data)), ("q", 0, None)], eventlog.SCHEMA)).orderBy("ordinal").collect()
    assert [r.error for r in got] == [None, "BadToken", None] and got[1].xml is None


@pytest.mark.parametrize(
    ("kind", "data", "text"),
    [
        (0x03, b"\x80", "-128"), (0x04, b"\xff", "255"), (0x09, struct.pack("<q", -(2**63)), str(-(2**63))), (0x0A, b"\xff" * 8, str(2**64 - 1)),
        (0x0B, struct.pack("<f", 0.1), "0.1"), (0x0C, struct.pack("<d", 1e20), "100000000000000000000"), (0x0C, struct.pack("<d", float("nan")), "-1.#IND"), (0x0C, struct.pack("<d", float("-inf")), "-1.#INF"),
        (0x0D, b"\0\0\0\0", "false"), (0x0D, b"\2\0\0\0", "true"), (0x0E, b"\xab\x01", "ab01"), (0x0F, bytes(range(16)), "{03020100-0504-0706-0809-0a0b0c0d0e0f}"),
        (0x10, b"\x10\0\0\0", "0x10"), (0x11, struct.pack("<Q", 5), "1970-01-01T00:00:00.000000Z"), (0x12, struct.pack("<8H", 2024, 2, 9, 3, 4, 5, 6, 7), "2024-02-03T04:05:06.007Z"),
        (0x13, bytes([1, 2, 0, 0, 0, 0, 0, 5]) + struct.pack("<II", 32, 544), "S-1-5-32-544"), (0x14, b"\xff\0\0\0", "0xFF"), (0x20, b"\7\0\0\0", "7"), (0x02, b"\x80a\x81", "€a�"), (0x00, b"x", ""),
    ],
)
def test_values(kind, data, text):
    assert binxml.value_text(kind, data) == text


@pytest.mark.parametrize(
    ("raw", "xml", "escaped"),
    [
        ("Hello &<>\"' World".encode("utf-16-le"), "Hello &amp;&lt;&gt;&quot;&apos; World", "Hello &<>\\\"' World"), (b"\xac\x20", "€", "€"), (b"\x3d\xd8\x00\xde", "\U0001f600", "\U0001f600"),
        (b"\x00\xd8", "", ""), (b"\x00\xdc", "", ""), (b"\x1f\x00", "\x1f", "\\u001F"), (b"\x0a\x00", "\n", "\\n"), (b"\x00\xd8A\x00", "A", "A"),
    ],
)
def test_escapes(raw, xml, escaped):
    assert binxml.utf16(raw).translate(binxml.XML) == xml and binxml.utf16(raw).translate(binxml.JSON) == escaped


def test_arrays():
    assert binxml.array_items(0x01, 0x81, "a\0\0b\0".encode("utf-16-le")) == ["a".encode("utf-16-le"), b"", "b".encode("utf-16-le")]
    assert binxml.array_items(0x06, 0x86, b"\1\0\2\0\3") == [b"\1\0", b"\2\0"]
    assert binxml.array_items(0x10, 0x10, b"\1\0\0\0") == []


@pytest.mark.parametrize(("raw", "want"), [("+2020-+1-+2T3:4:5.25Z", "2020-01-02T03:04:05.250000Z"), ("2020-01-02T03:04:05.1234567Z", "2020-01-02T03:04:05.123456Z"), ("2020-01-02T03:04:05Z", "2020-01-02T03:04:05Z"), ("no+time", "notime")])
def test_system_time(raw, want):
    assert binxml.system_time(raw) == want


def test_hand_assembled_tokens():
    """A plain element with a character reference, an entity, CDATA and a nested element, from the format's byte tables."""
    at = 512 + 24
    name = encoder.name_block("a")
    inner = Element("b", {}, ["t"])
    def body(start):
        out = struct.pack("<I", start + 11) + name + b"\x02" + b"\x08\x41\x00"
        out += b"\x09" + struct.pack("<I", start + 7 + len(out) + 5) + encoder.name_block("amp")
        out += b"\x07\x01\x00<\x00"
        return out + inner.encode(start + 7 + len(out)) + b"\x04"
    tokens = b"\x0f\x01\x01\x00" + struct.pack("<BHI", 1, 0xFFFF, len(body(at + 4))) + body(at + 4) + b"\x00"
    chunk = bytes(at) + tokens
    root = binxml.Chunk(chunk).root(at, len(chunk))
    assert binxml.to_xml(root) == "<a>\n  &#65;\n  &amp;\n  <![CDATA[<]]>\n  <b>t</b>\n</a>\n"
    assert json.loads(binxml.to_json(root)) == {"#text": "&#65;&<", "b": "t"}


def test_nested_binary_xml_null_and_array():
    template = Element("E", {}, [Element("N", {}, [(0, 0x21)]), Element("Z", {"q": (1, 0x01)}, [(1, 0x01)]), Element("L", {}, [(2, 0x81)])])
    nested_at = 4096
    nested = b"\x0f\x01\x01\x00" + Element("In", {}, ["deep"]).encode(nested_at + 4)
    values = [(0x21, nested), (0x00, b""), (0x81, "p\0q\0".encode("utf-16-le"))]
    for _ in range(2):  # the nested part's names are absolute: place it once its position is known
        payload = encoder.instance(template, values, 536, None)
        where = 536 + payload.index(nested)
        nested = b"\x0f\x01\x01\x00" + Element("In", {}, ["deep"]).encode(where + 4)
        values[0] = (0x21, nested)
    payload = encoder.instance(template, values, 536, None)
    chunk = bytes(536) + payload
    assert binxml.to_xml(binxml.Chunk(chunk).root(536, len(chunk))) == '<E>\n  <N>\n    <In>deep</In>\n  </N>\n  <Z q=""></Z>\n  <L>p,q</L>\n</E>\n'


def test_stream(spark, tmp_path):
    from logquarry.streaming.tail import stream_records

    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.log").write_bytes(encoder.log_file(log_of(5)))
    for n in (5, 9):
        (source / "a.log").write_bytes(encoder.log_file(log_of(5)))
        if n == 9:
            (source / "b.log").write_bytes(encoder.log_file(log_of(4)))
        q = stream_records(spark, str(source)).select("event_record_id", "written").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(out))
        q.awaitTermination(120)
        assert spark.read.parquet(str(out)).count() == n


def test_streaming_windows(spark):
    from logquarry.streaming.tail import windowed_counts

    rows = spark.createDataFrame([("A", "2024-01-01 00:10:00"), ("A", "2024-01-01 00:50:00"), ("B", "2024-01-01 01:00:00")], "channel string, w string")
    got = windowed_counts(rows.selectExpr("channel", "to_timestamp(w) AS written")).collect()
    assert sorted((r.channel, r.n) for r in got) == [("A", 2), ("B", 1)]
