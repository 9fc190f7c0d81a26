import random
import struct

import pytest
from logquarry.functions import formats as fmt
from logquarry.operators import records as rec
from logquarry.operators import token_tables as tokens
from logquarry.plans.event_table import TEMPLATE
from logquarry.sources import binxml
from logquarry.sources.encoder import Element, chunks, instance, value_bytes
from pyspark.sql import functions as F

SCHEMA = "path string, chunk_index int, data binary"
TICKS = 133_485_408_071_795_750


def chunk(template, values, ids=(1, 2, 3)):
    return next(chunks(template, iter([(i, TICKS, values) for i in ids])))


def frame(spark, data):
    return spark.createDataFrame([("f", k, bytes(d)) for k, d in enumerate(data)], SCHEMA).repartition(4)


def both(spark, data):
    """The decoder's rows and those of the tables, by record."""
    frames = frame(spark, data)
    return [{(r.chunk_index, r.ordinal): r.asDict() for r in f(frames).collect()} for f in (rec.decode, tokens.decode_tables)]


def test_flipped_bytes_as_the_decoder(spark):
    """Damage anywhere: the same records, texts and fields, and errors where the decoder has errors."""
    rng, damaged = random.Random(3), []
    whole = chunk(TEMPLATE, [(k, value_bytes(k, v)) for k, v in ((0x06, 1), (0x11, 10**17), (0x09, 5), (0x01, "click"), (0x0C, 1.5), (0x01, "{}"))])
    end = struct.unpack_from("<I", whole, 48)[0]
    for _ in range(700):
        d = bytearray(whole)
        for _ in range(rng.randrange(1, 4)):
            d[rng.randrange(40, end)] = rng.choice((0, 1, 0x7F, 0x80, 0xFF, rng.randrange(256)))
        damaged.append(d)
    want, got = both(spark, damaged)
    assert want.keys() == got.keys()
    for key, row in want.items():
        mine = got[key]
        assert (row["error"] is None) == (mine["error"] is None), (row, mine)
        if row["error"] is None:
            assert row == mine
    assert sum(r["error"] is None for r in want.values()) > 300


SCALARS = {
    0x01: ["a\u0000b", "", "é\U0001f600&<>\"'\t\x1f"], 0x03: [-128, 127], 0x04: [0, 255], 0x05: [-32768, 5], 0x06: [65535], 0x07: [-(2**31), 7], 0x08: [2**32 - 1], 0x09: [-(2**63), 2**63 - 1], 0x0A: [2**64 - 1, 0],
    0x0B: [1.5, -0.1, 3.4e38, float("nan")], 0x0C: [0.1, 1e22, 5e-324, -1e300, float("inf"), 8.939817659706545e17], 0x0D: [0, 1], 0x11: [TICKS, 0, 2**60], 0x14: [0, 255, 2**32 - 1], 0x15: [0, 2**64 - 1],
}
RAW = {
    0x01: [b"a\0b", b"\0\xd8x\0", b"\0\xdcx\0\0\xd8", b"\x3d\xd8\0\xde\0\xd8\0\xd8\0\xdc", b"a\0\0\0"], 0x02: [b"caf\xe9 \x80\x81\0\0", b"\0"], 0x0E: [b"", b"\x01\xff"], 0x0F: [bytes(range(16)), b"short"],
    0x12: [struct.pack("<8H", 2024, 2, 4, 29, 23, 59, 58, 7)], 0x13: [b"\x01\x02" + bytes([0, 0, 0, 0, 0, 5]) + struct.pack("<II", 32, 544), b"\x01\x09" + bytes(10), b"\x01"], 0x10: [b"\xff\0\0\0", b"\1\2\3\4\5\6\7\x88", b"\1"],
    0x20: [b"\xff\0\0\0", b"\xff" * 8], 0x23: [b"\xab"], 0x99: [b"odd"], 0x03: [b""], 0x09: [b"\1\2"], 0x0C: [b"\1\2\3"], 0x0D: [b"\1"], 0x11: [b"\1"],
}
ARRAYS = {
    0x81: ["a\0\0b\0".encode("utf-16-le"), "x".encode("utf-16-le"), b"\0\xd8\0\0x\0"], 0x82: [b"a\0\0b\0", b"caf\xe9"], 0x83: [b"\1\xff"], 0x88: [struct.pack("<3I", 1, 2, 2**32 - 1) + b"\1"], 0x8A: [b"\xff" * 8], 0x8B: [struct.pack("<3f", 0.1, 2, -3)],
    0x8C: [struct.pack("<2d", 0.1, 1e21)], 0x8F: [bytes(32)], 0x91: [struct.pack("<2Q", TICKS, TICKS + 10)], 0x93: [(b"\x01\x01" + bytes([0, 0, 0, 0, 0, 5]) + struct.pack("<I", 18)) * 2 + b"\1\1", b"\1\x09" + bytes(8)], 0x95: [struct.pack("<2Q", 1, 2**40)],
}


def test_values_of_all_types_as_the_decoder(spark):
    cases = [(k, value_bytes(k, v)) for k, values in SCALARS.items() for v in values] + [(k, raw) for found in (RAW, ARRAYS) for k, values in found.items() for raw in values]
    data = []
    for kind, raw in cases:
        for wanted in {kind, kind | 0x80, 0x01, kind & 0x7F} if kind < 0x99 else {kind}:
            if wanted & 0x7F != 0x21:
                template = Element("Event", {}, [Element("EventData", {}, [Element("Data", {"Name": "v", "a": (0, wanted)}, [(0, wanted)]), Element("Data", {"Name": "o"}, [struct.pack("<BHB", 0x0E, 1, wanted)])])])
                data.append(chunk(template, [(kind, raw), (0, b"")], (len(data) + 1,)))
    # a type of size pointer in an array tells its items' size
    for kind in (0x94, 0x95):
        data.append(chunk(Element("Event", {}, [Element("EventData", {}, [Element("Data", {"Name": "v"}, [(0, 0x90)])])]), [(kind, bytes(range(16)))], (len(data) + 1,)))
    want, got = both(spark, data)
    assert len(want) == len(data)
    for key, row in want.items():
        assert row == got[key], (row, got[key])


def test_literals_references_and_layout(spark):
    """Character and entity references, CDATA, processing instructions, literal values, deep and mixed trees."""
    text = lambda token, s: bytes([token]) + struct.pack("<H", len(s)) + s.encode("utf-16-le")
    charref, cdata, literal = struct.pack("<BH", 0x08, 65), text(0x07, "<raw>&"), struct.pack("<BBi", 0x05, 0x07, -5)
    deep = Element("L0", {}, ["bottom"])
    for k in range(1, 9):
        deep = Element(f"L{k % 3}", {"d": str(k)} if k % 2 else {}, [deep, "mixed" if k % 4 == 0 else Element("E")])
    event = Element("Event", {"SystemTime": "+2024-1-2T3:4:5.6Z", "q": '"<&'}, [Element("A", {}, [charref, cdata, literal, "t"]), deep, "\x01\b\f\r\n\\", Element("A", {}, [Element("A"), Element("B"), Element("A")])])
    want, got = both(spark, [chunk(event, [], (5,))])
    assert got == want and got[0, 0]["error"] is None and "&#65;" in got[0, 0]["xml"]


def nested(levels, at_attribute=False):
    """Values that hold each other, `levels` deep."""
    inner = Element("Leaf", {}, [(0, 0x01)])
    step = Element("Step", {"a": (0, 0x21)} if at_attribute else {}, ["s", *([] if at_attribute else [(0, 0x21)])])

    def held(k):
        if k == 0:
            return lambda at: instance(inner, [(0x01, value_bytes(0x01, "deep"))], at, None)
        return lambda at: instance(step, [(0x21, held(k - 1))], at, None)

    return chunk(Element("Event", {}, [Element("Out", {}, [(0, 0x21)])]), [(0x21, held(levels))], (1, 2))


@pytest.mark.parametrize("at_attribute", [False, True])
def test_nested_levels(spark, at_attribute):
    data = [nested(k, at_attribute) for k in (0, 1, 2, 4)]
    want, got = both(spark, data)
    assert want == got
    for k, depth in enumerate((0, 1, 2, 4)):
        text = got[k, 0]["xml"]
        assert text.count("<Step") == depth and text.count("deep") == 1
    assert tokens.trees(frame(spark, data[:1]))[1] == 3


def test_damaged_nested_values(spark):
    rng, whole, damaged = random.Random(8), nested(2), []
    end = struct.unpack_from("<I", whole, 48)[0]
    for _ in range(150):
        d = bytearray(whole)
        d[rng.randrange(512, end)] = rng.randrange(256)
        damaged.append(d)
    want, got = both(spark, damaged)
    assert want.keys() == got.keys()
    for key, row in want.items():
        assert (row["error"] is None) == (got[key]["error"] is None), (row, got[key])
        if row["error"] is None:
            assert row["xml"] == got[key]["xml"] and row["json"] == got[key]["json"]


def test_levels_beyond_the_deepest_are_errors(spark, monkeypatch):
    monkeypatch.setattr(binxml, "DEEPEST", 2)
    _, got = both(spark, [nested(1), nested(4)])
    assert got[0, 0]["error"] is None and got[1, 0]["error"] == "OutOfBounds" and got[1, 0]["xml"] is None


def test_null_and_short_chunks_and_slices(spark):
    whole = chunk(TEMPLATE, [(k, value_bytes(k, v)) for k, v in ((0x06, 1), (0x11, TICKS), (0x09, 5), (0x01, "x"), (0x0C, 1.5), (0x01, "{}"))], range(1, 9))
    frames = spark.createDataFrame([("f", 0, whole), ("f", 1, None), ("f", 2, b""), ("g", 0, whole)], SCHEMA)
    assert tokens.decode_tables(frames).count() == 16
    cut = rec.slice_chunks(frames.where("chunk_index = 0"), 5, 6)
    assert sorted((r.path, r.event_record_id) for r in tokens.decode_tables(cut).collect()) == [("f", 6), ("f", 7), ("f", 8), ("g", 1), ("g", 2), ("g", 3)]
    assert [r.event_record_id for r in tokens.decode_tables(frames.where("path = 'f'"), record_id=4).collect()] == [4]
    assert tokens.decode_tables(frames.where("false")).count() == 0


def test_records_need_no_shuffle_without_nested_values(spark):
    whole = chunk(TEMPLATE, [(k, value_bytes(k, v)) for k, v in ((0x06, 1), (0x11, TICKS), (0x09, 5), (0x01, "x"), (0x0C, 1.5), (0x01, "{}"))])
    rows, deepest = tokens.trees(spark.createDataFrame([("f", 0, whole)], SCHEMA))
    plan = tokens.fold(tokens.fields(rows), deepest, "json", "json")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "MapInArrow" not in plan


#: The escape matrix of UTF-16 code units: (bytes, text).
UNITS = [("4100", "A"), ("ac20", "€"), ("e900", "é"), ("ff07", "߿"), ("3dd800de", "\U0001f600"), ("00d8", ""), ("00dc", ""), ("1f00", "\x1f"), ("0a00", "\n"), ("00d84100", "A"), ("00dc00d8", ""), ("3dd83dd800de", "\U0001f600"), ("3dd800de00de", "\U0001f600"), ("410042004300440045004600470000d84800", "ABCDEFGH"), ("4100" * 7 + "3dd800de", "A" * 7 + "\U0001f600"), ("410000004200", "A\0B"), ("41", ""), ("", ""), ("d8004100", "ØA")]


def test_utf16_with_lone_halves(spark):
    cases = [(h.replace("470000d8", "470000d8"), t) for h, t in UNITS if "470000d8" not in h] + [("4100420043004400450046004700" + "00d8" + "4800", "ABCDEFGH")]
    rows = spark.createDataFrame([(bytes.fromhex(h), t) for h, t in cases], "raw binary, want string")
    got = rows.select("want", fmt.utf16_lenient("raw").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    rng = random.Random(2)
    raws = [b"".join(struct.pack("<H", rng.choice((0xD800, 0xDBFF, 0xDC00, 0xDFFF, 0x41, 0xD7FF, 0xE000, 0x00D8))) for _ in range(rng.randrange(12))) + (b"x" if rng.random() < 0.3 else b"") for _ in range(400)]
    found = spark.createDataFrame([(r,) for r in raws], "raw binary").select(fmt.utf16_lenient("raw").alias("t")).collect()
    assert [r.t for r in found] == [binxml.utf16(r) for r in raws]


def test_little_endian_hex_and_sids(spark):
    raws = [b"\0\0\0\0", b"\1\0\0\0", b"\0\1", b"\xff" * 8, b"\x10"]
    got = spark.createDataFrame([(r,) for r in raws], "raw binary").select(fmt.le_hex("raw").alias("t")).collect()
    assert [r.t for r in got] == [f"{int.from_bytes(r, 'little'):X}" for r in raws]
    sid = b"\x01\x02" + bytes(6) + bytes(8)
    got = spark.createDataFrame([(sid * 3 + b"\1\1",), (b"\1\5" + bytes(9),), (b"",)], "raw binary").select(F.array_size(fmt.sid_places("raw")).alias("n")).collect()
    assert [r.n for r in got] == [3, 0, 0]


def test_held_values_are_cut_with_their_record(spark):
    """Records that hold the same templates and elements are one row, whatever their literals; all as the decoder has it."""
    literal = struct.pack("<BBi", 0x05, 0x07, -5)
    leaf = Element("Leaf", {"Name": (0, 0x01), "SystemTime": "+2024-1-2T3:4:5Z"}, ["is ", (1, 0x8C), literal, (2, 0x01)])
    step = Element("Step", {"a": (0, 0x21), "b": "c"}, [(1, 0x21), Element("Data", {"Name": "k"}, [(2, 0x09), "units"])])

    def values(k):
        held = [(0x01, value_bytes(0x01, f"n{k}")), (0x8C, struct.pack("<2d", 0.1, k)), (0x00, b"")]
        inner = lambda at: instance(leaf, held, at, None)

        def two(at):
            first = Element("Plain", {"Name": f"p{k % 2}", "of": f"a\0{k}"}, [f"text {k}\0", Element("Q")]).encode(at)
            return first + instance(step, [(0x21, inner), (0x21, inner if k % 3 else b""), (0x09, value_bytes(0x09, k))], at + len(first), None) + b"\x00"

        return [(0x21, two), (0x21, inner if k != 4 else b"\x55")]

    event = Element("Event", {}, [Element("EventData", {}, [Element("Data", {"Name": "x"}, [(0, 0x21), "after"]), (1, 0x21)])])
    data = list(chunks(event, ((k, TICKS, values(k)) for k in range(1, 31))))
    want, got = both(spark, data)
    assert want == got and len(got) == 30 and got[0, 3]["error"] == "BadToken"
    rows = tokens.parse(frame(spark, data)).select("template", F.size("uses").alias("n"), F.size("parts").alias("parts")).collect()
    # two names of the element without template, with and without the second value
    assert sorted((r.n, r.parts) for r in rows if r.template >= 0) == sorted([(5, 5), (5, 5), (10, 6), (9, 6)])
    plan = tokens.decode_tables(frame(spark, data))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" not in plan
