"""Queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats as fmt
from ..functions.formats import EPOCH_TICKS
from ..operators import records as rec
from ..operators import recovery
from ..operators import token_tables as tokens
from ..functions.tables import register_tables
from ..operators.diff import canonical_json, log_diff
from ..operators.intervals import asof_join, interval_join
from ..sources import chunk_index
from ..api import lines
from ..sources.encoder import Element, instance, value_bytes
from ..sources.eventlog import load_chunks
from ..sources.scratch import shared_folder, table
from ..streaming.tail import user_sessions
from .event_table import INT64, STRING, TEMPLATE, encoded, event_chunks, event_files, event_rows, event_values, typed

BINXML = 0x21
TICKS = "(epoch_us(ts) * 10 + 116444736000000000)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(rec.decode(event_chunks(spark, sf_dir), xml=False, json=False))


def scan_records(spark, sf_dir):
    """All events, decoded as tables: templates, their uses, and values that become text."""
    return typed(tokens.decode_tables(event_chunks(spark, sf_dir), xml=False, json=False)).select("event_record_id", "timestamp_filetime", fmt.filetime_iso("timestamp_filetime").alias("iso_time"), "event_type", "user_id", "value", "props")


def offset_limit(spark, sf_dir, skip=7, limit=20):
    chunks = rec.slice_chunks(table(event_chunks(spark, sf_dir), "chunks"), skip, limit)
    return typed(rec.decode(chunks, xml=False, json=False)).select("event_record_id", "event_type")


def limit_across_chunks(spark, sf_dir):
    return offset_limit(spark, sf_dir, 150, 700)


def crc_ok(spark, sf_dir):
    chunks = event_chunks(spark, sf_dir).select(rec.checksum_ok().alias("ok"))
    return chunks.agg(F.bool_and("ok").alias("all_ok"), (F.count("*") > 0).alias("any_chunk"))


def crc_drop_corrupt_chunk(spark, sf_dir):
    """A byte of the first chunk of each file is flipped; counts the damaged chunks that stay and the others that don't."""
    chunks = event_chunks(spark, sf_dir, spread=False)
    flipped = F.concat(F.substring("data", 1, 600), F.lit(bytearray(b"\xff")), F.substring("data", 602, 65536))
    damaged = chunks.withColumn("data", F.when(F.col("chunk_index") == 0, flipped).otherwise(F.col("data")))
    kept = rec.valid_chunks(damaged).select("path", "chunk_index", F.lit(True).alias("stays"))
    all_chunks = damaged.select("path", "chunk_index").join(kept, ["path", "chunk_index"], "left")
    return all_chunks.where((F.col("chunk_index") == 0) == F.col("stays").isNotNull()).agg(F.count("*").alias("damaged_kept"))


def record_by_id(spark, sf_dir):
    chunks = rec.chunks_with_id(event_chunks(spark, sf_dir), 42)
    return typed(rec.decode(chunks, xml=False, json=False, record_id=42)).select("event_record_id", "event_type", "user_id")


def load_file(spark, sf_dir):
    """Written as files, read by the data source, checked, decoded."""
    chunks = rec.valid_chunks(load_chunks(spark, event_files(spark, sf_dir)), "FAILFAST")
    return typed(rec.decode(chunks, xml=False, json=False)).select("event_record_id", "timestamp_filetime", "event_type", "user_id", "value", "props")


def load_file_ranges(spark, sf_dir):
    """Two ranges of chunks of every file, read apart, are all of it."""
    folder = event_files(spark, sf_dir)
    chunks = load_chunks(spark, folder, chunkEnd="2", chunksPerPartition="1").union(load_chunks(spark, folder, chunkStart="2"))
    return typed(rec.decode(chunks, xml=False, json=False)).select("event_record_id", "event_type")


def load_file_slice(spark, sf_dir):
    """OFFSET and LIMIT over the records of several files."""
    chunks = rec.slice_chunks(load_chunks(spark, event_files(spark, sf_dir)), 333, 500)
    return typed(rec.decode(chunks, xml=False, json=False)).select("event_record_id", "event_type")


def file_headers(spark, sf_dir):
    """Files whose signature, header checksum or size is wrong, and whether there are any files."""
    files = spark.read.format("binaryFile").load(event_files(spark, sf_dir))
    sound = (F.substring("content", 1, 8) == F.lit(bytearray(b"ElfFile\0"))) & (F.crc32(F.substring("content", 1, 120)) == fmt.le_unsigned("content", 124, 4)) & (F.col("length") == 4096 + 65536 * fmt.le_unsigned("content", 42, 2))
    return files.agg(F.sum(F.when(sound, 0).otherwise(1)).alias("damaged"), (F.count("*") > 0).alias("any_file"))


def drop_damaged_chunks(spark, sf_dir):
    """The records that remain when the first chunk of each file is damaged, with those of a sound copy of it: all of them once."""
    chunks = event_chunks(spark, sf_dir, spread=False)
    flipped = F.concat(F.substring("data", 1, 600), F.lit(bytearray(b"\xff")), F.substring("data", 602, 65536))
    damaged = chunks.withColumn("data", F.when(F.col("chunk_index") == 0, flipped).otherwise(F.col("data")))
    kept = rec.valid_chunks(damaged).union(chunks.where("chunk_index = 0"))
    return typed(rec.decode(kept, xml=False, json=False)).select("event_record_id", "event_type", "props")


def sink_jsonl(spark, sf_dir):
    """Written as JSON lines, a file for each partition, and read again."""
    out = f"{shared_folder(spark)}/jsonl-{uuid.uuid4().hex}"
    lines(rec.decode(event_chunks(spark, sf_dir), xml=False), "jsonl").select(F.rtrim("text").alias("value")).write.text(out)
    return spark.read.schema("event_record_id long, timestamp_filetime long, Event struct<System: struct<EventID: string, Channel: string>>").json(out).select("event_record_id", "timestamp_filetime", F.col("Event.System.EventID").cast("int").alias("code"), F.col("Event.System.Channel").alias("channel"))


def sink_xml(spark, sf_dir):
    """Written as XML text and read again, a record for each Event element, its values by XPath."""
    out = f"{shared_folder(spark)}/xml-{uuid.uuid4().hex}"
    lines(rec.decode(event_chunks(spark, sf_dir), json=False), "xml").select(F.col("text").alias("value")).write.text(out, lineSep="\x1e")
    texts = spark.read.text(out, lineSep="\x1e").where("trim(value) <> ''")
    return texts.select(F.expr("xpath_long(value, '/Event/EventData/Data[@Name=\"user_id\"]')").alias("user_id"), F.expr("xpath_string(value, '/Event/EventData/Data[@Name=\"event_type\"]')").alias("event_type")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def render_layout(spark, sf_dir):
    """How XML is laid out: lines, and lines of each indentation."""
    text = rec.decode(event_chunks(spark, sf_dir), json=False).select("event_record_id", F.split(F.regexp_replace("xml", "\n$", ""), "\n").alias("rows"))
    depth = lambda n: F.size(F.filter("rows", lambda r: r.rlike(f"^ {{{n}}}<"))).cast("long").alias(f"indent_{n}")
    return text.select("event_record_id", F.size("rows").cast("long").alias("n_lines"), depth(0), depth(2), depth(4))


def json_child_grouping(spark, sf_dir):
    """Children of one name become an array, in order; a lone child doesn't."""
    got = rec.decode(event_chunks(spark, sf_dir), xml=False).select("event_record_id", F.from_json("json", "Event struct<System: struct<Channel: string>, EventData: struct<Data: array<struct<`@Name`: string, `#text`: string>>>>").alias("j"))
    return got.select("event_record_id", F.col("j.Event.System.Channel").alias("channel"), F.array_join("j.Event.EventData.Data.@Name", ",").alias("names"), F.col("j.Event.EventData.Data")[0]["#text"].cast("long").alias("user_id"))


def _one_event(content):
    return Element("Event", {}, [Element("EventData", {}, [Element("Data", {"Name": name}, [item]) for name, item in content])])


def _data(spark, sf_dir, content, values):
    got = rec.decode(encoded(event_rows(spark, sf_dir), _one_event(content), values), xml=False, json=False)
    return got.select("event_record_id", *[F.col("data")[name].alias(name) for name, _ in content])


def value_types(spark, sf_dir):
    """A value of every integer type, of booleans, hexadecimals, binary, GUID, SID and single-byte text, decoded to text."""

    def values(r):
        n = r["event_id"]
        guid = struct.pack("<IHH", n, 1, 2) + bytes(range(8))
        sid = struct.pack("<BB", 1, 2) + (5).to_bytes(6, "big") + struct.pack("<II", 32, n)
        return [(0x03, n % 100 - 50), (0x04, n % 200), (0x05, n % 1000 - 500), (0x06, n % 1000), (0x07, -n), (0x08, n), (0x09, -n), (0x0A, n), (0x0D, n % 2), (0x14, n), (0x15, n), (0x0E, struct.pack("<H", n % 256)), (0x0F, guid), (0x13, sid), (0x02, f"caf\xe9 {n}")]

    kinds = [0x03, 0x04, 0x05, 0x06, 0x07, 0x08, 0x09, 0x0A, 0x0D, 0x14, 0x15, 0x0E, 0x0F, 0x13, 0x02]
    return _data(spark, sf_dir, [(f"t{k:02x}", (i, k)) for i, k in enumerate(kinds)], values)


def optional_null(spark, sf_dir):
    """Optional substitutions: a null value leaves its element empty."""
    content = [("plain", (0, 0x09)), ("optional", struct.pack("<BHB", 0x0E, 1, 0x01))]
    return _data(spark, sf_dir, content, lambda r: [(0x09, r["user_id"]), (0x01, r["event_type"] if r["event_id"] % 2 else None)])


def array_decode(spark, sf_dir):
    """Array values: strings with commas between them, numbers with blanks."""
    texts = lambda r: f"{r['event_type']}\0n{r['event_id']}\0".encode("utf-16-le")
    return _data(spark, sf_dir, [("texts", (0, 0x81)), ("numbers", (1, 0x88))], lambda r: [(0x81, texts(r)), (0x88, struct.pack("<3I", r["event_id"], 7, 9))])


def wide_pairs(spark, sf_dir):
    """Each user's events paired with their next one (a window over decoded records, as pairing logons with logoffs)."""
    w = Window.partitionBy("user_id").orderBy("timestamp_filetime", "event_record_id")
    return _events(spark, sf_dir).select("event_record_id", F.lead("event_record_id").over(w).alias("next_id"), F.lead("event_type").over(w).alias("next_type"))


def sql_view(spark, sf_dir):
    """Decoded records under Spark SQL, with set operations."""
    events = _events(spark, sf_dir)
    return spark.sql("SELECT DISTINCT user_id FROM {e} WHERE event_type = 'click' INTERSECT SELECT user_id FROM {e} WHERE event_type = 'error'", e=events)


def filetime_iso(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return events.select("event_id", fmt.filetime_iso(fmt.filetime_of("ts")).alias("iso"))


def systemtime_iso(spark, sf_dir):
    t = F.col("ts").cast("timestamp")
    parts = [F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t), F.second(t), F.expr("CAST(unix_millis(CAST(ts AS timestamp)) % 1000 AS INT)")]
    return _table(spark, sf_dir, "events").select("event_id", fmt.systemtime_iso(*parts).alias("iso"))


def systemtime_normalise(spark, sf_dir):
    t = F.col("ts").cast("timestamp")
    loose = F.concat(F.lit("+"), F.year(t).cast("string"), F.lit("-+"), F.month(t).cast("string"), F.lit("-+"), F.dayofmonth(t).cast("string"), F.lit("T"), F.hour(t).cast("string"), F.lit(":"), F.minute(t).cast("string"), F.lit(":"), F.second(t).cast("string"), F.lit(".25Z"))
    return _table(spark, sf_dir, "events").select("event_id", fmt.systemtime_normalise(loose).alias("iso"))


def xml_escape(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", fmt.xml_escape(F.concat(F.lit("<a b=\"'&"), "o_orderpriority", F.lit(">"))).alias("xml"))


def json_escape(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('"'), fmt.json_escape(F.concat("props", F.lit("\t/\n"))), F.lit('"')).alias("json"))


def utf16_roundtrip(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", fmt.utf16_text(F.encode(F.concat("c_name", F.lit(" é€")), "UTF-16LE")).alias("name"))


def cp1252_decode(spark, sf_dir):
    codes = spark.range(128, 256).select("id", F.unhex(F.hex("id")).alias("b"))
    return codes.select("id", fmt.cp1252_text("b").alias("text"))


def guid_format(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", fmt.guid_text(F.unhex(F.lpad(F.hex("o_orderkey"), 32, "0"))).alias("guid"))


def sid_format(spark, sf_dir):
    le = F.concat(*[F.substring(F.lpad(F.hex("s_suppkey"), 8, "0"), k, 2) for k in (7, 5, 3, 1)])
    return _table(spark, sf_dir, "supplier").select("s_suppkey", fmt.sid_text(F.unhex(F.concat(F.lit("0102000000000005" + "20000000"), le))).alias("sid"))


def hex_lower(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_nationkey", fmt.hex_lower(F.col("n_name").cast("binary")).alias("hex"))


def hexint(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", fmt.hex_int("o_orderkey").alias("hex"))


def le_ints(spark, sf_dir):
    back = F.concat(*[F.substring(F.lpad(F.hex(F.expr("o_custkey - 500")), 16, "0"), k, 2) for k in range(15, 0, -2)])
    raw = F.unhex(back)
    return _table(spark, sf_dir, "orders").select("o_orderkey", fmt.le_signed(raw, 0, 8).alias("i64"), fmt.le_unsigned(raw, 0, 2).alias("u16"))


def reals(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", fmt.real_text("o_totalprice").cast("double").alias("value"), F.instr(fmt.real_text("o_totalprice"), "E").cast("long").alias("exponent_at"))


def array_join_text(spark, sf_dir):
    names = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return names.select("n_regionkey", fmt.array_text("names", strings=True).alias("text"), fmt.array_text("names", attribute=True, strings=True).alias("attribute"))


def _typed_chunks(spark, sf_dir):
    template = Element("Event", {}, [Element("Type", {}, [(0, STRING)]), Element("User", {}, [(1, INT64)])])
    rows = _table(spark, sf_dir, "events").select("event_id", F.lit(None).cast("long").alias("ticks"), "user_id", "event_type")
    return encoded(rows, template, lambda r: [(STRING, r["event_type"]), (INT64, r["user_id"])])


def _compact(xml):
    return F.regexp_replace(xml, r"\n *", "")


def template_expand_relational(spark, sf_dir):
    """A log's templates and their uses as two tables, joined on (path, chunk, definition), and on the substitutions' positions."""
    parsed = table(tokens.parse(_typed_chunks(spark, sf_dir)), "parsed")
    got = rec.expand_templates(tokens.template_tokens(parsed), tokens.template_values(parsed))
    ids = tokens.uses(parsed).select(F.struct("path", "chunk_index", "use.ordinal").alias("record"), F.col("use.event_record_id").alias("event_id"))
    return got.join(ids, "record").select("event_id", F.col("text").alias("xml"))


def template_expand_all(spark, sf_dir):
    """The same without a shuffle: each template's uses lie with it."""
    rows, deepest = tokens.trees(_typed_chunks(spark, sf_dir))
    return tokens.fold(rows, deepest, "xml", "xml").select(F.col("event_record_id").alias("event_id"), _compact("xml").alias("xml"))


def _nested_chunks(spark, sf_dir):
    """Events whose values hold binary XML: in an attribute, and three levels deep, the last as an element without template."""
    outer = Element("Event", {}, [Element("EventData", {"tag": (0, BINXML)}, [Element("Data", {"Name": "user_id"}, [(1, INT64)]), (2, BINXML), Element("After")])])
    note = Element("Note", {}, [(0, STRING)])
    second = Element("Second", {"n": (0, INT64)}, ["before", (1, BINXML)])
    third = Element("Third", {"held": (0, BINXML)}, [(1, BINXML), "end"])

    def values(r):
        plain = lambda at: Element("Plain", {}, [r["event_type"]]).encode(at) + b"\x00"
        last = lambda at: instance(third, [(BINXML, lambda at: instance(note, [(STRING, value_bytes(STRING, "held"))], at, None)), (BINXML, plain)], at, None)

        def two(at):
            first = instance(second, [(INT64, value_bytes(INT64, r["event_id"])), (BINXML, last)], at, None)
            return first + plain(at + len(first))

        return [(BINXML, lambda at: instance(note, [(STRING, value_bytes(STRING, r["event_type"]))], at, None)), (INT64, r["user_id"]), (BINXML, two if r["event_id"] % 3 else b"")]

    return encoded(event_rows(spark, sf_dir), outer, values)


def nested_splice(spark, sf_dir):
    """Nested binary XML put in place at all levels; what an attribute holds comes after the element's children."""
    return tokens.events(_nested_chunks(spark, sf_dir), json=False).select("event_record_id", _compact("xml").alias("xml"))


def nested_json(spark, sf_dir):
    """The same events as JSON."""
    return tokens.events(_nested_chunks(spark, sf_dir), xml=False).select("event_record_id", "json")


def json_mixed(spark, sf_dir):
    """Repeated children, text between elements, attributes and empty elements: a tree folded from its leaves."""
    template = Element("Event", {"v": "1"}, [Element("A", {}, ["x", (0, INT64), Element("B", {}, [(1, STRING)]), "y", Element("B", {"k": (0, INT64)})]), Element("C"), Element("A", {}, ["z"]), "tail", Element("C", {}, [Element("D")])])
    rows, deepest = tokens.trees(encoded(event_rows(spark, sf_dir), template, lambda r: [(INT64, r["event_id"]), (STRING, r["props"])]))
    return tokens.fold(rows, deepest, "json", "json").select("event_record_id", "json")


def recover_slack(spark, sf_dir):
    """All events once, though part of them has to be recovered.

    The last record of each chunk lies in free space, every third chunk lost its signature, and further chunks hold all
    records again, but only in free space: these are former versions of what is live or found elsewhere.
    """
    chunks = table(event_chunks(spark, sf_dir, spread=False), "chunks")
    last = F.concat(F.substring("data", 1, 48), F.substring("data", 45, 4), F.substring("data", 53, 65536))
    lost = F.concat(F.lit(bytearray(8)), F.substring("data", 9, 65536))
    empty = F.concat(F.substring("data", 1, 48), F.lit(bytearray(b"\x00\x02\x00\x00")), F.substring("data", 53, 65536))
    damaged = chunks.select("path", "chunk_index", F.when(F.col("chunk_index") % 3 == 2, lost).otherwise(last).alias("data"))
    damaged = damaged.unionAll(chunks.select("path", F.col("chunk_index") + 100_000, empty.alias("data")))
    live = tokens.decode_tables(damaged.where(F.substring("data", 1, 8) == F.lit(bytearray(b"ElfChnk\0"))), xml=False, json=False)
    found = live.unionByName(recovery.recover(damaged, checksums=False).drop("origin"))
    return typed(found).select("event_record_id", "event_type", "user_id")


def dirty_files(spark, sf_dir):
    """Files whose headers count one chunk: the others are found by the files' sizes, and belong to them as they go on."""
    chunks = chunk_index.load(spark, event_files(spark, sf_dir, dirty=True), extra=True)
    return typed(rec.decode(chunks, xml=False, json=False)).select("event_record_id", "event_type", "value")


def indexed_ids(spark, sf_dir):
    """Records of a range of ids, through a table of chunks that leaves the others unread."""
    index = table(chunk_index.build(spark, event_files(spark, sf_dir)), "index")
    chunks = chunk_index.read(chunk_index.pruned(chunk_index.in_file(index), ids=(200, 399)))
    return typed(rec.decode(chunks, xml=False, json=False)).where("event_record_id BETWEEN 200 AND 399").select("event_record_id", "event_type", "props")


def indexed_times(spark, sf_dir):
    """Records of a span of time, through the same table."""
    index = table(chunk_index.build(spark, event_files(spark, sf_dir)), "index")
    low, high = EPOCH_TICKS + 1_704_672_000 * 10_000_000, EPOCH_TICKS + 1_704_844_800 * 10_000_000
    chunks = chunk_index.read(chunk_index.pruned(chunk_index.in_file(index), ticks=(low, high)))
    return typed(rec.decode(chunks, xml=False, json=False)).where(F.col("timestamp_filetime").between(low, high)).select("event_record_id", "timestamp_filetime", "event_type")


def asof_view(spark, sf_dir):
    """Each purchase with the user's last view before it."""
    events = _events(spark, sf_dir).select("event_record_id", "timestamp_filetime", "user_id", "event_type")
    views = events.where("event_type = 'view'").select("user_id", "timestamp_filetime", F.col("event_record_id").alias("view_id"))
    got = asof_join(events.where("event_type = 'purchase'").drop("event_type"), views, "user_id", "timestamp_filetime", "view_id", 24 * 3600 * 10_000_000)
    return got.select("event_record_id", "user_id", F.col("match.view_id").alias("view_id"), (F.col("timestamp_filetime") - F.col("match.timestamp_filetime")).alias("ticks"))


def session_errors(spark, sf_dir):
    """Sessions (from a signup to the user's next purchase) with the errors that fall into them."""
    events = _events(spark, sf_dir).select("event_record_id", "timestamp_filetime", "user_id", "event_type")
    of_user = Window.partitionBy("user_id").orderBy("timestamp_filetime", "event_record_id").rowsBetween(1, Window.unboundedFollowing)
    out = F.min(F.when(F.col("event_type") == "purchase", F.col("timestamp_filetime"))).over(of_user)
    sessions = events.withColumn("purchase", out).where("event_type = 'signup' AND purchase IS NOT NULL").select("user_id", F.col("event_record_id").alias("signup_id"), F.col("timestamp_filetime").alias("signup"), "purchase")
    errors = events.where("event_type = 'error'").select("user_id", F.col("event_record_id").alias("error_id"), F.col("timestamp_filetime").alias("at"))
    return interval_join(sessions, errors, "user_id", "signup", "purchase", "at").select("signup_id", "error_id", "user_id")


def xml_fold(spark, sf_dir):
    """As render_xml, from the tables."""
    return tokens.decode_tables(event_chunks(spark, sf_dir), json=False).select("event_record_id", _compact("xml").alias("xml"))


def json_fold(spark, sf_dir):
    """As render_jsonl, from the tables."""
    return _json_fields(tokens.decode_tables(event_chunks(spark, sf_dir), xml=False))


def render_xml(spark, sf_dir):
    got = rec.decode(event_chunks(spark, sf_dir), json=False)
    return got.select("event_record_id", F.regexp_replace("xml", r"\n *", "").alias("xml"))


def _json_fields(got):
    field = lambda path: F.get_json_object("json", path)
    return got.select(
        field("$.event_record_id").cast("long").alias("event_id"),
        field("$.timestamp_filetime").cast("long").alias("ticks"),
        field("$.Event.System.TimeCreated.@SystemTime").alias("system_time"),
        field("$.Event.EventData.Data[1].#text").alias("event_type"),
        field("$.Event.EventData.Data[3].#text").alias("props"),
    )


def render_jsonl(spark, sf_dir):
    return _json_fields(rec.decode(event_chunks(spark, sf_dir), xml=False))


def events_by_type(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("user_id").alias("users"))


def hourly(spark, sf_dir):
    hour = F.date_trunc("hour", fmt.filetime_timestamp("timestamp_filetime"))
    return _events(spark, sf_dir).groupBy(F.date_format(hour, "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("n"))


def sessionize(spark, sf_dir):
    """Sessions of a user end with a gap of over 30 minutes."""
    w = Window.partitionBy("user_id").orderBy("timestamp_filetime", "event_record_id")
    gap = F.col("timestamp_filetime") - F.lag("timestamp_filetime").over(w)
    marked = _events(spark, sf_dir).withColumn("new", F.when(gap.isNull() | (gap > 30 * 60 * 10_000_000), 1).otherwise(0))
    return marked.groupBy("user_id").agg(F.sum("new").alias("sessions"), F.count("*").alias("events"))


def record_diff(spark, sf_dir):
    """The events against a log with its elements in another order, without errors and with signups twice: just those differ."""
    rows = event_rows(spark, sf_dir).where("event_type IS NULL OR event_type <> 'error'").withColumn("time", F.explode(F.expr("sequence(1, IF(event_type = 'signup', 2, 1))"))).drop("time")
    system, data = TEMPLATE.content
    turned = Element(TEMPLATE.name, TEMPLATE.attributes, [data, Element(system.name, system.attributes, system.content[::-1])])
    sides = [rec.decode(chunks, xml=False).withColumn("canonical", canonical_json(F.col("json"))) for chunks in (event_chunks(spark, sf_dir), encoded(rows, turned, event_values))]
    return log_diff(*sides, "canonical", "event_record_id").select(F.col("id").alias("event_record_id"), "left_n", "right_n")


def login_sessions(spark, sf_dir):
    """Users' sessions with their logins and logouts, as the stream gives them."""
    found = user_sessions(_events(spark, sf_dir).withColumn("written", fmt.filetime_timestamp("timestamp_filetime")))
    micros = lambda c: F.unix_micros(c).alias(c)
    return found.select("user_id", micros("start"), micros("login"), micros("logout"), "n")


def records_in_sql(spark, sf_dir):
    """Chunks decoded by a table function in SQL."""
    register_tables(spark)
    view = f"chunks_{uuid.uuid4().hex}"
    event_chunks(spark, sf_dir).createOrReplaceTempView(view)
    return spark.sql(f"SELECT r.event_record_id, r.timestamp_filetime, r.data['event_type'] AS event_type, CAST(r.data['user_id'] AS BIGINT) AS user_id FROM {view} c, LATERAL eventlog_records(c.data) r WHERE r.error IS NULL")


def top_users(spark, sf_dir):
    per_user = _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return per_user.orderBy(F.desc("n"), "user_id").limit(20)


SYSTEM_XML = "'<Event xmlns=\"http://schemas.microsoft.com/win/2004/08/events/event\"><System><Provider Name=\"logquarry\"></Provider><EventID>'"
CODE = "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'logout' THEN 5 WHEN 'login' THEN 6 WHEN 'error' THEN 7 WHEN 'search' THEN 8 ELSE 0 END"
ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"
LOOSE = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.250000Z'"

QUERIES = {
    "scan_records": (scan_records, f"SELECT event_id AS event_record_id, {TICKS} AS timestamp_filetime, {ISO} AS iso_time, event_type, user_id, value, props FROM events"),
    "offset_limit": (offset_limit, "SELECT event_id AS event_record_id, event_type FROM events ORDER BY event_id LIMIT 20 OFFSET 7"),
    "limit_across_chunks": (limit_across_chunks, "SELECT event_id AS event_record_id, event_type FROM events ORDER BY event_id LIMIT 700 OFFSET 150"),
    "crc_ok": (crc_ok, "SELECT true AS all_ok, count(*) > 0 AS any_chunk FROM events"),
    "crc_drop_corrupt_chunk": (crc_drop_corrupt_chunk, "SELECT CAST(0 AS BIGINT) AS damaged_kept"),
    "record_by_id": (record_by_id, "SELECT event_id AS event_record_id, event_type, user_id FROM events WHERE event_id = 42"),
    "load_file": (load_file, f"SELECT event_id AS event_record_id, {TICKS} AS timestamp_filetime, event_type, user_id, value, props FROM events"),
    "load_file_ranges": (load_file_ranges, "SELECT event_id AS event_record_id, event_type FROM events"),
    "load_file_slice": (load_file_slice, "SELECT event_id AS event_record_id, event_type FROM events ORDER BY event_id LIMIT 500 OFFSET 333"),
    "file_headers": (file_headers, "SELECT CAST(0 AS BIGINT) AS damaged, count(*) > 0 AS any_file FROM events"),
    "drop_damaged_chunks": (drop_damaged_chunks, "SELECT event_id AS event_record_id, event_type, props FROM events"),
    "sink_jsonl": (sink_jsonl, f"SELECT event_id AS event_record_id, {TICKS} AS timestamp_filetime, {CODE} AS code, 'Application' AS channel FROM events"),
    "sink_xml": (sink_xml, "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "render_layout": (render_layout, "SELECT event_id AS event_record_id, CAST(15 AS BIGINT) AS n_lines, CAST(2 AS BIGINT) AS indent_0, CAST(4 AS BIGINT) AS indent_2, CAST(9 AS BIGINT) AS indent_4 FROM events"),
    "json_child_grouping": (json_child_grouping, "SELECT event_id AS event_record_id, 'Application' AS channel, 'user_id,event_type,value,props' AS names, user_id FROM events"),
    "value_types": (value_types, """SELECT event_id AS event_record_id, CAST(event_id % 100 - 50 AS VARCHAR) AS t03, CAST(event_id % 200 AS VARCHAR) AS t04, CAST(event_id % 1000 - 500 AS VARCHAR) AS t05, CAST(event_id % 1000 AS VARCHAR) AS t06, CAST(-event_id AS VARCHAR) AS t07, CAST(event_id AS VARCHAR) AS t08, CAST(-event_id AS VARCHAR) AS t09, CAST(event_id AS VARCHAR) AS t0a, CASE WHEN event_id % 2 = 1 THEN 'true' ELSE 'false' END AS t0d, '0x' || printf('%X', event_id) AS t14, '0x' || printf('%X', event_id) AS t15, lpad(lower(to_hex(event_id % 256)), 2, '0') || '00' AS t0e, '{' || lpad(lower(to_hex(event_id)), 8, '0') || '-0001-0002-0001-020304050607}' AS t0f, 'S-1-5-32-' || event_id AS t13, 'café ' || event_id AS t02 FROM events"""),
    "optional_null": (optional_null, "SELECT event_id AS event_record_id, CAST(user_id AS VARCHAR) AS plain, CASE WHEN event_id % 2 = 1 THEN event_type ELSE '' END AS optional FROM events"),
    "array_decode": (array_decode, "SELECT event_id AS event_record_id, event_type || ',n' || event_id AS texts, event_id || ' 7 9' AS numbers FROM events"),
    "wide_pairs": (wide_pairs, "SELECT event_id AS event_record_id, lead(event_id) OVER w AS next_id, lead(event_type) OVER w AS next_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "sql_view": (sql_view, "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'"),
    "filetime_iso": (filetime_iso, f"SELECT event_id, {ISO} AS iso FROM events"),
    "systemtime_iso": (systemtime_iso, "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM events"),
    "systemtime_normalise": (systemtime_normalise, f"SELECT event_id, {LOOSE} AS iso FROM events"),
    "xml_escape": (xml_escape, "SELECT o_orderkey, '&lt;a b=&quot;&apos;&amp;' || o_orderpriority || '&gt;' AS xml FROM orders"),
    "json_escape": (json_escape, "SELECT event_id, CAST(to_json(props || chr(9) || '/' || chr(10)) AS VARCHAR) AS json FROM events"),
    "utf16_roundtrip": (utf16_roundtrip, "SELECT c_custkey, c_name || ' é€' AS name FROM customer"),
    "cp1252_decode": (cp1252_decode, "SELECT CAST(i AS BIGINT) AS id, CASE WHEN i >= 160 THEN chr(CAST(i AS INT)) ELSE substring('" + fmt.CP1252_HIGH + "', CAST(i - 127 AS INT), 1) END AS text FROM range(128, 256) t(i)"),
    "guid_format": (guid_format, "SELECT o_orderkey, '{00000000-0000-0000-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '}' AS guid FROM (SELECT o_orderkey, lpad(lower(to_hex(o_orderkey)), 32, '0') AS h FROM orders)"),
    "sid_format": (sid_format, "SELECT s_suppkey, 'S-1-5-32-' || s_suppkey AS sid FROM supplier"),
    "hex_lower": (hex_lower, "SELECT n_nationkey, lower(hex(encode(n_name))) AS hex FROM nation"),
    "hexint": (hexint, "SELECT o_orderkey, '0x' || printf('%X', o_orderkey) AS hex FROM orders"),
    "le_ints": (le_ints, "SELECT o_orderkey, o_custkey - 500 AS i64, (o_custkey - 500 + 65536) % 65536 AS u16 FROM orders"),
    "reals": (reals, "SELECT o_orderkey, o_totalprice AS value, CAST(0 AS BIGINT) AS exponent_at FROM orders"),
    "array_join_text": (array_join_text, "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS text, string_agg(n_name, ' ' ORDER BY n_name) AS attribute FROM nation GROUP BY n_regionkey"),
    "template_expand_relational": (template_expand_relational, "SELECT event_id, '<Event><Type>' || event_type || '</Type><User>' || user_id || '</User></Event>' AS xml FROM events"),
    "template_expand_all": (template_expand_all, "SELECT event_id, '<Event><Type>' || event_type || '</Type><User>' || user_id || '</User></Event>' AS xml FROM events"),
    "recover_slack": (recover_slack, "SELECT event_id AS event_record_id, event_type, user_id FROM events"),
    "dirty_files": (dirty_files, "SELECT event_id AS event_record_id, event_type, value FROM events"),
    "indexed_ids": (indexed_ids, "SELECT event_id AS event_record_id, event_type, props FROM events WHERE event_id BETWEEN 200 AND 399"),
    "indexed_times": (indexed_times, f"SELECT event_id AS event_record_id, {TICKS} AS timestamp_filetime, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-10'"),
    "asof_view": (asof_view, f"SELECT e.event_id AS event_record_id, e.user_id, l.event_id AS view_id, epoch_us(e.ts) * 10 - epoch_us(l.ts) * 10 AS ticks FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') l ON e.user_id = l.user_id AND e.ts >= l.ts"),
    "session_errors": (session_errors, """WITH s AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS out_ts FROM events)
      SELECT s.event_id AS signup_id, e.event_id AS error_id, s.user_id FROM s JOIN events e ON e.user_id = s.user_id AND e.event_type = 'error' AND e.ts BETWEEN s.ts AND s.out_ts WHERE s.event_type = 'signup'"""),
    "nested_splice": (nested_splice, """SELECT event_id AS event_record_id, '<Event><EventData tag=""><Data Name="user_id">' || user_id || '</Data>' || CASE WHEN event_id % 3 = 0 THEN '' ELSE '<Second n="' || event_id || '">before<Third held=""><Plain>' || event_type || '</Plain>end<Note>held</Note></Third></Second><Plain>' || event_type || '</Plain>' END || '<After></After><Note>' || event_type || '</Note></EventData></Event>' AS xml FROM events"""),
    "nested_json": (nested_json, """SELECT event_id AS event_record_id, '{"EventData":{"@tag":"","Data":{"@Name":"user_id","#text":"' || user_id || '"},' || CASE WHEN event_id % 3 = 0 THEN '' ELSE '"Second":{"@n":"' || event_id || '","#text":"before","Third":{"@held":"","#text":"end","Plain":"' || event_type || '","Note":"held"}},"Plain":"' || event_type || '",' END || '"After":"","Note":"' || event_type || '"}}' AS json FROM events"""),
    "json_mixed": (json_mixed, """SELECT event_id AS event_record_id, '{"@v":"1","#text":"tail","A":[{"#text":"x' || event_id || 'y","B":[' || CAST(to_json(props) AS VARCHAR) || ',{"@k":"' || event_id || '"}]},"z"],"C":["",{"D":""}]}' AS json FROM events"""),
    "render_xml": (render_xml, f"""SELECT event_id AS event_record_id, {SYSTEM_XML} || {CODE} || '</EventID><TimeCreated SystemTime="' || {ISO} || '"></TimeCreated><Channel>Application</Channel><Computer>host</Computer></System><EventData><Data Name="user_id">' || user_id || '</Data><Data Name="event_type">' || event_type || '</Data><Data Name="value">' || CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END || '</Data><Data Name="props">' || replace(props, '"', '&quot;') || '</Data></EventData></Event>' AS xml FROM events"""),
    "render_jsonl": (render_jsonl, f"SELECT event_id, {TICKS} AS ticks, {ISO} AS system_time, event_type, props FROM events"),
    "events_by_type": (events_by_type, "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"),
    "hourly": (hourly, "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY 1"),
    "sessionize": (sessionize, "SELECT user_id, CAST(sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) AS BIGINT) AS sessions, count(*) AS events FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY user_id"),
    "top_users": (top_users, "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20"),
}
QUERIES |= {"xml_fold": (xml_fold, QUERIES["render_xml"][1]), "json_fold": (json_fold, QUERIES["render_jsonl"][1])}
QUERIES |= {
    "record_diff": (record_diff, "SELECT event_id AS event_record_id, CAST(1 AS BIGINT) AS left_n, CAST(CASE event_type WHEN 'error' THEN 0 ELSE 2 END AS BIGINT) AS right_n FROM events WHERE event_type IN ('error', 'signup')"),
    "login_sessions": (login_sessions, "WITH marked AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events), numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM marked) SELECT user_id, min(epoch_us(ts)) AS start, min(CASE WHEN event_type = 'login' THEN epoch_us(ts) END) AS login, max(CASE WHEN event_type = 'logout' THEN epoch_us(ts) END) AS logout, count(*) AS n FROM numbered GROUP BY user_id, k"),
    "records_in_sql": (records_in_sql, f"SELECT event_id AS event_record_id, {TICKS} AS timestamp_filetime, event_type, user_id FROM events"),
}
