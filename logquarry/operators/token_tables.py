"""Decoding as tables: templates and their uses, met without a shuffle; nested binary XML put in place; trees folded.

The helper in the tasks only cuts tokens: a chunk gives a row for each template that its records use (one for each set of
values that are absent), with the template's nodes in pre-order and all uses (the record's ids, and the types and bytes of
its values). A use meets its template where both lie, by exploding that row, so nothing is shuffled.

Values that hold binary XML are cut where they stand, as names and templates are their chunk's own: a row then is for one
sequence of templates and elements that hold each other, in parts, and a use has the values of all of them. Literal texts
of what is held count as values, so records that differ in them share a row.

What depends on the templates alone is made once a row, before uses are exploded: parts are merged by place to one tree,
the tree is folded to text with marks where values go, and its fields are found. A record then only turns its values into
text and joins the pieces. Templates that values can change otherwise have the trees of their records folded. All of that
is done with DataFrame functions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats as fmt
from ..sources import binxml
from ..sources.scratch import table
from .records import RECORD, frames

NODE = "struct<id: int, last: int, parent: int, depth: int, attribute: boolean, kind: string, name: string, type: int, subst: int, text: string, raw: binary, real: string, slot: int, clock: boolean>"
VALUE = "struct<type: int, raw: binary, real: string>"
USE = f"struct<ordinal: int, event_record_id: bigint, timestamp_filetime: bigint, values: array<{VALUE}>, error: string>"
#: `slot` is the place of a part in its record: [] of the record's own, else where the value that held it stands; `inside`
#: is the place of the element that the value stands in, and depth what its nodes' depths count from.
PART = f"struct<slot: array<int>, inside: array<int>, depth: int, nodes: array<{NODE}>>"
PARSED = f"path string, chunk_index int, template int, simple boolean, depth int, nodes array<{NODE}>, parts array<{PART}>, uses array<{USE}>"
KEY = ["path", "chunk_index", "ordinal"]
#: Second number of the place of what stood in an attribute (after the element's children), less the attribute's own.
IN_ATTRIBUTE = 1 << 30

NODE_TYPE = pa.struct([(n, t) for n, t in (("id", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("attribute", pa.bool_()), ("kind", pa.string()), ("name", pa.string()), ("type", pa.int32()), ("subst", pa.int32()), ("text", pa.string()), ("raw", pa.binary()), ("real", pa.string()), ("slot", pa.int32()), ("clock", pa.bool_()))])
VALUE_TYPE = pa.struct([("type", pa.int32()), ("raw", pa.binary()), ("real", pa.string())])
USE_TYPE = pa.struct([("ordinal", pa.int32()), ("event_record_id", pa.int64()), ("timestamp_filetime", pa.int64()), ("values", pa.list_(VALUE_TYPE)), ("error", pa.string())])
PART_TYPE = pa.struct([("slot", pa.list_(pa.int32())), ("inside", pa.list_(pa.int32())), ("depth", pa.int32()), ("nodes", pa.list_(NODE_TYPE))])
PARSED_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(NODE_TYPE), pa.list_(PART_TYPE), pa.list_(USE_TYPE)]
PARSED_NAMES = ["path", "chunk_index", "template", "simple", "depth", "nodes", "parts", "uses"]


REALS = (0x0B, 0x0C)
#: Stands around the numbers of values in texts of templates; templates that have it themselves aren't simple.
MARK = "\uf7f1"
#: Type of a literal text of what a value holds: it comes as text, in `real`.
LITERAL = 0x100


def real_of(kind: int, data: bytes) -> str | None:
    """A real or an array of reals as shortest decimal texts, which the JVM of today doesn't always find."""
    if kind & 0x7F not in REALS:
        return None
    items = binxml.array_items(kind & 0x7F, kind, data)
    return " ".join(binxml.value_text(kind & 0x7F, x) for x in items) if items else None


def simple(nodes: list[dict]) -> bool:
    """Whether texts of the template's values only go to places that they don't change."""

    def plain(n: dict) -> bool:
        if MARK in (n["name"] or "") or MARK in (n["text"] or ""):
            return False
        name = nodes[n["parent"]]["name"] if n["attribute"] else None
        alone = nodes[n["parent"]]["last"] == n["parent"] + 1 if n["attribute"] else True
        return n["slot"] is None or name != "Name" and (name != "SystemTime" or alone)

    return bool(nodes) and all(map(plain, nodes))


def shape(element: tuple, literals: list[tuple]) -> tuple:
    """What an element that a value holds has but for its literals, which are added to the list (type, start, end, text)
    in pre-order. Texts of attributes called Name aren't literals, since they name fields."""

    def token(n: tuple, name: str = "") -> tuple | int:
        if n[0] == binxml.ELEMENT:
            return shape(n[1], literals)
        if n[0] == binxml.TEXT and name != "Name":
            literals.append((LITERAL, 0, 0, n[1]))
            return n[0]
        if n[0] == binxml.VALUE:
            literals.append((*n[1:], None))
            return n[:2]
        return n

    return element[0], tuple((key, tuple(token(n, key) for n in nodes)) for key, nodes in element[1]), tuple(token(n) for n in element[2])


class Uses:
    """The templates of one chunk with what uses them; values that hold binary XML at most `deepest` levels deep."""

    def __init__(self, data: bytes, deepest: int = binxml.DEEPEST):
        self.chunk, self.found, self.pieces, self.deepest = binxml.Chunk(data), {}, {}, deepest

    def add(self, head: tuple, start: int, end: int) -> None:
        parts, values, key, errors = [], [], [], []
        self.cut([], [], 0, start, end, 0, parts, values, key, errors)
        if errors:
            parts, values, key = [], [], [-1]
        self.use(tuple(key), parts)["uses"].append((*head, values, max(errors, default=None)))

    def cut(self, slot: list[int], inside: list[int], depth: int, start: int, end: int, level: int, parts: list[tuple], values: list[tuple], key: list[int], errors: list[str]) -> None:
        """What stands between two places: its parts and values are added, and to the key what tells such parts from others."""
        try:
            if level > self.deepest:
                raise binxml.BadRecord("OutOfBounds")
            data = self.chunk.data
            for k, (template, element, spans) in enumerate(list(self.chunk.pieces(start, end, level == 0)) or ([(0, ("Event", [], []), [])] if level == 0 else [])):
                literals: list[tuple] = []
                like = shape(element, literals) if level else template
                absent = tuple([n for n, (kind, a, b) in enumerate(spans) if kind == 0 or a == b])
                piece = self.piece(like, template, element, len(spans), absent, level > 0)
                at = [*slot, k] if level else slot
                parts.append((at, inside, depth, piece, len(values)))
                key.append(piece["number"])
                # where a template wants an array of reals, it says which, whatever the value says of itself; what holds others is cut below
                reals, own = piece["reals"], piece["own"]
                for n, (kind, a, b) in enumerate(spans):
                    raw, wanted = data[a:b] if n not in own else b"", reals.get(n, kind)
                    values.append((kind, raw, real_of(wanted, raw) if wanted & 0x7F in REALS else None))
                for kind, a, b, text in literals:
                    raw = data[a:b]
                    values.append((kind, raw, real_of(kind, raw) if text is None else text))
                for place, n, span in piece["held"]:
                    first, last = span or (spans[n] if n < len(spans) else literals[n - len(spans)])[1:3]
                    self.cut([*at, *place["slot"]], [*at, place["element"]], depth + place["depth"], first, last, level + 1, parts, values, key, errors)
                    key.append(-1)
        except (ValueError, struct.error, IndexError, OverflowError, RecursionError) as e:
            errors.append(str(e) if isinstance(e, binxml.BadRecord) else "UnexpectedEof")

    def piece(self, like: tuple | int, template: int, element: tuple, n_values: int, absent: tuple[int, ...], held: bool) -> dict:
        """A template or element with the set of its values that are absent: its nodes, and which of them hold others."""
        known = like, n_values, absent
        if known not in self.pieces:
            nodes, slots, holding, literals = binxml.flat(element), 0, [], n_values
            for n in nodes:
                n["slot"], n["clock"], n["raw"], n["real"] = None, False, None, None
                name = nodes[n["parent"]]["name"] if n["attribute"] else None
                if held and (n["kind"] == "value" or n["kind"] == "text" and name != "Name"):
                    n["type"], n["text"] = LITERAL if n["kind"] == "text" else n["type"], None
                    n["kind"], n["subst"], literals = "subst", literals, literals + 1
                elif n["kind"] == "subst" and (n["subst"] in absent or n["subst"] >= n_values):
                    n["kind"] = "absent"
                if n["kind"] in ("value", "subst") and n["type"] & 0x7F == 0x21:
                    owner = nodes[n["parent"]]
                    around = nodes[owner["parent"]] if n["attribute"] else owner
                    # what an attribute holds comes after its element's children
                    place = {"slot": [around["last"], n["id"] + IN_ATTRIBUTE] if n["attribute"] else [n["id"]], "element": around["id"], "depth": around["depth"] + 1}
                    holding.append((place, n["subst"], None if n["kind"] == "subst" else (n["start"], n["start"] + n["size"])))
                    n["kind"] = "held"
                elif n["kind"] in ("value", "subst"):
                    if n["kind"] == "value":
                        n["raw"] = self.chunk.data[n["start"] : n["start"] + n["size"]]
                        n["real"] = real_of(n["type"], n["raw"])
                    n["slot"], n["clock"], slots = slots, n["attribute"] and name == "SystemTime", slots + 1
            reals = {n["subst"]: n["type"] for n in nodes if n["kind"] == "subst" and n["type"] & 0x80 and n["type"] & 0x7F in REALS}
            self.pieces[known] = {"number": len(self.pieces), "template": template, "nodes": nodes, "slots": slots, "held": holding, "own": {n for _, n, _ in holding}, "reals": reals}
        return self.pieces[known]

    def use(self, key: tuple[int, ...], parts: list[tuple]) -> dict:
        if key not in self.found:
            slots, listed = 0, []
            for slot, inside, depth, piece, first in parts:
                nodes = [n | {"slot": None if n["slot"] is None else n["slot"] + slots, "subst": None if n["subst"] is None else n["subst"] + first} for n in piece["nodes"]]
                slots += piece["slots"]
                listed.append({"slot": slot, "inside": inside, "depth": depth, "nodes": nodes})
            deepest = max((p["depth"] + n["depth"] for p in listed for n in p["nodes"]), default=0)
            self.found[key] = {"template": parts[0][3]["template"] if parts else -1, "simple": bool(parts) and all(simple(p["nodes"]) for p in listed), "depth": deepest, "nodes": listed[0]["nodes"] if listed else [], "parts": listed if len(listed) > 1 else [], "uses": []}
        return self.found[key]

    def batch(self, path: str, chunk_index: int) -> pa.RecordBatch:
        rows = list(self.found.values())
        uses = [u for r in rows for u in r["uses"]]
        values = columns_of(VALUE_TYPE, [v for u in uses for v in u[3]])
        columns = [pa.array([u[k] for u in uses], t.type) for k, t in enumerate(USE_TYPE) if k != 3]
        columns.insert(3, lists_of(values, [len(u[3]) for u in uses]))
        uses = lists_of(pa.StructArray.from_arrays(columns, fields=list(USE_TYPE)), [len(r["uses"]) for r in rows])
        columns = [[path] * len(rows), [chunk_index] * len(rows), *[[r[c] for r in rows] for c in PARSED_NAMES[2:-1]]]
        return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, PARSED_TYPES, strict=False)], uses], PARSED_NAMES)


def columns_of(kind: pa.StructType, rows: list[tuple]) -> pa.StructArray:
    columns = zip(*rows, strict=True) if rows else [()] * len(kind)
    return pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(columns, kind, strict=True)], fields=list(kind))


def lists_of(values: pa.Array, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), values)


def framed(data: bytes, at: int, size: int) -> tuple[int, int, int, int]:
    return (*struct.unpack_from("<QQ", data, at + 8), at + 24, at + size - 4)


def parse(chunks: DataFrame, record_id: int | None = None) -> DataFrame:
    """PARSED rows of chunks (path, chunk_index, data, and low and high if sliced): the templates of their records, each with
    its uses; of one record id only, if that is given. With a column places (array of structs with at and size), of the
    records there instead of those in their chain.

    Records that can't be cut are uses of template -1, with `error`; null data gives no row. An id or FILETIME of
    2 ** 63 or more is null, with error OutOfBounds.
    """
    sliced = ["low", "high"] if "low" in chunks.columns else []
    placed = ["places"] if "places" in chunks.columns else []
    deepest = binxml.DEEPEST

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index, data, *more in zip(*batch.columns, strict=True):
                if data.is_valid:
                    data, more = data.as_py(), [m.as_py() for m in more]
                    low, high = more[:2] if sliced else (0, len(data))
                    records = (framed(data, p["at"], p["size"]) for p in more[-1]) if placed else frames(data)
                    uses = Uses(data, deepest)
                    for k, (found, written, start, end) in enumerate(records):
                        if low <= k < high and record_id in (None, found):
                            uses.add((k, *(v if v < 1 << 63 else None for v in (found, written))), start, end)
                    yield uses.batch(path.as_py(), index.as_py())

    return chunks.select("path", "chunk_index", "data", *sliced, *placed).mapInArrow(cut, PARSED)


def templates(parsed: DataFrame) -> DataFrame:
    """(path, chunk_index, template, node): the nodes of every template in pre-order."""
    return parsed.where("template >= 0").select("path", "chunk_index", "template", F.explode("nodes").alias("node"))


def uses(parsed: DataFrame) -> DataFrame:
    """(path, chunk_index, template, use): what uses every template."""
    return parsed.select("path", "chunk_index", "template", F.explode("uses").alias("use"))


def template_tokens(parsed: DataFrame) -> DataFrame:
    """Templates as the tokens of records.expand_templates: (template, place, text, subst), tags and texts in order."""
    nodes = parsed.where("template >= 0").select(F.struct("path", "chunk_index", "template").alias("template"), "nodes", F.explode("nodes").alias("n"))
    n = F.col("n")
    # '>' comes after the last attribute, an end tag after the last node inside, the deeper first
    attributes = F.filter("nodes", lambda a: (a.parent == n.id) & (a.kind == "attribute"))
    opened = F.coalesce(F.array_max(F.transform(attributes, lambda a: a["last"])), n.id)

    def token(at: Column, order: Column | int, text: Column | str, subst: Column | None = None) -> Column:
        return F.struct(F.array(at, F.lit(order) if isinstance(order, int) else order).alias("place"), (F.lit(text) if isinstance(text, str) else text).alias("text"), (F.lit(None).cast("int") if subst is None else subst).alias("subst"))

    element = F.array(token(n.id, 0, F.concat(F.lit("<"), n["name"])), token(opened, 600, ">"), token(n["last"], 1000 - n.depth, F.concat(F.lit("</"), n["name"], F.lit(">"))))
    attribute = F.array(token(n.id, 0, F.concat(F.lit(" "), n["name"], F.lit('="'))), token(n["last"], 500, '"'))
    inside = F.array(token(n.id, 0, fmt.xml_escape(n.text), n.subst))
    tokens = F.when(n.kind == "element", element).when(n.kind == "attribute", attribute).otherwise(inside)
    return nodes.select("template", F.explode(tokens).alias("t")).select("template", "t.*")


def template_values(parsed: DataFrame) -> DataFrame:
    """The values of records.expand_templates: (record, template, position, value), as XML; without value null."""
    used = uses(parsed).where("use.error IS NULL").select(F.struct("path", "chunk_index", "use.ordinal").alias("record"), F.struct("path", "chunk_index", "template").alias("template"), F.posexplode("use.values").alias("position", "v"))
    return used.select("record", "template", "position", F.when(F.octet_length("v.raw") > 0, fmt.xml_escape(value_text(F.col("v.type"), F.col("v.raw"), F.col("v.real")))).alias("value"))


def let(value: Column, use) -> Column:
    """use(value), where value is evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_bytes(raw: Column, size: int, text: Column) -> Column:
    """The text of a value of fixed size; null of one that is too short."""
    return F.when(F.octet_length(raw) >= size, text)


def value_text(kind: Column, raw: Column, real: Column | None = None) -> Column:
    """A scalar value as text; null of one that is too short, '' of an unknown type; reals come as `real`."""
    ends = F.substring(raw, -2, 2) == F.lit(b"\0\0")
    text = fmt.utf16_lenient(F.when(ends & (F.octet_length(raw) >= 2), raw.substr(F.lit(1), F.octet_length(raw) - 2)).otherwise(raw))
    whole = F.when(kind == 0x10, F.concat(F.lit("0x"), fmt.le_hex(raw))).otherwise(F.conv(fmt.le_hex(raw), 16, 10))
    signed = {0x03: 1, 0x05: 2, 0x07: 4, 0x09: 8}
    unsigned = {0x04: 1, 0x06: 2, 0x08: 4, 0x0A: 8}
    out = F.when(kind == 0x01, text)
    for k, size in signed.items():
        out = out.when(kind == k, first_bytes(raw, size, fmt.le_signed(raw, 0, size).cast("string")))
    for k, size in unsigned.items():
        out = out.when(kind == k, first_bytes(raw, size, F.conv(fmt.le_hex(F.substring(raw, 1, size)), 16, 10)))
    two = [fmt.le_unsigned(raw, k, 2).cast("int") for k in (0, 2, 6, 8, 10, 12, 14)]
    return (
        out.when(kind.isin(*REALS), F.lit(None).cast("string") if real is None else F.substring_index(real, " ", 1))
        .when(kind == 0x0D, first_bytes(raw, 4, fmt.bool_text(raw)))
        .when(kind == 0x0F, first_bytes(raw, 16, fmt.guid_text(raw)))
        .when(kind == 0x11, first_bytes(raw, 8, F.regexp_replace(fmt.filetime_iso(fmt.le_unsigned(raw, 0, 8)), "^[+]", "")))
        .when(kind == 0x12, first_bytes(raw, 16, fmt.systemtime_iso(*two)))
        .when(kind == 0x13, first_bytes(raw, 8, fmt.sid_text(raw)))
        .when(kind.isin(0x14, 0x15), F.when((kind == 0x14) & (F.octet_length(raw) >= 4), F.concat(F.lit("0x"), fmt.le_hex(F.substring(raw, 1, 4)))).when((kind == 0x15) & (F.octet_length(raw) >= 8), F.concat(F.lit("0x"), fmt.le_hex(F.substring(raw, 1, 8)))))
        .when(kind == 0x02, F.regexp_replace(fmt.cp1252_text(raw), "\x00+$", ""))
        .when(kind.isin(0x0E, 0x23), fmt.hex_lower(raw))
        .when(kind.isin(0x10, 0x20) & F.octet_length(raw).isin(4, 8), whole)
        .otherwise("")
    )


#: Bytes of the items of arrays of numbers, by type (fixed values).
WIDTHS = {k: n for k, n in binxml.SIZES.items() if k not in (0x0B, 0x0C)}


def array_text(kind: Column, backing: Column, raw: Column, real: Column, attribute: Column) -> Column:
    """An array value as one text."""
    strings = kind.isin(0x01, 0x02)
    between = F.when(strings & ~attribute, ",").otherwise(" ")
    width = F.when(kind == 0x10, F.when(backing == 0x94, 4).when(backing == 0x95, 8))
    for n in sorted(set(WIDTHS.values())):
        width = width.when(kind.isin(*[k for k, m in WIDTHS.items() if m == n]), n)

    def items_of(width: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor(F.octet_length(raw) / width).cast("int") - 1)
        texts = F.transform(at, lambda i: let(raw.substr(i * width + 1, width), lambda item: value_text(kind, item)))
        return F.when(F.octet_length(raw) >= width, texts).otherwise(F.array().cast("array<string>"))

    numbers = let(width, items_of)
    # interior empty strings stay, what follows the last terminator only if it isn't empty
    text = F.when(kind == 0x01, fmt.utf16_lenient(raw)).otherwise(fmt.cp1252_text(raw))
    pieces = let(F.split(text, "\\x00", -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))
    sids = F.transform(fmt.sid_places(raw), lambda p: fmt.sid_text(raw.substr(p, F.octet_length(raw))))
    items = F.when(strings, pieces).when(kind == 0x13, sids).otherwise(numbers)
    return F.when(kind.isin(*REALS), F.coalesce(real, F.lit(""))).otherwise(F.call_function("array_join", items, between, F.lit("")))


def value_of(n: Column) -> Column:
    """(type, raw, real) of a substitution or a literal value."""
    return F.when(n.kind == "subst", F.get("values", n.subst)).otherwise(F.struct(n.type, n.raw, n.real))


def text_of(n: Column, v: Column) -> Column:
    """The text of a value where node n wants it; null of one that is too short."""
    base = n.type.bitwiseAND(0x7F)
    of = F.struct(base.alias("base"), F.when(base == 1, F.lit(1)).otherwise(v.type.bitwiseAND(0x7F)).alias("kind"), (n.type.bitwiseAND(0x80) != 0).alias("many"))
    return let(of, lambda o: F.when(v.type == LITERAL, v.real).when(o.many, array_text(o.base, v.type, v.raw, v.real, n.attribute)).otherwise(value_text(o.kind, v.raw, v.real)))


def spliced(parsed: DataFrame) -> DataFrame:
    """The nodes of all parts of a row as one tree: sorted by place, numbered anew. Once for all records of the row."""

    def placed(part: Column) -> Column:
        def node(n: Column) -> Column:
            inside = F.when(n.parent >= 0, F.concat(part["slot"], F.array(n.parent))).otherwise(part.inside)
            return F.struct(F.concat(part["slot"], F.array(n.id)).alias("at"), inside.alias("inside"), (part.depth + n.depth).alias("depth"), n.alias("n"))

        return F.transform(part.nodes, node)

    def numbered(found: Column) -> Column:
        def tree(places: Column) -> Column:
            def node(x: Column, i: Column) -> Column:
                parent = (F.coalesce(F.array_position(places, x.inside), F.lit(0)) - 1).cast("int")
                of = {"id": i, "last": F.size(found) - 1, "parent": parent, "depth": x.depth}
                return F.struct(*[of.get(c, x.n[c]).alias(c) for c in NODE_TYPE.names])

            return F.transform(found, node)

        return let(F.transform(found, lambda x: x.at), tree)

    # field by field, as the sort compares them; places differ
    return parsed.withColumn("nodes", F.when(F.size("parts") > 0, let(F.array_sort(F.flatten(F.transform("parts", placed))), numbered)).otherwise(F.col("nodes"))).drop("parts")


def expand(parsed: DataFrame) -> DataFrame:
    """A row for each use: its record's ids, error, and nodes in pre-order (id, last, parent, depth, kind, name, text).

    Substitutions become `text`; a value that is too short makes the error UnexpectedEof.
    """

    def placed(n: Column) -> Column:
        value = n.kind.isin("subst", "value")
        of = {"kind": F.when(value, "text").otherwise(n.kind), "text": F.when(value, let(value_of(n), lambda v: text_of(n, v))).otherwise(n.text)}
        return F.struct(*[of.get(c, n[c]).alias(c) for c in ("id", "last", "parent", "depth", "kind", "name", "text")])

    rows = spliced(parsed).select("path", "chunk_index", "nodes", F.explode("uses").alias("u")).select("path", "chunk_index", "nodes", "u.*")
    rows = rows.select(*KEY, "event_record_id", "timestamp_filetime", "error", F.transform("nodes", placed).alias("nodes"))
    short = F.exists("nodes", lambda n: (n.kind == "text") & n.text.isNull())
    huge = F.col("event_record_id").isNull() | F.col("timestamp_filetime").isNull()
    return rows.withColumn("error", F.coalesce("error", F.when(short, "UnexpectedEof"), F.when(huge, "OutOfBounds")))


def trees(chunks: DataFrame) -> tuple[DataFrame, int]:
    """A row for each record: KEY, its ids, error, and nodes as one tree in pre-order; and the depth of the deepest.

    No record needs a shuffle. Those with values that hold each other more than binxml.DEEPEST levels deep get the error
    OutOfBounds.
    """
    return trees_of(table(parse(chunks), "parsed"))


def trees_of(parsed: DataFrame) -> tuple[DataFrame, int]:
    return expand(parsed), parsed.agg(F.max("depth")).first()[0] or 0


def inner(nodes: Column, n: Column, *kinds: str) -> Column:
    """The nodes of these kinds right inside a node."""
    return F.filter(F.slice(nodes, n.id + 2, n["last"] - n.id), lambda c: (c.parent == n.id) & c.kind.isin(*kinds))


TEXTS = ("text", "charref", "entity", "cdata", "target", "data")


def plain(nodes: Column, n: Column) -> Column:
    return F.array_join(F.transform(inner(nodes, n, "text", "cdata"), lambda c: c.text), "", "")


FIELDS = ("provider", "channel", "computer", "event_id", "level")


def number(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{1,9}$"), text.cast("int"))


def fields(rows: DataFrame) -> DataFrame:
    """provider, channel, computer, event_id, level and data of trees, as records.decode has them."""
    rows = field_texts(rows)
    return rows.withColumns({"event_id": number(F.col("event_id")), "level": number(F.col("level"))})


def field_texts(rows: DataFrame) -> DataFrame:
    """The same with event_id and level as texts."""
    nodes = F.col("nodes")

    def leaf(e: Column) -> Column:
        names = F.filter(inner(nodes, e, "attribute"), lambda a: a["name"] == "Name")
        key = let(names, lambda found: F.when(F.size(found) > 0, plain(nodes, F.element_at(found, -1))))
        return F.struct(F.get(nodes, e.parent)["name"].alias("section"), e["name"].alias("name"), key.alias("key"), plain(nodes, e).alias("text"))

    rows = rows.withColumn("leaves", F.transform(F.filter("nodes", lambda n: (n.kind == "element") & (n.depth == 2)), leaf))

    def system(name: str, of: str) -> Column:
        found = F.filter("leaves", lambda x: (x.section == "System") & (x["name"] == name))
        return let(found, lambda f: F.when(F.size(f) > 0, F.element_at(f, -1)[of]))

    data = F.filter("leaves", lambda x: (x.section != "System") & ((x["name"] == "Data") | x.section.isin("EventData", "UserData")))
    none = F.create_map().cast("map<string,string>")

    def one_more(found: Column, x: Column) -> Column:
        key = F.coalesce(x.key, F.concat(x["name"], F.size(found).cast("string")))
        names = F.transform(F.sequence(F.lit(1), F.size(found) + 1), lambda k: F.when(k == 1, key).otherwise(F.concat(key, F.lit("."), k.cast("string"))))
        free = F.element_at(F.filter(names, lambda k: ~F.map_contains_key(found, k)), 1)
        return F.map_concat(found, F.create_map(free, x.text))

    def mapped(items: Column) -> Column:
        keys = F.transform(items, lambda x, i: F.coalesce(x.key, F.concat(x["name"], i.cast("string"))))
        distinct = F.map_from_arrays(keys, F.transform(items, lambda x: x.text))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), distinct).otherwise(F.aggregate(items, none, one_more))

    of = {"provider": system("Provider", "key"), "channel": system("Channel", "text"), "computer": system("Computer", "text"), "event_id": system("EventID", "text"), "level": system("Level", "text")}
    sound = F.col("error").isNull()
    return rows.select("*", *[F.when(sound, c).alias(name) for name, c in of.items()], F.when(sound, let(data, mapped)).alias("data")).drop("leaves")


def json_items(items: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in binxml.ENTITIES.items() for x in pair])
    one = lambda c: F.when(c.kind.isin("text", "cdata"), c.text).when(c.kind == "charref", F.concat(F.lit("&#"), c.text, F.lit(";"))).when(c.kind == "entity", F.coalesce(F.try_element_at(known, c.text), F.concat(F.lit("&"), c.text, F.lit(";")))).otherwise("")
    return fmt.json_escape(F.array_join(F.transform(items, one), ""))


def attribute_text(name: Column, value: Column) -> Column:
    return let(value, lambda v: F.when(name == "SystemTime", fmt.systemtime_normalise(v)).otherwise(v))


def json_own(nodes: Column, e: Column) -> Column:
    """What an element's JSON has of its own: `parts` (attributes, then text), and its text as a leaf's value."""

    def attribute(a: Column) -> Column:
        return F.concat(F.lit('"@'), fmt.json_escape(a["name"]), F.lit('":"'), attribute_text(a["name"], json_items(inner(nodes, a, *TEXTS))), F.lit('"'))

    def with_text(items: Column) -> Column:
        text = let(F.concat(F.lit('"'), json_items(items), F.lit('"')), lambda t: F.struct(F.when(F.size(items) > 0, F.array(F.concat(F.lit('"#text":'), t))).otherwise(F.array().cast("array<string>")).alias("parts"), t.alias("leaf")))
        return let(text, lambda t: F.struct(F.concat(F.transform(inner(nodes, e, "attribute"), attribute), t.parts).alias("parts"), F.size(inner(nodes, e, "attribute")).alias("n"), t.leaf.alias("leaf")))

    return let(inner(nodes, e, *TEXTS), with_text)


def json_of(own: Column, below: Column, depth: int) -> Column:
    """An element's JSON, given that of the elements inside it: attributes, text, and children by name in order of first appearance."""

    def named(name: Column) -> Column:
        same = F.transform(F.filter(below, lambda c: c["name"] == name), lambda c: c.shown)
        return F.concat(F.lit('"'), fmt.json_escape(name), F.lit('":'), let(same, lambda s: F.when(F.size(s) == 1, F.element_at(s, 1)).otherwise(F.concat(F.lit("["), F.array_join(s, ","), F.lit("]")))))

    parts = F.concat(own.parts, F.transform(F.array_distinct(F.transform(below, lambda c: c["name"])), named))
    leaf = (own.n == 0) & (F.size(below) == 0) & F.lit(depth > 0)
    return F.when(leaf, own.leaf).otherwise(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))


def xml_item(c: Column, attribute: bool) -> Column:
    escaped = fmt.xml_escape(c.text)
    cdata = escaped if attribute else F.concat(F.lit("<![CDATA["), c.text, F.lit("]]>"))
    return (
        F.when(c.kind == "text", escaped).when(c.kind == "cdata", cdata).when(c.kind == "charref", F.concat(F.lit("&#"), c.text, F.lit(";"))).when(c.kind == "entity", F.concat(F.lit("&"), c.text, F.lit(";")))
        .when(c.kind == "target", F.concat(F.lit("<?"), c.text)).otherwise(F.concat(F.lit(" "), c.text, F.lit("?>")))
    )


def xml_own(nodes: Column, e: Column) -> Column:
    """What an element's XML has of its own: `head` (name and attributes), and its text items, each with its node."""

    def attribute(a: Column) -> Column:
        value = F.array_join(F.transform(inner(nodes, a, *TEXTS), lambda c: xml_item(c, True)), "")
        return F.concat(F.lit(" "), a["name"], F.lit('="'), attribute_text(a["name"], value), F.lit('"'))

    items = F.transform(inner(nodes, e, *TEXTS), lambda c: F.struct(c.id.alias("id"), xml_item(c, False).alias("shown")))
    return F.struct(F.concat(e["name"], F.array_join(F.transform(inner(nodes, e, "attribute"), attribute), "")).alias("head"), items.alias("items"))


def xml_of(own: Column, below: Column, depth: int, name: Column) -> Column:
    """An element's XML, given that of the elements inside it; what is mixed with elements stands on lines of its own."""
    pad = " " * (2 * depth)
    text = F.array_join(F.transform(own["items"], lambda c: c.shown), "")
    lines = F.transform(own["items"], lambda c: F.struct(c.id.alias("id"), F.concat(F.lit(f"{pad}  "), c.shown, F.lit("\n")).alias("shown")))
    lines = F.array_sort(F.concat(lines, F.transform(below, lambda c: F.struct(c.id.alias("id"), c.shown.alias("shown")))))
    block = F.concat(F.lit("\n"), F.array_join(F.transform(lines, lambda c: c.shown), ""), F.lit(pad))
    return F.concat(F.lit(f"{pad}<"), own.head, F.lit(">"), F.when(F.size(below) == 0, text).otherwise(block), F.lit("</"), name, F.lit(">\n"))


def fold(rows: DataFrame, deepest: int, kind: str, name: str) -> DataFrame:
    """rows with column `name`: the tree as "json" or "xml", from the deepest elements up, one step a depth.

    What elements have of their own is made first; a step gives each element of its depth the texts of those right inside
    it, in order, and makes its text. Null of records with an error.
    """

    def own(e: Column) -> Column:
        of = (json_own if kind == "json" else xml_own)(F.col("nodes"), e)
        return F.struct(*[e[c].alias(c) for c in ("id", "parent", "depth", "name")], of.alias("of"))

    def step(depth: int):
        def one(under: Column, e: Column) -> Column:
            inside = F.filter(under, lambda u: u.parent == e.id)
            text = let(inside, lambda b: json_of(e.of, b, depth) if kind == "json" else xml_of(e.of, b, depth, e["name"]))
            return F.struct(e.id.alias("id"), e.parent.alias("parent"), e["name"].alias("name"), text.alias("shown"))

        elements = F.filter("own", lambda e: e.depth == depth)
        return lambda under: F.transform(elements, lambda e: one(under, e))

    elements = F.when(F.col("error").isNull(), F.filter("nodes", lambda n: n.kind == "element"))
    rows = rows.withColumn("own", F.transform(elements, own))
    rows = rows.withColumn("below", F.array().cast("array<struct<id: int, parent: int, name: string, shown: string>>"))
    for depth in range(deepest, -1, -1):
        rows = rows.withColumn("below", let(F.col("below"), step(depth)))
    return rows.withColumn(name, F.get("below", F.lit(0)).shown).drop("own", "below")


def fill(pieces: Column, texts: Column) -> Column:
    """Pieces of a template's text with values' texts at every second place, which has their number."""
    joined = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 0, p).otherwise(F.get(texts, p.cast("int")))), "")
    return F.when(F.size(pieces) == 1, F.element_at(pieces, 1)).otherwise(joined)


def compiled(parsed: DataFrame, xml: bool, json: bool) -> DataFrame:
    """Decoded records of simple templates: text, fields and places of values once a template, then the values of each use."""

    def marked(n: Column) -> Column:
        text = F.when(n["slot"].isNull(), n.text).otherwise(F.concat(F.lit(MARK), n["slot"].cast("string"), F.lit(MARK)))
        of = {"kind": F.when(n["slot"].isNull(), n.kind).otherwise("text"), "text": text}
        return F.struct(*[of.get(c, n[c]).alias(c) for c in ("id", "last", "parent", "depth", "kind", "name", "text")])

    slots = F.array_sort(F.transform(F.filter("nodes", lambda n: n["slot"].isNotNull()), lambda n: F.struct(*[n[c].alias(c) for c in ("slot", "attribute", "kind", "type", "subst", "raw", "real", "clock")])))
    rows = spliced(parsed).select("path", "chunk_index", "uses", slots.alias("slots"), F.transform("nodes", marked).alias("nodes"), F.lit(None).cast("string").alias("error"))
    deepest = parsed.agg(F.max("depth")).first()[0] or 0
    rows = field_texts(rows)
    kinds = [k for k, wanted in (("xml", xml), ("json", json)) if wanted]
    for kind in kinds:
        rows = fold(rows, deepest, kind, kind)
    pieces = {c: F.split(c, MARK, -1) for c in (*FIELDS, *kinds)}
    pieces |= {"keys": F.map_keys("data"), "items": F.transform(F.map_values("data"), lambda v: F.split(v, MARK, -1))}
    rows = rows.select("path", "chunk_index", "slots", *[c.alias(f"of_{name}") for name, c in pieces.items()], F.explode("uses").alias("u"))
    rows = rows.select("path", "chunk_index", *[f"of_{c}" for c in pieces], "slots", "u.*")

    def read(n: Column) -> Column:
        return let(let(value_of(n), lambda v: text_of(n, v)), lambda t: F.when(n.clock, fmt.systemtime_normalise(t)).otherwise(t))

    rows = rows.withColumn("texts", F.transform("slots", read))
    huge = F.col("event_record_id").isNull() | F.col("timestamp_filetime").isNull()
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.exists("texts", lambda t: t.isNull()), "UnexpectedEof"), F.when(huge, "OutOfBounds")))
    bad = F.exists("texts", lambda t: t.isNull())
    texts = F.col("texts")
    out = {c: fill(F.col(f"of_{c}"), texts) for c in FIELDS}
    out |= {c: number(out[c]) for c in ("event_id", "level")}
    out["data"] = F.map_from_arrays("of_keys", F.transform("of_items", lambda p: fill(p, texts)))
    if xml:
        out["xml"] = let(F.transform(texts, fmt.xml_escape), lambda t: fill(F.col("of_xml"), t))
    if json:
        out["json"] = let(F.transform(texts, fmt.json_escape), lambda t: fill(F.col("of_json"), t))
    return rows.select(*KEY, "event_record_id", "timestamp_filetime", *[F.when(~bad & ~huge, c).alias(name) for name, c in out.items()], "error")


def decode_tables(chunks: DataFrame, xml: bool = True, json: bool = True, record_id: int | None = None) -> DataFrame:
    """What records.decode gives, from the tables; in no certain order."""
    rows = events(chunks, xml, json, record_id)
    if json:
        head = F.concat(F.lit('{"event_record_id":'), F.col("event_record_id").cast("string"), F.lit(',"timestamp_filetime":'), F.col("timestamp_filetime").cast("string"), F.lit(',"Event":'))
        rows = rows.withColumn("json", F.concat(head, "json", F.lit("}")))
    return rows


def events(chunks: DataFrame, xml: bool = True, json: bool = True, record_id: int | None = None) -> DataFrame:
    """The same, but that json is the event's alone."""
    parsed = table(parse(chunks, record_id), "parsed")
    parts = [compiled(parsed.where("simple"), xml, json)]
    other = parsed.where("NOT simple")
    if not other.isEmpty():
        rows, deepest = trees_of(other)
        rows = fields(rows)
        for kind in [k for k, wanted in (("xml", xml), ("json", json)) if wanted]:
            rows = fold(rows, deepest, kind, kind)
        parts.append(rows)
    none = {name: F.lit(None).cast("string") for name, wanted in (("xml", xml), ("json", json)) if not wanted}
    whole = [rows.withColumns(none).select(*[f.split()[0] for f in RECORD.split(", ")]) for rows in parts]
    return whole[0] if len(whole) == 1 else whole[0].unionAll(whole[1])
