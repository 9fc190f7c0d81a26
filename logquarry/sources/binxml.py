"""Binary XML of one record: tokens to a tree, template values put in place, and the tree as XML or JSON text.

A helper that runs inside Spark tasks, one chunk at a time (names and templates are local to their chunk).
Elements are (name, attributes, children); other nodes are tuples that begin with their kind.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

TEXT, VALUE, SUBST, CHARREF, ENTITY, CDATA, TARGET, DATA, ELEMENT = range(9)
#: Bytes of values of fixed size, by type code (fixed values).
SIZES = {0x03: 1, 0x04: 1, 0x05: 2, 0x06: 2, 0x07: 4, 0x08: 4, 0x09: 8, 0x0A: 8, 0x0B: 4, 0x0C: 8, 0x0D: 4, 0x0F: 16, 0x11: 8, 0x12: 16, 0x14: 4, 0x15: 8}
INTS = {0x03: "<b", 0x04: "<B", 0x05: "<h", 0x06: "<H", 0x07: "<i", 0x08: "<I", 0x09: "<q", 0x0A: "<Q"}
EPOCH_TICKS = 116_444_736_000_000_000
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
XML = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"})
JSON = {c: f"\\u{c:04X}" for c in range(32)} | {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}
DEEPEST = 200
UINT = {1: struct.Struct("<B").unpack_from, 2: struct.Struct("<H").unpack_from, 4: struct.Struct("<I").unpack_from}


class BadRecord(ValueError):
    """UnexpectedEof, BadToken or OutOfBounds."""


def utf16(data: bytes) -> str:
    """UTF-16LE without lone surrogates."""
    return data[: len(data) & ~1].decode("utf-16-le", "ignore")


def filetime(ticks: int) -> str:
    micros = max(0, ticks - EPOCH_TICKS) // 10
    return str(np.datetime64(micros, "us")) + "Z"


def real(x: float, kind) -> str:
    if x != x:
        return "-1.#IND"
    if x in (float("inf"), float("-inf")):
        return "1.#INF" if x > 0 else "-1.#INF"
    return np.format_float_positional(kind(x), trim="-")


def value_text(kind: int, data: bytes) -> str:
    """A scalar value as text; too short ones raise."""
    if kind == 0x01:
        return utf16(data[:-2] if data[-2:] == b"\0\0" else data)
    if kind == 0x02:
        return "".join(chr(b) if b < 0x80 or b > 0x9F else bytes([b]).decode("cp1252", "replace") for b in data.rstrip(b"\0"))
    if kind in (0x0E, 0x23):
        return data.hex()
    if kind == 0x13:
        if len(data) < 8:
            raise BadRecord("UnexpectedEof")
        subs = struct.unpack_from(f"<{min(data[1], (len(data) - 8) // 4)}I", data, 8)
        return "-".join(map(str, ("S", data[0], int.from_bytes(data[2:8], "big"), *subs)))
    if kind in (0x10, 0x20):
        if len(data) not in (4, 8):
            return ""
        n = int.from_bytes(data, "little")
        return f"0x{n:X}" if kind == 0x10 else str(n)
    if kind not in SIZES:
        return ""
    if len(data) < SIZES[kind]:
        raise BadRecord("UnexpectedEof")
    if kind in INTS:
        return str(struct.unpack_from(INTS[kind], data)[0])
    if kind == 0x0B:
        return real(struct.unpack_from("<f", data)[0], np.float32)
    if kind == 0x0C:
        return real(struct.unpack_from("<d", data)[0], np.float64)
    if kind == 0x0D:
        return "true" if any(data[:4]) else "false"
    if kind == 0x0F:
        a, b, c = struct.unpack_from("<IHH", data)
        return f"{{{a:08x}-{b:04x}-{c:04x}-{data[8:10].hex()}-{data[10:16].hex()}}}"
    if kind == 0x11:
        return filetime(struct.unpack_from("<Q", data)[0])
    if kind == 0x12:
        y, mo, _, d, h, mi, s, ms = struct.unpack_from("<8H", data)
        return f"{y:04d}-{mo:02d}-{d:02d}T{h:02d}:{mi:02d}:{s:02d}.{ms:03d}Z"
    return f"0x{int.from_bytes(data[: SIZES[kind]], 'little'):X}"


def array_items(kind: int, backing: int, data: bytes) -> list[bytes]:
    """The items of an array value; a partial last one is left out."""
    if kind in (0x01, 0x02):
        width = 3 - kind
        items, start = [], 0
        for at in range(0, len(data) - width + 1, width):
            if not any(data[at : at + width]):
                items.append(data[start:at])
                start = at + width
        return items + ([data[start:]] if start < len(data) else [])
    if kind == 0x13:
        items, at = [], 0
        while at + 8 <= len(data) and at + 8 + 4 * data[at + 1] <= len(data):
            items.append(data[at : at + 8 + 4 * data[at + 1]])
            at += len(items[-1])
        return items
    size = {0x94: 4, 0x95: 8}.get(backing, 0) if kind == 0x10 else SIZES.get(kind, 0)
    return [data[k : k + size] for k in range(0, len(data) - size + 1, size)] if size else []


def system_time(text: str) -> str:
    """As functions.formats.systemtime_normalise."""
    s = text.replace("+", "")[:64]
    head, t, rest = s.partition("T")
    clock, z, _ = rest.rpartition("Z")
    date, time = head.split("-"), clock.split(":")
    if not t or not z or len(date) < 3 or len(time) < 3:
        return s
    second, _, fraction = time[2].partition(".")
    two = [p.zfill(2) if len(p) == 1 else p for p in (date[1], date[2], time[0], time[1], second)]
    return f"{date[0]}-{two[0]}-{two[1]}T{two[2]}:{two[3]}:{two[4]}" + (f".{fraction[:6]:0<6}" if fraction else "") + "Z"


class Chunk:
    """A chunk's bytes with its names and templates, each read once."""

    def __init__(self, data: bytes):
        self.data, self.names, self.templates = data, {}, {}

    def u(self, at: int, size: int, end: int | None = None) -> int:
        if at < 0 or at + size > (len(self.data) if end is None else end):
            raise BadRecord("UnexpectedEof")
        return UINT[size](self.data, at)[0]

    def name_at(self, offset: int) -> tuple[str, int]:
        """The name and the bytes that its block takes."""
        if offset not in self.names:
            if offset + 8 > len(self.data):
                raise BadRecord("OutOfBounds")
            n = self.u(offset + 6, 2)
            if offset + 8 + 2 * n > len(self.data):
                raise BadRecord("OutOfBounds")
            self.names[offset] = utf16(self.data[offset + 8 : offset + 8 + 2 * n]).rstrip("\0"), 10 + 2 * n
        return self.names[offset]

    def name(self, at: int, end: int) -> tuple[str, int]:
        """A name reference, with the block if it stands right there. -> (name, next position)"""
        offset = self.u(at, 4, end)
        name, size = self.name_at(offset)
        return name, at + 4 + (size if offset == at + 4 else 0)

    def root(self, at: int, end: int, depth: int = 0) -> tuple:
        """The first element of a fragment: read, or a template with its values in place."""
        roots = self.fragment(at, end, depth)
        return roots[0] if roots else ("Event", [], [])

    def fragment(self, at: int, end: int, depth: int) -> list[tuple]:
        out = []
        if depth > DEEPEST:
            raise BadRecord("OutOfBounds")
        while at < end:
            token = self.data[at] & 0x1F
            if token == 0x0F:
                at += 4
            elif token == 0x0C:
                element, at = self.instance(at, end, depth)
                out.append(element)
            elif token == 0x01:
                element, at = self.element(at, end, depth)
                out.append(self.expand(element, [], depth))
            elif token == 0 and out:
                break
            else:
                raise BadRecord("BadToken")
            if depth == 0 and out:
                break
        return out

    def template(self, offset: int, depth: int = 0) -> tuple:
        """The element of the template defined at this place of the chunk."""
        if offset not in self.templates:
            if offset + 24 > len(self.data):
                raise BadRecord("OutOfBounds")
            stop = offset + 24 + self.u(offset + 20, 4)
            if stop > len(self.data):
                raise BadRecord("OutOfBounds")
            body = offset + 24
            self.templates[offset] = self.element(body + 4 if self.data[body] == 0x0F else body, stop, depth)[0]
        return self.templates[offset]

    def parts(self, at: int, end: int, depth: int = 0) -> tuple[int, list[tuple[int, int, int]], int]:
        """Of a template's instance: the definition's place, (type, start, end) of its values, and the next position."""
        offset = self.u(at + 6, 4, end)
        at += 10
        if offset == at:  # the definition stands right here
            at += 24 + self.u(at + 20, 4, end)
        self.template(offset, depth)
        count = self.u(at, 4, end)
        at += 4
        if at + 4 * count > end:
            raise BadRecord("UnexpectedEof")
        heads = struct.iter_unpack("<HBx", self.data[at : at + 4 * count])
        at += 4 * count
        values = []
        for size, kind in heads:
            if at + size > end:
                raise BadRecord("UnexpectedEof")
            values.append((kind, at, at + size))
            at += size
        return offset, values, at

    def instance(self, at: int, end: int, depth: int) -> tuple[tuple, int]:
        offset, values, at = self.parts(at, end, depth)
        return self.expand(self.templates[offset], values, depth), at

    def pieces(self, at: int, end: int, first: bool) -> Iterator[tuple[int, tuple, list[tuple[int, int, int]]]]:
        """The roots of a fragment, nothing put in place: (place of the definition or element, element, values)."""
        found = False
        while at < end and not (first and found):
            token = self.data[at] & 0x1F
            if token == 0x0F:
                at += 4
            elif token == 0x0C:
                offset, values, at = self.parts(at, end)
                found = True
                yield offset, self.templates[offset], values
            elif token == 0x01:
                start = at
                element, at = self.element(at, end, 0)
                found = True
                yield start, element, []
            elif token == 0 and found:
                return
            else:
                raise BadRecord("BadToken")

    def element(self, at: int, end: int, depth: int) -> tuple[tuple, int]:
        if depth > DEEPEST:
            raise BadRecord("OutOfBounds")
        token = self.data[at]
        if token & 0x1F != 0x01:
            raise BadRecord("BadToken")
        stop = at + 7 + self.u(at + 3, 4, end)
        if stop <= end:
            at += 7
        else:  # without the dependency id
            stop = at + 5 + self.u(at + 1, 4, end)
            at += 5
        if stop > end:
            raise BadRecord("UnexpectedEof")
        name, at = self.name(at, stop)
        attributes, children = [], []
        if token & 0x40:
            last = at + 4 + self.u(at, 4, stop)
            if last > stop:
                raise BadRecord("UnexpectedEof")
            at += 4
            while at < last and self.data[at] & 0x1F == 0x06:
                key, at = self.name(at + 1, last)
                nodes, at = self.values(at, last)
                attributes.append((key, nodes))
            at = last
        pads = 0
        while pads < 4 and at < stop and self.data[at] == 0:
            at, pads = at + 1, pads + 1
        if at >= stop or self.data[at] & 0x1F == 0x03:
            return (name, attributes, children), stop if at >= stop else at + 1
        if self.data[at] & 0x1F != 0x02:
            raise BadRecord("BadToken")
        at += 1
        while at < stop:
            token = self.data[at] & 0x1F
            if token == 0x04:
                at += 1
                break
            if token == 0x01:
                child, at = self.element(at, stop, depth + 1)
                children.append((ELEMENT, child))
            else:
                nodes, after = self.values(at, stop)
                if after == at:
                    break
                children += nodes
                at = after
        return (name, attributes, children), at

    def text(self, at: int, end: int) -> tuple[str, int]:
        n = self.u(at, 2, end)
        if at + 2 + 2 * n > end:
            raise BadRecord("UnexpectedEof")
        return utf16(self.data[at + 2 : at + 2 + 2 * n]), at + 2 + 2 * n

    def values(self, at: int, end: int) -> tuple[list[tuple], int]:
        out: list[tuple] = []
        while at < end:
            token = self.data[at] & 0x1F
            if token == 0x05:
                kind = self.u(at + 1, 1, end)
                at += 2
                if kind == 0x01:
                    text, at = self.text(at, end)
                    out.append((TEXT, text))
                    continue
                if kind in (0x02, 0x0E) or kind & 0x7F == 0x21:
                    start, size = at + 2, self.u(at, 2, end)
                elif kind == 0x13:
                    start, size = at, 8 + 4 * self.u(at + 1, 1, end)
                elif kind in SIZES:
                    start, size = at, SIZES[kind]
                else:
                    raise BadRecord("BadToken")
                if start + size > end:
                    raise BadRecord("UnexpectedEof")
                out.append((VALUE, kind, start, start + size))
                at = start + size
            elif token in (0x0D, 0x0E):
                out.append((SUBST, self.u(at + 1, 2, end), self.u(at + 3, 1, end)))
                at += 4
            elif token == 0x08:
                out.append((CHARREF, self.u(at + 1, 2, end)))
                at += 3
            elif token in (0x09, 0x0A):
                name, at = self.name(at + 1, end)
                out.append((ENTITY if token == 0x09 else TARGET, name))
            elif token in (0x07, 0x0B):
                text, at = self.text(at + 1, end)
                out.append((CDATA if token == 0x07 else DATA, text))
            else:
                break
        return out, at

    def expand(self, element: tuple, values: list[tuple], depth: int) -> tuple:
        """The element with its substitutions replaced and nested binary XML in place, at all depths."""
        name, attributes, children = element
        done = [(key, [y for x in nodes for y in self.node(x, values, True, depth)]) for key, nodes in attributes]
        inner = [y for x in children for y in self.node(x, values, False, depth)]
        # elements that an attribute's value holds come after the children
        inner += [y for _, nodes in done for y in nodes if y[0] == ELEMENT]
        return name, [(key, [y for y in nodes if y[0] != ELEMENT]) for key, nodes in done], inner

    def node(self, node: tuple, values: list[tuple], attribute: bool, depth: int) -> list[tuple]:
        if node[0] == ELEMENT:
            return [(ELEMENT, self.expand(node[1], values, depth))]
        if node[0] == VALUE:
            return self.value(node[1], node[1], node[2], node[3], attribute, depth)
        if node[0] != SUBST:
            return [node]
        if node[1] >= len(values):
            return []
        kind, start, end = values[node[1]]
        if kind == 0 or start == end:
            return []
        return self.value(node[2], kind, start, end, attribute, depth)

    def value(self, wanted: int, kind: int, start: int, end: int, attribute: bool, depth: int) -> list[tuple]:
        data, base = self.data[start:end], wanted & 0x7F
        if base == 0x21:
            return [(ELEMENT, e) for e in self.fragment(start, end, depth + 1)]
        if wanted & 0x80:
            between = "," if base in (1, 2) and not attribute else " "
            return [(TEXT, between.join(value_text(base, x) for x in array_items(base, kind, data)))]
        return [(TEXT, value_text(0x01 if base == 0x01 else kind & 0x7F, data))]


#: Names of the nodes other than elements and attributes, by kind.
KINDS = ("text", "value", "subst", "charref", "entity", "cdata", "target", "data")


def flat(element: tuple) -> list[dict]:
    """The element's nodes in pre-order: an element, its attributes with their items, its children.

    `last` is the last node inside, `parent` the element (or, of an attribute's item, the attribute), -1 of the root.
    """
    out: list[dict] = []

    def add(parent: int, depth: int, attribute: bool, kind: str, **more) -> dict:
        node = {"id": len(out), "last": len(out), "parent": parent, "depth": depth, "attribute": attribute, "kind": kind, "name": None, "type": None, "subst": None, "text": None, "start": None, "size": None} | more
        out.append(node)
        return node

    def item(node: tuple, parent: int, depth: int, attribute: bool) -> None:
        kind = KINDS[node[0]]
        if kind == "value":
            add(parent, depth, attribute, kind, type=node[1], start=node[2], size=node[3] - node[2])
        elif kind == "subst":
            add(parent, depth, attribute, kind, subst=node[1], type=node[2])
        else:
            add(parent, depth, attribute, kind, text=str(node[1]))

    def walk(element: tuple, parent: int, depth: int) -> None:
        own = add(parent, depth, False, "element", name=element[0])
        for key, nodes in element[1]:
            attribute = add(own["id"], depth + 1, False, "attribute", name=key)
            for node in nodes:
                item(node, attribute["id"], depth + 2, True)
            attribute["last"] = len(out) - 1
        for node in element[2]:
            if node[0] == ELEMENT:
                walk(node[1], own["id"], depth + 1)
            else:
                item(node, own["id"], depth + 1, False)
        own["last"] = len(out) - 1

    walk(element, -1, 0)
    return out


def xml_nodes(nodes: list[tuple], attribute: bool) -> str:
    out = []
    for n in nodes:
        kind, text = n[0], n[1]
        if kind == TEXT or (kind == CDATA and attribute):
            out.append(text.translate(XML))
        elif kind == CDATA:
            out.append(f"<![CDATA[{text}]]>")
        elif kind == CHARREF:
            out.append(f"&#{text};")
        elif kind == ENTITY:
            out.append(f"&{text};")
        elif kind == TARGET:
            out.append(f"<?{text}")
        elif kind == DATA:
            out.append(f" {text}?>")
    return "".join(out)


def to_xml(element: tuple, indent: int = 0) -> str:
    name, attributes, children = element
    pad, shown = " " * indent, []
    for key, nodes in attributes:
        value = xml_nodes(nodes, True)
        shown.append(f' {key}="{system_time(value) if key == "SystemTime" else value}"')
    head = f"{pad}<{name}{''.join(shown)}>"
    if not any(c[0] == ELEMENT for c in children):
        return f"{head}{xml_nodes(children, False)}</{name}>\n"
    lines = [to_xml(c[1], indent + 2) if c[0] == ELEMENT else f"{pad}  {xml_nodes([c], False)}\n" for c in children]
    return f"{head}\n{''.join(lines)}{pad}</{name}>\n"


def json_text(nodes: list[tuple]) -> str:
    out = []
    for n in nodes:
        if n[0] in (TEXT, CDATA):
            out.append(n[1])
        elif n[0] == CHARREF:
            out.append(f"&#{n[1]};")
        elif n[0] == ENTITY:
            out.append(ENTITIES.get(n[1], f"&{n[1]};"))
    return "".join(out).translate(JSON)


def to_json(element: tuple, root: bool = True) -> str:
    """Attributes as @name, text as #text, children grouped by name in order of first appearance."""
    _, attributes, children = element
    inner = [c[1] for c in children if c[0] == ELEMENT]
    text = [c for c in children if c[0] != ELEMENT]
    if not root and not attributes and not inner:
        return f'"{json_text(text)}"'
    parts = []
    for key, nodes in attributes:
        value = json_text(nodes)
        parts.append(f'"@{key.translate(JSON)}":"{system_time(value) if key == "SystemTime" else value}"')
    if text:
        parts.append(f'"#text":"{json_text(text)}"')
    groups: dict[str, list[str]] = {}
    for child in inner:
        groups.setdefault(child[0], []).append(to_json(child, False))
    parts += [f'"{key.translate(JSON)}":' + (found[0] if len(found) == 1 else f"[{','.join(found)}]") for key, found in groups.items()]
    return "{" + ",".join(parts) + "}"
