"""Rows to event-log bytes: the inverse of the decoder, for tests and for writing logs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

HEADER, CHUNK = 4096, 65536


@lru_cache(4096)
def name_block(text: str) -> bytes:
    raw = text.encode("utf-16-le")
    h = 0
    for c in text:
        h = (h * 65599 + ord(c)) & 0xFFFFFFFF
    return struct.pack("<IHH", 0, h & 0xFFFF, len(raw) // 2) + raw + b"\0\0"


class Element:
    """A template's element; content and attribute values are elements, texts, ready token bytes or substitutions (id, type)."""

    def __init__(self, name: str, attributes: dict | None = None, content: list | None = None):
        self.name, self.attributes, self.content = name, attributes or {}, content or []

    def encode(self, at: int) -> bytes:
        """The tokens, where `at` is the place of the first in its chunk."""
        body = struct.pack("<I", at + 11) + name_block(self.name)
        if self.attributes:
            listed = b""
            start = at + 7 + len(body) + 4
            for k, (key, value) in enumerate(self.attributes.items()):
                more = 0x46 if k < len(self.attributes) - 1 else 0x06
                listed += struct.pack("<BI", more, start + len(listed) + 5) + name_block(key)
                listed += item(value, start + len(listed))
            body += struct.pack("<I", len(listed)) + listed
        body += b"\x02"
        for value in self.content:
            body += item(value, at + 7 + len(body))
        body += b"\x04"
        return struct.pack("<BHI", 0x41 if self.attributes else 0x01, 0xFFFF, len(body)) + body


def item(value, at: int) -> bytes:
    if isinstance(value, Element):
        return value.encode(at)
    if isinstance(value, bytes):
        return value
    if isinstance(value, str):
        raw = value.encode("utf-16-le")
        return struct.pack("<BBH", 0x05, 0x01, len(raw) // 2) + raw
    return struct.pack("<BHB", 0x0D, value[0], value[1])


def value_bytes(kind: int, value) -> bytes:
    if value is None:
        return b""
    if kind == 0x01:
        return value.encode("utf-16-le")
    if kind == 0x02:
        return value.encode("cp1252")
    formats = {0x03: "<b", 0x04: "<B", 0x05: "<h", 0x06: "<H", 0x07: "<i", 0x08: "<I", 0x09: "<q", 0x0A: "<Q", 0x0B: "<f", 0x0C: "<d", 0x11: "<Q", 0x14: "<I", 0x15: "<Q"}
    if kind in formats:
        return struct.pack(formats[kind], value)
    return struct.pack("<I", 1 if value else 0) if kind == 0x0D else bytes(value)


def instance(template: Element, values: list[tuple[int, bytes]], at: int, known: int | None) -> bytes:
    """A record's payload at a place of its chunk; `known` is where the chunk has the template's definition already.

    A value that depends on its place (binary XML) is a function of it.
    """
    head = b"\x0f\x01\x01\x00\x0c\x01" + struct.pack("<I", 1)
    here = at + len(head) + 4
    out = head + struct.pack("<I", here if known is None else known)
    if known is None:
        body = b"\x0f\x01\x01\x00" + template.encode(here + 28) + b"\x00"
        out += struct.pack("<I16sI", 0, b"logquarry-tmpl-1", len(body)) + body
    start, payload = at + len(out) + 4 + 4 * len(values), b""
    heads = b""
    for kind, raw in values:
        raw = raw(start + len(payload)) if callable(raw) else raw
        payload += raw
        heads += struct.pack("<HBB", len(raw), kind, 0)
    return out + struct.pack("<I", len(values)) + heads + payload


def seal(records: list[bytes], first: int, last: int) -> bytes:
    """A chunk of whole records, with its header and both checksums."""
    body = b"".join(records)
    free = 512 + len(body)
    data = bytearray(CHUNK)
    data[512:free] = body
    struct.pack_into("<8sQQQQIIII", data, 0, b"ElfChnk\0", first, last, first, last, 128, free - len(records[-1]) if records else 512, free, zlib.crc32(body))
    struct.pack_into("<I", data, 124, zlib.crc32(data[128:512], zlib.crc32(data[:120])))
    return bytes(data)


def chunks(template: Element, rows: Iterator[tuple[int, int, list[tuple[int, bytes]]]]) -> Iterator[bytes]:
    """Chunks of (record id, FILETIME, values) rows."""
    records, size, known, ids = [], 512, None, []
    for record_id, written, values in rows:
        for _ in range(2):
            payload = instance(template, values, size + 24, known)
            total = len(payload) + 28
            if size + total <= CHUNK or not records:
                break
            yield seal(records, ids[0], ids[-1])
            records, size, known, ids = [], 512, None, []
        if size + total > CHUNK:
            raise ValueError(f"record {record_id} doesn't fit into a chunk")
        if known is None:
            known = size + 24 + 14
        records.append(struct.pack("<4sIQQ", b"**\0\0", total, record_id, written) + payload + struct.pack("<I", total))
        ids.append(record_id)
        size += total
    if records:
        yield seal(records, ids[0], ids[-1])


def log_file(parts: list[bytes], counted: int | None = None) -> bytes:
    """A whole file of chunks; its header counts them all, or as many as `counted` says (as in a file that wasn't closed)."""
    head = bytearray(HEADER)
    struct.pack_into("<8sQQQIHHHH", head, 0, b"ElfFile\0", 0, max(0, len(parts) - 1), 1, 128, 1, 3, HEADER, len(parts) if counted is None else counted)
    struct.pack_into("<II", head, 120, 0, zlib.crc32(head[:120]))
    return bytes(head) + b"".join(parts)
