"""Text and number formats of event-log values as Spark column functions; all but `real_text` stay in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: FILETIME of 1970-01-01 (100 ns ticks since 1601); fixed value.
EPOCH_TICKS = 116_444_736_000_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filetime_of(ts: Column | str) -> Column:
    """A timestamp as FILETIME ticks (whole microseconds)."""
    return F.unix_micros(_col(ts).cast("timestamp")) * 10 + EPOCH_TICKS


def filetime_timestamp(ticks: Column | str) -> Column:
    """FILETIME as timestamp; what lies before 1970 becomes 1970."""
    after = _col(ticks) - EPOCH_TICKS
    return F.timestamp_micros(F.greatest(F.call_function("div", after, F.lit(10)), F.lit(0)))


def filetime_iso(ticks: Column | str) -> Column:
    """FILETIME as ISO 8601 with microseconds and Z (session time zone UTC)."""
    return F.date_format(filetime_timestamp(ticks), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def systemtime_iso(year, month, day, hour, minute, second, millis) -> Column:
    """The fields of a SYSTEMTIME as they are, with milliseconds."""
    return F.format_string("%04d-%02d-%02dT%02d:%02d:%02d.%03dZ", *[_col(c) for c in (year, month, day, hour, minute, second, millis)])


def systemtime_normalise(text: Column | str) -> Column:
    """A SystemTime text with '+' dropped, two-digit parts and a fraction of six digits; other texts only lose the '+'."""
    s = F.substring(F.replace(_col(text), F.lit("+"), F.lit("")), 1, 64)
    pattern = r"^([^-T]*)-([^-T]*)-([^-T]*)(?:-[^T]*)?T([^:]*):([^:]*):([^:.]*)(?:\.([^:]*))?(?::.*)?Z[^Z]*$"

    def part(k: int) -> Column:
        return F.regexp_extract(s, pattern, k)

    def two(k: int) -> Column:
        return F.when(F.length(part(k)) == 1, F.concat(F.lit("0"), part(k))).otherwise(part(k))

    fraction = F.when(part(7) == "", "").otherwise(F.concat(F.lit("."), F.rpad(F.substring(part(7), 1, 6), 6, "0")))
    whole = F.concat(part(1), F.lit("-"), two(2), F.lit("-"), two(3), F.lit("T"), two(4), F.lit(":"), two(5), F.lit(":"), two(6), fraction, F.lit("Z"))
    return F.when(s.rlike(pattern), whole).otherwise(s)


def xml_escape(text: Column | str) -> Column:
    """The five XML entities; control characters stay."""
    out = _col(text)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def json_escape(text: Column | str) -> Column:
    """The inside of a JSON string: short escapes, other controls as \\u00XX, the rest as it is."""
    wrapped = F.to_json(F.struct(_col(text).alias("s")))
    return F.when(_col(text).isNotNull(), F.substring(wrapped, 7, F.length(wrapped) - 8))


def hex_lower(data: Column | str) -> Column:
    return F.lower(F.hex(_col(data)))


def hex_int(number: Column | str) -> Column:
    """0x and upper-case hexadecimal digits without leading zeros."""
    return F.concat(F.lit("0x"), F.hex(_col(number).cast("long")))


def le_unsigned(data: Column | str, start: int, size: int) -> Column:
    """An unsigned little-endian integer of 1 to 7 bytes (8 while below 2 ** 63) at a 0-based offset."""
    data = _col(data)
    digits = F.concat(*[F.hex(F.substring(data, start + k + 1, 1)) for k in range(size - 1, -1, -1)])
    return F.conv(digits, 16, 10).cast("long" if size < 8 else "decimal(20,0)")


def le_signed(data: Column | str, start: int, size: int) -> Column:
    """A signed little-endian integer of 1 to 8 bytes."""
    raw = le_unsigned(data, start, size).cast("decimal(20,0)")
    half, whole = 1 << (8 * size - 1), 1 << (8 * size)
    return F.when(raw >= F.lit(str(half)).cast("decimal(20,0)"), raw - F.lit(str(whole)).cast("decimal(20,0)")).otherwise(raw).cast("long")


def bool_text(data: Column | str) -> Column:
    return F.when(le_unsigned(data, 0, 4) == 0, "false").otherwise("true")


def guid_text(data: Column | str) -> Column:
    """{8-4-4-4-12}, lower case; the first three fields are little-endian."""
    h = F.lower(F.hex(_col(data)))

    def bytes_at(*order: int) -> list[Column]:
        return [F.substring(h, 2 * k + 1, 2) for k in order]

    dash = [F.lit("-")]
    return F.concat(F.lit("{"), *bytes_at(3, 2, 1, 0), *dash, *bytes_at(5, 4), *dash, *bytes_at(7, 6), *dash, *bytes_at(8, 9), *dash, *bytes_at(*range(10, 16)), F.lit("}"))


def sid_text(data: Column | str) -> Column:
    """S-revision-authority and the sub-authorities that are there in full."""
    data = _col(data)
    h = F.hex(data)
    count = F.least(F.conv(F.substring(h, 3, 2), 16, 10).cast("int"), F.floor((F.length(data) - 8) / 4).cast("int"))
    subs = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.conv(F.concat(*[h.substr(F.lit(17) + i * 8 + 2 * k, F.lit(2)) for k in (3, 2, 1, 0)]), 16, 10),
    )
    head = F.concat(F.lit("S-"), F.conv(F.substring(h, 1, 2), 16, 10), F.lit("-"), F.conv(F.substring(h, 5, 12), 16, 10))
    return F.when(F.size(subs) > 0, F.concat(head, F.lit("-"), F.array_join(subs, "-"))).otherwise(head)


def utf16_text(data: Column | str) -> Column:
    """Well-formed UTF-16LE bytes as text."""
    return F.decode(_col(data), "UTF-16LE")


def utf16_lenient(data: Column | str) -> Column:
    """UTF-16LE bytes as text; halves of surrogate pairs that stand alone and an odd last byte are left out."""
    data = _col(data)
    even = data.substr(F.lit(1), F.octet_length(data) - F.octet_length(data) % 2)
    units = F.transform(F.sequence(F.lit(0), F.greatest((F.octet_length(even) / 2).cast("int") - 1, F.lit(0))), lambda i: F.hex(even.substr(i * 2 + 1, F.lit(2))))

    def paired(units: Column) -> Column:
        def stays(unit: Column, i: Column) -> Column:
            high, low = "^..D[89AB]", "^..D[C-F]"
            return F.when(unit.rlike(high), F.coalesce(F.get(units, i + 1).rlike(low), F.lit(False))).when(unit.rlike(low), F.coalesce(F.get(units, i - 1).rlike(high), F.lit(False))).otherwise(True)

        return F.decode(F.unhex(F.array_join(F.filter(units, stays), "")), "UTF-16LE")

    # D8 to DF anywhere is rare; without it there are no surrogates to pair
    return F.when(F.hex(even).rlike("D[89A-F]"), F.get(F.transform(F.array(units), paired), F.lit(0))).otherwise(F.decode(even, "UTF-16LE"))


def le_hex(data: Column | str) -> Column:
    """A little-endian integer of any size as upper-case hexadecimal digits without leading zeros."""
    swapped = F.regexp_replace(F.reverse(F.hex(_col(data))), "(.)(.)", "$2$1")
    return F.regexp_replace(swapped, "^0+(?=.)", "")


def sid_places(data: Column | str) -> Column:
    """Where (from 1) the whole SIDs of an array begin, each as long as it says."""
    data = _col(data)
    size = F.octet_length(data)

    def step(s: Column, _: Column) -> Column:
        end = s.at + 8 + F.coalesce(F.conv(F.hex(data.substr(s.at + 1, F.lit(1))), 16, 10).cast("int"), F.lit(0)) * 4
        fits = (s.at + 7 <= size) & (end - 1 <= size)
        return F.struct(F.when(fits, F.concat(s.places, F.array(s.at))).otherwise(s.places).alias("places"), F.when(fits, end).otherwise(size + 1).alias("at"))

    start = F.struct(F.array().cast("array<int>").alias("places"), F.lit(1).alias("at"))
    return F.aggregate(F.sequence(F.lit(0), (size / 8).cast("int")), start, step, lambda s: s.places)


#: Code page 1252 where it isn't Latin-1: bytes 0x80 to 0x9F in order (fixed values); five bytes stand for nothing.
CP1252_HIGH = "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"


def cp1252_text(data: Column | str) -> Column:
    return F.translate(F.decode(_col(data), "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), CP1252_HIGH)


@F.pandas_udf(StringType())
def real_text(x: pd.Series) -> pd.Series:
    """Shortest decimal that reads back as the same double, without exponent; -1.#IND and +-1.#INF for the others."""

    def one(v: float) -> str | None:
        if v is None:
            return None
        if np.isnan(v):
            return "-1.#IND"
        if np.isinf(v):
            return "1.#INF" if v > 0 else "-1.#INF"
        return np.format_float_positional(v, trim="-")

    return x.map(one)


def array_text(items: Column | str, attribute: bool = False, strings: bool = False) -> Column:
    """Array values as one text: blanks between them in attributes, commas between strings in element text."""
    return F.array_join(_col(items), "," if strings and not attribute else " ")
