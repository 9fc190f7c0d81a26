"""Records outside the live ones: in free space, behind damage, and in chunks whose header is gone.

The scan is a split of the chunk's bytes at the record signature; what it finds counts where the size at its head equals
the copy at its end. Live records are the unbroken chain from the start of a sound chunk. Without Python up to decoding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import le_unsigned
from ..sources.scratch import table
from .records import RECORD, checksum_ok
from .token_tables import decode_tables, let

START = 512


def found_records(data: Column) -> Column:
    """array<struct<at, size, id, written, digest>> of all places (from 0) of whole records with equal sizes, in order."""
    return let(data, records_in)  # bound once: each look at a column copies its bytes


def records_in(data: Column) -> Column:
    pieces = F.split(F.decode(data, "ISO-8859-1"), "\\*\\*\\x00\\x00", -1)

    def places(pieces: Column) -> Column:
        lengths = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.length(p))
        start = F.struct(F.array().cast("array<int>").alias("found"), F.lit(-4).alias("end"))
        step = lambda s, n: F.struct(F.concat(s.found, F.array(s.end + 4 + n)).alias("found"), (s.end + 4 + n).alias("end"))
        return F.aggregate(lengths, start, step, lambda s: s.found)

    def record(at: Column) -> Column:
        size = le_unsigned(data.substr(at + 5, F.lit(4)), 0, 4)
        return F.struct(at.alias("at"), F.least(size, F.lit(1 << 20)).cast("int").alias("size"))

    def whole(r: Column) -> Column:
        fits = (r["size"] >= 32) & (r.at >= START) & (r.at + r["size"] <= F.octet_length(data))
        return F.when(fits, data.substr(r.at + r["size"] - 3, F.lit(4)) == data.substr(r.at + 5, F.lit(4))).otherwise(False)

    def more(r: Column) -> Column:
        number = lambda k: le_unsigned(data.substr(r.at + k + 1, F.lit(8)), 0, 8)
        largest = F.lit((1 << 63) - 1).cast("decimal(20,0)")
        id_, written = (F.when(number(k) <= largest, number(k).cast("long")) for k in (8, 16))
        return F.struct(r.at.alias("at"), r["size"].alias("size"), id_.alias("id"), written.alias("written"), F.xxhash64(data.substr(r.at + 1, r["size"])).alias("digest"))

    found = let(pieces, lambda p: F.transform(places(p), record))
    return F.transform(F.filter(found, whole), more)


def scanned(chunks: DataFrame, checksums: bool = True) -> DataFrame:
    """(path, chunk_index, sound, free, found, live): all found records, and the live ones of chunks that are sound."""
    sound = checksum_ok() if checksums else F.substring("data", 1, 8) == F.lit(bytearray(b"ElfChnk\0"))
    free = F.least(le_unsigned("data", 48, 4), F.lit(65536)).cast("int")
    rows = chunks.where(F.octet_length("data") >= START).select("path", "chunk_index", F.coalesce(sound, F.lit(False)).alias("sound"), free.alias("free"), found_records(F.col("data")).alias("found"))

    def chain(s: Column, r: Column) -> Column:
        next_ = (r.at == s.end) & (r.at + r["size"] <= F.col("free"))
        return F.struct(F.when(next_, s.end + r["size"]).otherwise(s.end).alias("end"), F.when(next_, F.concat(s.live, F.array(r))).otherwise(s.live).alias("live"))

    kind = rows.schema["found"].dataType.simpleString()
    start = F.struct(F.lit(START).alias("end"), F.array().cast(kind).alias("live"))
    live = F.when(F.col("sound"), F.aggregate("found", start, chain, lambda s: s.live)).otherwise(F.array().cast(kind))
    return rows.withColumn("live", live)


def recoverable(scan: DataFrame) -> DataFrame:
    """(path, chunk_index, origin, r) of records that aren't live, none whose id is, and equal ones once.

    origin: `slack` after the end of the chunk's records, `damaged` behind a break of their chain, `chunk` where the chunk
    itself isn't sound. A record that begins inside an earlier found one isn't one. Ids are compared within a file.
    """
    end = F.coalesce(F.get(F.transform(F.slice("live", -1, 1), lambda r: r.at + r["size"]), F.lit(0)), F.lit(START))
    live_end = F.when(F.size("live") > 0, end).otherwise(F.lit(START))

    def apart(s: Column, r: Column) -> Column:
        clear = r.at >= s.end
        return F.struct(F.when(clear, r.at + r["size"]).otherwise(s.end).alias("end"), F.when(clear, F.concat(s.found, F.array(r))).otherwise(s.found).alias("found"))

    kind = scan.schema["found"].dataType.simpleString()
    rest = F.aggregate("found", F.struct(live_end.alias("end"), F.array().cast(kind).alias("found")), apart, lambda s: s.found)
    origin = F.when(~F.col("sound"), "chunk").when(F.col("r.at") >= F.col("free"), "slack").otherwise("damaged")
    lost = scan.select("path", "chunk_index", "sound", "free", F.explode(rest).alias("r")).select("path", "chunk_index", origin.alias("origin"), "r").withColumn("id", F.col("r.id"))
    alive = scan.select(F.col("path").alias("of"), F.explode("live.id").alias("live_id"))
    lost = lost.join(alive, (F.col("path") == F.col("of")) & (F.col("id") == F.col("live_id")), "left_anti")
    return lost.withColumn("digest", F.col("r.digest")).dropDuplicates(["path", "id", "digest"]).drop("id", "digest")


def recover(chunks: DataFrame, checksums: bool = True) -> DataFrame:
    """Decoded records (RECORD) that recoverable() finds, with their origin; ordinal counts those of a chunk.

    Only chunks that have some are decoded; names and templates come from wherever the chunk still has them. Chunks shorter
    than a header and null data have none.
    """
    # numbers only, some ten bytes a record
    places = recoverable(table(scanned(chunks, checksums), "scanned")).groupBy("path", "chunk_index").agg(F.array_sort(F.collect_list(F.struct(F.col("r.at").alias("at"), F.col("r.size").alias("size"), "origin"))).alias("places"))
    places = table(places, "places")
    decoded = decode_tables(chunks.join(places, ["path", "chunk_index"]))
    origins = places.select("path", "chunk_index", F.posexplode("places.origin").alias("ordinal", "origin"))
    return decoded.join(origins, ["path", "chunk_index", "ordinal"]).select(*[f.split()[0] for f in RECORD.split(", ")], "origin")
