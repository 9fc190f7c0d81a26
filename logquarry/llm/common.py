"""What the corpus operators share: scratch tables in the cluster's shared folder, and word fingerprints."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. It is set here only where nobody set it and all
    run on one machine (local tests); on a cluster without it this raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="logquarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: cuts the lineage, survives lost executors, computes once.

    The driver's collection lets Spark's cleaner delete the shuffle files of the job, which nothing reads any more; else
    they stay until the driver happens to run short of memory.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/logquarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch = target
    spark._jvm.System.gc()
    return written


def discard(*tables: DataFrame) -> None:
    """Delete such tables once all that was to come of them is itself a table."""
    for df in tables:
        df._scratch.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(df._scratch, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bits of the bitmap that thins rows before a semi-join by id.
THIN_BITS = 1 << 23


def thinned(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id may be among `ids` (one column), so that few of the others are shuffled for the join by id.

    The ids become a bitmap of THIN_BITS hashed positions, 1 MB whatever their number, which is broadcast.
    """
    spot = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(THIN_BITS)) + 1
    bits = ids.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("thin_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("thin_bits"))
    own = F.pmod(F.xxhash64(F.col(id_col)), F.lit(THIN_BITS)) + 1
    placed = rows.withColumns({"thin_bucket": F.bitmap_bucket_number(own), "thin_at": F.bitmap_bit_position(own)})
    byte = "CAST(conv(hex(substring(thin_bits, CAST(thin_at div 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    return placed.join(F.broadcast(bits), "thin_bucket").where(f"({byte} & shiftleft(1, CAST(thin_at % 8 AS INT))) <> 0").select(*rows.columns)


class WordPrints:
    """64-bit fingerprints of a text's words, straight from its UTF-8 bytes: no word becomes a Python object.

    Words are the runs of bytes outside `separators`; A-Z count as a-z. A word's fingerprint is a polynomial over its
    bytes modulo 2 ** 64, taken from running sums over the text, and then mixed.
    """

    STRETCH = 1 << 20

    def __init__(self, separators: bytes = b" \t\n\x0b\x0c\r"):
        rng = np.random.default_rng(20240229)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self.values[65:91] = self.values[97:123]
        self.gap = np.zeros(256, bool)
        self.gap[list(separators)] = True
        self.values[self.gap] = 0
        self.base = 0x9E3779B97F4A7C15
        self.powers, self.inverses = np.ones(1, U64), np.ones(1, U64)

    def grow(self, n: int) -> None:
        back = pow(self.base, -1, 1 << 64)
        while len(self.powers) < n:
            k = len(self.powers)
            self.powers = np.concatenate([self.powers, self.powers * U64(pow(self.base, k, 1 << 64))])
            self.inverses = np.concatenate([self.inverses, self.inverses * U64(pow(back, k, 1 << 64))])

    def of(self, text: str | None) -> np.ndarray:
        return self.of_bytes(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8))

    def of_all(self, texts: list[bytes | memoryview]) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints of several UTF-8 texts, one after the other, and the number of each text's words."""
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        gap = self.gap[data]
        last = np.flatnonzero(gap[1:] & ~gap[:-1])
        ends = np.cumsum([len(t) + 1 for t in texts])
        return self.of_bytes(data), np.diff(np.searchsorted(last, ends - 1), prepend=0)

    def of_bytes(self, data: np.ndarray) -> np.ndarray:
        found, start = [], 0
        while start < len(data):  # a long text is read in stretches that end between words
            size = self.STRETCH
            while start + size < len(data) and not self.gap[data[start : start + size]].any():
                size *= 2
            end = min(len(data), start + size)
            if end < len(data):
                end = start + int(np.flatnonzero(self.gap[data[start:end]])[-1]) + 1
            found.append(self.stretch(data[start:end]))
            start = end
        return found[0] if len(found) == 1 else np.concatenate([np.empty(0, U64), *found])

    def stretch(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self.grow(n + 1)
        edge = np.ones(n + 2, bool)
        edge[1:-1] = self.gap[data]
        turn = np.flatnonzero(edge[1:] != edge[:-1])
        first, last = turn[::2], turn[1::2]
        sums = np.zeros(n + 1, U64)
        np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])
        return mix((sums[last] - sums[first]) * self.inverses[first] + (last - first).astype(U64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def shingles(prints: np.ndarray, width: int = 5) -> np.ndarray:
    """Fingerprints of the runs of `width` words, in order; with fewer words, of the whole sequence; none of none."""
    n = len(prints)
    if n == 0:
        return np.empty(0, U64)
    runs = max(1, n - width + 1)
    out = np.full(runs, min(n, width), U64)
    factor = 1
    for k in range(min(n, width)):
        factor = factor * 0xD1342543DE82EF95 % (1 << 64)
        out += prints[k : k + runs] * U64(factor)
    return mix(out)
