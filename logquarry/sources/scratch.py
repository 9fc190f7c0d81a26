"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table's row group, and of the rows that a Python worker gets at once while a table is written. A row here is a
#: chunk or holds a chunk's records; Spark reads up to 4,096 rows of a row group at once and hands on 64 MB.
GROUP = 8 << 20
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where all run on one machine and none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="logquarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df there and read it back: computed once, however often it is read; gone when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    own = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(GROUP))
    try:
        df.write.option("parquet.block.size", GROUP).parquet(path)
    finally:
        spark.conf.set(BATCH, own)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
