"""Tables that outlive executors: Parquet in the folder that all of them share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size, in bytes, of a side that is sent to every executor.
BROADCAST_BYTES = 32 << 20
#: Rows of ids that one task groups in memory, about 100 bytes each.
TASK_ROWS = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode, as in tests, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", "")
    if not where:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="latticework-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: its lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files of tables made by `stored`."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint if rows * row_bytes is within BROADCAST_BYTES; else Spark's shuffled join stands."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def dealt(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """`df`, of about so many rows, by hash of the columns to tasks of TASK_ROWS.

    A number of partitions of its own is left as it is, where those of other
    shuffles are merged by compressed bytes: 64 MB of short ids are millions of rows.
    """
    return df.repartition(max(1, math.ceil(rows / TASK_ROWS)), *columns)


def fingerprint(df: DataFrame) -> tuple:
    """(rows, sum, exclusive or) of the rows' 64-bit hashes: tells whether a round changed a table."""
    row = F.xxhash64(*df.columns)
    return tuple(df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first())
