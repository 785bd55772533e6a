"""Python over Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch: a task holds several copies of one, in the JVM and in Python.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def release() -> None:
    """Give what this process has freed back to the system: workers are used again, and their memory stays with the executor's."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """`df.mapInArrow(run, schema)` with batches of at most `BATCH_BYTES` or one row, whatever the rows' sizes; lowers the session's bound."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release()

    spark = df.sparkSession
    # As a plain number or with b, which the default has; another unit is the user's own choice.
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(_BATCH))
    if now and int(now[1]) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(tidy, schema)
