"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import BATCH_BYTES, mapped, release
from ..operators.iterative import components
from ..storage import drop_stored, maybe_broadcast, shared_dir, stored

def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Identity of a document row: id and content hash; rows equal in both count as one document."""
    return [doc_id.cast("long").alias("k_doc"), F.xxhash64(text).alias("k_text")]


def apart(df: DataFrame, *names: str) -> list[str]:
    """The given names, with underscores before them as long as `df` has a column of that name."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["BATCH_BYTES", "apart", "components", "documents", "drop_stored", "mapped", "maybe_broadcast", "release", "row_key", "shared_dir", "stored"]
