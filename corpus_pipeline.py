"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

All stages but the last return the columns of the documents they are given,
whatever else these hold; columns with the names of the operators' own do no
harm.  Nulls in other columns than text have no influence, a null id counts as
an id.  Null and empty texts are rejected by the first stage; those that come
to a later stage pass through it unchanged, and are packed as rows without
tokens.  Texts are read whole, however long.  Rows equal in id and text are one
document to each stage: they lose the same lines, and one of them stays after
near-dedup.  Ties go to the lowest id, nulls last.  An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm import classifier, linededup, packing, secretscan, simhash
from latticework.llm.common import documents, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    model = classifier.train(docs, documents(spark, sf_dir, "labels"))
    return classifier.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every occurrence but one of lines that repeat, exactly or nearly; drop documents of which nothing is left."""
    return linededup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace the secrets that the scan finds by a mask."""
    return secretscan.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences: the result of the pipeline."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("secret scan", secret_scan),
    ("best-fit packing", pack),
]

#: The classifier is trained, and packing is a greedy procedure: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again.

    Gives a row per piece of a document: (doc_id, chunk, start_token, n_tokens,
    part, bin, bin_offset, part_bins, part_bound, certified).
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
