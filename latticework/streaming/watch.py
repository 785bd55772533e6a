"""Incremental graphs: changes of source files as a stream, and a feed of what they changed.

The graph lies in versions under one folder; a batch of changes writes the next
version, its messages, and then the mark that makes the version count, so
readers see either all of a batch or nothing.  A batch that is run again writes
the same version and messages if the mark was missing, and nothing if it wasn't.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.window import Window

from ..model import Graph
from ..operators import mutation, ranking
from ..sources.files import extract, graph_of

CHANGE = "filepath string, event string, seen timestamp, text string"
#: What a file that isn't quiet yet waits with.
_WAITING = "event string, seen timestamp, text string"
#: Whole versions that stay, for readers that began before the last.
KEPT = 3
FEED = "batch long, topic string, repo string, id string, change string"


def debounced(changes: DataFrame) -> DataFrame:
    """The last change of each file in a batch: what an editor writes in quick succession counts once."""
    last = Window.partitionBy("filepath").orderBy(F.col("seen").desc(), F.col("event"))
    return changes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def quiet_changes(changes: DataFrame, quiet_ms: int = 500) -> DataFrame:
    """The last change of each file of a streaming DataFrame, once nothing more has come for `quiet_ms` milliseconds.

    A file's latest change is state; each further one puts the timer back.
    """

    def settle(key, batches, state):
        if state.hasTimedOut:
            event, seen, text = state.get
            state.remove()
            yield pd.DataFrame({"filepath": [key[0]], "event": [event], "seen": [seen], "text": [text]})
            return
        rows = [tuple(r) for b in batches for r in b[["event", "seen", "text"]].itertuples(index=False)]
        if state.exists:
            rows.append(state.get)
        event, seen, text = max(rows, key=lambda r: (pd.Timestamp(r[1]), r[0] == "deleted"))
        state.update((event, pd.Timestamp(seen).to_pydatetime(), text))
        state.setTimeoutDuration(quiet_ms)

    return changes.groupBy("filepath").applyInPandasWithState(settle, CHANGE, _WAITING, "append", GroupStateTimeout.ProcessingTimeTimeout)


class LiveGraph:
    """A graph that changes in batches, and the feed of its changes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path or self.folder)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """Whole versions, and what cut-off batches left."""
        p, fs = self._fs(self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    @property
    def version(self) -> int:
        """Number of the last whole version, -1 before the first."""
        whole = (v for v in self._versions()[::-1] if self._fs("")[1].exists(self._fs(f"{self.folder}/v{v}/mark/_SUCCESS")[0]))
        return next(whole, -1)

    def read(self, version: int | None = None) -> Graph:
        v = self.version if version is None else version
        if v < 0:
            return Graph.empty(self.spark)
        return Graph(self.spark.read.parquet(f"{self.folder}/v{v}/nodes"), self.spark.read.parquet(f"{self.folder}/v{v}/edges"))

    def batch_of(self, version: int) -> int:
        """The batch that wrote a version, -1 before the first."""
        return self.spark.read.parquet(f"{self.folder}/v{version}/mark").first()["batch"] if version >= 0 else -1

    def apply(self, changes: DataFrame, batch: int, on_update=None, hot_weight: str | None = None) -> None:
        """Take in a batch of changes (filepath, event, seen, text): re-read files, or drop those with event `deleted`."""
        before = self.version
        if batch <= self.batch_of(before):
            return
        last = debounced(changes).persist()
        try:
            old = self.read(before)
            there = last.where("event <> 'deleted'").select("filepath", "text")
            fresh = graph_of(extract(there))
            new = mutation.upsert_files(old, last, fresh.nodes, fresh.edges)
            at = f"{self.folder}/v{before + 1}"
            new.nodes.write.mode("overwrite").parquet(f"{at}/nodes")
            new.edges.write.mode("overwrite").parquet(f"{at}/edges")
            # One feed that everybody reads from where they are; nobody takes a message away from another.
            added = fresh.nodes.select(F.lit(batch).cast("long").alias("batch"), F.lit("node_changed").alias("topic"), "repo", "id", F.lit("updated").alias("change"))
            removed = old.nodes.join(last.select("filepath"), "filepath", "left_semi").join(fresh.nodes.select("id"), "id", "left_anti")
            removed = removed.select(F.lit(batch).cast("long").alias("batch"), F.lit("node_changed").alias("topic"), "repo", "id", F.lit("removed").alias("change"))
            files = last.select(F.lit(batch).cast("long").alias("batch"), F.lit("graph_updated").alias("topic"), F.lit("").alias("repo"), F.col("filepath").alias("id"), F.col("event").alias("change"))
            feed = added.unionByName(removed).unionByName(files)
            if hot_weight:
                hot = ranking.hot_paths(self.read(before + 1), 20, hot_weight)
                feed = feed.unionByName(hot.select(F.lit(batch).cast("long").alias("batch"), F.lit(f"hot_paths_changed:{hot_weight}").alias("topic"), "repo", "id", F.col("rank").cast("string").alias("change")))
            feed.write.mode("overwrite").parquet(f"{self.folder}/feed/batch={batch}")
            self.spark.createDataFrame([(batch,)], "batch long").write.mode("overwrite").parquet(f"{at}/mark")
            if on_update:
                for row in last.select("filepath", "event").toLocalIterator():
                    on_update(row["filepath"], row["event"])
            for v in self._versions():
                if v <= before + 1 - KEPT:
                    p, fs = self._fs(f"{self.folder}/v{v}")
                    fs.delete(p, True)
        finally:
            last.unpersist()

    def feed(self, topic: str | None = None, repo: str | None = None, since: int = -1) -> DataFrame:
        """Changes after batch `since`, of a topic, of a repo."""
        p, fs = self._fs(f"{self.folder}/feed")
        if not fs.exists(p):
            return self.spark.createDataFrame([], FEED)
        rows = self.spark.read.option("basePath", f"{self.folder}/feed").schema(FEED).parquet(f"{self.folder}/feed").where(F.col("batch") > since)
        for column, value in (("topic", topic), ("repo", repo)):
            if value:
                rows = rows.where(F.col(column) == value)
        return rows

    def follow(self, changes: DataFrame, checkpoint: str, interval: str = "500 milliseconds", on_update=None, hot_weight: str | None = None, available_now: bool = False, quiet_ms: int | None = None):
        """Start the stream that applies a streaming DataFrame of changes batch by batch; with `quiet_ms`, files wait until they are quiet."""
        changes = quiet_changes(changes, quiet_ms) if quiet_ms else changes
        writer = changes.writeStream.foreachBatch(lambda df, batch: self.apply(df, batch, on_update, hot_weight)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming changes from JSON lines that a file watcher drops into a folder."""
    return spark.readStream.schema(CHANGE).json(folder)


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes between two listings (filepath, modified, text): a file stream by itself never reports deletions."""
    b = before.select("filepath", F.col("modified").alias("was"))
    joined = after.join(b, "filepath", "full")
    event = F.when(F.col("modified").isNull(), "deleted").when(F.col("was").isNull(), "created").when(F.col("modified") > F.col("was"), "modified")
    return joined.withColumn("event", event).where("event is not null").select("filepath", "event", F.coalesce("modified", F.current_timestamp()).alias("seen"), "text")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(filepath, modified, text) of a source tree now."""
    from ..sources.files import source_files

    times = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", r"^file:/*", "/").alias("filepath"), F.col("modificationTime").alias("modified"))
    return source_files(spark, root).select("filepath", "text").join(times, "filepath").select("filepath", "modified", "text")
