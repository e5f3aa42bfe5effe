"""Incremental indexing as a Structured Streaming query.

Changed documents arrive as files of ``id, sha, body``.  Each micro-batch is
reduced to the newest state of its ids, held against the table so far, and
written as a new version of the table; the checkpoint is the record of what has
been covered, and a batch that is run again gives the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators import maintain as M

SCHEMA = "id string, sha string, body string, seq long, gone boolean"


def latest(changes: DataFrame) -> DataFrame:
    """The last change of every id, by ``seq``."""
    last = changes.groupBy("id").agg(F.max_by(F.struct(*[c for c in changes.columns if c != "id"]), "seq").alias("x"))
    return last.select("id", "x.*")


def upsert(state: DataFrame, changes: DataFrame) -> DataFrame:
    """``id, sha, body, ver`` after the changes; the version grows with the content."""
    news = latest(changes)
    kept = state.join(news.select("id"), "id", "left_anti")
    live = news.where(~F.coalesce("gone", F.lit(False)))
    return kept.unionByName(M.bump(state, live).join(live.select("id", "body"), "id").select("id", "sha", "body", "ver"))


class VersionedTable:
    """Parquet versions ``v=<batch>`` of a table; a reader takes the last whole one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(done(p, "_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        found = [v for v in self._versions() if before is None or v < before]
        if not found:
            return self.spark.createDataFrame([], "id string, sha string, body string, ver int")
        return self.spark.read.schema("id string, sha string, body string, ver int").parquet(f"{self.path}/v={found[-1]}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")


def run(spark: SparkSession, changes: str, table: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Work off all waiting change files, then stop."""
    target = VersionedTable(spark, table)

    def step(batch: DataFrame, no: int) -> None:
        target.write(upsert(target.read(before=no), batch), no)

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(changes)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events of each type by time window, dropping what comes too late."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
