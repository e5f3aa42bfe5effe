"""Query catalogue: incremental and streaming operators, run to completion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans import corpus as C
from marlstone.operators.shared import shared_dir
from marlstone.streaming import incremental as S


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that executors share."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def stream_incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three waves of changes worked off as a stream: all, edits, removals."""
    at = _folder(spark)
    r = C.records(spark, sf_dir).select("id", "doc_id", "body")
    wave = lambda df, seq, body, gone: df.select("id", F.md5(body.cast("binary")).alias("sha"), body.alias("body"), F.lit(seq).cast("long").alias("seq"), F.lit(gone).alias("gone"))
    edited = F.concat("body", F.lit(" edited"))
    for no, df in enumerate((
        wave(r, 0, F.col("body"), False), wave(r.where("doc_id % 13 = 0"), 1, edited, False), wave(r.where("doc_id % 17 = 0"), 2, F.col("body"), True))):
        df.coalesce(4).write.mode("append").parquet(f"{at}/changes")
        S.run(spark, f"{at}/changes", f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return S.VersionedTable(spark, f"{at}/table").read().select("id", "sha", "ver")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of each event type, by the same plan in batch and stream."""
    out = S.windowed_counts(C.table(spark, sf_dir, "events").select("ts", "event_type", "value"))
    return out.select(F.date_format(F.col("window.start"), "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {"stream_incremental_index": stream_incremental_index, "event_windows": event_windows}

ORACLES = {
    "stream_incremental_index": """SELECT 'file:' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.md' AS id,
        md5(coalesce(text, '') || CASE WHEN doc_id % 13 = 0 THEN ' edited' ELSE '' END) AS sha, CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 1 END AS ver FROM documents WHERE doc_id % 17 <> 0""",
    "event_windows": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
}
