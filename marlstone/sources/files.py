"""File sources: recursive scans with type, exclusion and content filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T

#: What counts as a document unless a list says otherwise.
DEFAULT_TYPES = ["*.md", "*.markdown", "*.txt", "*.rst", "*.adoc", "*.org"]


def skip_reason(content: Column) -> Column:
    """Why a content can't be a document: empty, binary or not UTF-8; else null."""
    nul = F.locate("00", F.regexp_replace(F.hex(content), "(..)", "$1 "))
    return (
        F.when(F.length(content) == 0, "empty")
        .when(nul > 0, "binary")
        .when(~F.is_valid_utf8(content.cast("string")), "non-utf8")
    )


def scan(spark: SparkSession, root: str, dirs: list[str], excludes: list[str] = (), allow: list[str] = (), deny: list[str] = ()) -> DataFrame:
    """Every file below ``dirs`` of ``root``: ``path, content, reason``.

    ``reason`` is null for documents; others say why they are skipped: the
    pattern that excludes them, their type, or their content.  Hidden files and
    folders are no candidates; roots that overlap give a file once.
    """
    base = root.rstrip("/")
    files = None
    for d in dirs:
        where = f"{base}/{d}".rstrip("/")
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(where)
        # Spark lists files without bytes and then reads nothing of them
        listed = spark.createDataFrame([(n,) for n in found.inputFiles()], "path string").select(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))).alias("path"))
        one = found.select("path", "content").unionByName(listed.withColumn("content", F.lit("").cast("binary")))
        files = one if files is None else files.unionByName(one)
    plain = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/*", "/")
    inside = "/" + re.sub("^[a-z0-9]+:", "", base).lstrip("/") + "/"
    rows = files.groupBy(plain.alias("plain")).agg(F.max("content").alias("content"))
    rows = rows.select(F.substring("plain", len(inside) + 1, 1 << 20).alias("path"), "content")
    rows = rows.where(~F.col("path").rlike(r"(^|/)\."))
    excluded = T.excluded_by(list(excludes), F.col("path"))
    kind = T.accepted_type(F.col("path"), list(allow) or DEFAULT_TYPES, list(deny))
    reason = F.when(excluded.isNotNull(), F.concat(F.lit("excluded: "), excluded)).when(~kind, "type").otherwise(skip_reason(F.col("content")))
    return rows.withColumn("reason", reason)


def documents(scanned: DataFrame) -> DataFrame:
    """Decoded documents ``id, loc, body`` of a scan, in NFC."""
    from marlstone.functions.markup import nfc

    good = scanned.where("reason IS NULL")
    return good.select(F.concat(F.lit("file:"), "path").alias("id"), F.col("path").alias("loc"), nfc(F.col("content").cast("string")).alias("raw"))


def skipped(scanned: DataFrame) -> DataFrame:
    return scanned.where("reason IS NOT NULL").select("path", "reason")
