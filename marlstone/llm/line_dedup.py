"""Corpus-wide line dedup with levelled sorted runs of line hashes.

Documents are cut into ``batches`` id ranges, taken in ascending order.  A run
is a table of 128-bit line hashes, bucketed and sorted by hash, with the
smallest document that holds the line; joins merge it as it lies.  Each batch is reduced to its own distinct hashes, merge
anti-joined with the runs so far, and what is left becomes a new run on level
0.  ``fanout`` runs of one level are compacted into one of the next level.
Because batches ascend, a hash's run entry always names its smallest holder,
so a line goes exactly if a smaller document holds its key.

Everything on the path is a DataFrame expression.  The number of batches is a
parameter and not a function of the data: every batch reads all runs once, so
a fixed number keeps the cost proportional to the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import SPACES, delete, fold_case, materialise, scratch, sha256_hex, table


def _bounds(docs: DataFrame, id_col: str, batches: int) -> list:
    """Ascending cut points that split the ids into about equal batches."""
    shares = [(k + 1) / batches for k in range(batches - 1)]
    if not shares:
        return []
    found = docs.agg(F.percentile_approx(id_col, shares, 10_000).alias("q")).first()["q"]
    return sorted(set(found or []))


#: The first lets a scan of one sorted file in each bucket say that its rows are sorted.  Without the
#: second, small runs are joined with the lines of a batch before equal lines are combined.
_SETTINGS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """The settings of the merge joins, while the runs are written."""
    before = {key: spark.conf.get(key) for key in _SETTINGS}
    try:
        for key, value in _SETTINGS.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _write_run(rows: DataFrame) -> tuple[str, str]:
    """Write a run, bucketed and sorted by hash, as a table of the shared folder: its name and path.

    ``rows`` are dealt by hash already, over as many partitions as there are
    buckets, so each bucket is one file and the next merge join reads the run
    without an exchange or a sort.
    """
    spark = rows.sparkSession
    path = scratch(spark, "run")
    name = path.rpartition("/")[2].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).format("parquet").saveAsTable(name)
    return name, path


def _against(fresh: DataFrame, runs: list[tuple[str, str]]) -> DataFrame:
    """What no run holds, by merge anti-joins."""
    for name, _ in runs:
        run = fresh.sparkSession.table(name).select("h1", "h2")
        fresh = fresh.join(run.hint("merge"), ["h1", "h2"], "left_anti")
    return fresh


def _runs(lines: DataFrame, batches: int, fanout: int) -> DataFrame:
    """First holder of every line hash: the union of the levelled runs."""
    spark, levels, names = lines.sparkSession, {}, []

    def keep(rows: DataFrame, level: int) -> None:
        run = _write_run(rows)
        names.append(run[0])
        levels.setdefault(level, []).append(run)

    try:
        with _settings(spark):
            for b in range(batches):
                fresh = lines.where(F.col("batch") == b).groupBy("h1", "h2").agg(F.min("doc").alias("first"))
                keep(_against(fresh, [run for level in sorted(levels) for run in levels[level]]), 0)
                level = 0
                while b < batches - 1 and len(levels[level]) >= fanout:
                    old = levels.pop(level)
                    keep(reduce(DataFrame.unionByName, [spark.table(n) for n, _ in old]).repartition("h1", "h2"), level + 1)
                    for _, path in old:
                        delete(spark, path)
                    level += 1
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    paths = [path for level in levels.values() for _, path in level]
    return spark.read.schema("h1 long, h2 long, first " + lines.schema["doc"].dataType.simpleString()).parquet(*paths)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Drop lines that a document with a smaller id holds already.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and
    with ``A-Z`` in lower case; keys of fewer than ``min_chars`` code points
    never go.  Returns all columns of ``docs`` with ``text_col`` replaced, and
    ``n_lines`` (before) and ``n_dropped``; input columns of these two names
    are replaced.

    Null or empty text is one empty line and stays.  Rows with a null id hold
    no lines and lose none.  Rows with the same id are one document: they don't
    take lines from each other, and identical rows are treated alike.  Within
    the smallest holder repeated lines stay.  An empty table gives an empty one.
    """
    key = fold_case(F.btrim(F.col("line"), F.lit(SPACES)))
    cuts = _bounds(docs, id_col, batches)
    batch = reduce(lambda a, b: a + b, [(F.col("doc") > F.lit(c)).cast("int") for c in cuts], F.lit(0))
    lines = (
        docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .where(F.col("doc").isNotNull())
        .select("doc", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc", "row", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), batch.alias("batch"))
    )
    lines = materialise(lines, "lines", ["batch"])
    runs = _runs(lines, len(cuts) + 1, fanout)
    dropped = (
        lines.join(runs, ["h1", "h2"])
        .where(F.col("doc") > F.col("first"))
        .groupBy("doc", "row")
        .agg(F.collect_set("pos").alias("gone"))
        .withColumnsRenamed({"doc": "__ld_doc", "row": "__ld_row", "gone": "__ld_gone"})
    )
    kept = docs.drop("n_lines", "n_dropped") if {"n_lines", "n_dropped"} & set(docs.columns) else docs
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = kept.join(
        dropped.hint("shuffle_hash"),
        (kept[id_col] == F.col("__ld_doc")) & (F.xxhash64(F.coalesce(kept[text_col], F.lit(""))) == F.col("__ld_row")),
        "left",
    )
    split = joined.withColumn("__ld_lines", F.split(text, "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("__ld_lines") - 1), F.col("__ld_gone"))
    new = F.when(F.col("__ld_gone").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("__ld_lines", i)), "\n")
    )
    out = {c: (new if c == text_col else F.col(c)) for c in kept.columns}
    return split.select(
        *[v.alias(k) for k, v in out.items()],
        F.size("__ld_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__ld_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup over all ``documents``, with digests of what is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


ORACLE = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first_doc, false) AS gone
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
