"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of consecutive words; a window is the set
of its placed shingles.  As containment has to be exact, every shingle of a
window is necessary, so the rarest one (by its count in the corpus) is prefix
enough.  Document shingles that occur in the benchmark at all are found in one
scan; from those, the prefix shingles propose starts, bounds on place and
length discard the impossible, and the survivors are compared word by word
with the document.

All of it is DataFrame expressions.  The benchmark side is broadcast only up to
``broadcast_rows`` shingles, counted first, and is shuffled beyond that; the
scan's output is the occurrences of benchmark shingles, not pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import fold_case, materialise, sha256_hex, table

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after folding A-Z; null has none."""
    return F.filter(F.split(fold_case(F.coalesce(text, F.lit(""))), _GAP, -1), lambda w: w != "")


def _shingles(words: Column, k: int) -> Column:
    """64-bit hashes of the k-word shingles, with their places and k."""
    at = lambda i: F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)])
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), at))


def benchmark_windows(bench: DataFrame, item_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """Windows of all items: ``win, words, len, k, item``, a row for each item that holds one."""
    w = bench.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("words")).where((F.size("words") > 0) & F.col("item").isNotNull())
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - window))
    w = w.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s + 1, window))).alias("words"))
    return w.distinct().select(
        F.md5(F.concat_ws(" ", "words").cast("binary")).alias("win"), "words", F.size("words").alias("len"), F.least(F.lit(shingle), F.size("words")).alias("k"), F.col("item").cast("string").alias("item"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 3, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Find benchmark windows inside documents.

    Returns all columns of ``docs`` and ``n_words``, ``n_hit`` (words inside an
    occurring window), ``items`` (sorted array of items with one, ids as
    strings) and ``contaminated``; input columns of these names are replaced.

    An item of fewer than ``window`` words is one window; an item without words
    or id is none.  Null or empty text has no words.  Rows with a null id are
    returned with their words counted and never as contaminated.  Rows with the
    same id are looked at one by one, identical rows alike.  An empty benchmark
    hits nothing; an empty table gives an empty one.
    """
    docs = docs.drop("n_words", "n_hit", "items", "contaminated")
    held = materialise(benchmark_windows(bench, item_col, item_text_col, window, shingle), "windows")
    wins = materialise(held.dropDuplicates(["win"]).drop("item"), "distinct-windows")
    placed = None
    for k in range(1, shingle + 1):
        part = wins.where(F.col("k") == k).select("win", "len", F.posexplode(_shingles(F.col("words"), k)).alias("at", "h"))
        placed = part if placed is None else placed.unionByName(part)
    placed = materialise(placed, "placed")
    wanted = placed.select("h").distinct()
    if placed.count() <= broadcast_rows:
        wanted, small = F.broadcast(wanted), F.broadcast
    else:
        small = lambda df: df

    row = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), row.alias("row"), words_of(F.col(text_col)).alias("words"))
    lengths = [r["k"] for r in wins.select("k").distinct().collect()]  # at most ``shingle`` values
    found = None
    for k in sorted(lengths):
        part = base.select("doc", "row", F.size("words").alias("n"), F.posexplode(_shingles(F.col("words"), k)).alias("pos", "h")).join(wanted, "h")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = base.select("doc", "row", F.size("words").alias("n"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("h")).where(F.lit(False))
    found = materialise(found.select("doc", "row", "n", "pos", "h"), "occurrences")

    rarity = found.groupBy("h").agg(F.count("*").alias("df"))
    ranked = placed.join(rarity, "h", "left").groupBy("win", "len").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "at")).alias("rare"))
    prefix = ranked.where(F.col("rare.df") > 0).select("win", "len", F.col("rare.h").alias("h"), F.col("rare.at").alias("at"))
    prefix = materialise(prefix.join(wins.select("win", F.col("words").alias("need")), "win"), "prefix")
    starts = (
        found.join(small(prefix), "h")
        .withColumn("start", F.col("pos") - F.col("at"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
        .groupBy("doc", "row").agg(F.collect_set(F.struct("start", "len", "need", "win")).alias("cand"))
    )
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), row.alias("row"), F.col(text_col).alias("text"))
    checked = texts.join(starts, ["doc", "row"]).dropDuplicates(["doc", "row"]).select("doc", "row", "cand", words_of(F.col("text")).alias("words"))
    checked = materialise(checked, "candidates")  # else the split moves into the lambda and runs for each candidate
    true = F.filter("cand", lambda c: F.slice("words", c.getField("start") + 1, c.getField("len")) == c.getField("need"))
    checked = checked.select("doc", "row", true.alias("true")).where(F.size("true") > 0)
    covered = F.flatten(F.transform("true", lambda c: F.sequence(c.getField("start"), c.getField("start") + c.getField("len") - 1)))
    checked = materialise(checked.select("doc", "row", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), F.array_distinct(F.transform("true", lambda c: c.getField("win"))).alias("wins")), "hits")
    named = checked.select("doc", "row", F.explode("wins").alias("win")).join(held.select("win", "item"), "win")
    named = named.groupBy("doc", "row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = checked.select("doc", "row", "n_hit").join(named, ["doc", "row"]).select(*[F.col(c).alias(f"__d_{c}") for c in ("doc", "row", "n_hit", "items")])
    out = docs.withColumns({"__d_words": F.size(words_of(F.col(text_col))).cast("long"), "__d_key": row})
    out = out.join(hits.hint("shuffle_hash"), (out[id_col] == F.col("__d_doc")) & (out["__d_key"] == F.col("__d_row")), "left")
    return out.select(
        *docs.columns,
        F.col("__d_words").alias("n_words"),
        F.coalesce("__d_n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("__d_items", F.array().cast("array<string>")).alias("items"),
        F.col("__d_n_hit").isNotNull().alias("contaminated"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all of ``benchmark``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        sha256_hex(F.array_join("items", ",")).alias("items_sha256"), "contaminated",
    )


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, len(ws[s : s + 9]) AS n, array_to_string(ws[s : s + 9], ' ') AS win
  FROM bw, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(s) WHERE len(ws) > 0
), places AS (
  SELECT doc_id, s, n, array_to_string(ws[s : s + n - 1], ' ') AS win
  FROM dw, (SELECT DISTINCT n FROM wins) k, unnest(range(1, len(ws) - n + 2)) AS t(s)
), hits AS (
  SELECT p.doc_id, p.s, p.n, w.item_id FROM places p JOIN wins w ON p.win = w.win AND p.n = w.n
), words AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words w ON d.doc_id = w.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""
