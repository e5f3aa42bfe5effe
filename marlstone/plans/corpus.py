"""Bindings of the engine's concepts to tables, shared by the query catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import index as I
from marlstone.operators import ranking as R
from marlstone.operators.shared import spread

#: Sources that count as archived.
ARCHIVED = ["src0"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in ("documents", "pages") else found


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a file corpus: ``id, loc, source, lang, body``."""
    loc = F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("file:"), loc).alias("id"), loc.alias("loc"), "source", "lang", "doc_id", F.coalesce("text", F.lit("")).alias("body"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.fields(records(spark, sf_dir))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.postings(fields(spark, sf_dir))


def scored_batch(spark: SparkSession, sf_dir: str, queries: DataFrame) -> DataFrame:
    """Scores of all documents that share a term with ``query_id, query``.

    Tokens are filtered by the queries' terms before anything is shuffled, as a
    posting list's term filter would; statistics come from token counts alone.
    """
    f = fields(spark, sf_dir)
    terms = R.explode_queries(queries)
    small = R.small_enough(terms)
    wanted = terms.select("term").distinct()
    wanted = F.broadcast(wanted) if small else wanted
    rows = f.select("id", "wlen", F.explode("body_tokens").alias("term")).join(wanted, "term", "left_semi")
    posts = rows.groupBy("id", "wlen", "term").agg(F.count("*").alias("tf_b")).withColumn("tf_h", F.lit(0).cast("long"))
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    return R.score(terms, posts, I.corpus_stats(f), df)


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def sql_tokens(text: str) -> str:
    """DuckDB's form of the analyser."""
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9_]+'), lambda t: t NOT IN ({_STOP}))"


SQL_RECORDS = f"""rec AS (
  SELECT 'file:' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.md' AS id,
         source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.md' AS loc, source, lang, doc_id,
         coalesce(text, '') AS body, {sql_tokens("coalesce(text, '')")} AS toks FROM documents
), tok AS (SELECT id, unnest(toks) AS term FROM rec
), lens AS (SELECT id, CAST(len(toks) AS BIGINT) AS wlen FROM rec
), stats AS (SELECT count(*) AS n, coalesce(CAST(sum(wlen) AS BIGINT), 0) AS total_wlen, coalesce(sum(wlen) / count(*), 0) AS avg_wlen FROM lens
), post AS (SELECT t.id, t.term, l.wlen, count(*) AS tf_b FROM tok t JOIN lens l ON t.id = l.id GROUP BY ALL
), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""

SQL_SCORE = "ln((n - df + 0.5) / (df + 0.5) + 1) * tf_b * 2.2 / (tf_b + 1.2 * (0.25 + 0.75 * wlen / avg_wlen))"


def sql_scored(queries: str) -> str:
    """CTEs up to ``scored(query_id, id, loc, source, score)`` for a query CTE's SQL."""
    return f"""{SQL_RECORDS}, q AS ({queries}
), qt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({sql_tokens("query")}) AS term FROM q)
), scored AS (
  SELECT qt.query_id, p.id, sum({SQL_SCORE}) AS score
  FROM qt JOIN post p ON qt.term = p.term JOIN dfs d ON qt.term = d.term CROSS JOIN stats GROUP BY qt.query_id, p.id
)"""


def sql_top(source: str, k: int) -> str:
    """The k best of each query, with their rank."""
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {source} WHERE score > 0) WHERE rank <= {k}"


SQL_BENCH = "SELECT item_id AS query_id, coalesce(text, '') AS query FROM benchmark"
