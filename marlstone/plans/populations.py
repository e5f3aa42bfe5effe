"""Query catalogue: query populations, graded goldens, display titles, the plain walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import evaluate as EV
from marlstone.operators import graph as G
from marlstone.operators import index as I
from marlstone.operators import maintain as M
from marlstone.plans import corpus as C
from marlstone.plans import graphs, upkeep
from marlstone.plans import retrieval as V


def query_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent, middling and single terms of all documents."""
    return EV.query_bands(I.doc_frequency(C.postings(spark, sf_dir)))


def query_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands' terms with their pairs and triples, as query texts."""
    return EV.stride_queries(query_bands(spark, sf_dir))


def golden_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as goldens: their document in the best three, no archived one above; long ones are known failures."""
    asked = C.benchmark_queries(spark, sf_dir)
    top = V._ask(spark, sf_dir, asked, 50)
    seen = top.groupBy("query_id").agg(F.count("*").alias("n_results"), F.min(F.when(F.col("archived"), F.col("rank"))).alias("forbid_rank"))
    goldens = asked.select("query_id", F.lit(3).alias("max_rank"), (F.length("query") == 0).alias("expect_empty"), (F.length("query") > 200).alias("known"))
    rows = goldens.join(upkeep._gold(spark, sf_dir).select("query_id", "rank"), "query_id", "left").join(seen, "query_id", "left")
    return EV.grade(rows.withColumn("n_results", F.coalesce("n_results", F.lit(0)))).select("query_id", "status")


def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of all documents: a third is plain, a fifth is in the cache."""
    name = F.concat("source", F.lit(" "), F.col("doc_id").cast("string"))
    d = C.records(spark, sf_dir).withColumns({"name": name, "sha": F.sha2(F.col("id"), 256)})
    plain = F.when(F.col("doc_id") % 3 == 0, F.col("name"))
    records = d.select("id", "sha", plain.alias("title"), F.when(plain.isNull(), F.concat(F.lit("h:"), F.substring(F.md5("name"), 1, 16))).alias("title_h"))
    return M.display_titles(records, d.where("doc_id % 5 = 0").select("sha", F.col("name").alias("title")))


def ppr_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk without laziness over all foreign keys."""
    return G.pagerank(graphs.fk_edges(spark, sf_dir), graphs._seeds(spark), laziness=0.0).select("node", F.round("score", 9).alias("score"))


QUERIES = {f.__name__: f for f in (query_bands, query_population, golden_grades, display_titles, ppr_plain)}

_BANDS = f"""WITH {C.SQL_RECORDS}, v AS (SELECT term, df, row_number() OVER (ORDER BY df DESC, term) - 1 AS no, count(*) OVER () AS n, count(*) FILTER (WHERE df > 1) OVER () AS several FROM dfs
), b AS (
  SELECT 'head' AS band, no, term, df FROM v WHERE no < 120
  UNION ALL SELECT 'mid', no - greatest(0, n // 2 - 60), term, df FROM v WHERE no >= greatest(0, n // 2 - 60) AND no < greatest(0, n // 2 - 60) + 120
  UNION ALL SELECT 'tail', no - lo, term, df FROM (SELECT *, CASE WHEN several < n THEN several ELSE greatest(0, n - 120) END AS lo FROM v) WHERE no >= lo AND no < lo + 120
)"""


def _at(band: str, place: str) -> str:
    return f"(SELECT term FROM b WHERE band = '{band}' AND no = ({place}) % (SELECT count(*) FROM b WHERE band = '{band}'))"


ORACLES = {
    "query_bands": f"{_BANDS} SELECT * FROM b",
    "query_population": f"""{_BANDS} SELECT DISTINCT query FROM (SELECT term AS query FROM b
        UNION ALL SELECT concat_ws(' ', {_at('tail', 'i * 7')}, {_at('head', 'i')}) FROM range(200) t(i)
        UNION ALL SELECT concat_ws(' ', {_at('head', 'i')}, {_at('head', 'i * 3 + 1')}) FROM range(100) t(i)
        UNION ALL SELECT concat_ws(' ', {_at('tail', 'i * 5')}, {_at('mid', 'i * 11')}, {_at('head', 'i * 13')}) FROM range(100) t(i)) WHERE query <> ''""",
    "golden_grades": f"""{upkeep._GOLD}, seen AS (SELECT query_id, count(*) AS n_results, min(rank) FILTER (WHERE id LIKE 'file:src0/%') AS forbid_rank FROM top WHERE rank <= 50 GROUP BY 1
        ), j AS (SELECT a.query_id, length(a.query) > 200 AS known, coalesce(CASE WHEN length(a.query) = 0 THEN coalesce(n_results, 0) = 0
          ELSE g.rank <= 3 AND (forbid_rank IS NULL OR forbid_rank >= g.rank) END, false) AS met
          FROM ({C.SQL_BENCH}) a LEFT JOIN g ON g.query_id = a.query_id LEFT JOIN seen s ON s.query_id = a.query_id)
        SELECT query_id, CASE WHEN met AND known THEN 'xpass' WHEN met THEN 'pass' WHEN known THEN 'xfail' ELSE 'fail' END AS status FROM j""",
    "display_titles": f"""WITH {C.SQL_RECORDS} SELECT id, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN source || ' ' || doc_id
        ELSE substr(md5(source || ' ' || doc_id), 1, 16) || ' (uncached — title unavailable)' END AS title FROM rec""",
    "ppr_plain": f"{graphs._PPR.replace('0.425 * p.m', '0.85 * p.m').replace('0.425 * m FROM', '0.0 * m FROM')} SELECT * FROM sc",
}
