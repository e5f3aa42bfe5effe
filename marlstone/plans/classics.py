"""Query catalogue: signatures, supersession, extractive answers, explain with communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators import classics as K
from marlstone.operators import graph as G
from marlstone.operators import passages as P
from marlstone.plans import corpus as C
from marlstone.plans import graphs
from marlstone.plans import retrieval as V

ASKED = ["license", "version", "token", "the"]


def bloom_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of all documents, and how many of four terms each may hold."""
    f = C.fields(spark, sf_dir).select("id", F.array_distinct("body_tokens").alias("terms"))
    f = f.withColumn("bytes", K.signature_bytes(F.size("terms")))
    f = f.select("id", F.size("terms").cast("long").alias("n_terms"), "bytes", K.signature("terms", F.col("bytes")).alias("places"))
    hits = K.match_count(F.col("places"), F.col("bytes"), ASKED)
    return f.select("id", "n_terms", F.col("bytes").cast("long").alias("bytes"), F.size("places").cast("long").alias("n_bits"), hits.alias("hits"), (hits == len(ASKED)).alias("may_hold_all"))


def supersession_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finished order gives way to its customer's next one; urgent ones name an order that isn't there."""
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    target = F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderpriority") == "1-URGENT", -F.col("o_orderkey") - 1).otherwise(after))
    return K.resolve_supersession(C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), target.alias("superseded_by")))


def textrank_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three sentences of the best document's passages, for each benchmark question."""
    asked = C.benchmark_queries(spark, sf_dir)
    best = V._ask(spark, sf_dir, asked, 1).select("query_id", "id")
    cut = P.chunks(best.join(C.records(spark, sf_dir).select("id", "loc", "body"), "id"), ["query_id", "id", "loc"], "body")
    scored = P.rescore(cut, asked).join(asked, "query_id")
    rows = scored.select("query_id", "query", F.col("loc").alias("file"), F.lit(1).alias("start"), "text", "score")
    return K.extractive_answer(rows).withColumn("score", F.round("score", 6))


def explain_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of regions, nations and suppliers with their community and its other members."""
    edges = graphs.fk_edges(spark, sf_dir).where(F.col("src").startswith("supplier:") | F.col("src").startswith("nation:"))
    return G.with_community(edges.select(F.col("src").alias("doc")).distinct(), G.communities(edges))


QUERIES = {f.__name__: f for f in (bloom_prefilter, supersession_chain, textrank_answer, explain_community)}

_PLACE = "CAST('0x' || substr(md5({i} || ':' || t), 1, 8) AS BIGINT) % (8 * bytes)"
_PLACES = "[" + ", ".join(_PLACE.replace("{i}", f"'{i}'") for i in range(K.HASHES)) + "]"
_HITS = " + ".join(f"CAST(list_has_all(places, (SELECT {_PLACES} FROM (SELECT '{w}' AS t))) AS BIGINT)" for w in ASKED)

ORACLES = {
    "bloom_prefilter": f"""WITH {C.SQL_RECORDS}, d AS (SELECT id, list_distinct(toks) AS ts, len(list_distinct(toks)) AS n_terms FROM rec
        ), b AS (SELECT *, greatest(8, least(128, CAST(ceil(floor(n_terms * 9.6::DOUBLE) / 8) AS BIGINT))) AS bytes FROM d
        ), p AS (SELECT id, n_terms, bytes, list_distinct(flatten(list_transform(ts, lambda t: {_PLACES}))) AS places FROM b
        ), h AS (SELECT *, {_HITS} AS hits FROM p)
        SELECT id, CAST(n_terms AS BIGINT) AS n_terms, CAST(bytes AS BIGINT) AS bytes, CAST(len(places) AS BIGINT) AS n_bits, hits, hits = {len(ASKED)} AS may_hold_all FROM h""",
    "supersession_chain": """WITH RECURSIVE o AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN -o_orderkey - 1
          ELSE lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END END AS nxt FROM orders
        ), r AS (SELECT id, nxt AS at FROM o WHERE nxt IS NOT NULL UNION ALL SELECT r.id, o.nxt FROM r JOIN o ON o.id = r.at WHERE o.nxt IS NOT NULL
        ), e AS (SELECT r.id, r.at FROM r LEFT JOIN o ON o.id = r.at WHERE o.id IS NULL OR o.nxt IS NULL)
        SELECT o.id, o.nxt AS superseded_by, k.id AS resolved, o.nxt IS NOT NULL AND k.id IS NULL AS unresolved FROM o LEFT JOIN e ON e.id = o.id LEFT JOIN o k ON k.id = e.at""",
}
