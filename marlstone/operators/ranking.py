"""Ranking: candidates, scores, top-k, fusion and dense lanes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions import text as T
from marlstone.operators import index as I

#: Fixed value: the constant of reciprocal rank fusion.
RRF_K = 60

#: Query-term rows up to which a batch of queries is broadcast.
BROADCAST_TERMS = 1_000_000


def explode_queries(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """``query_id, qpos, term`` of every query, in query order."""
    return queries.select(F.col(id_col).alias("query_id"), F.posexplode(T.query_terms(F.col(text_col))).alias("qpos", "term"))


def small_enough(df: DataFrame, rows: int = BROADCAST_TERMS) -> bool:
    """Whether a side has few enough rows to be broadcast; counts to the limit only."""
    return df.limit(rows + 1).count() <= rows


def score(terms: DataFrame, posts: DataFrame, stats: DataFrame, df: DataFrame | None = None, checked: bool = True) -> DataFrame:
    """``query_id, id, score`` of every document that shares a term.

    Contributions are added in query order, so a score doesn't depend on how
    rows were shuffled.  Postings may carry their term's ``df``.  The query side is broadcast only after its size has
    been checked; one row of corpus statistics always is.
    """
    side = F.broadcast(terms) if checked and small_enough(terms) else terms
    hits = posts.join(side, "term")
    if "df" not in posts.columns:
        asked = terms.select("term").distinct()
        weights = I.doc_frequency(posts.join(asked if side is terms else F.broadcast(asked), "term", "left_semi")) if df is None else df
        hits = hits.join(weights, "term")
    hits = hits.crossJoin(F.broadcast(stats))
    part = I.contribution(I.idf(F.col("n"), F.col("df")), F.col("tf_h"), F.col("tf_b"), F.col("wlen"), F.col("avg_wlen"))
    grouped = hits.groupBy("query_id", "id").agg(F.array_sort(F.collect_list(F.struct("qpos", part.alias("c")))).alias("cs"))
    return grouped.select("query_id", "id", F.aggregate("cs", F.lit(0.0), lambda a, x: a + x.getField("c")).alias("score"))


def demote(scored: DataFrame, archived: Column, weight: float) -> DataFrame:
    """Multiply archived documents' scores; weight 1 leaves the plan alone."""
    if weight == 1.0:
        return scored
    return scored.withColumn("score", F.when(archived, F.col("score") * weight).otherwise(F.col("score")))


def top_k(scored: DataFrame, k: int, per: str | None = "query_id") -> DataFrame:
    """The k best by score rounded to nine places, then id; scores of 0 go."""
    good = scored.where("score > 0")
    if per is None:
        return good.orderBy(F.round("score", 9).desc(), "id").limit(k)
    order = Window.partitionBy(per).orderBy(F.round("score", 9).desc(), "id")
    return good.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def rrf(ranked: DataFrame, per: list[str] = (), k: int = RRF_K) -> DataFrame:
    """Fuse rows of ``item, rank`` and optional ``rank_offset`` over lanes."""
    offset = F.col("rank_offset") if "rank_offset" in ranked.columns else F.lit(0)
    return ranked.groupBy(*per, "item").agg(F.sum(1 / (k + F.col("rank") + offset)).alias("score"))


def sign_words(v: Column, dims: int) -> Column:
    """Bit i of the code is set where component i is above 0; 64 bits to a word."""
    word = lambda w: F.aggregate(
        F.sequence(F.lit(0), F.lit(min(64, dims - 64 * w) - 1)), F.lit(0).cast("long"),
        lambda acc, i: acc.bitwiseOR(F.when(F.get(v, i + 64 * w) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
    )
    return F.array(*[word(w) for w in range(-(-dims // 64))])


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def dense_top(codes: DataFrame, queries: DataFrame, width: int = 100) -> DataFrame:
    """Nearest codes of each query by Hamming distance, ties by id.

    Queries (``query_id, qcode``) are a stated set held against all rows, in
    blocks of a number that can be broadcast.
    """
    blocks = _query_blocks(queries, 100_000)
    return reduce(DataFrame.unionByName, [_dense_block(codes, b, width) for b in blocks])


def _query_blocks(queries: DataFrame, rows: int) -> list[DataFrame]:
    """Queries in blocks of about ``rows`` by the hash of their id; together they are all of them."""
    n = -(-queries.count() // rows)
    return [queries] if n <= 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]


def _dense_block(codes: DataFrame, queries: DataFrame, width: int) -> DataFrame:
    near = codes.where(F.col("code").isNotNull()).crossJoin(F.broadcast(queries)).withColumn("distance", hamming(F.col("code"), F.col("qcode")))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= width).select("query_id", "id", "distance", "rank")


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best of all rows ``id, v`` by cosine for each of ``query_id, q``, ties by id.

    No row is left out: each batch of rows meets all queries in blocks, and its k
    best of a query go on.  Queries are a stated set, held against all rows in
    blocks of a number that can be broadcast.
    """
    blocks = _query_blocks(queries, 100_000)
    return reduce(DataFrame.unionByName, [_cosine_block(vectors, b, k) for b in blocks])


def _cosine_block(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    spark = vectors.sparkSession
    asked = queries.collect()
    names = np.array([r["query_id"] for r in asked])
    q = spark.sparkContext.broadcast((names, _unit([r["q"] for r in asked])))
    ids = {"query_id": queries.schema["query_id"].dataType, "id": vectors.schema["id"].dataType}

    def run(batches):
        names, wanted = q.value
        for part in batches:
            part = part.sort_values("id")
            found, v = part["id"].to_numpy(), _unit(part["v"].tolist())
            for at in range(0, len(wanted) if len(found) else 0, 256):
                cos = np.round(wanted[at : at + 256] @ v.T, 6)
                best = np.argsort(-cos, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(names[at : at + 256], best.shape[1]), "id": found[best].ravel(), "cosine": np.take_along_axis(cos, best, 1).ravel()})

    rows = vectors.select("id", "v").mapInPandas(run, ", ".join([*(f"{n} {t.simpleString()}" for n, t in ids.items()), "cosine double"]))
    order = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "id", "cosine")


def _unit(rows: list) -> np.ndarray:
    """Rows at length 1; those without length stay 0."""
    m = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    norm = np.linalg.norm(m, axis=-1, keepdims=True) if len(m) else m
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def mean_code(chunks: DataFrame, key: str, vec: str = "q", scale: str = "scale", dims: int = 64) -> DataFrame:
    """Sign code of the scale-weighted mean of a document's chunk vectors.

    Rows without any chunk vector have no code.
    """
    parts = chunks.where(F.col(vec).isNotNull()).select(key, scale, F.posexplode(vec).alias("dim", "x"))
    sums = parts.groupBy(key, "dim").agg(F.sum(F.col(scale) * F.col("x")).alias("s"))
    packed = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "s"))).alias("v"))
    return packed.select(key, sign_words(F.col("v.s"), dims).alias("code"))
