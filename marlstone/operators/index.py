"""The inverted index: postings, statistics, posting blocks, constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions import text as T

#: Saturation, length normalisation, postings in a block.
K1, B, BLOCK = 1.2, 0.75, 128


def fields(records: DataFrame, id_col: str = "id", body: str = "body", heads: str | None = None, title: str | None = None) -> DataFrame:
    """``id, heading_tokens, body_tokens, wlen`` of every record."""
    if heads:
        h = T.heading_tokens(F.col(heads), F.col(title) if title else F.get(heads, F.lit(0)))
        b = T.tokens(T.without_headings(F.col(body)))
    else:
        h, b = F.array().cast("array<string>"), T.tokens(F.col(body))
    df = records.select(F.col(id_col).alias("id"), h.alias("heading_tokens"), b.alias("body_tokens"))
    return df.withColumn("wlen", (T.HEADING_WEIGHT * F.size("heading_tokens") + T.BODY_WEIGHT * F.size("body_tokens")).cast("long"))


def postings(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """``term, id, tf_h, tf_b, wlen``: a row for every term of every record.

    Both fields are exploded together, so term frequencies need one shuffle.
    """
    marked = F.concat(
        F.transform("heading_tokens", lambda t: F.struct(t.alias("term"), F.lit(1).alias("h"))),
        F.transform("body_tokens", lambda t: F.struct(t.alias("term"), F.lit(0).alias("h"))),
    )
    rows = df.select("id", "wlen", *keep, F.explode(marked).alias("t"))
    return rows.groupBy("id", "wlen", *keep, F.col("t.term").alias("term")).agg(
        F.sum("t.h").cast("long").alias("tf_h"), F.sum(1 - F.col("t.h")).cast("long").alias("tf_b"))


def corpus_stats(df: DataFrame) -> DataFrame:
    """One row ``n, total_wlen, avg_wlen``; a missing length counts in ``n`` alone."""
    total = F.coalesce(F.sum("wlen"), F.lit(0)).cast("long")
    return df.agg(F.count("*").alias("n"), total.alias("total_wlen")).withColumn(
        "avg_wlen", F.when(F.col("n") > 0, F.col("total_wlen") / F.col("n")).otherwise(F.lit(0.0)))


def doc_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def contribution(weight: Column, tf_h: Column, tf_b: Column, wlen: Column, avg: Column) -> Column:
    """Field-weighted frequency first, saturated once; 0 where it can't count."""
    wtf = T.HEADING_WEIGHT * tf_h + T.BODY_WEIGHT * tf_b
    score = weight * wtf * (K1 + 1) / (wtf + K1 * (1 - B + B * F.coalesce(wlen, F.lit(0)) / avg))
    return F.when((wtf > 0) & (avg > 0), score).otherwise(F.lit(0.0))


def blocks(posts: DataFrame, size: int = BLOCK) -> DataFrame:
    """Posting blocks with the figures that bound their scores.

    ``mx`` is the largest weighted frequency and ``mnw`` the least length.
    """
    order = Window.partitionBy("term").orderBy("id")
    rows = posts.withColumn("block_no", F.floor((F.row_number().over(order) - 1) / size).cast("long"))
    return rows.groupBy("term", "block_no").agg(
        F.max(T.HEADING_WEIGHT * F.col("tf_h") + F.col("tf_b")).alias("mx"), F.min("wlen").alias("mnw"),
        F.min("id").alias("first_doc"), F.max("id").alias("last_doc"), F.count("*").alias("cnt"))


def duplicate_ids(records: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids that occur more than once; empty in a sound index."""
    return records.groupBy(id_col).agg(F.count("*").alias("times")).where("times > 1")


def hash_collisions(terms: DataFrame, term: str, hashed: str) -> DataFrame:
    """Hashes that stand for several terms; empty in a sound index."""
    return terms.groupBy(hashed).agg(F.count_distinct(term).alias("n_terms")).where("n_terms > 1")


def policy_violations(records: DataFrame) -> DataFrame:
    """Records from outside the repository that show more than their policy allows."""
    outside = F.col("src") != "git"
    hashed = F.col("meta") == "hashed"
    bad = outside & (
        F.col("meta").isNull() | ~F.col("meta").isin("plain", "hashed")
        | (hashed & (F.col("title").isNotNull() | (F.size(F.coalesce("phrases", F.array())) > 0) | F.col("title_h").isNull()))
    )
    return records.where(bad)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
