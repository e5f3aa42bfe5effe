"""Maintenance: deltas, merges, drift, carried records, bounded caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def delta(prior: DataFrame, current: DataFrame) -> DataFrame:
    """``id, action`` between two states ``id, sha``: reuse, extract or drop."""
    both = prior.select("id", F.col("sha").alias("old")).join(current.select("id", F.col("sha").alias("new")), "id", "full_outer")
    action = F.when(F.col("new").isNull(), "drop").when(F.col("old") == F.col("new"), "reuse").otherwise("extract")
    return both.select("id", action.alias("action"))


def bump(prior: DataFrame, current: DataFrame) -> DataFrame:
    """Current records with their version: one more where the content changed."""
    both = current.select("id", "sha").join(prior.select("id", F.col("sha").alias("old"), F.col("ver").alias("was")), "id", "left")
    ver = F.when(F.col("was").isNull(), 1).when(F.col("sha") == F.col("old"), F.col("was")).otherwise(F.col("was") + 1)
    return both.select("id", "sha", ver.cast("int").alias("ver"))


def drift(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """``id, state``: fresh, stale, gone, or unverified where nothing was looked up.

    ``current`` has ``id, sha, ok``; a lookup that failed is no statement.
    """
    rows = indexed.select("id", F.col("sha").alias("old")).join(current.select("id", F.col("sha").alias("now"), "ok"), "id", "left")
    state = F.when(F.col("ok").isNull(), "gone").when(~F.col("ok"), "unverified").when(F.col("old") == F.col("now"), "fresh").otherwise("stale")
    return rows.select("id", state.alias("state"))


def carried(prior: DataFrame, listed: DataFrame, fetched: DataFrame) -> DataFrame:
    """Prior records that are still listed and weren't fetched this time."""
    return prior.join(listed.select("id").distinct(), "id", "left_semi").join(fetched.select("id"), "id", "left_anti")


def delisted(prior: DataFrame, listed: DataFrame) -> DataFrame:
    """Prior records that no list names any more."""
    return prior.join(listed.select("id"), "id", "left_anti")


def merge3(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Three-way merge of ``id, ver, sha``: ``id, status, ver, sha``.

    Agreement, a one-sided addition, and a change or removal of what the other
    side left alone are taken.  If both sides changed a record the larger
    version wins.  Everything else is a conflict and has no value.
    """
    side = lambda df, p: df.select("id", F.struct("ver", "sha").alias(p))
    m = side(base, "b").join(side(ours, "o"), "id", "full_outer").join(side(theirs, "t"), "id", "full_outer")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    pick = (
        F.when(o.eqNullSafe(t), F.lit("ours"))
        .when(o.eqNullSafe(b), F.lit("theirs"))
        .when(t.eqNullSafe(b), F.lit("ours"))
        .when(o.isNull() | t.isNull() | b.isNull(), F.lit("conflict"))
        .when(o["ver"] > t["ver"], F.lit("ours"))
        .when(o["ver"] < t["ver"], F.lit("theirs"))
        .otherwise(F.lit("conflict"))
    )
    rows = m.withColumn("pick", pick)
    value = F.when(F.col("pick") == "ours", o).when(F.col("pick") == "theirs", t)
    rows = rows.select("id", F.when(F.col("pick") == "conflict", "conflict").when(value.isNull(), "deleted").otherwise("merged").alias("status"), value.alias("v"))
    return rows.select("id", "status", F.col("v.ver").alias("ver"), F.col("v.sha").alias("sha"))


def dirty_union(pending: DataFrame, more: DataFrame) -> DataFrame:
    return pending.select("id").unionAll(more.select("id")).distinct()


def dirty_subtract(pending: DataFrame, covered: DataFrame) -> DataFrame:
    """What was pending and isn't covered; later additions are never cleared."""
    return pending.join(covered.select("id"), "id", "left_anti")


def fresh_entries(cache: DataFrame, now: Column, ttl: int) -> DataFrame:
    """Entries younger than ``ttl`` seconds; a ttl of 0 or less turns the cache off."""
    return cache.where((now - F.col("fetched_at") < ttl) & F.lit(ttl > 0))


def evict(cache: DataFrame, order: list[str], max_bytes: int, per: str | None = None) -> DataFrame:
    """The newest entries whose sizes together stay within ``max_bytes``.

    Sizes are summed from the newest down, the last of ``order`` breaking ties;
    with ``per`` every partition has a budget of its own and is summed apart.
    """
    w = Window.orderBy(*[F.col(c).desc() for c in order])
    w = Window.partitionBy(per).orderBy(*[F.col(c).desc() for c in order]) if per else w
    total = F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return cache.withColumn("__total", total).where(F.col("__total") <= max_bytes).drop("__total")


def policy(lines: DataFrame, source: dict, defaults: dict) -> DataFrame:
    """Each line's settings: its own, else the source's, else the built-in ones."""
    cols = [F.coalesce(F.col("attrs")[k], F.lit(source.get(k)), F.lit(v)).alias(k) for k, v in defaults.items()]
    return lines.select("value", *cols)


def changed_shards(old: DataFrame, new: DataFrame) -> DataFrame:
    """Shards whose digest differs between two states ``shard, digest``."""
    both = old.select("shard", F.col("digest").alias("a")).join(new.select("shard", F.col("digest").alias("b")), "shard", "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("shard", F.col("b").isNull().alias("gone"))


def shard_digests(records: DataFrame, shard: Column) -> DataFrame:
    """An order-free digest of every shard's rows ``id, sha``."""
    rows = records.select(shard.alias("shard"), F.xxhash64("id", "sha").alias("h"))
    return rows.groupBy("shard").agg(F.count("*").alias("n"), F.bit_xor("h").alias("digest"))


def display_titles(records: DataFrame, cache: DataFrame) -> DataFrame:
    """``id, title`` as shown for ``id, sha, title, title_h``: the plain title, else the cached one, else the labelled hash.

    ``cache`` holds one ``title`` for each ``sha``; a hash loses its ``h:``.
    """
    shown = cache.select("sha", F.col("title").alias("cached"))
    digest = F.regexp_replace(F.coalesce("title_h", F.lit("")), "^h:", "")
    label = F.concat(digest, F.lit(" (uncached — title unavailable)"))
    return records.join(shown, "sha", "left").select("id", F.coalesce("title", "cached", label).alias("title"))
