"""Query catalogue: sources, maintenance, constraints and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import evaluate as EV
from marlstone.operators import index as I
from marlstone.operators import maintain as M
from marlstone.operators import ranking as R
from marlstone.plans import corpus as C
from marlstone.plans import retrieval as V
from marlstone.plans.corpus import SQL_BENCH, SQL_RECORDS, sql_scored, sql_top, sql_tokens
from marlstone.plans.pages import SQL_SNAPSHOTS, _snapshots


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for every document, with folders and types by its language and id."""
    ext = F.element_at(F.array(*[F.lit(e) for e in ("md", "txt", "svg", "rst", "json")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return C.table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/work/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), "text")


def source_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    tests = {"g1": "*.md", "g2": "en/*/src1/*", "g3": "**/src?/*.txt", "g4": "en/**", "g5": "*/work"}
    return _paths(spark, sf_dir).select("path", *[T.glob_match(g, p).alias(k) for k, g in tests.items()])


def source_excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("path", T.excluded_by(["*/work/src1", "fr", "*.svg"], F.col("path")).alias("excluded_by"))


def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(spark, sf_dir).withColumn("ok", T.accepted_type(F.col("path"), ["*.md", "*.markdown", "*.txt", "*.rst", "*.adoc", "*.org"], ["en/work/src2/*"]))
    return rows.select("path", "ok")


def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why contents would be skipped; some are made empty or binary by their id's digits."""
    from marlstone.sources.files import skip_reason

    d = C.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    spoiled = F.when(F.col("doc_id") % 10 == 3, F.lit("").cast("binary")).when(F.col("doc_id") % 10 == 4, F.concat("content", F.unhex(F.lit("00")))).when(F.col("doc_id") % 10 == 5, F.concat("content", F.unhex(F.lit("C3")))).otherwise(F.col("content"))
    return d.select("doc_id", skip_reason(spoiled).alias("reason"))


def delta_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    return M.delta(before, after)


def version_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    return M.bump(before, after).select("id", "ver")


def drift_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    states = M.drift(before, after.withColumn("ok", F.col("doc_id") % 19 != 0))
    return states.groupBy("state").agg(F.count("*").alias("n"))


def delisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    return M.delisted(before, after).select("id")


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    return M.carried(before, after, after.where("doc_id % 19 <> 0")).select("id", "sha")


def dirty_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents pending after a run that covered those divisible by 7."""
    before, after = _snapshots(spark, sf_dir)
    return M.dirty_subtract(M.dirty_union(before, after), after.where("doc_id % 7 = 0")).select("id")


def merge3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base, an edit of the multiples of 13 and 3, and one of those of 5 and 3."""
    r = C.records(spark, sf_dir).select("id", "doc_id", F.md5(F.col("body").cast("binary")).alias("sha"))

    def side(gone: int, new: int, edit: int, more: int) -> DataFrame:
        rows = r.where((F.col("doc_id") % gone != 0) & (F.col("doc_id") % new != 1))
        hit = (F.col("doc_id") % edit == 0) | (F.col("doc_id") % 3 == 0)
        return rows.select("id", F.when(hit, 2 + more * (F.col("doc_id") % 2)).otherwise(F.lit(1)).cast("int").alias("ver"), F.when(hit, F.concat("sha", F.lit(str(edit)))).otherwise(F.col("sha")).alias("sha"))

    base = r.where("doc_id % 11 <> 1").select("id", F.lit(1).alias("ver"), "sha")
    return M.merge3(base, side(17, 29, 13, 1), side(19, 31, 5, 0))


def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = C.records(spark, sf_dir).select("loc", (F.col("doc_id") % 1000).alias("fetched_at"))
    return M.fresh_entries(cache, F.lit(1000), 300)


def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A display cache for each source, of 50 kB each."""
    cache = C.records(spark, sf_dir).select("source", "loc", F.octet_length("body").cast("long").alias("bytes"), F.col("doc_id").alias("seq"))
    return M.evict(cache, ["seq"], 50_000, "source").select("loc", "bytes")


def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("meta"), F.lit("hashed"))).otherwise(F.create_map(F.lit("fetcher"), F.lit("browser")))
    lines = C.table(spark, sf_dir, "pages").select(F.col("url").alias("value"), own.alias("attrs"))
    return M.policy(lines, {"fetcher": "http"}, {"fetcher": "none", "meta": "plain", "ttl": "0"})


def constraint_unique_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.records(spark, sf_dir).select("id").unionAll(C.records(spark, sf_dir).where("doc_id % 100 = 0").select("id"))
    return I.duplicate_ids(rows)


def constraint_meta_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page records of which every third breaks the policy in one of three ways."""
    k = F.col("page_id") % 9
    rows = C.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("url:"), "url").alias("id"), F.lit("url").alias("src"), F.when(k != 0, "hashed").alias("meta"),
        F.when(k == 3, "shown").alias("title"), F.when(k != 6, "h:0").alias("title_h"), F.array().cast("array<string>").alias("phrases"))
    return I.policy_violations(rows).select("id")


def constraint_term_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that share the first five digits of their hash: too short a hash collides."""
    terms = C.fields(spark, sf_dir).select(F.explode("body_tokens").alias("term")).distinct().withColumn("h", F.substring(F.md5(F.col("term").cast("binary")), 1, 5))
    return I.hash_collisions(terms, "term", "h")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged ranks: a document's gold is the smallest id that holds the item's text."""
    q = C.benchmark_queries(spark, sf_dir).withColumn("len", F.length("query"))
    top = V._ask(spark, sf_dir, C.benchmark_queries(spark, sf_dir), 50)
    texts = top.join(C.records(spark, sf_dir).select("id", "body"), "id").join(q, "query_id")
    hits = texts.where(F.contains("body", F.col("query")))
    return q.select("query_id").join(hits.groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")


def eval_hit_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.metrics(_gold(spark, sf_dir))


def eval_recall_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = EV.recall_at(_gold(spark, sf_dir), [1, 5, 20, 50])
    return r.select(F.col("depth").cast("long").alias("depth"), "n", F.round("recall", 6).alias("recall"), F.round("se", 6).alias("se"))


def eval_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of archived documents in the best five, by whether there is a gold hit."""
    top = V._ask(spark, sf_dir, C.benchmark_queries(spark, sf_dir), 5)
    rows = top.join(_gold(spark, sf_dir).select("query_id", F.when(F.col("rank").isNotNull(), "found").otherwise("lost").alias("slice")), "query_id")
    return rows.groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg(F.col("archived").cast("double")), 6).alias("share"))


def rare_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = R.explode_queries(C.benchmark_queries(spark, sf_dir))
    df = I.doc_frequency(C.postings(spark, sf_dir).join(terms.select("term").distinct(), "term", "left_semi"))
    return EV.rare_slice(terms.join(df, "term").groupBy("query_id").agg(F.min("df").alias("min_df")))


def kl_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = EV.top_terms(EV.kl_scores(C.postings(spark, sf_dir), F.col("tf_b")), 5)
    return rows.select("id", F.col("no").cast("long").alias("no"), "term", F.round("score", 6).alias("score"))


def _impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impacts with the first tokens of a document standing in for headings."""
    f = C.fields(spark, sf_dir)
    f = f.withColumns({"heading_tokens": F.slice("body_tokens", 1, 3), "body_tokens": F.slice("body_tokens", 4, F.greatest(F.lit(0), F.size("body_tokens")))})
    f = f.withColumn("wlen", (3 * F.size("heading_tokens") + F.size("body_tokens")).cast("long"))
    return EV.impacts(I.postings(f), I.corpus_stats(f))


def impact_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _impacts(spark, sf_dir).select("id", "term", F.round("impact", 6).alias("impact"))


def spine_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of terms that a budget of 10 %, 8 at least, keeps of each document."""
    return EV.budgeted(_impacts(spark, sf_dir), 0.1, 8).groupBy("id").agg(F.count("*").alias("n_kept"))


def term_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms kept after each was also kept in its two best documents."""
    imp = _impacts(spark, sf_dir).withColumn("impact", F.round("impact", 6))
    return EV.term_sweep(imp, EV.budgeted(imp, 0.1, 8), 2).groupBy("id").agg(F.count("*").alias("n_kept"))


def vocab_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = C.fields(spark, sf_dir).select(F.size(F.array_distinct("body_tokens")).cast("long").alias("v"))
    return EV.profile(sizes, "v")


def prune_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = C.fields(spark, sf_dir).select(F.size(F.array_distinct("body_tokens")).alias("v"))
    ks = F.explode(F.array(*[F.lit(k) for k in (50, 100, 200)])).alias("k")
    return sizes.select("v", ks).groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("v") > F.col("k")).alias("pruned"))


def cache_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates of two cache policies on the events of each type."""
    e = C.table(spark, sf_dir, "events")
    trace = e.select(F.col("event_type").alias("trace"), F.col("event_id").alias("at"), F.col("user_id").cast("string").alias("key"), (F.col("user_id") % 900 + 100).alias("size"))
    return EV.hit_rates(trace, 8_000)


QUERIES = {f.__name__: f for f in (
    source_globs, source_excludes, source_types, skip_reasons, delta_plan, version_bump, drift_check, delisted, carry_forward, dirty_subtract,
    merge3, ttl_cache, cache_eviction, url_policy, constraint_unique_id, constraint_meta_policy, constraint_term_collision,
    eval_hit_mrr, eval_recall_se, eval_contamination, rare_slice, kl_terms, impact_terms, spine_budget, term_sweep, vocab_profile,
    prune_coverage, cache_policies)}

_PATHS = "p AS (SELECT lang || '/work/' || source || '/' || doc_id || '.' || (['md', 'txt', 'svg', 'rst', 'json'])[doc_id % 5 + 1] AS path, source, lang, doc_id FROM documents)"
_GOLD = f"""WITH {sql_scored(SQL_BENCH)}, top AS ({sql_top('scored', 50)}), g AS (
  SELECT q.query_id, (SELECT min(rank) FROM top JOIN rec ON top.id = rec.id WHERE top.query_id = q.query_id AND contains(rec.body, q.query)) AS rank FROM q)"""
_IMPACT = f"""WITH {SQL_RECORDS}, w AS (SELECT id, toks[1:3] AS h, toks[4:] AS b FROM rec
), wl AS (SELECT id, 3 * len(h) + len(b) AS wlen FROM w), st AS (SELECT count(*) AS n, CAST(sum(wlen) AS DOUBLE) / count(*) AS avg_wlen FROM wl
), t AS (SELECT id, unnest(h) AS term, 1 AS x FROM w UNION ALL SELECT id, unnest(b), 0 FROM w
), ps AS (SELECT t.id, term, wlen, sum(x) AS tf_h, sum(1 - x) AS tf_b FROM t JOIN wl ON t.id = wl.id GROUP BY ALL
), dd AS (SELECT term, count(*) AS df FROM ps GROUP BY term
), imp AS (SELECT id, ps.term, tf_h, round(ln((n - df + 0.5) / (df + 0.5) + 1) * (3 * tf_h + tf_b) * 2.2 / (3 * tf_h + tf_b + 1.2 * (0.25 + 0.75 * wlen / avg_wlen)), 6) AS impact
  FROM ps JOIN dd ON ps.term = dd.term, st
), bud AS (SELECT id, greatest(8, ceil(0.1 * count(*))) AS budget, count(*) FILTER (WHERE tf_h > 0) AS spine FROM imp GROUP BY id
), rk AS (SELECT *, row_number() OVER (PARTITION BY id, tf_h > 0 ORDER BY impact DESC, term) AS no FROM imp
), kept AS (SELECT rk.id, term FROM rk JOIN bud ON rk.id = bud.id WHERE tf_h > 0 OR no <= budget - spine)"""


def _merge_side(gone: int, new: int, edit: int, more: int) -> str:
    hit = f"(doc_id % {edit} = 0 OR doc_id % 3 = 0)"
    return f"SELECT id, CASE WHEN {hit} THEN 2 + {more} * (doc_id % 2) ELSE 1 END AS ver, CASE WHEN {hit} THEN sha || '{edit}' ELSE sha END AS sha FROM r WHERE doc_id % {gone} <> 0 AND doc_id % {new} <> 1"


ORACLES = {
    "source_globs": f"""WITH {_PATHS} SELECT path, path LIKE '%.md' AS g1, regexp_full_match(path, 'en/[^/]*/src1/[^/]*') AS g2, regexp_full_match(path, '.*/src[^/]/[^/]*\\.txt') AS g3,
        path LIKE 'en/%' AS g4, false AS g5 FROM p""",
    "source_excludes": f"WITH {_PATHS} SELECT path, CASE WHEN source = 'src1' THEN '*/work/src1' WHEN lang = 'fr' THEN 'fr' WHEN path LIKE '%.svg' THEN '*.svg' END AS excluded_by FROM p",
    "source_types": f"WITH {_PATHS} SELECT path, NOT (lang = 'en' AND source = 'src2') AND doc_id % 5 IN (0, 1, 3) AS ok FROM p",
    "skip_reasons": "SELECT doc_id, CASE WHEN doc_id % 10 = 3 OR (coalesce(text, '') = '' AND doc_id % 10 NOT IN (4, 5)) THEN 'empty' WHEN doc_id % 10 = 4 THEN 'binary' WHEN doc_id % 10 = 5 THEN 'non-utf8' END AS reason FROM documents",
    "delta_plan": f"WITH {SQL_SNAPSHOTS} SELECT coalesce(b.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'drop' WHEN a.sha = b.sha THEN 'reuse' ELSE 'extract' END AS action FROM b FULL JOIN a ON a.id = b.id",
    "version_bump": f"WITH {SQL_SNAPSHOTS} SELECT a.id, CASE WHEN b.id IS NULL OR a.sha = b.sha THEN 1 ELSE 2 END AS ver FROM a LEFT JOIN b ON a.id = b.id",
    "drift_check": f"""WITH {SQL_SNAPSHOTS} SELECT CASE WHEN a.id IS NULL THEN 'gone' WHEN a.doc_id % 19 = 0 THEN 'unverified' WHEN a.sha = b.sha THEN 'fresh' ELSE 'stale' END AS state, count(*) AS n
        FROM b LEFT JOIN a ON a.id = b.id GROUP BY 1""",
    "delisted": f"WITH {SQL_SNAPSHOTS} SELECT id FROM b WHERE id NOT IN (SELECT id FROM a)",
    "carry_forward": f"WITH {SQL_SNAPSHOTS} SELECT id, sha FROM b WHERE id IN (SELECT id FROM a WHERE doc_id % 19 = 0)",
    "dirty_subtract": f"WITH {SQL_SNAPSHOTS} SELECT id FROM b UNION SELECT id FROM a EXCEPT SELECT id FROM a WHERE doc_id % 7 = 0",
    "merge3": f"""WITH r AS (SELECT 'file:' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.md' AS id, doc_id, md5(coalesce(text, '')) AS sha FROM documents
        ), b AS (SELECT id, 1 AS ver, sha FROM r WHERE doc_id % 11 <> 1), o AS ({_merge_side(17, 29, 13, 1)}), t AS ({_merge_side(19, 31, 5, 0)}
        ), x AS (SELECT ids.id, b.ver AS bv, b.sha AS bs, o.ver AS ov, o.sha AS os, t.ver AS tv, t.sha AS ts,
            b.ver IS NOT DISTINCT FROM o.ver AND b.sha IS NOT DISTINCT FROM o.sha AS bo, b.ver IS NOT DISTINCT FROM t.ver AND b.sha IS NOT DISTINCT FROM t.sha AS bt,
            o.ver IS NOT DISTINCT FROM t.ver AND o.sha IS NOT DISTINCT FROM t.sha AS ot
          FROM (SELECT id FROM b UNION SELECT id FROM o UNION SELECT id FROM t) ids LEFT JOIN b ON ids.id = b.id LEFT JOIN o ON ids.id = o.id LEFT JOIN t ON ids.id = t.id
        ), y AS (SELECT *, CASE WHEN ot THEN 'o' WHEN bo THEN 't' WHEN bt THEN 'o' WHEN os IS NULL OR ts IS NULL OR bs IS NULL THEN 'c' WHEN ov > tv THEN 'o' WHEN tv > ov THEN 't' ELSE 'c' END AS p FROM x
        ), z AS (SELECT id, p, CASE p WHEN 'o' THEN ov WHEN 't' THEN tv END AS ver, CASE p WHEN 'o' THEN os WHEN 't' THEN ts END AS sha FROM y)
        SELECT id, CASE WHEN p = 'c' THEN 'conflict' WHEN sha IS NULL THEN 'deleted' ELSE 'merged' END AS status, CAST(ver AS INTEGER) AS ver, sha FROM z""",
    "ttl_cache": f"WITH {SQL_RECORDS} SELECT loc, doc_id % 1000 AS fetched_at FROM rec WHERE 1000 - doc_id % 1000 < 300",
    "cache_eviction": f"""WITH {SQL_RECORDS}, s AS (SELECT source, loc, CAST(strlen(body) AS BIGINT) AS bytes, sum(strlen(body)) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS total FROM rec)
        SELECT loc, bytes FROM s WHERE total <= 50000""",
    "url_policy": "SELECT url AS value, CASE WHEN page_id % 2 = 0 THEN 'http' ELSE 'browser' END AS fetcher, CASE WHEN page_id % 2 = 0 THEN 'hashed' ELSE 'plain' END AS meta, '0' AS ttl FROM pages",
    "constraint_unique_id": f"WITH {SQL_RECORDS} SELECT id, CAST(2 AS BIGINT) AS times FROM rec WHERE doc_id % 100 = 0",
    "constraint_meta_policy": "SELECT 'url:' || url AS id FROM pages WHERE page_id % 3 = 0",
    "constraint_term_collision": f"WITH {SQL_RECORDS}, u AS (SELECT DISTINCT term FROM tok) SELECT substr(md5(term), 1, 5) AS h, count(*) AS n_terms FROM u GROUP BY 1 HAVING count(*) > 1",
    "eval_hit_mrr": f"""{_GOLD} SELECT count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit5, round(avg(CASE WHEN rank <= 10 THEN 0.1::DOUBLE ELSE 0 END), 6) AS p10,
        round(avg(CASE WHEN rank <= 50 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr FROM g""",
    "eval_recall_se": f"""{_GOLD}, r AS (SELECT depth, count(*) AS n, avg(CASE WHEN rank <= depth THEN 1.0::DOUBLE ELSE 0 END) AS recall FROM g, (VALUES (1), (5), (20), (50)) d(depth) GROUP BY depth)
        SELECT CAST(depth AS BIGINT) AS depth, n, round(recall, 6) AS recall, round(sqrt(recall * (1 - recall) / n), 6) AS se FROM r""",
    "eval_contamination": f"""{_GOLD} SELECT CASE WHEN g.rank IS NOT NULL THEN 'found' ELSE 'lost' END AS slice, count(*) AS n, round(avg(CASE WHEN id LIKE 'file:src0/%' THEN 1.0::DOUBLE ELSE 0 END), 6) AS share
        FROM top JOIN g ON top.query_id = g.query_id WHERE top.rank <= 5 GROUP BY 1""",
    "rare_slice": f"""WITH {SQL_RECORDS}, qt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({sql_tokens('query')}) AS term FROM ({SQL_BENCH}))
        ), m AS (SELECT query_id, min(df) AS min_df FROM qt JOIN dfs ON qt.term = dfs.term GROUP BY query_id)
        SELECT query_id, min_df FROM (SELECT *, row_number() OVER (ORDER BY min_df, query_id) AS no, count(*) OVER () AS n FROM m) WHERE no <= ceil(n / 3.0)""",
    "kl_terms": f"""WITH {SQL_RECORDS}, cf AS (SELECT term, sum(tf_b) AS cf FROM post GROUP BY term), tot AS (SELECT sum(tf_b) AS total FROM post
        ), s AS (SELECT id, post.term, round(CAST(tf_b AS DOUBLE) / wlen * ln((CAST(tf_b AS DOUBLE) / wlen) / (CAST(cf AS DOUBLE) / total)), 12) AS score FROM post JOIN cf ON post.term = cf.term, tot)
        SELECT id, no, term, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, term) AS no FROM s) WHERE no <= 5""",
    "impact_terms": f"{_IMPACT} SELECT id, term, impact FROM imp",
    "spine_budget": f"{_IMPACT.replace(', 6) AS impact', ', 12) AS impact')} SELECT id, count(*) AS n_kept FROM kept GROUP BY id",
    "term_sweep": f"""{_IMPACT}, best AS (SELECT id, term FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY impact DESC, id) AS k FROM imp) WHERE k <= 2)
        SELECT id, count(*) AS n_kept FROM (SELECT id, term FROM kept UNION SELECT id, term FROM best) GROUP BY id""",
    "vocab_profile": f"""WITH {SQL_RECORDS}, v AS (SELECT len(list_distinct(toks)) AS v FROM rec), o AS (SELECT list(v ORDER BY v) AS l, count(*) AS n FROM v)
        SELECT n, l[1] AS min, l[least(floor(0.5 * n), n - 1)::BIGINT + 1] AS median, l[least(floor(0.9 * n), n - 1)::BIGINT + 1] AS p90, l[least(floor(0.99 * n), n - 1)::BIGINT + 1] AS p99,
          l[-1] AS max, round(list_avg(l), 6) AS mean FROM o""",
    "prune_coverage": f"WITH {SQL_RECORDS}, v AS (SELECT len(list_distinct(toks)) AS v FROM rec) SELECT k, count(*) AS n, count(*) FILTER (WHERE v > k) AS pruned FROM v, (VALUES (50), (100), (200)) t(k) GROUP BY k",
}
