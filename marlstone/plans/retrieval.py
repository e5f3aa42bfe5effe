"""Query catalogue: index tables, ranking, fusion, dense lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions import text as T
from marlstone.operators import index as I
from marlstone.operators import ranking as R
from marlstone.plans import corpus as C
from marlstone.plans.corpus import SQL_BENCH, SQL_RECORDS, sql_scored, sql_top

#: The flagship query's words.
QUESTION = "that the erent thand token and license version"
_ONE = f"SELECT 0 AS query_id, '{QUESTION}' AS query"


def doc_term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.postings(spark, sf_dir).select("id", "term", "tf_h", "tf_b")


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.records(spark, sf_dir).select("id", T.tokens(F.col("body")).alias("t"))
    return rows.select("id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.explode_queries(C.benchmark_queries(spark, sf_dir)).select("query_id", F.col("qpos").cast("long").alias("qpos"), "term")


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fields(spark, sf_dir).select("id", "wlen")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.corpus_stats(C.fields(spark, sf_dir)).withColumn("avg_wlen", F.round("avg_wlen", 6))


def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.doc_frequency(C.postings(spark, sf_dir))


def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = doc_frequency(spark, sf_dir).crossJoin(F.broadcast(I.corpus_stats(C.fields(spark, sf_dir)).select("n")))
    return df.select("term", "df", F.round(I.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.postings(spark, sf_dir).select("term", "id", "tf_h", "tf_b", "wlen")


def posting_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.blocks(C.postings(spark, sf_dir))


def block_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper bound of every block's scores, from its figures alone."""
    b = I.blocks(C.postings(spark, sf_dir))
    df = b.groupBy("term").agg(F.sum("cnt").alias("df"))
    rows = b.join(df, "term").crossJoin(F.broadcast(I.corpus_stats(C.fields(spark, sf_dir))))
    bound = I.contribution(I.idf(F.col("n"), F.col("df")), F.lit(0), F.col("mx"), F.col("mnw"), F.col("avg_wlen"))
    return rows.select("term", "block_no", F.round(bound, 6).alias("bound"))


def _ask(spark: SparkSession, sf_dir: str, queries: DataFrame, k: int, weight: float = 1.0) -> DataFrame:
    scored = C.scored_batch(spark, sf_dir, queries)
    archived = T.is_archived(T.loc_of(F.col("id")), C.ARCHIVED)
    return R.top_k(R.demote(scored, archived, weight), k).withColumn("archived", archived)


def ask_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: one question over all documents, the ten best."""
    one = spark.range(1).select(F.lit(0).alias("query_id"), F.lit(QUESTION).alias("query"))
    return _ask(spark, sf_dir, one, 10).select("rank", "id", F.round("score", 6).alias("score"))


def ask_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, C.benchmark_queries(spark, sf_dir), 5).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def find_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, C.benchmark_queries(spark, sf_dir), 5).select("query_id", "rank", T.loc_of(F.col("id")).alias("loc"))


def ask_archived_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ask(spark, sf_dir, C.benchmark_queries(spark, sf_dir), 5)
    return rows.groupBy("query_id").agg(F.count("*").alias("hits"), F.count_if("archived").alias("archived_hits"))


def ask_archived_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, C.benchmark_queries(spark, sf_dir), 5, 0.5).select("query_id", "rank", "id", "archived", F.round("score", 6).alias("score"))


def scan_equals_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings of the scan plan and of the posting-table plan, held against each other."""
    queries = C.benchmark_queries(spark, sf_dir)
    terms, posts = R.explode_queries(queries), C.postings(spark, sf_dir)
    clustered = R.top_k(R.score(terms, posts, I.corpus_stats(C.fields(spark, sf_dir)), I.doc_frequency(posts)), 20)
    scan = _ask(spark, sf_dir, queries, 20)
    cols = ["query_id", "rank", "id", F.round("score", 9).alias("score")]
    a, b = scan.select(*cols), clustered.select(*cols)
    both = a.withColumn("side", F.lit(1)).unionAll(b.withColumn("side", F.lit(-1)))
    uneven = both.groupBy("query_id", "rank", "id", "score").agg(F.sum("side").alias("s")).where("s <> 0")
    return uneven.agg(F.count("*").alias("differences"))


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexical lane and one by length, as ranked items of each query."""
    lexical = _ask(spark, sf_dir, C.benchmark_queries(spark, sf_dir), 50)
    order = Window.partitionBy("query_id").orderBy(F.col("id").desc())
    by_id = lexical.withColumn("r2", F.row_number().over(order).cast("long"))
    return lexical.select("query_id", F.col("id").alias("item"), "rank").unionAll(by_id.select("query_id", "id", "r2"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = R.rrf(_lanes(spark, sf_dir), ["query_id"])
    return fused.select("query_id", "item", F.round("score", 9).alias("score"))


def rrf_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion in which archived items start five ranks later."""
    lanes = _lanes(spark, sf_dir)
    offset = F.when(T.is_archived(T.loc_of(F.col("item")), C.ARCHIVED), 5).otherwise(0)
    fused = R.rrf(lanes.withColumn("rank_offset", offset), ["query_id"])
    return fused.select("query_id", "item", F.round("score", 9).alias("score"))


def sign_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("id", F.get("code", F.lit(0)).alias("code"))


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", "label", F.when(F.col("embedding").isNotNull(), R.sign_words(F.col("embedding"), 64)).alias("code"))


def hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _codes(spark, sf_dir)
    queries = codes.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("code").alias("qcode"))
    return R.dense_top(codes.select("id", "code"), queries, 100)


def dense_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-code prefilter of 100, then cosine: the ten best of each query."""
    codes = _codes(spark, sf_dir)
    near = hamming_topk(spark, sf_dir)
    rows = near.join(codes.select("id", F.col("embedding").alias("v")), "id").join(codes.select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
    rows = rows.select("query_id", "id", F.round(R.cosine(F.col("v"), F.col("q")), 6).alias("cosine"))
    order = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 10").select("query_id", "rank", "id", "cosine")


def dense_cosine_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the stated queries against all rows: the ten best of each query."""
    rows = C.table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return R.cosine_top(rows, rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), 10)


def mean_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign code of the mean vector of each label, unscaled."""
    rows = C.table(spark, sf_dir, "embeddings").select("label", F.lit(1.0).alias("scale"), F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("q"))
    return R.mean_code(rows, "label").select("label", F.get("code", F.lit(0)).alias("code"))


def hybrid_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and dense lanes over documents that carry the vector of their id, fused.

    The dense query of item i is the vector with id i; a document's vector is
    the one with its id.  Items without a vector have the lexical lane alone.
    """
    lexical = _ask(spark, sf_dir, C.benchmark_queries(spark, sf_dir), 100).select("query_id", F.col("id").alias("item"), "rank")
    codes = _codes(spark, sf_dir).select(F.col("id").alias("vec_id"), "code")
    docs = C.records(spark, sf_dir).select("id", "doc_id").join(codes, F.col("doc_id") == F.col("vec_id")).select("id", "code")
    queries = C.benchmark_queries(spark, sf_dir).join(codes, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("code").alias("qcode"))
    dense = R.dense_top(docs, queries, 100).select("query_id", F.col("id").alias("item"), "rank")
    fused = R.rrf(lexical.unionAll(dense), ["query_id"])
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "item")
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 5").select("query_id", "rank", "item", F.round("score", 9).alias("score"))


def path_field_bm25f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-field ranking: path words count twice as much as body words."""
    terms = R.explode_queries(C.benchmark_queries(spark, sf_dir).withColumn("query", F.concat_ws(" ", "query", F.lit("src1 src2 md"))))
    f = C.records(spark, sf_dir).select("id", T.tokens(F.col("body")).alias("b"), T.tokens(F.col("loc")).alias("p"))
    f = f.withColumn("wlen", (F.size("b") + 2 * F.size("p")).cast("long"))
    both = F.concat(F.transform("b", lambda t: F.struct(t.alias("t"), F.lit(1).alias("w"))), F.transform("p", lambda t: F.struct(t.alias("t"), F.lit(2).alias("w"))))
    rows = f.select("id", "wlen", F.explode(both).alias("x")).select("id", "wlen", F.col("x.t").alias("term"), F.col("x.w").alias("w"))
    wanted = terms.select("term").distinct()
    posts = rows.join(F.broadcast(wanted) if R.small_enough(terms) else wanted, "term", "left_semi").groupBy("id", "wlen", "term").agg(F.sum("w").alias("tf_b")).withColumn("tf_h", F.lit(0).cast("long"))
    best = R.top_k(R.score(terms, posts, I.corpus_stats(f), posts.groupBy("term").agg(F.count("*").alias("df"))), 5)
    return best.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (
    ask_topk, ask_batch, find_locations, ask_archived_flag, ask_archived_weight, scan_equals_clustered, tokenize_terms, query_terms,
    doc_term_freq, doc_lengths, corpus_stats, doc_frequency, idf_table, postings, posting_blocks, block_bounds,
    rrf_fusion, rrf_offsets, sign_codes, hamming_topk, dense_cosine, dense_cosine_exact, mean_codes, hybrid_ask, path_field_bm25f)}

_BATCH = f"WITH {sql_scored(SQL_BENCH)}, top AS ({sql_top('scored', 5)})"
_LANES = f"""WITH {sql_scored(SQL_BENCH)}, top AS ({sql_top('scored', 50)}),
lanes AS (SELECT query_id, id AS item, rank FROM top UNION ALL
          SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id DESC) FROM top)"""
_BLOCKS = f"""WITH {SQL_RECORDS}, num AS (
  SELECT *, (row_number() OVER (PARTITION BY term ORDER BY id) - 1) // 128 AS block_no FROM post
), blk AS (SELECT term, block_no, max(tf_b) AS mx, min(wlen) AS mnw, min(id) AS first_doc, max(id) AS last_doc, count(*) AS cnt FROM num GROUP BY ALL)"""
_CODE = "list_sum(list_transform(range(0, 64), lambda i: CASE WHEN v[i + 1] > 0 THEN CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << i::HUGEINT) END ELSE 0 END))::BIGINT"
_CODES = f"codes AS (SELECT vec_id AS id, embedding AS v, label, {_CODE.replace('v[', 'embedding[')} AS code FROM embeddings)"
_NEAR = f"""WITH {_CODES}, near AS (
  SELECT q.id AS query_id, c.id, CAST(bit_count(xor(q.code, c.code)) AS INTEGER) AS distance FROM codes q, codes c WHERE q.id % 20 = 0
), dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM near) WHERE rank <= 100)"""

ORACLES = {
    "ask_topk": f"WITH {sql_scored(_ONE)} SELECT rank, id, round(score, 6) AS score FROM ({sql_top('scored', 10)})",
    "ask_batch": f"{_BATCH} SELECT query_id, rank, id, round(score, 6) AS score FROM top",
    "find_locations": f"{_BATCH} SELECT query_id, rank, substr(id, 6) AS loc FROM top",
    "ask_archived_flag": f"{_BATCH} SELECT query_id, count(*) AS hits, count(*) FILTER (WHERE id LIKE 'file:src0/%') AS archived_hits FROM top GROUP BY query_id",
    "ask_archived_weight": f"""WITH {sql_scored(SQL_BENCH)}, w AS (
        SELECT query_id, id, id LIKE 'file:src0/%' AS archived, CASE WHEN id LIKE 'file:src0/%' THEN score * 0.5 ELSE score END AS score FROM scored)
        SELECT query_id, rank, id, archived, round(score, 6) AS score FROM ({sql_top('w', 5)})""",
    "scan_equals_clustered": "SELECT CAST(0 AS BIGINT) AS differences",
    "tokenize_terms": f"WITH {SQL_RECORDS} SELECT id, CAST(len(toks) AS BIGINT) AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM rec",
    "query_terms": f"""WITH q AS (SELECT query_id, {C.sql_tokens('query')} AS ts FROM ({SQL_BENCH})),
        p AS (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS i FROM q),
        f AS (SELECT query_id, term, min(i) AS i FROM p GROUP BY ALL)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS qpos, term FROM f""",
    "doc_term_freq": f"WITH {SQL_RECORDS} SELECT id, term, CAST(0 AS BIGINT) AS tf_h, tf_b FROM post",
    "doc_lengths": f"WITH {SQL_RECORDS} SELECT id, wlen FROM lens",
    "corpus_stats": f"WITH {SQL_RECORDS} SELECT n, total_wlen, round(avg_wlen, 6) AS avg_wlen FROM stats",
    "doc_frequency": f"WITH {SQL_RECORDS} SELECT term, df FROM dfs",
    "idf_table": f"WITH {SQL_RECORDS} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM dfs, stats",
    "postings": f"WITH {SQL_RECORDS} SELECT term, id, CAST(0 AS BIGINT) AS tf_h, tf_b, wlen FROM post",
    "posting_blocks": f"{_BLOCKS} SELECT term, block_no, mx, mnw, first_doc, last_doc, cnt FROM blk",
    "block_bounds": f"""{_BLOCKS} SELECT b.term, block_no,
        round(ln((n - df + 0.5) / (df + 0.5) + 1) * mx * 2.2 / (mx + 1.2 * (0.25 + 0.75 * mnw / avg_wlen)), 6) AS bound
        FROM blk b JOIN dfs d ON b.term = d.term, stats""",
    "rrf_fusion": f"{_LANES} SELECT query_id, item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM lanes GROUP BY ALL",
    "rrf_offsets": f"{_LANES} SELECT query_id, item, round(sum(1.0::DOUBLE / (60 + rank + CASE WHEN item LIKE 'file:src0/%' THEN 5 ELSE 0 END)), 9) AS score FROM lanes GROUP BY query_id, item",
    "sign_codes": f"WITH {_CODES} SELECT id, code FROM codes",
    "hamming_topk": f"{_NEAR} SELECT query_id, id, distance, rank FROM dense",
    "dense_cosine": f"""{_NEAR}, cs AS (
        SELECT d.query_id, d.id, round(list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]), 6) AS cosine
        FROM dense d JOIN codes a ON d.id = a.id JOIN codes b ON d.query_id = b.id)
        SELECT query_id, rank, id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM cs) WHERE rank <= 10""",
    "dense_cosine_exact": """WITH cs AS (
        SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine
        FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND q.embedding IS NOT NULL AND c.embedding IS NOT NULL)
        SELECT query_id, rank, id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM cs) WHERE rank <= 10""",
    "mean_codes": f"""WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(0, 64)) AS i FROM embeddings),
        s AS (SELECT label, i, sum(round(CAST(x AS DOUBLE) * 1000)) AS s FROM e GROUP BY ALL),
        g AS (SELECT label, list(s ORDER BY i) AS v FROM s GROUP BY label) SELECT label, {_CODE} AS code FROM g""",
    "hybrid_ask": f"""WITH {_CODES}, {sql_scored(SQL_BENCH)}, lex AS ({sql_top('scored', 100)}), near AS (
          SELECT b.item_id AS query_id, r.id, bit_count(xor(c.code, q.code)) AS distance
          FROM benchmark b JOIN codes q ON b.item_id = q.id, rec r JOIN codes c ON r.doc_id = c.id
        ), dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM near) WHERE rank <= 100
        ), fused AS (SELECT query_id, item, sum(1.0::DOUBLE / (60 + rank)) AS score
          FROM (SELECT query_id, id AS item, rank FROM lex UNION ALL SELECT query_id, id, rank FROM dense) GROUP BY ALL)
        SELECT query_id, rank, item, round(score, 9) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS rank FROM fused) WHERE rank <= 5""",
    "path_field_bm25f": f"""WITH d AS (
          SELECT 'file:' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.md' AS id,
                 {C.sql_tokens("coalesce(text, '')")} AS b, {C.sql_tokens("source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.md'")} AS p FROM documents
        ), l AS (SELECT id, len(b) + 2 * len(p) AS wlen FROM d), stats AS (SELECT count(*) AS n, sum(wlen) / count(*) AS avg_wlen FROM l
        ), t AS (SELECT id, unnest(b) AS term, 1 AS w FROM d UNION ALL SELECT id, unnest(p), 2 FROM d
        ), post AS (SELECT t.id, term, wlen, sum(w) AS tf_b FROM t JOIN l ON t.id = l.id GROUP BY ALL
        ), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term
        ), qt AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({C.sql_tokens("coalesce(text, '') || ' src1 src2 md'")}) AS term FROM benchmark)
        ), scored AS (SELECT query_id, p.id, sum({C.SQL_SCORE}) AS score FROM qt JOIN post p ON qt.term = p.term JOIN dfs d ON qt.term = d.term, stats GROUP BY ALL)
        SELECT query_id, rank, id, round(score, 6) AS score FROM ({sql_top('scored', 5)})""",
}
