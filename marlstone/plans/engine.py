"""The engine: index tables in a folder, and the verbs that read and keep them.

An index is a folder of Parquet tables: ``records`` (a row for each document),
``postings`` sorted by term with the term's document frequency, ``edges`` and
one row of ``stats``.  The terms of a question are few and become an ``IN``
filter, which reaches the scan and skips row groups.  A build writes a new
version beside the last and then names it in ``CURRENT`` by an atomic rename; a
reader never sees half a build.  One writer works at a time, and the two
versions before the last stay for readers that are still at work.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import markup as MK
from marlstone.functions import text as T
from marlstone.operators import edges as E
from marlstone.operators import graph as G
from marlstone.operators import index as I
from marlstone.operators import maintain as M
from marlstone.operators import passages as P
from marlstone.operators import ranking as R

SCHEMA_VERSION, ANALYSER_VERSION = 2, 1

#: Distinct terms of a batch up to which they are a filter of the scan; more are joined.
FILTER_TERMS = 10_000


@dataclass(frozen=True)
class Config:
    """Settings of an engine; ``archived_weight`` of 1 changes nothing."""

    archived: tuple[str, ...] = ()
    archived_weight: float = 1.0
    budget: int = P.BUDGET
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.archived_weight < 0 or self.budget <= 0:
            raise ValueError("weights can't be negative, and a budget must be positive")


def extract(documents: DataFrame, config: Config = Config()) -> DataFrame:
    """Index records of ``id, loc, raw``: front matter, headings, tokens, links, tags."""
    d = documents.withColumn("p", MK.parse_document(F.col("raw")))
    d = d.select("id", "loc", "raw", F.col("p.title").alias("front"), F.col("p.tags").alias("tags"), F.col("p.body").alias("body"))
    d = d.withColumn("heads", T.headings(F.col("body")))
    d = d.withColumn("title", T.title(F.col("front"), F.col("heads"), F.col("loc")))
    tokens = d.withColumns({
        "heading_tokens": T.heading_tokens(F.col("heads"), F.col("title")), "body_tokens": T.tokens(T.without_headings(F.col("body"))),
        "links": T.link_targets(F.col("body")), "spans": T.code_spans(F.col("body")), "phrases": T.phrases(F.col("heads"))})
    wlen = (T.HEADING_WEIGHT * F.size("heading_tokens") + F.size("body_tokens")).cast("long")
    return tokens.select(
        "id", "loc", MK.hash_udf(MK.CONTENT_BYTES)(F.col("raw")).alias("sha"), MK.hash_udf(MK.SHARD_BYTES)(F.col("id")).alias("shard"),
        "title", "phrases", T.tags(F.col("tags")).alias("tags"), "links", "spans", T.is_archived(F.col("loc"), list(config.archived)).alias("archived"),
        "heading_tokens", "body_tokens", wlen.alias("wlen"), F.col("raw").alias("content"))


def resolve(records: DataFrame) -> DataFrame:
    """All edges of all records; resolved anew whenever any record changes."""
    known = records.select("id")
    links = records.select(F.col("id").alias("src"), F.explode("links").alias("target"))
    spans = records.select(F.col("id").alias("src"), F.explode("spans").alias("span"))
    found = E.resolve_links(links, known).unionByName(E.resolve_code(spans, known)).unionByName(E.tag_edges(records, "id", "tags"))
    return E.dedupe(found)


class Engine:
    """One index folder and its verbs."""

    def __init__(self, spark: SparkSession, path: str, config: Config = Config()):
        self.spark, self.root, self.config = spark, path.rstrip("/"), config

    # building

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> str | None:
        fs, p = self._fs(f"{self.root}/CURRENT")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            schema, name = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()
        if schema != f"{SCHEMA_VERSION}.{ANALYSER_VERSION}":
            raise ValueError(f"the index has schema {schema}; build it again")
        return name

    def table(self, name: str) -> DataFrame:
        version = self.version()
        if version is None:
            raise FileNotFoundError("there is no index yet")
        return self.spark.read.parquet(f"{self.root}/{version}/{name}")

    def _point(self, name: str) -> None:
        """Name the version in ``CURRENT``: a new file takes its place in one step."""
        jvm, new = self.spark._jvm, f"{self.root}/CURRENT.{name}"
        fs, p = self._fs(new)
        stream = fs.create(p)
        stream.write(bytearray(f"{SCHEMA_VERSION}.{ANALYSER_VERSION} {name}\n".encode()))
        stream.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(p, jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT"), how)

    @contextmanager
    def _writing(self) -> Iterator[None]:
        """Hold the writer's lock; a second writer is refused."""
        fs, p = self._fs(f"{self.root}/LOCK")
        try:
            fs.create(p, False).close()
        except Py4JJavaError as e:
            if fs.exists(p):
                raise RuntimeError(f"another writer holds {p.toString()}; delete it if that one is gone") from e
            raise
        try:
            yield
        finally:
            fs.delete(p, False)

    def _publish(self, records: DataFrame) -> None:
        with self._writing():
            self._write(records)

    def _write(self, records: DataFrame) -> None:
        version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.root}/{version}"
        records.repartition("shard").sortWithinPartitions("id").write.parquet(f"{at}/records")
        records = self.spark.read.parquet(f"{at}/records")
        if not I.duplicate_ids(records).isEmpty():
            raise ValueError("an id occurs twice")
        posts = I.postings(records.select("id", "heading_tokens", "body_tokens", "wlen"))
        posts = posts.join(I.doc_frequency(posts), "term")
        posts.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{at}/postings")
        I.corpus_stats(records).coalesce(1).write.parquet(f"{at}/stats")
        resolve(records).write.parquet(f"{at}/edges")
        self._point(version)
        fs, root = self._fs(self.root)
        built = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("v-"))
        for name in built[:-3]:
            fs.delete(self._fs(f"{self.root}/{name}")[1], True)

    def ingest(self, documents: DataFrame) -> dict[str, int]:
        """Index ``id, loc, raw``; unchanged documents keep their records.

        Only new and changed documents are analysed.  Edges are resolved anew
        for all, so that the result is that of a full build.
        """
        now = documents.withColumn("sha", MK.hash_udf(MK.CONTENT_BYTES)(F.col("raw")))
        if self.version() is None:
            fresh = extract(documents, self.config).withColumn("ver", F.lit(1))
            self._publish(fresh)
            n = self.table("records").count()
            return {"documents": n, "changed": n, "reused": 0, "dropped": 0}
        prior = self.table("records")
        same = prior.join(now.select("id", "sha"), ["id", "sha"], "left_semi")
        changed = now.join(prior.select("id", "sha"), ["id", "sha"], "left_anti").drop("sha")
        news = extract(changed, self.config).join(prior.select("id", F.col("ver").alias("was")), "id", "left").withColumn("ver", F.coalesce(F.col("was") + 1, F.lit(1))).drop("was")
        kept = same.withColumn("archived", T.is_archived(F.col("loc"), list(self.config.archived)))
        actions = {r["action"]: r["n"] for r in M.delta(prior, now).groupBy("action").agg(F.count("*").alias("n")).collect()}
        self._publish(kept.unionByName(news.select(kept.columns)))
        return {"documents": actions.get("reuse", 0) + actions.get("extract", 0), "changed": actions.get("extract", 0), "reused": actions.get("reuse", 0), "dropped": actions.get("drop", 0)}

    def add(self, documents: DataFrame) -> dict[str, int]:
        """Add or replace documents and leave all others as they are."""
        if self.version() is None:
            return self.ingest(documents)
        rest = self.table("records").select("id", "loc", F.col("content").alias("raw")).join(documents.select("id"), "id", "left_anti")
        return self.ingest(rest.unionByName(documents.select("id", "loc", "raw")))

    def remove(self, ids: DataFrame) -> DataFrame:
        """Drop ``id``s; returns how many edges pointed at each."""
        lost = G.inbound(self.table("edges")).join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
        self.ingest(self.table("records").select("id", "loc", F.col("content").alias("raw")).join(ids, "id", "left_anti"))
        return lost

    def check(self, current: DataFrame) -> DataFrame:
        """Drift of the index against ``id, sha, ok``."""
        return M.drift(self.table("records"), current)

    # asking

    def _query(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, text)], "query_id long, query string")

    def scores(self, queries: DataFrame) -> DataFrame:
        """``query_id, id, score, archived`` for ``query_id, query``."""
        terms, posts = R.explode_queries(queries), self.table("postings")
        asked = [r["term"] for r in terms.select("term").distinct().limit(FILTER_TERMS + 1).collect()]
        if len(asked) <= FILTER_TERMS:
            posts = posts.where(F.col("term").isin(asked))
        scored = R.score(terms, posts, self.table("stats"))
        flags = self.table("records").select("id", "archived")
        return R.demote(scored.join(flags, "id"), F.col("archived"), self.config.archived_weight)

    def ask_batch(self, queries: DataFrame, top: int = 5) -> DataFrame:
        best = R.top_k(self.scores(queries), top)
        return best.join(self.table("records").select("id", "title", "loc"), "id").select("query_id", "rank", "id", "title", "loc", "score", "archived")

    def ask(self, text: str, top: int = 5) -> DataFrame:
        return self.ask_batch(self._query(text), top).drop("query_id").orderBy("rank")

    def find(self, text: str, top: int = 5) -> DataFrame:
        return self.ask(text, top).select("loc")

    def hybrid(self, text: str, codes: DataFrame, code: list[int], top: int = 5) -> DataFrame:
        """Lexical and dense lanes fused; ``codes`` has ``id, code``."""
        lexical = R.top_k(self.scores(self._query(text)), max(10 * top, 100)).select(F.col("id").alias("item"), "rank")
        query = self.spark.createDataFrame([(0, code)], "query_id long, qcode array<bigint>")
        dense = R.dense_top(codes, query, 100).select(F.col("id").alias("item"), "rank")
        return R.rrf(lexical.unionByName(dense)).orderBy(F.col("score").desc(), "item").limit(top)

    def answer(self, text: str, current: DataFrame | None = None, documents: int = 1) -> DataFrame:
        """Citations from the best documents within the byte budget.

        ``current`` (``id, raw``) is what a fetch returned; without it the
        indexed contents are cited as unverified.
        """
        best = R.top_k(self.scores(self._query(text)), documents).select("query_id", "id")
        docs = best.join(self.table("records").select("id", "loc", "sha", "content"), "id")
        if current is not None:
            now = current.select("id", F.col("raw"), MK.hash_udf(MK.CONTENT_BYTES)(F.col("raw")).alias("now"))
            docs = docs.join(now, "id", "left").withColumn("verdict", P.verdict(F.col("sha"), F.col("now"), F.col("raw").isNotNull()))
            docs = docs.withColumn("content", F.coalesce("raw", "content"))
        else:
            docs = docs.withColumn("verdict", F.lit("unverified"))
        cut = P.chunks(docs, ["query_id", "id", "loc", "sha", "verdict"], "content")
        scored = P.rescore(cut, self._query(text)).withColumns({"doc_id": F.col("id"), "locator": T.locator(F.col("loc"), F.col("ordinal"))})
        cited = P.assemble(scored, budget=self.config.budget)
        return cited.join(docs.select(F.col("id").alias("doc_id"), "verdict"), "doc_id").orderBy("position")

    # the graph

    def explain(self, doc: str) -> DataFrame:
        name = doc if doc.startswith(("file:", "url:")) else f"file:{doc}"
        out = G.explain(self.table("edges"), self.table("records"), name)
        return G.with_community(out, self.communities())

    def graph(self, text: str, seeds: int = 5, more: int = 10) -> DataFrame:
        """The best documents of a question and what the links add to them."""
        first = R.top_k(self.scores(self._query(text)), seeds).select(F.col("id").alias("node"), "rank")
        scores = G.pagerank(self.table("edges"), first)
        rows = first.select("node", F.lit("seed").alias("role")).unionByName(G.expand(scores, first, more).select("node", F.lit("expanded").alias("role")))
        return rows.join(scores, "node", "left").orderBy(F.col("role").desc(), F.col("score").desc(), "node")

    def path(self, a: str, b: str, hops: int = 2) -> DataFrame:
        name = lambda d: d if d.startswith(("file:", "url:", "tag:")) else f"file:{d}"
        return G.routes(self.table("edges"), self.spark.createDataFrame([(name(a), name(b))], "a string, b string"), hops).orderBy("no")

    def communities(self) -> DataFrame:
        """Found once for each version and kept beside its edges."""
        fs, p = self._fs(f"{self.root}/{self.version()}/communities/_SUCCESS")
        if not fs.exists(p):
            G.communities(self.table("edges")).write.mode("overwrite").parquet(p.getParent().toString())
        return self.table("communities")

    def doctor(self) -> dict[str, object]:
        """Health of the index: counts, and constraints that should be 0."""
        records, edges = self.table("records"), self.table("edges")
        known = records.select("id")
        return {
            "version": self.version(), "documents": records.count(), "edges": edges.count(),
            "duplicate_ids": I.duplicate_ids(records).count(),
            "dangling_edges": edges.count() - E.drop_dangling(edges, known).count(),
            "term_collisions": I.hash_collisions(self.table("postings").select("term", MK.hash_udf(MK.TERM_BYTES)(F.col("term")).alias("h")).distinct(), "term", "h").count(),
        }
