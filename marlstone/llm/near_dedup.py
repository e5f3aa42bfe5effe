"""MinHash near-dedup with sequential Bayesian verification.

1. One scan turns each text into its set of word shingles, a 128-bit key of the
   set, band values and a signature of one byte per hash.  Rows with the same
   set are one *node* from here on, named by the smallest id.
2. Nodes that share a band meet in a bucket.  A bucket's pairs are compared on
   signatures, batch by batch; after each batch a pair goes if the posterior
   probability that it is similar enough falls below ``miss``.  A bucket gives
   back a spanning forest of what survives and never its pairs.
3. The parts so tied are candidate clusters, and all possible links lie inside
   them.  A cluster's pairs are pruned by signatures again, the survivors that
   are not yet connected are compared on their full sets, and a spanning forest
   of the exact links comes back.
4. Components of the exact links are found by contraction: each round ties
   every node to its smallest neighbour and joins the edges anew.

Buckets and clusters of any size are worked through alike (``forest_links``):
members are dealt into blocks, and each block is a task that also holds a few
leaders of the whole group.  Near copies meet their leader there and are
connected across blocks.  Only members outside a group's largest tree are then
compared with the other blocks.  So texts travel once or twice, cost in a large
group of near copies is linear, no pair of members is ever a row, and a task
holds two blocks at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from marlstone.llm.batches import slices
from marlstone.llm.common import materialise, table

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case.  Fewer words make
    one shingle of the whole sequence; none make none.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h = w[: len(w) - k + 1].copy()
    for i in range(1, k):
        h *= _MUL
        h += w[i : len(w) - k + 1 + i]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return np.unique(h)


class Sketch:
    """Band values and one-byte signatures of shingle sets."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.n = bands, rows, bands * rows
        self.a = rng.integers(1, 1 << 63, self.n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, self.n, dtype=np.uint64)

    def least(self, s: np.ndarray) -> np.ndarray:
        out = np.full(self.n, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(s), 1024):
            part = s[at : at + 1024, None] * self.a
            part += self.b
            np.minimum(out, part.min(0), out=out)
        return out >> np.uint64(20)

    def of(self, s: np.ndarray) -> tuple[bytes, list[int]]:
        low = self.least(s)
        values = low.reshape(self.bands, self.rows).tobytes()
        step = self.rows * 8
        return (low & np.uint64(255)).astype(np.uint8).tobytes(), [
            xxhash.xxh64_intdigest(values[i * step : (i + 1) * step], seed=i) - (1 << 63) for i in range(self.bands)]


def needed_matches(n: int, batch: int, similarity: float, miss: float) -> list[tuple[int, int]]:
    """(hashes seen, matches needed) after each batch.

    With a uniform prior, P(similar enough | m of n match) is the chance of at
    most m successes in n + 1 trials; a byte matches by chance once in 256.
    """
    p = similarity + (1 - similarity) / 256
    out = []
    for seen in range(batch, n + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(seen + 1, m) * p**m * (1 - p) ** (seen + 1 - m)
        out.append((seen, m))
    return out


def survivors(one: np.ndarray, many: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Places in ``many`` that sequential comparison with ``one`` doesn't prune."""
    left, agree, at = np.arange(len(many)), np.zeros(len(many), np.int32), 0
    for seen, least in needed:
        agree = agree + (many[left, at:seen] == one[at:seen]).sum(1, dtype=np.int32)
        stay = agree >= least
        left, agree, at = left[stay], agree[stay], seen
        if not len(left):
            break
    return left


class Forest:
    """Union-find that remembers the links that joined something."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), []

    def join(self, i: int, js: np.ndarray) -> None:
        for j in js.tolist():
            a, b = self.root[i], self.root[j]
            if a != b:
                self.root[self.root == max(a, b)] = min(a, b)
                self.links.append((i, j))


def _started(n: int, trees: np.ndarray | None) -> Forest:
    """A forest in which members of one tree are connected already."""
    forest = Forest(n)
    if trees is not None:
        known = np.flatnonzero(trees >= 0)
        _, first, back = np.unique(trees[known], return_index=True, return_inverse=True)
        forest.root[known] = known[first[back]]
    return forest


def sketch_forest(sigs: np.ndarray, side: np.ndarray, trees: np.ndarray | None, needed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spanning forest of the pairs that survive the signatures.

    ``side`` is 0 and 1 for two blocks, of which only pairs across count, and
    all 0 for a block with itself.
    """
    forest, across = _started(len(sigs), trees), bool(side.any())
    for i in np.flatnonzero(side == side.max()).tolist():
        rest = forest.root != forest.root[i]
        if across:
            rest &= side == 0
        else:
            rest[: i + 1] = False
        rest = np.flatnonzero(rest)
        if len(rest):
            forest.join(i, rest[survivors(sigs[i], sigs[rest], needed)])
    return forest.links


def leaders(sigs: np.ndarray, needed: list[tuple[int, int]], most: int) -> list[int]:
    """Members that many others of a sample are near to.

    The one closest to the most frequent bytes leads whom it survives with; then
    the same among the others.  This only saves work: no link depends on it.
    """
    left, out = np.arange(len(sigs)), []
    while len(left) and len(out) < most:
        top = np.array([np.bincount(c, minlength=256).argmax() for c in sigs[left].T], np.uint8)
        lead = left[(sigs[left] == top).sum(1).argmax()]
        out.append(int(lead))
        left = np.setdiff1d(left, np.r_[lead, left[survivors(sigs[lead], sigs[left], needed)]])
    return out


def exact_forest(sets: list[np.ndarray], sigs: np.ndarray, side: np.ndarray, trees: np.ndarray | None, needed: list[tuple[int, int]], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the exact links of one block, or across two.

    The members closest to the most frequent bytes come first, as centres;
    after them only members outside the largest part are compared with whatever
    is not connected to them.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    flat, ends = np.concatenate(sets), np.cumsum(sizes)
    forest, across = _started(n, trees), bool(side.any())

    def compare(i: int) -> None:
        other = forest.root != forest.root[i]
        if across:
            other &= side != side[i]
        other &= (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        some = np.flatnonzero(other)
        if len(some):
            some = some[survivors(sigs[i], sigs[some], needed)]
        for at in range(0, len(some), 512):
            part = some[at : at + 512]
            part = part[forest.root[part] != forest.root[i]]
            if not len(part):
                continue
            values = np.concatenate([flat[ends[j] - sizes[j] : ends[j]] for j in part.tolist()])
            place = np.minimum(np.searchsorted(sets[i], values), len(sets[i]) - 1)
            common = np.add.reduceat((sets[i][place] == values).astype(np.int64), np.r_[0, np.cumsum(sizes[part])[:-1]])
            forest.join(i, part[100 * common >= percent * (sizes[part] + sizes[i] - common)])

    if n > 16 and not across:
        for s in {0, int(side.max())}:
            own = np.flatnonzero(side == s)
            top = np.array([np.bincount(c, minlength=256).argmax() for c in sigs[own].T], np.uint8)
            for i in own[np.argsort(-(sigs[own] == top).sum(1), kind="stable")[:3]].tolist():
                compare(i)
    if across:
        queue = np.flatnonzero(side == 1)
    else:
        queue = np.flatnonzero(forest.root != np.bincount(forest.root, minlength=n).argmax())
    for i in queue.tolist():
        compare(i)
    return forest.links


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of sorted batches by key; holds one group at a time."""
    rows = (r for b in batches for at in range(0, b.num_rows, 512) for r in b.slice(at, 512).to_pylist())
    for k, group in groupby(rows, key=lambda r: tuple(r[c] for c in key)):
        yield k, list(group)


def _edges(pairs: Iterator[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []
    for found in pairs:
        held += found
        if len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held)], names=["u", "v"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(u, v)``: the smallest node reached.

    Each round ties every node to its smallest neighbour if that is smaller and
    contracts the edges; rounds end when no edge is left.  Nodes that are
    smaller than all neighbours stay, so a round at least halves the others.
    """
    order = lambda df: df.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = materialise(order(edges), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = materialise(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("n"), F.least("u", "v").alias("p")), "parents")
        if labels is None:
            labels = parent.withColumnsRenamed({"n": "node", "p": "component"})
        else:
            labels = labels.join(parent, F.col("component") == F.col("n"), "left").select("node", F.coalesce("p", "component").alias("component"))
        labels = materialise(labels, "labels")
        step = edges.join(parent, F.col("u") == F.col("n")).select(F.col("p").alias("u"), "v")
        step = step.join(parent, F.col("v") == F.col("n")).select("u", F.col("p").alias("v"))
        edges = materialise(order(step), "edges")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels


def forest_links(members: DataFrame, block_nodes: int, task: Callable[[list[dict], np.ndarray, np.ndarray, np.ndarray | None], list[tuple[int, int]]], needed: list[tuple[int, int]], sample: int = 64, most: int = 8) -> DataFrame:
    """Edges ``u, v`` that connect what ``task`` links inside the groups.

    ``members`` has ``grp, node, sig`` and what else ``task`` reads, a row for
    each node of a group, and is written already.  ``task`` gets rows, their
    signatures, sides and known trees, and returns a spanning forest of places.
    """
    cuts = members.groupBy("grp").agg(F.ceil(F.count("*") / block_nodes).cast("int").alias("blocks"))
    large = materialise(cuts.where("blocks > 1"), "large")
    rest = [c for c in members.columns if c not in ("grp", "node", "sig")]

    def run(batches):
        def pairs():
            for _, group in _groups(batches, ["grp", "own", "chunk"]):
                side = np.array([r["side"] for r in group])
                if len(group) < 2 or (side.any() and side.all()):
                    continue
                sigs = np.frombuffer(b"".join(r["sig"] for r in group), np.uint8).reshape(len(group), -1)
                trees = np.array([-1 if r["tree"] is None else r["tree"] for r in group]) if side.any() else None
                ids = [r["node"] for r in group]
                yield [(ids[a], ids[b]) for a, b in task(group, sigs, side, trees)]
        return _edges(pairs())

    def work(rows: DataFrame) -> DataFrame:
        rows = rows.select("grp", "own", "chunk", "side", "tree", "node", "sig", *rest)
        return rows.repartition("grp", "own", "chunk").sortWithinPartitions("grp", "own", "chunk", "side", "node").mapInArrow(run, "u long, v long")

    none = {"chunk": F.lit(-1), "side": F.lit(0), "tree": F.lit(None).cast("long")}
    if large.isEmpty():
        return work(members.withColumns({"own": F.lit(0), **none}))
    dealt = members.join(large, "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int"))
    order = Window.partitionBy("grp").orderBy(F.xxhash64(F.lit(5), "node"), "node")
    drawn = members.join(large, "grp").withColumn("no", F.row_number().over(order)).where(F.col("no") <= sample).drop("no")

    def choose(batches):
        for _, group in _groups(batches, ["grp"]):
            sigs = np.frombuffer(b"".join(r["sig"] for r in group), np.uint8).reshape(len(group), -1)
            yield pa.RecordBatch.from_pylist([group[i] for i in leaders(sigs, needed, most)], schema=batch_schema)

    batch_schema = to_arrow_schema(drawn.schema)
    lead = drawn.repartition("grp").sortWithinPartitions("grp", "node").mapInArrow(choose, drawn.schema)
    lead = materialise(lead, "leaders").withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lead = lead.where(F.col("own") != F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")))
    near = materialise(work(dealt.unionByName(lead).withColumns(none)), "near")

    trees = components(near).withColumnRenamed("component", "tree")
    grown = dealt.where("blocks > 1").join(trees, "node", "left").withColumn("tree", F.coalesce("tree", "node"))
    grown = materialise(grown, "grown")
    main = grown.groupBy("grp", "tree").count().groupBy("grp").agg(F.max_by("tree", F.struct("count", "tree")).alias("main"))
    outside = grown.join(main, "grp").where("tree <> main")
    chunks = outside.groupBy("grp").agg(F.ceil(F.count("*") / block_nodes).cast("int").alias("chunks"))
    outside = outside.join(chunks, "grp").withColumns({"chunk": F.pmod(F.xxhash64(F.lit(7), "node"), F.col("chunks")).cast("int"), "side": F.lit(1)})
    spread = outside.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    inside = grown.join(chunks, "grp").withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "side": F.lit(0)})
    return near.unionByName(work(inside.unionByName(spread, allowMissingColumns=True)))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = 24, rows: int = 3, miss: float = 1e-6, batch: int = 12, block_nodes: int = 2000) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Returns ``id_col, n_shingles, component_id, kept``, a row for each row of
    ``docs``: the component is the smallest id reachable over links, and its
    document is the one kept.  A pair at the threshold is missed by all bands
    with probability ``(1 - s**rows)**bands`` (3e-8 at 0.8) and pruned wrongly
    with ``miss``; links are confirmed on full sets of 64-bit shingle hashes.

    Null, empty and blank texts have an empty set and are linked with nothing.
    Texts of any length are read whole; a task holds the texts of two blocks of
    ``block_nodes``.  Rows with a null id are linked with nothing, have a null
    component and are kept.  Rows with the same id are one document: their classes are linked.
    Repeated rows give repeated rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    sketch = Sketch(bands, rows)
    needed = needed_matches(sketch.n, batch, percent / 100, miss)
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))

    def scan(batches):
        for whole in batches:
            for part in slices(whole, 1):
                sets = [shingle_set(t, words) for t in part.column(1).to_pylist()]
                made = [sketch.of(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.list_(pa.int64())),
                    part.column(2),
                ], names=["doc", "n", "key", "sig", "bands", "row"])

    seen = materialise(base.select("doc", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row")).mapInArrow(scan, "doc long, n long, key binary, sig binary, bands array<long>, row long"), "sketches")
    real = seen.where(F.col("key").isNotNull() & F.col("doc").isNotNull())
    first = real.groupBy("key").agg(F.min(F.struct("doc", "row")).alias("f")).select("key", F.col("f.doc").alias("node"), F.col("f.row").alias("row"))
    first = materialise(first, "classes")
    same = real.select("key", "doc", "row", "n", "sig", "bands").join(first.select("key", F.col("node").alias("doc"), "row"), ["key", "doc", "row"], "left_semi")
    nodes = materialise(same.dropDuplicates(["key"]).select(F.col("doc").alias("node"), "row", "n", "sig", "bands"), "nodes")

    members = nodes.select("node", F.explode("bands").alias("grp"))
    shared = members.groupBy("grp").agg(F.count("*").alias("size")).where("size > 1").select("grp")
    met = materialise(members.join(shared, "grp").join(nodes.select("node", "sig"), "node").select("grp", "node", "sig"), "buckets")
    open_bucket = lambda group, sigs, side, trees: sketch_forest(sigs, side, trees, needed)
    clusters = components(forest_links(met, block_nodes, open_bucket, needed)).withColumnRenamed("component", "grp")

    texts = base.withColumn("row", F.xxhash64(F.coalesce("text", F.lit("")))).withColumnRenamed("doc", "node")
    placed = clusters.join(nodes.select("node", "row", "sig"), "node")
    placed = texts.join(placed, ["node", "row"]).dropDuplicates(["node", "row"]).select("grp", "node", "sig", "text")

    def verify(group, sigs, side, trees):
        return exact_forest([shingle_set(r["text"], words) for r in group], sigs, side, trees, needed, percent)

    links = forest_links(materialise(placed, "clusters"), block_nodes, verify, needed)
    parts = components(links)
    named = first.join(parts, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    out = seen.select("doc", "n", "key").join(named, "key", "left")
    label = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return out.select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), label.alias("component_id"),
        F.coalesce(F.col("doc") == label, F.lit(True)).alias("kept"),
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents`` over 4-word shingles."""
    return near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, ws[s : s + 3] AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS t(s) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN ways b ON r.y = b.x
), comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM comp c LEFT JOIN n ON n.doc_id = c.doc_id
"""
