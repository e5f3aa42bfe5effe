"""Graph operators over edges ``src, kind, dst, grade``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators.propagation import propagated
from marlstone.operators.shared import numbered, save

#: Damping, rounds and laziness of the walk; decay of a hop; sweeps.
DAMPING, ROUNDS, LAZINESS, HOP_DECAY, SWEEPS = 0.85, 3, 0.5, 0.5, 20
STATED = 10
#: Edges of a graph that one task sweeps faster than rounds of jobs do.
FEW = 100_000


def undirected(edges: DataFrame) -> DataFrame:
    """``node, neighbour, grade`` both ways; parallel edges stay apart."""
    there = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "grade")
    return there.unionAll(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), "grade"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct()


def documents(all_nodes: DataFrame) -> DataFrame:
    return all_nodes.where(~F.startswith("node", F.lit("tag:")))


def explain(edges: DataFrame, known: DataFrame, doc: str) -> DataFrame:
    """Outgoing edges of one document, and whether it is known at all.

    One row ``doc, state, kind, dst, grade`` for each edge; a single row without
    edge tells ``isolated`` (known, no edges) from ``unknown``.
    """
    one = known.sparkSession.range(1).select(F.lit(doc).alias("doc"))
    out = one.join(known.select(F.col("id").alias("doc"), F.lit(True).alias("known")).distinct(), "doc", "left")
    out = out.join(edges.withColumnRenamed("src", "doc"), "doc", "left")
    state = F.when(F.col("dst").isNotNull(), "connected").when(F.col("known"), "isolated").otherwise("unknown")
    return out.select("doc", state.alias("state"), "kind", "dst", "grade")


def inbound(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count("*").alias("n_in"))


def seed_mass(seeds: DataFrame) -> DataFrame:
    """Mass 1/rank of ``node, rank``, made to sum to 1; a handful of rows."""
    total = seeds.agg(F.sum(1 / F.col("rank")).alias("total"))
    return seeds.crossJoin(F.broadcast(total)).select("node", (1 / F.col("rank") / F.col("total")).alias("mass"))


def pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, laziness: float = LAZINESS) -> DataFrame:
    """Lazy personalised PageRank from ranked seeds: ``node, score``.

    The number of rounds is fixed, so the plan is; a seed outside the graph
    keeps its lazy and its restart mass.  A ``laziness`` of 0 is the plain walk.  Each round joins the mass with the
    adjacency, whose shares are summed before they are shuffled.
    """
    links = undirected(edges)
    weight = links.groupBy("node").agg(F.sum("grade").alias("out"))
    share = links.join(weight, "node").select("node", "neighbour", (F.col("grade") / F.col("out")).alias("share"))
    start = seed_mass(seeds)
    mass = start
    for _ in range(rounds):
        moved = mass.join(share, "node").select(F.col("neighbour").alias("node"), (DAMPING * (1 - laziness) * F.col("mass") * F.col("share")).alias("m"))
        stay = mass.select("node", (DAMPING * laziness * F.col("mass")).alias("m"))
        again = start.select("node", ((1 - DAMPING) * F.col("mass")).alias("m"))
        mass = moved.unionAll(stay).unionAll(again).groupBy("node").agg(F.sum("m").alias("mass"))
    return mass.withColumnRenamed("mass", "score")


def expand(scores: DataFrame, seeds: DataFrame, limit: int = 10, least: float = 0.0) -> DataFrame:
    """The best nodes that are no seeds, by score, then id."""
    rest = scores.join(seeds.select("node"), "node", "left_anti").where(F.col("score") >= least)
    return rest.orderBy(F.col("score").desc(), "node").limit(limit)


def routes(edges: DataFrame, pairs: DataFrame, hops: int = 2, limit: int = 10) -> DataFrame:
    """Simple directed routes of at most ``hops`` edges for pairs ``a, b``.

    Rows ``a, b, hops, reliability, steps`` with the steps' kinds and targets.
    A route that has arrived is not extended.  The best ``limit`` of each pair
    by reliability, then steps.
    """
    grow = pairs.where("a <> b").select("a", "b", F.col("a").alias("at"), F.array("a").alias("seen"), F.lit(1.0).alias("rel"), F.array().cast("array<struct<kind:string,dst:string>>").alias("steps"))
    out = None
    for hop in range(1, hops + 1):
        step = grow.join(edges.withColumnRenamed("src", "at"), "at").where(~F.array_contains("seen", F.col("dst")))
        decay = HOP_DECAY if hop > 1 else 1.0
        step = step.select(
            "a", "b", F.col("dst").alias("at"), F.concat("seen", F.array("dst")).alias("seen"),
            (F.col("rel") * F.col("grade") / STATED * decay).alias("rel"),
            F.concat("steps", F.array(F.struct("kind", "dst"))).alias("steps"))
        done = step.where("at = b").withColumn("hops", F.lit(hop))
        out = done if out is None else out.unionByName(done)
        grow = step.where("at <> b")
    if out is None:
        out = grow.withColumn("hops", F.lit(0)).where(F.lit(False))
    order = Window.partitionBy("a", "b").orderBy(F.col("rel").desc(), "steps")
    ranked = out.withColumn("no", F.row_number().over(order)).where(F.col("no") <= limit)
    return ranked.select("a", "b", "no", "hops", F.col("rel").alias("reliability"), "steps")


def connected(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node of the part, found by contraction."""
    flat = lambda df: df.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    left = save(flat(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))), "edges")
    labels = save(nodes(edges).withColumn("component", F.col("node")), "labels")
    while not left.isEmpty():
        both = left.unionAll(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = save(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("n"), F.least("u", "v").alias("p")), "parents")
        labels = save(labels.join(parent, F.col("component") == F.col("n"), "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        step = left.join(parent, F.col("u") == F.col("n")).select(F.col("p").alias("u"), "v")
        left = save(flat(step.join(parent, F.col("v") == F.col("n")).select("u", F.col("p").alias("v"))), "edges")
    return labels


def propagate_labels(links: dict[str, list[tuple[str, int]]], sweeps: int = SWEEPS) -> dict[str, str]:
    """Asynchronous label propagation of one component, nodes in sorted order.

    A node takes the label of the largest total grade among its neighbours, the
    smallest of equals; a sweep without a change ends it.
    """
    label = {n: n for n in links}
    order = sorted(links)
    for _ in range(sweeps):
        before = dict(label)
        for n in order:
            votes: dict[str, int] = {}
            for other, grade in links[n]:
                votes[label[other]] = votes.get(label[other], 0) + grade
            if votes:
                top = max(votes.values())
                label[n] = min(k for k, v in votes.items() if v == top)
        if label == before:
            break
    return label


def communities(edges: DataFrame, few: int = FEW) -> DataFrame:
    """``node, community, size`` with communities named c0, c1, … by size, then member.

    A graph of at most ``few`` edges is swept by one task.  A larger one is swept
    level by level over blocks of nodes (``propagation``).  What that form
    can't hold is swept by components.
    """
    ends = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("grade").cast("int").alias("grade"))
    if ends.limit(few + 1).count() <= few:
        links = undirected(edges.where("src IS NOT NULL AND dst IS NOT NULL")).withColumn("component", F.lit(""))
        return _named(links)
    found = propagated(ends, SWEEPS)
    return by_components(edges.where("src IS NOT NULL AND dst IS NOT NULL")) if found is None else found


def by_components(edges: DataFrame) -> DataFrame:
    """The same, each connected component swept by one task.

    Labels only flow along edges, so each connected component is a group of its
    own; a component that had a sweep without change stays as it is, so ending
    each by itself gives what sweeping all of them together would.
    """
    return _named(undirected(edges).join(connected(edges), "node"))


def _named(links: DataFrame) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[tuple[str, int]]] = {}
        for n, other, grade in zip(pdf["node"], pdf["neighbour"], pdf["grade"]):
            near.setdefault(n, []).append((other, int(grade)))
        found = propagate_labels(near)
        return pd.DataFrame({"node": list(found), "label": list(found.values())})

    labelled = save(links.select("component", "node", "neighbour", "grade").groupBy("component").applyInPandas(run, "node string, label string"), "communities")
    named = labelled.groupBy("label").agg(F.count("*").alias("size"), F.min("node").alias("least"))
    named = numbered(named, F.col("size").desc(), F.col("least")).withColumn("community", F.concat(F.lit("c"), F.col("no").cast("string")))
    return labelled.join(named.select("label", "community", "size"), "label").select("node", "community", "size")


def with_community(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``doc`` with its ``community`` and how many other nodes are in it; both null outside the graph."""
    named = found.select(F.col("node").alias("doc"), "community", (F.col("size") - 1).cast("long").alias("siblings"))
    return docs.join(named, "doc", "left")
