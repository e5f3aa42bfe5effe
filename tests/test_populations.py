from pyspark.sql import functions as F

from marlstone.operators import evaluate as EV
from marlstone.operators import graph as G
from marlstone.operators import maintain as M
from marlstone.operators.shared import numbered


def test_numbered_gives_places_across_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    got = numbered(rows, F.col("v").desc()).collect()
    assert sorted((r["no"], r["v"]) for r in got) == [(i, 4999 - i) for i in range(5000)]
    assert numbered(rows.where("false"), F.col("v")).isEmpty()


def test_bands_and_strides(spark):
    dfs = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 1), ("e", 1)], "term string, df long")
    bands = EV.query_bands(dfs, 2, 2, 1)
    assert sorted(tuple(r) for r in bands.collect()) == [("head", 0, "a", 9), ("head", 1, "b", 5), ("mid", 0, "b", 5), ("mid", 1, "c", 5), ("tail", 0, "d", 1)]
    asked = {r["query"] for r in EV.stride_queries(bands, 2, 1).collect()}
    assert asked == {"a", "b", "c", "d", "d a", "d b", "a b", "d b a"}
    several = EV.query_bands(dfs.where("df > 1"), 1, 1, 2).where("band = 'tail'")
    assert sorted(r["term"] for r in several.collect()) == ["b", "c"]
    nothing = EV.query_bands(dfs.where("false"))
    assert nothing.isEmpty() and EV.stride_queries(nothing).isEmpty()


def test_grades(spark):
    rows = [(1, 1, 3, None, 9, False, False), (2, 4, 3, None, 9, False, False), (3, 2, 3, 1, 9, False, True), (4, 2, 3, 5, 9, False, True), (5, None, 3, None, 9, False, False), (6, None, 3, None, 0, True, False), (7, None, 3, None, 2, True, True)]
    got = EV.grade(spark.createDataFrame(rows, "no int, rank int, max_rank int, forbid_rank int, n_results int, expect_empty boolean, known boolean"))
    assert {r["no"]: r["status"] for r in got.collect()} == {1: "pass", 2: "fail", 3: "xfail", 4: "xpass", 5: "fail", 6: "pass", 7: "xfail"}


def test_display_titles(spark):
    records = spark.createDataFrame([("a", "1", "Plain", None), ("b", "2", None, "h:ff"), ("c", "3", None, "h:ee"), ("d", None, None, None)], "id string, sha string, title string, title_h string")
    cache = spark.createDataFrame([("1", "Other"), ("2", "Known")], "sha string, title string")
    got = {r["id"]: r["title"] for r in M.display_titles(records, cache).collect()}
    assert got == {"a": "Plain", "b": "Known", "c": "ee (uncached — title unavailable)", "d": " (uncached — title unavailable)"}


def test_plain_walk_keeps_no_lazy_mass(spark):
    edges = spark.createDataFrame([("a", "ref", "b", 10)], "src string, kind string, dst string, grade int")
    seeds = spark.createDataFrame([("a", 1)], "node string, rank int")
    got = {r["node"]: r["score"] for r in G.pagerank(edges, seeds, rounds=1, laziness=0.0).collect()}
    assert abs(got["a"] - 0.15) < 1e-12 and abs(got["b"] - 0.85) < 1e-12
