"""Queries that once did less than the whole job, against brute force over all rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import edges as E
from marlstone.operators import graph as G
from marlstone.plans import catalogue, graphs, upkeep


@pytest.fixture(scope="module")
def fk(spark, sf_dir):
    return [tuple(r) for r in graphs.fk_edges(spark, sf_dir).select("src", "dst", "grade").collect()]


def test_components_of_all_foreign_keys(spark, sf_dir, fk):
    parent = {n: n for s, d, _ in fk for n in (s, d)}

    def find(n):
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    for s, d, _ in fk:
        a, b = sorted((find(s), find(d)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in catalogue.QUERIES["graph_components_whole"](spark, sf_dir).collect()}
    assert got == {n: find(n) for n in parent}
    assert {n.split(":")[0] for n in got} == {"order", "customer", "supplier", "part", "nation", "region"}


def test_communities_of_all_foreign_keys(spark, sf_dir, fk):
    links = {}
    for s, d, g in fk:
        links.setdefault(s, []).append((d, g))
        links.setdefault(d, []).append((s, g))
    groups = {}
    for n, label in G.propagate_labels(links).items():
        groups.setdefault(label, []).append(n)
    ranked = sorted(groups.values(), key=lambda ns: (-len(ns), min(ns)))
    want = {n: (f"c{i}", len(ns)) for i, ns in enumerate(ranked) for n in ns}
    got = {r["node"]: (r["community"], r["size"]) for r in catalogue.QUERIES["communities"](spark, sf_dir).collect()}
    assert got == want


def test_communities_by_levels_are_those_of_one_sweep(spark, sf_dir, fk, monkeypatch):
    one = sorted(map(tuple, catalogue.QUERIES["communities"](spark, sf_dir).collect()))
    monkeypatch.setattr(G, "FEW", 0)
    monkeypatch.setattr(G, "by_components", lambda edges: pytest.fail("a component came to one task"))
    assert sorted(map(tuple, catalogue.QUERIES["communities"](spark, sf_dir).collect())) == one
    assert {r["node"] for r in catalogue.QUERIES["communities"](spark, sf_dir).select("node").collect()} == {n for s, d, _ in fk for n in (s, d)}


def test_codes_of_nodes_keep_names_and_order(spark):
    keys = [0, 1, 10, 100, 11, 2, 9, 90, 99, 10**15, 10**16 - 1]
    table = spark.createDataFrame([(k,) for k in keys], "k long")
    coded = [table.select(F.concat(F.lit(f"{kind}:"), F.col("k").cast("string")).alias("name"), graphs._code(kind, F.col("k")).alias("code")) for kind in graphs.KINDS]
    rows = [r for df in coded for r in df.withColumn("back", graphs._decoded(F.col("code"))).collect()]
    assert all(r["name"] == r["back"] for r in rows)
    assert [r["name"] for r in sorted(rows, key=lambda r: r["code"])] == sorted(r["name"] for r in rows)
    odd = spark.createDataFrame([(-1,), (10**16,), (None,)], "k long").select(graphs._code("order", F.col("k"))).collect()
    assert [r[0] for r in odd] == [-1, -1, None]


def test_routes_by_suppliers_are_found(spark, sf_dir, fk):
    nation = {s: d for s, d, _ in fk if s.startswith("supplier:")}
    region = {s: d for s, d, _ in fk if s.startswith("nation:")}
    want = {(s, d) for s, d, _ in fk if s.startswith("order:") and d.startswith("supplier:") and region[nation[d]] == "region:0"}
    rows = catalogue.QUERIES["simple_routes_whole"](spark, sf_dir).collect()
    assert {(r["a"], r["steps"].split(" ")[0].removeprefix("ref>")) for r in rows if "supplier:" in r["steps"]} == want


def test_exact_cosine_finds_the_best_of_all_rows(spark, sf_dir, duck):
    rows = duck.sql("SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id").fetchall()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = {int(q): set(ids[np.lexsort((ids, -np.round(v @ v[i], 6)))[:10]].tolist()) for i, q in enumerate(ids) if q % 20 == 0}
    got = {}
    for r in catalogue.QUERIES["dense_cosine_exact"](spark, sf_dir).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert got == want


def test_every_foreign_key_is_resolved(spark, sf_dir, fk):
    file = lambda n: f"file:{n.replace(':', '/')}.md"
    want = {(file(s), file(d)) for s, d, _ in fk}
    for name in ("resolve_links_whole", "resolve_code_whole"):
        assert want <= {(r["src"], r["dst"]) for r in catalogue.QUERIES[name](spark, sf_dir).collect()}
    kept = {(r["src"], r["dst"]) for r in catalogue.QUERIES["drop_dangling_whole"](spark, sf_dir).collect()}
    assert {e for e in want if "supplier/" not in e[1]} <= kept and not any("supplier/" in d for _, d in kept)


@pytest.mark.parametrize("name", ["link_targets_whole", "code_targets_whole", "markdown_headings_whole"])
def test_all_texts_are_scanned(spark, sf_dir, duck, name):
    n = duck.sql("SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages)").fetchall()[0][0]
    assert catalogue.QUERIES[name](spark, sf_dir).count() == n


def test_explained_node_has_all_its_edges(spark, sf_dir, fk):
    rows = catalogue.QUERIES["explain_node_whole"](spark, sf_dir).collect()
    assert {r["dst"] for r in rows if r["state"] == "connected"} == {d for s, d, _ in fk if s == "order:1"}
    assert {r["doc"]: r["state"] for r in rows if r["state"] != "connected"} == {"region:0": "isolated", "customer:999999999": "unknown"}


def test_paths_of_all_texts_are_normalised(spark, sf_dir, duck):
    paths = {r["path"] for r in catalogue.QUERIES["path_normalize_whole"](spark, sf_dir).collect()}
    assert {u for (u,) in duck.sql("SELECT url FROM pages").fetchall()} <= paths


def test_gold_holds_the_whole_item(spark, tmp_path):
    opening = "rollback storage ledger quartz " * 3
    docs = [(1, opening + "other ending", "en", "src1", 1), (2, "filler words only", "en", "src1", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, opening + "right ending")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r["rank"] for r in upkeep._gold(spark, str(tmp_path)).collect()] == [None]


def test_title_agrees_with_its_sql_on_odd_pages(spark, tmp_path):
    pages = ["<title>a &amp;&amp</title>", "<title>\t x &lt;b&gt; </title>", "<title>&amp;lt; &quot;q&quot; &#65; &eacute;</title>", "<title lang='en'>n</title>", "<TITLE>n</TITLE>",
             "<title></title><title>two</title>", "<title>\u00a0\u3000n\nm\n</title>", "<title>open", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("*", "'http://h/' AS url").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(c.sql(catalogue.ORACLES["html_title"]).fetchall())
    got = {r["page_id"]: r["title"] for r in catalogue.QUERIES["html_title"](spark, str(tmp_path)).collect()}
    assert got == want
    whole = {r["page_id"]: r["title"] for r in catalogue.QUERIES["html_title_whole"](spark, str(tmp_path)).collect()}
    assert (whole[0], whole[2], whole[3]) == ("a &&", "&lt; \"q\" A \u00e9", "n")


def test_plain_links_are_not_shuffled_and_odd_ones_stay_right(spark):
    known = spark.createDataFrame([("file:a/x.md",), ("file:a/y.md",), ("file:b/index.md",), ("file:c/only.md",)], "id string")
    rows = [("file:a/y.md", "x.md"), ("file:a/y.md", "./x.md"), ("file:a/x.md", "../b"), ("file:a/x.md", "../b/index.md"), ("file:a/x.md", "x.md"), ("file:a/x.md", "gone.md"), ("file:a/x.md", "../c/only.md")]
    links = spark.createDataFrame(rows + rows[:1], "src string, target string")
    want = [("file:a/x.md", "file:b/index.md"), ("file:a/x.md", "file:c/only.md"), ("file:a/y.md", "file:a/x.md")]
    assert sorted((r["src"], r["dst"]) for r in E.resolve_links(links, known).collect()) == want
    spans = spark.createDataFrame([("file:a/y.md", "a/x.md"), ("file:a/y.md", "x.md"), ("file:a/y.md", "only.md"), ("file:a/y.md", "none.md")] * 2, "src string, span string")
    assert sorted(tuple(r) for r in E.code_edges(spans, known).collect()) == [("file:a/y.md", "code", "file:a/x.md", 10), ("file:a/y.md", "code", "file:c/only.md", 8)]
    plain = spark.createDataFrame([("file:a/x.md", "y.md"), ("file:a/y.md", "x.md")], "src string, target string")
    edges = E.drop_dangling(E.resolve_links(plain, known, once=True), known.where("id <> 'file:a/y.md'"), known)
    assert "hashpartitioning" not in edges._jdf.queryExecution().executedPlan().toString()
    assert [r["dst"] for r in edges.collect()] == ["file:a/x.md"]
