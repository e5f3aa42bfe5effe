import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.functions import markup
from marlstone.functions import text as T
from marlstone.operators import evaluate as EV
from marlstone.operators import graph as G
from marlstone.operators import index as I
from marlstone.operators import maintain as M
from marlstone.operators import passages as P
from marlstone.operators import propagation as L
from marlstone.operators import ranking as R
from marlstone.sources import files, lists, web


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_tokens(spark):
    r = one(spark, T.tokens(F.lit("The Quick_brown fox, Iechä 42!")), T.query_terms(F.lit("b a1 b c a1")))
    assert r[0] == ["quick_brown", "fox", "iech", "42"]
    assert r[1] == ["b", "a1", "c"]


def test_bm25f_of_one_occurrence(spark):
    score = I.contribution(I.idf(F.lit(1), F.lit(1)), F.lit(0), F.lit(1), F.lit(10), F.lit(10.0))
    assert one(spark, score)[0] == pytest.approx(math.log(4 / 3))


def test_bound_holds_for_every_posting(spark):
    rows = [(f"d{i:04d}", "common", i % 7, i % 13 + 1, 10 + (i * 37) % 900) for i in range(400)] + [(f"d{i:04d}", "mid", 1, i % 17, 10 + (i * 37) % 900) for i in range(0, 400, 3)]
    posts = spark.createDataFrame(rows, "id string, term string, tf_h long, tf_b long, wlen long")
    blocks = I.blocks(posts)
    assert blocks.groupBy("term").agg(F.sum("cnt").alias("n")).orderBy("term").collect() == posts.groupBy("term").agg(F.count("*").alias("n")).orderBy("term").collect()
    both = posts.join(blocks, "term").where((F.col("id") >= F.col("first_doc")) & (F.col("id") <= F.col("last_doc")))
    score = I.contribution(F.lit(1.0), F.col("tf_h"), F.col("tf_b"), F.col("wlen"), F.lit(400.0))
    bound = I.contribution(F.lit(1.0), F.lit(0), F.col("mx"), F.col("mnw"), F.lit(400.0))
    assert both.where(score > bound + 1e-12).isEmpty()


def test_weight_one_is_no_step(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("id"), F.lit(1.0).alias("score"))
    assert R.demote(df, F.lit(True), 1.0) is df


def test_rrf(spark):
    lanes = spark.createDataFrame([("a", 1, 5), ("b", 2, 0), ("a", 1, 5), ("b", 2, 0)], "item string, rank int, rank_offset int")
    got = {r["item"]: r["score"] for r in R.rrf(lanes.drop("rank_offset")).collect()}
    assert got == {"a": pytest.approx(2 / 61), "b": pytest.approx(2 / 62)}
    assert {r["item"]: r["score"] for r in R.rrf(lanes).collect()}["a"] == pytest.approx(2 / 66)


def chain(spark, *edges):
    return spark.createDataFrame([(a, "ref", b, 10) for a, b in edges], "src string, kind string, dst string, grade int")


def test_lazy_walk_on_a_path(spark):
    edges = chain(spark, ("a", "b"), ("b", "c"), ("c", "d"))
    seeds = spark.createDataFrame([("a", 1)], "node string, rank int")
    got = {r["node"]: r["score"] for r in G.pagerank(edges, seeds).collect()}
    assert [round(got[k], 3) for k in "abcd"] == [0.446, 0.406, 0.129, 0.019]


def test_routes(spark):
    edges = chain(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"))
    got = G.routes(edges, spark.createDataFrame([("a", "c"), ("a", "a")], "a string, b string"), 3).orderBy("no").collect()
    assert [(r["hops"], r["reliability"]) for r in got] == [(1, 1.0), (2, 0.5)]


def test_communities_are_those_of_one_sweep_over_all(spark):
    rng = random.Random(4)
    edges = sorted({(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(45)})
    edges = [(a, b) for a, b in edges if a != b]
    links: dict[str, list[tuple[str, int]]] = {}
    for a, b in edges:
        links.setdefault(a, []).append((b, 10))
        links.setdefault(b, []).append((a, 10))
    labels = G.propagate_labels(links)
    members: dict[str, list[str]] = {}
    for n, label in labels.items():
        members.setdefault(label, []).append(n)
    order = sorted(members.values(), key=lambda m: (-len(m), min(m)))
    want = {n: f"c{i}" for i, m in enumerate(order) for n in m}
    assert {r["node"]: r["community"] for r in G.communities(chain(spark, *edges)).collect()} == want


def test_one_large_component_is_swept_in_blocks(spark, monkeypatch):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(90):02d}", f"n{rng.randrange(90):02d}", rng.choice([8, 10])) for _ in range(170)]
    edges += edges[:9] + [("n05", "n05", 10)] + [(f"n{i:02d}", "n90", 10) for i in range(0, 90, 3)]
    links: dict[str, list[tuple[str, int]]] = {}
    for a, b, grade in edges:
        links.setdefault(a, []).append((b, grade))
        links.setdefault(b, []).append((a, grade))
    members: dict[str, list[str]] = {}
    for n, label in G.propagate_labels(links).items():
        members.setdefault(label, []).append(n)
    order = sorted(members.values(), key=lambda m: (-len(m), min(m)))
    want = {n: (f"c{i}", len(m)) for i, m in enumerate(order) for n in m}
    assert len(order) > 1
    made, blocks = [], L._blocks
    monkeypatch.setattr(L, "BLOCK", 40)
    monkeypatch.setattr(L, "_blocks", lambda *a: made.append(blocks(*a)) or made[-1])
    monkeypatch.setattr(G, "by_components", lambda edges: pytest.fail("a component came to one task"))
    table = spark.createDataFrame([(a, "ref", b, g) for a, b, g in edges], "src string, kind string, dst string, grade int")
    assert {r["node"]: (r["community"], r["size"]) for r in G.communities(table, 0).collect()} == want
    ends = spark.createDataFrame([(int(a[1:]), int(b[1:]), g) for a, b, g in edges], "a long, b long, grade int")
    assert {f"n{r['node']:02d}": (r["community"], r["size"]) for r in L.propagated(ends, G.SWEEPS).collect()} == want
    most = max(map(len, links.values())) + 40
    for table in made:
        sizes = [r["links"] for r in table.collect()]
        assert sum(sizes) == 2 * len(edges) and len(sizes) > 5 and max(sizes) <= most


def test_a_graph_too_deep_for_levels_is_swept_by_components(spark, monkeypatch):
    monkeypatch.setattr(L, "LEVELS", 3)
    edges = chain(spark, *((f"n{i}", f"n{i + 1}") for i in range(8)))
    assert sorted(G.communities(edges, 0).collect()) == sorted(G.by_components(edges).collect())


def test_chunks():
    body = "word " * 40
    got = P.chunk(f"intro\n# A\n{body}\n## Notes\n## B\n{body}\n")
    assert [h for h, _ in got] == ["", "A", "Notes"]
    assert "## Notes\n\n## B" in got[2][1]
    long = "\n\n".join(["word " * 60] * 20)
    assert all(len(t.encode()) <= P.MAX_BYTES for _, t in P.chunk(long)) and len(P.chunk(long)) > 1
    assert P.chunk("") == [] and P.chunk("\n \n") == []
    assert [h for h, _ in P.chunk(f"# A\n{body}\n# tail\nshort\n")] == ["A"]


def passages(*rows):
    return pd.DataFrame([(d, f"{d}#p{i}", s, "h", "x" * (n - P.OVERHEAD), w) for d, i, n, w, s in rows], columns=["doc_id", "locator", "sha", "heading", "text", "score"])


def test_assembly_seats_the_best_first_and_passes_over_what_does_not_fit():
    got = P.assemble_one(passages(("a", 0, 900, 5.0, "1"), ("a", 1, 200, 4.0, "1"), ("a", 2, 90, 1.0, "1"), ("a", 3, 100, 0.0, "1")), budget=1000)
    assert list(got["locator"]) == ["a#p0", "a#p2"] and got["used"].iloc[0] == 990 and got["dropped"].iloc[0] == 1


def test_assembly_caps_a_document_only_against_others():
    rows = [("a", i, 300, 5.0 - i, "1") for i in range(3)]
    assert len(P.assemble_one(passages(*rows), budget=1000)) == 3
    assert list(P.assemble_one(passages(*rows, ("b", 0, 300, 0.1, "2")), budget=1000)["locator"]) == ["a#p0", "b#p0"]


@pytest.mark.parametrize("base,ours,theirs,want", [
    ((1, "x"), (1, "x"), (2, "y"), ("merged", 2, "y")), ((1, "x"), None, (1, "x"), ("deleted", None, None)),
    ((1, "x"), None, (2, "y"), ("conflict", None, None)), (None, (1, "x"), None, ("merged", 1, "x")),
    (None, (1, "x"), (1, "y"), ("conflict", None, None)), ((1, "x"), (3, "a"), (2, "b"), ("merged", 3, "a")),
    ((1, "x"), (2, "a"), (2, "b"), ("conflict", None, None)), ((1, "x"), (2, "a"), (2, "a"), ("merged", 2, "a")),
])
def test_merge3(spark, base, ours, theirs, want):
    side = lambda v: spark.createDataFrame([("d", *v)] if v else [], "id string, ver int, sha string")
    r = M.merge3(side(base), side(ours), side(theirs)).first()
    assert (r["status"], r["ver"], r["sha"]) == want


def test_hash_vectors():
    assert markup.blake2b(b"pruning", 8) == "5618d61da2fc0d56"
    assert markup.blake2b(b"hello world", 20) == "70e8ece5e293e1bda064deef6b080edde357010f"
    assert markup.blake2b(b"file:docs/foo.md", 1) == "2b"


def test_front_matter_round_trip():
    meta = {"title": "A: b", "tags": ["x", "y z"], "n": 3, "f": 1.5, "on": True, "none": None, "date": "2024-01-02", "deep": {"k": "v"}, "lit": "a\n  b\nc"}
    assert markup.front_matter(markup.write_front_matter(meta, "body\n---\n")) == (meta, "body\n---\n")
    assert markup.front_matter("---\nopen") == ({}, "---\nopen")
    assert markup.front_matter("---\ntags: [a, 'b, c']\n# note\nx: 1 # y\n---\nB") == ({"tags": ["a", "b, c"], "x": 1}, "B")


def test_markdown_of_html():
    html = "<h1>T &amp; x</h1><p>a <b>b</b> <a href='u'>l</a><ol><li>one<li>two</li></ol><blockquote><p>q</p></blockquote><table><tr><th>h</th><th>i</th></tr><tr><td>1</td></tr></table><pre>c  \n d</pre><script>no</script>"
    assert markup.to_markdown(html) == "# T & x\n\na **b** [l](u)\n\none\n\n1. two\n\n> q\n\n| h | i |\n|---|---|\n| 1 |  |\n\n```\nc\n d\n```\n"
    assert markup.read_head("<base href='http://h/d/'><title>x</title><a href='../p#f'><a href='#q'><a href='mailto:m'><a href='../p'>", "http://z/") == ("x", ["http://h/p"])


def test_canonical():
    assert markup.canonical({"b": [1, True], "a": "é"}) == '{"a":"é","b":[1,true]}'
    for bad in ({"a": None}, {"a": 1.0}, {"a": "é"}, {"a": "x "}):
        with pytest.raises(ValueError):
            markup.canonical(bad)


def test_lists(spark):
    text = "docs archived=true # old\n!docs/x/*\n\nadr\ndocs archived=true\n"
    got = lists.read(text, "dirs")
    assert [(e.exclude, e.value, e.attrs) for e in got] == [(False, "adr", {"archived": "false"}), (False, "docs", {"archived": "true"}), (True, "docs/x/*", {"archived": "false"})]
    for bad in ("docs archived=maybe", "!!x", "!x a=b", "docs\ndocs archived=true"):
        with pytest.raises(lists.ListError):
            lists.read(bad, "dirs")
    assert lists.remove("docs\n", "docs/sub", "dirs") == ("docs\n!docs/sub\n", "excluded")
    assert lists.frame(spark, {"dirs": got}).count() == 3


def test_files(spark, tmp_path):
    for name, content in {"a.md": b"x", "b.svg": b"y", "sub/c.md": b"", "sub/d.txt": b"a\0", "sub/.hid/e.md": b"z", "out/f.md": b"w", "g.md": b"\xc3"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r["path"]: r["reason"] for r in files.scan(spark, str(tmp_path), [""], ["out"]).collect()}
    assert got == {"a.md": None, "b.svg": "type", "sub/c.md": "empty", "sub/d.txt": "binary", "out/f.md": "excluded: out", "g.md": "non-utf8"}


def test_web_source(spark, tmp_path):
    module = tmp_path / "fake.py"
    module.write_text("def fetch(url):\n    if 'bad' in url:\n        raise OSError('no')\n    return 'text of ' + url + '\\r\\n'\n")
    web.register(spark)
    got = {r["url"]: (r["text"], r["reason"]) for r in spark.read.format("webpages").option("urls", "http://a http://bad").option("fetcher", str(module)).load().collect()}
    assert got == {"http://a": ("text of http://a\n", None), "http://bad": (None, "OSError: no")}
    table = spark.createDataFrame([("http://a",)], "url string")
    assert web.fetch_all(table, str(module)).first()["text"] == "text of http://a\n"


def test_caches():
    arc, lru = EV.ArcCache(400), EV.LruCache(400)
    for cache in (arc, lru):
        assert not cache.access("a", 100) and cache.access("a", 100) and not cache.access("big", 500)
    for i in range(20):
        arc.access(f"s{i}", 100)
    assert arc.access("a", 100)


def test_policy_violations(spark):
    rows = spark.createDataFrame([("a", "git", None, "t", None), ("b", "url", None, "t", None), ("c", "url", "hashed", "t", "h:1"), ("d", "url", "hashed", None, "h:1"), ("e", "url", "hashed", None, None)], "id string, src string, meta string, title string, title_h string").withColumn("phrases", F.array().cast("array<string>"))
    assert sorted(r["id"] for r in I.policy_violations(rows).collect()) == ["b", "c", "e"]


def test_nulls_and_empty_tables(spark):
    none = spark.createDataFrame([], "id string, body string")
    assert I.corpus_stats(I.fields(none)).first().asDict() == {"n": 0, "total_wlen": 0, "avg_wlen": 0.0}
    assert I.postings(I.fields(none)).isEmpty()
    assert G.connected(chain(spark, ("a", "b")).where("false")).isEmpty()
