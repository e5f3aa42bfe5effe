import pytest
from pyspark.sql import functions as F

from marlstone import cli
from marlstone.plans.engine import Config, Engine

DOCS = {f"doc-{i}.md": f"---\ntitle: Document {i}\ntags: [t{i % 2}]\n---\n# Head {i}\n\nBody about topic{i} and shared words. See [next](doc-{i + 1}.md) and `doc-0.md`.\n" for i in range(6)}


def frame(spark, docs):
    return spark.createDataFrame([(f"file:{k}", k, v) for k, v in docs.items()], "id string, loc string, raw string")


def state(engine):
    keep = [c for c in engine.table("records").columns if c != "ver"]
    return (sorted(map(str, engine.table("records").select(*sorted(keep)).collect())), sorted(map(str, engine.table("edges").collect())), sorted(map(str, engine.table("postings").select("term", "id", "tf_h", "tf_b", "wlen").collect())))


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('index')}", Config(archived=("doc-5.md",), archived_weight=0.5))
    assert e.ingest(frame(spark, DOCS))["documents"] == 6
    return e


def test_verbs(engine):
    best = engine.ask("topic3", 3).collect()
    assert best[0]["title"] == "Document 3" and len(best) == 1
    assert [r["loc"] for r in engine.find("topic5").collect()] == ["doc-5.md"]
    assert engine.ask("the of").isEmpty() and engine.ask("").isEmpty() and engine.ask("zzzz").isEmpty()
    cited = engine.answer("topic3 shared").collect()
    assert cited[0]["doc_id"] == "file:doc-3.md" and cited[0]["verdict"] == "unverified"
    assert {(r["kind"], r["dst"]) for r in engine.explain("doc-1.md").collect()} == {("ref", "file:doc-2.md"), ("code", "file:doc-0.md"), ("tag", "tag:t1")}
    assert engine.explain("nowhere.md").first()["state"] == "unknown"
    assert engine.path("doc-1.md", "doc-3.md").first()["reliability"] == 0.5
    assert engine.path("doc-1.md", "doc-5.md").isEmpty()
    roles = {r["node"]: r["role"] for r in engine.graph("topic3").collect()}
    assert roles["file:doc-3.md"] == "seed" and roles["file:doc-4.md"] == "expanded"
    assert engine.communities().count() == 8
    health = engine.doctor()
    assert (health["documents"], health["duplicate_ids"], health["dangling_edges"], health["term_collisions"]) == (6, 0, 0, 0)


def test_answer_sees_what_changed(engine, spark):
    now = frame(spark, {"doc-3.md": DOCS["doc-3.md"] + "changed topic3\n"})
    assert engine.answer("topic3", now).first()["verdict"] == "stale"
    assert engine.answer("topic3", frame(spark, DOCS)).first()["verdict"] == "current"


def test_delta_is_full_build(spark, tmp_path):
    changed = {**DOCS, "doc-2.md": "# New\n\nother [x](doc-6.md)\n", "doc-6.md": "# Six\n"}
    del changed["doc-4.md"]
    delta, full = Engine(spark, f"file://{tmp_path}/a"), Engine(spark, f"file://{tmp_path}/b")
    delta.ingest(frame(spark, DOCS))
    assert delta.ingest(frame(spark, changed)) == {"documents": 6, "changed": 2, "reused": 4, "dropped": 1}
    full.ingest(frame(spark, changed))
    assert state(delta) == state(full)
    versions = {r["id"]: r["ver"] for r in delta.table("records").select("id", "ver").collect()}
    assert versions["file:doc-2.md"] == 2 and versions["file:doc-6.md"] == 1 and versions["file:doc-0.md"] == 1


def test_add_and_remove(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/c")
    e.add(frame(spark, {"a.md": "[b](b.md)", "b.md": "x"}))
    e.add(frame(spark, {"c.md": "[b](b.md)"}))
    lost = e.remove(spark.createDataFrame([("file:b.md",)], "id string")).collect()
    assert [(r["dst"], r["n_in"]) for r in lost] == [("file:b.md", 2)]
    assert e.table("records").count() == 2 and e.table("edges").isEmpty()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("# Alpha\n\nfirst thing\n")
    (tmp_path / "docs/b.svg").write_text("x")
    index = f"file://{tmp_path}/index"
    assert cli.main([index, "ingest", str(tmp_path), "docs"], spark) == 0
    assert cli.main([index, "--json", "find", "alpha"], spark) == 0
    assert cli.main([index, "--json", "ingest", str(tmp_path), "docs", "--list-skipped"], spark) == 0
    out = capsys.readouterr().out
    assert '{"loc": "docs/a.md"}' in out and '"reason": "type"' in out


def test_settings():
    with pytest.raises(ValueError):
        Config(archived_weight=-1)


def test_many_questions(engine, spark):
    q = spark.createDataFrame([(1, "topic1"), (2, "topic2 shared")], "query_id long, query string")
    got = engine.ask_batch(q, 2).groupBy("query_id").agg(F.count("*").alias("n")).orderBy("query_id").collect()
    assert [(r["query_id"], r["n"]) for r in got] == [(1, 1), (2, 2)]


def test_terms_reach_the_scan_as_a_filter(engine, spark):
    plan = engine.ask("topic3 shared", 3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [" in plan.replace("IsNotNull(term), ", "") or "In(term" in plan


def test_publishing_is_one_step_and_one_writer_works_at_a_time(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/d")
    for i in range(4):
        e.ingest(frame(spark, {"a.md": f"text {i}"}))
    names = sorted(p.name for p in (tmp_path / "d").iterdir() if not p.name.startswith("."))
    assert names[0] == "CURRENT" and len(names) == 4 and (tmp_path / "d/CURRENT").is_file()
    (tmp_path / "d/LOCK").touch()
    with pytest.raises(RuntimeError):
        e.ingest(frame(spark, {"a.md": "other"}))
    (tmp_path / "d/LOCK").unlink()
    assert e.ingest(frame(spark, {"a.md": "other"}))["changed"] == 1


def test_source_lists_check_their_values():
    from marlstone.sources import lists

    assert lists.read("https://x/a", "urls")[0].attrs == {"fetch": "http", "meta": "hashed"}
    for kind, bad in (("urls", "ftp://x"), ("dirs", "/abs"), ("dirs", "a/../b"), ("types", "docs/"), ("types", "../x"), ("urls", "http://x meta=open")):
        with pytest.raises(lists.ListError):
            lists.read(bad, kind)


def test_ghosts_move_the_target_by_their_size():
    from marlstone.operators.evaluate import ArcCache

    cache = ArcCache(100)
    for key, size in (("a", 60), ("b", 60)):
        assert not cache.access(key, size)
    assert cache.ghost["recent"] == {"a": 60} and not cache.access("a", 30)
    assert cache.target == 60 and "a" in cache.live["often"] and cache.access("b", 60)
    small = ArcCache(10)
    for key in "xyz":
        small.access(key, 10)
    assert list(small.ghost["recent"]) == ["y"]
