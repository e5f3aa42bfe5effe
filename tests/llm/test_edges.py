"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe, chat, decontaminate, html_extract, language_id, line_dedup, near_dedup, pii, quality, token_files
from marlstone.llm.common import scratch

LONG = "\n".join(f"line number {i} of a long text about nothing" for i in range(3000))
ROWS = [
    (1, None, None), (2, "", "en"), (3, "Same line here\nshort\nSame line here", "en"), (4, "  SAME LINE HERE \nother words", "en"), (4, "same line here", None),
    (5, "same line here", "de"), (5, "same line here", "de"), (None, "same line here", "en"), (6, LONG, "en"), (7, "12 34 !!", "fr"), (8, " \t\n", "fr"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumns({"n_words": F.lit("mine"), "batch": F.lit(0), "kept": F.lit(7), "h1": F.lit("x"), "ids": F.lit("y"), "score": F.lit("z"), "row": F.lit(1), "doc": F.lit(2)})


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def test_line_dedup(docs, nothing):
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"], r["batch"]) for r in line_dedup.line_dedup(docs).collect()), key=repr)
    assert got == sorted([
        (1, None, 1, 0, 0), (2, "", 1, 0, 0), (3, ROWS[2][1], 3, 0, 0), (4, "other words", 2, 1, 0), (4, "", 1, 1, 0), (5, "", 1, 1, 0), (5, "", 1, 1, 0),
        (None, "same line here", 1, 0, 0), (6, LONG, 3000, 0, 0), (7, "12 34 !!", 1, 0, 0), (8, " \t\n", 2, 0, 0)], key=repr)
    assert line_dedup.line_dedup(nothing).isEmpty()


def test_line_dedup_does_not_depend_on_batches(docs):
    want = sorted(map(str, line_dedup.line_dedup(docs, batches=1).collect()))
    for batches, fanout in ((2, 2), (5, 2), (7, 3)):
        assert sorted(map(str, line_dedup.line_dedup(docs, batches=batches, fanout=fanout).collect())) == want


def test_line_dedup_reads_sorted_runs_as_they_lie(spark):
    """A batch is combined, dealt and sorted once; the run it is merged with is neither dealt nor sorted."""
    hashes = ("xxhash64(id) AS h1", "xxhash64(id, 1) AS h2", "id AS first")
    distinct = lambda a, b: spark.range(a, b).selectExpr(*hashes).groupBy("h1", "h2").agg(F.min("first").alias("first"))
    with line_dedup._settings(spark):
        run = line_dedup._write_run(distinct(0, 2000))
        left = line_dedup._against(distinct(1000, 3000), [run])
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange ") == 1 and plan.count("Sort [") == 1
        assert plan.index("SortMergeJoin") < plan.index("HashAggregate")
        assert left.count() == 1000
    spark.sql(f"DROP TABLE {run[0]}")


def test_decontaminate(spark, docs, nothing):
    bench = spark.createDataFrame([(10, "Same line"), (11, "line number 5 of a long text about nothing line number 6"), (12, None), (13, ""), (None, "other words"), (14, "same LINE")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.decontaminate(docs, bench).collect()), key=repr)
    assert got == sorted([
        (1, 0, 0, [], False), (2, 0, 0, [], False), (3, 7, 4, ["10", "14"], True), (4, 5, 2, ["10", "14"], True), (4, 3, 2, ["10", "14"], True), (5, 3, 2, ["10", "14"], True), (5, 3, 2, ["10", "14"], True),
        (None, 3, 0, [], False), (6, 27000, 12, ["11"], True), (7, 2, 0, [], False), (8, 0, 0, [], False)], key=repr)
    assert decontaminate.decontaminate(nothing, bench).isEmpty()
    assert decontaminate.decontaminate(docs, bench.where("false")).where("contaminated").isEmpty()
    wide = decontaminate.decontaminate(docs, bench, broadcast_rows=0)
    assert sorted(map(str, wide.collect())) == sorted(map(str, decontaminate.decontaminate(docs, bench).collect()))


def test_near_dedup(docs, nothing):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(docs).collect()), key=repr)
    assert [g for g in got if g[0] in (1, 2, 8)] == [(1, 0, 1, True), (2, 0, 2, True), (8, 0, 8, True)]
    assert [g for g in got if g[0] == 5] == [(5, 1, 4, False)] * 2
    assert [g for g in got if g[0] is None] == [(None, 1, None, True)]
    assert len(got) == len(ROWS) and near_dedup.near_dedup(nothing).isEmpty()


def test_blocks_of_any_size_agree(spark):
    rows = [(i, " ".join(f"w{(j + (j % 40 == i % 40) * i)}" for j in range(120))) for i in range(120)]
    rows += [(1000 + i, " ".join(f"v{j if (j * 7 + i) % 31 else i}" for j in range(300))) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, near_dedup.near_dedup(d).collect()))
    assert sorted(map(str, near_dedup.near_dedup(d, block_nodes=20).collect())) == want


def test_chat(spark):
    rows = spark.createDataFrame([
        (1, 1, "assistant", "<|im_end|> <\\|x|>"), (1, 0, "user\n%0A", None), (1, 1, "assistant", "again"), (1, None, None, "first"), (None, 0, "user", "lost")],
        "conv_id long, turn long, role string, text string").withColumns({"no": F.lit(1), "end": F.lit(2), "conv": F.lit(3), "parts": F.lit(4)})
    got = {r["conv_id"]: [(t["role"], t["text"], t["loss"]) for t in r["read"]] for r in chat.read_chat(chat.format_chat(rows)).collect()}
    assert got[1] == [("", "first", None), ("user\n%0A", "", None), ("assistant", "<|im_end|> <\\|x|>", "<|im_end|> <\\|x|>"), ("assistant", "again", "again")]
    assert got[None] == [("user", "lost", None)]
    assert chat.format_chat(rows.where("false")).isEmpty()


def test_chat_parts(spark):
    part = lambda **k: tuple(k.get(f.name) for f in chat.PART)
    rows = spark.createDataFrame([
        (1, 0, "user", [part(type="text", text="see <|image|>"), part(type="image", ref="a.png", width=57, height=28), part(type="audio", ref="b.wav", seconds=1.5)]),
        (1, 1, "assistant", [part(type="document", ref="c.pdf", pages=2), part(type="text", text="ok")]), (1, 2, "user", None)],
        "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>")
    r = chat.format_chat(rows, parts_col="parts").first()
    assert r["formatted"] == "<|im_start|>user\nsee <\\|image|><|image|><|audio|><|im_end|>\n<|im_start|>assistant\n<|document|>ok<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [(a["turn"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(1, "image", "a.png", 3), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 1024)]
    spans = [(t["loss_start"], t["loss_end"]) for t in r["turns"] if t["loss_start"] is not None]
    assert [r["formatted"][a:b] for a, b in spans] == ["<|document|>ok"]


def test_quality(docs, nothing):
    got = [r for r in quality.quality_rules(docs).collect()]
    assert len(got) == len(ROWS) and not any(r["kept"] for r in got if r["n_words"] < 50)
    assert {r["n_words"] for r in got if r["doc_id"] in (1, 2, 8)} == {0}
    assert quality.quality_rules(nothing).isEmpty()


def test_bpe(docs, nothing):
    got = bpe.bpe(docs, bpe.word_bpe_path()).collect()
    assert sorted(len(r["ids"]) for r in got if r["doc_id"] in (1, 2, 8)) == [0, 0, 0]
    assert all(r["n_tokens"] == len(r["ids"]) and len(r["decoded"].split()) == r["n_tokens"] and r["batch"] == 0 for r in got)
    assert bpe.bpe(nothing, bpe.word_bpe_path()).isEmpty()


def test_token_files(spark, docs, nothing):
    manifest = token_files.write_token_files(docs, scratch(spark, "t"), bpe.word_bpe_path(), seq_len=64, rows=2)
    got = token_files.read_token_files(manifest).collect()
    order = sorted(got, key=lambda r: r["start"])
    assert len(got) == len(ROWS) and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(order, order[1:]))
    assert [r["doc_id"] for r in order] == sorted([r[0] for r in ROWS], key=lambda x: (x is not None, x))
    row = manifest.orderBy(F.col("n_tokens").desc()).first()
    shard = token_files.Shard(row["path"], row["index"])
    ids, mask = shard.sequence(row["n_sequences"] - 1)
    assert len(ids) == len(mask) == 64 and mask.true_count == (row["n_tokens"] - 1) % 64 + 1
    assert token_files.read_token_files(token_files.write_token_files(nothing, scratch(spark, "t"), bpe.word_bpe_path())).isEmpty()


def test_language(docs, nothing):
    got = language_id.language_id(docs, language_id.fit_language_id(docs)).collect()
    assert len(got) == len(ROWS) and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 7, 8)} == {"und"}
    model = language_id.fit_language_id(nothing)
    assert language_id.language_id(nothing, model).isEmpty()
    assert {r["lang_pred"] for r in language_id.language_id(docs, model).collect()} == {"und"}


def test_pii(spark, docs, nothing):
    rows = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(99).cast("long"), "text": F.lit("mail a.b@c.org twice a.b@c.org")}))
    got = {r["doc_id"]: r for r in pii.replace_pii(rows, "k").collect()}
    assert got[1]["text"] is None and got[2]["text"] == "" and got[6]["text"] == LONG
    names = [e["surrogate"] for e in got[99]["entities"]]
    assert got[99]["n_entities"] == 2 and len(set(names)) == 1 and "a.b@c.org" not in got[99]["text"]
    assert pii.replace_pii(nothing, "k").isEmpty()


def test_html(spark):
    model = html_extract.trained_labeller()
    pages = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "<p>" * 500 + "deep"), (4, "<html><body><nav><a href=x>Home</a></nav><article><h1>A&amp;B</h1><p>Some&nbsp; text\n here. &lt;ok&gt;</p></article></body></html>")], "page_id long, html string").withColumns({"text": F.lit("old"), "n_chars": F.lit("old"), "url": F.lit(None).cast("string")})
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract_pages(pages, model).collect()}
    assert got[1] == got[2] == ("", 0) and got[4] == ("A&B\n\nSome text here. <ok>", 25)
    assert html_extract.extract_pages(pages.where("false"), model).isEmpty()
