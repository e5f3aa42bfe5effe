"""The stages by themselves: nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

EN = "the house and of this with that was for it on are as his they be at one have from or had by hot but some what there "
LONG = "\n".join(f"{EN} number {i}" for i in range(4000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None, "en"), (2, "", None), (3, EN * 4, "en"), (4, EN * 4, "en"), (4, EN * 4, "en"), (None, EN * 4, "en"), (5, LONG, "en"), (6, "12 !!", "en"), (7, EN * 3 + "other", None)]
    d = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.lit("mine") for c in ("kept", "score", "lang_pred", "n_words", "ids", "items", "n_lines", "row", "doc")})


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_empty_tables(docs, sf_dir, spark, name, stage):
    assert stage(spark, docs.where("false"), sf_dir).isEmpty()


def test_stages_on_odd_rows(spark, docs, sf_dir):
    out = {name: stage(spark, docs, sf_dir) for name, stage in P.STAGES}
    assert all(out[n].columns == P.COLUMNS for n, _ in P.STAGES[:-1])
    ids = {n: sorted([r["doc_id"] for r in d.select("doc_id").collect()], key=str) for n, d in out.items()}
    assert ids["language_id"] == sorted([3, 4, 4, None, 5, 7], key=str)
    assert ids["line_dedup"] == ids["bpe"] == ids["decontaminate"] == sorted([1, 2, 3, 4, 4, None, 5, 6, 7], key=str)
    assert ids["near_dedup"] == sorted([1, 2, 3, None, 5, 6], key=str)  # 7 has nearly the shingles of 3
    lines = {r["doc_id"]: r["text"] for r in out["line_dedup"].collect()}
    assert lines[3] == EN * 4 and lines[4] == "" and lines[None] == EN * 4 and lines[1] is None and lines[5] == LONG
    tokens = {r["doc_id"]: r for r in out["bpe"].collect()}
    assert tokens[1]["n_tokens"] == tokens[2]["n_tokens"] == 0 and len(tokens[5]["ids"]) == tokens[5]["n_tokens"] > 4000 * 25
