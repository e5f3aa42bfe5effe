"""Signatures, supersession and extractive answers against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import classics as K


def test_signatures_never_miss(spark):
    rows = [(i, [f"t{j}" for j in range(i * 7)]) for i in range(40)]
    d = spark.createDataFrame(rows, "id int, terms array<string>").withColumn("n", K.signature_bytes(F.size("terms")))
    d = d.withColumn("p", K.signature("terms", F.col("n")))
    asked = ["t0", "t5", "t100", "zz"]
    for r in d.withColumn("hits", K.match_count(F.col("p"), F.col("n"), asked)).collect():
        assert r["n"] == max(8, min(128, math.ceil(int(len(r["terms"]) * 9.6) / 8))) and all(0 <= x < 8 * r["n"] for x in r["p"])
        assert r["hits"] >= sum(t in r["terms"] for t in asked)
    assert d.where(K.match_count(F.col("p"), F.col("n"), ["zz"]) > 0).count() < 12


def plain_chain(links):
    out = {}
    for doc, target in links.items():
        seen, at = {doc}, target
        while at in links and at not in seen and links[at]:
            seen.add(at)
            at = links[at]
        ok = target and at in links and at not in seen
        out[doc] = (at if ok else None, bool(target) and not ok)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_supersession(spark, seed):
    rng = random.Random(seed)
    links = {i: rng.choice([None, rng.randint(0, 45)]) for i in range(40)} | {100 + i: 101 + i for i in range(40)} | {140: None, 200: 200, 201: 202, 202: 201, 203: 201}
    got = {r["id"]: (r["resolved"], r["unresolved"]) for r in K.resolve_supersession(spark.createDataFrame(list(links.items()), "id long, superseded_by long")).collect()}
    assert got == plain_chain(links)


def test_supersession_of_nothing(spark):
    assert K.resolve_supersession(spark.createDataFrame([], "id long, superseded_by long")).isEmpty()


def test_sentences():
    text = "# Head line of words here\n- First point is about things. Second one\nruns over lines. Too short.\n\n```\ncode is not a sentence\n```\n| a | b | c | d |\n3. Last words come at the end"
    assert list(K.sentences(text)) == [(2, "First point is about things."), (2, "Second one runs over lines."), (9, "Last words come at the end")]
    assert list(K.sentences("")) == [] and len(list(K.sentences("word " * 20_000))) == 1


def test_centrality_is_a_walk_over_shared_terms():
    sets = [{"a", "b", "c"}, {"b", "c"}, {"c", "d"}, {"x"}, {"y", "z"}]
    weight = np.array([[0.0 if i == j or min(len(a), len(b)) < 2 else len(a & b) / (math.log(len(a)) + math.log(len(b))) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    score = [0.2] * 5
    for _ in range(30):
        score = [0.03 + 0.85 * sum(weight[j, i] / weight[j].sum() * score[j] for j in range(5) if weight[j, i]) for i in range(5)]
    assert np.allclose(K.centrality(sets), np.array(score) / max(score))
    assert K.centrality([]).size == 0 and K.centrality([{"a"}]).tolist() == [1.0]


def test_extractive_answer(spark):
    rows = [(1, "blue whale song", "f.md", 10, "The blue whale song is long. Nothing to see here at all.\nThe blue whale song is long.", 2.0), (1, "blue whale song", "g.md", 1, "A whale of the blue sea sings.", 1.0), (2, "the of", "h.md", 1, "tiny", 1.0)]
    got = K.extractive_answer(spark.createDataFrame(rows, "query_id long, query string, file string, start int, text string, score double")).collect()
    assert [(r["query_id"], r["file"], r["line"], r["text"]) for r in got] == [(1, "f.md", 10, "The blue whale song is long.")]
