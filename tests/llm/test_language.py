"""The random field against sums over all labellings, and what training reads."""

from itertools import product

import numpy as np
import pytest

from marlstone.llm import language_id


def plain_features(word, lexicon):
    """Feature numbers of one word, from their definition."""
    mul, mask, size = 0x9E3779B97F4A7C15, (1 << 64) - 1, 1 << 15
    cut = lambda x: (x * mul & mask) >> 49
    c = [32, *map(ord, word), 32]
    two = [c[i] * (1 << 21) + c[i + 1] & mask for i in range(len(c) - 1)]
    three = [two[i] * (1 << 21) + c[i + 2] & mask for i in range(len(c) - 2)]
    out = [cut(x) for x in two] + [size + cut(x) for x in three]
    if len(word) >= 3:
        four = [three[i] * 1000003 + c[i + 3] & mask for i in range(len(c) - 3)]
        out += [2 * size + cut(four[0]), 3 * size + cut(four[-1])]
    return sorted([*out, 4 * size + lexicon.get(word, 0)])


def test_features_of_each_word():
    words, lexicon = ["a", "the", "été", "of", "straße", "ist"], {"the": 3, "ist": 9}
    feats, at = language_id.word_features(words, lexicon)
    got = [sorted(x.tolist()) for x in np.split(feats, at[1:])]
    assert got == [plain_features(w, lexicon) for w in words]


def test_predictions_are_those_of_all_labellings():
    rng = np.random.default_rng(2)
    model = language_id.Crf(["x", "y"], {"the": 1}, rng.normal(size=(5 << 15, 2)).astype(np.float32), rng.normal(size=(2, 2)))
    text = "The été was straße ist of"
    words = language_id.words_of(text)
    score = [[float(sum(model.weights[f, k] for f in plain_features(w, model.lexicon))) for k in range(2)] for w in words]
    total, share = 0.0, np.zeros(2)
    for labels in product(range(2), repeat=len(words)):
        p = np.exp(sum(score[i][k] for i, k in enumerate(labels)) + sum(model.trans[a, b] for a, b in zip(labels, labels[1:])) + np.log(np.exp(model.trans)[:, labels[0]].mean()))
        total += p
        share += p * np.bincount(labels, minlength=2)
    share /= total * len(words)
    (lang, got), = language_id.Labeller(model).predict([text])
    assert lang == "xy"[share.argmax()] and abs(got - share.max()) < 1e-4


def test_every_word_of_a_training_text_counts():
    text = " ".join(["so"] * 100 + ["ending"] * 3)
    model = language_id.train([(text, "a"), ("other words " * 60, "b")], rounds=2)
    assert "ending" in model.lexicon


def test_a_long_text_is_one_chain(spark):
    model = language_id.train([("the house and of this with that " * 30, "en"), ("das haus und nicht mit dieser von " * 30, "de")], rounds=10)
    long = "the house and of " * 60_000 + "das haus und " * 10_000
    rows = spark.createDataFrame([(1, long), (2, "das haus")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(rows, model).collect()}
    assert got[1][0] == "en" and 0.8 < got[1][1] < 0.95 and got[2][0] == "de"


def test_a_column_of_many_values_is_refused(spark):
    rows = spark.createDataFrame([(i, "a b", f"l{i}") for i in range(12)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.fit_language_id(rows, max_languages=10)
