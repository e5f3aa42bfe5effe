"""Language identification by a linear-chain conditional random field.

Words are labelled with languages: a word's score for a language is the sum of
learned weights of its affixes, its character bigrams and trigrams and its
place in a lexicon; learned transitions tie neighbouring words together.  The
forward-backward algorithm gives each word's label probabilities, also where a
text switches languages, and a document's language is the one with the largest
expected share of words.

Texts are taken whole.  Long ones are cut into blocks whose transfer matrices
are multiplied, so that numpy steps through the blocks of many documents side
by side; the result is that of one chain over the whole text.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.batches import slices
from marlstone.llm.common import table

_WORD = re.compile(r"[^\W\d_]+")
_BITS = 15
_BLOCK = 64


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall((text or "").lower())


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words, one after another, and where each word begins.

    Bigrams and trigrams reach over the word's ends, where a space stands, and
    so are affixes too; prefixes and suffixes of three letters and the lexicon
    entry (0 for none) have ranges of their own.
    """
    joined = " " + " ".join(words) + " "
    c = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    start = np.r_[0, np.cumsum(lengths + 1)[:-1]]  # the space before each word
    cut = lambda x: (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)
    two = c[:-1] * np.uint64(1 << 21) + c[1:]
    three = two[:-1] * np.uint64(1 << 21) + c[2:]
    four = three[:-1] * np.uint64(1000003) + c[3:] if len(c) > 3 else np.zeros(0, np.uint64)
    size = 1 << _BITS
    owner = np.repeat(np.arange(len(words)), lengths + 1)
    place = np.arange(len(owner)) - np.repeat(start, lengths + 1)
    in3 = place < np.repeat(lengths, lengths + 1)
    has4 = lengths >= 3
    feats = [cut(two[: len(owner)]), size + cut(three[np.flatnonzero(in3)]), 2 * size + cut(four[start[has4]]), 3 * size + cut(four[(start + lengths - 2)[has4]])]
    owners = [owner, owner[in3], np.flatnonzero(has4), np.flatnonzero(has4)]
    feats.append(4 * size + np.array([lexicon.get(w, 0) for w in words], dtype=np.int64))
    owners.append(np.arange(len(words)))
    who = np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return np.concatenate(feats)[order], np.searchsorted(who[order], np.arange(len(words)))


class Crf:
    """Weights of a trained model."""

    def __init__(self, labels: list[str], lexicon: dict[str, int], weights: np.ndarray, trans: np.ndarray):
        self.labels, self.lexicon, self.weights, self.trans = labels, lexicon, weights, trans

    def emissions(self, words: list[str]) -> np.ndarray:
        feats, at = word_features(words, self.lexicon)
        return np.add.reduceat(self.weights[feats], at)

    def shares(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Expected number of words of each label for sequences laid end to end."""
        n_labels, step = len(self.labels), np.exp(self.trans)
        e = np.exp(emissions - emissions.max(1, keepdims=True)).astype(np.float64) + 1e-30
        blocks = -(-lengths // _BLOCK)
        doc = np.repeat(np.arange(len(lengths)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(blocks)[:-1]], blocks)
        first = np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], blocks) + nth * _BLOCK
        size = np.minimum(_BLOCK, np.repeat(lengths, blocks) - nth * _BLOCK)
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        live = [int((size > t).sum()) for t in range(_BLOCK)]
        move = np.tile(np.eye(n_labels), (len(order), 1, 1))
        for t, k in enumerate(live):
            if k:
                m = move[:k] @ step
                m *= e[first[:k] + t][:, None, :]
                move[:k] = m / m.sum((1, 2), keepdims=True)
        enter, leave = np.full((len(order), n_labels), 1 / n_labels), np.full((len(order), n_labels), 1 / n_labels)
        where = np.empty(len(order), dtype=np.int64)
        where[order] = np.arange(len(order))  # block in text order -> its row
        begin = np.r_[0, np.cumsum(blocks)[:-1]]
        for k in range(1, int(blocks.max(initial=0))):
            some = blocks > k
            here, before = where[begin[some] + k], where[begin[some] + k - 1]
            v = np.einsum("bi,bij->bj", enter[before], move[before])
            enter[here] = v / v.sum(1, keepdims=True)
            some_b = blocks - 1 - k >= 0
            here, after = where[begin[some_b] + blocks[some_b] - 1 - k], where[begin[some_b] + blocks[some_b] - k]
            v = np.einsum("bij,bj->bi", move[after], leave[after])
            leave[here] = v / v.sum(1, keepdims=True)
        alphas, alpha = [], enter.copy()
        for t, k in enumerate(live):
            if k:
                a = (alpha[:k] @ step) * e[first[:k] + t]
                alpha[:k] = a / a.sum(1, keepdims=True)
            alphas.append(alpha[:k].copy())
        total, beta = np.zeros((len(order), n_labels)), leave.copy()
        for t in range(_BLOCK - 1, -1, -1):
            k = live[t]
            if k:
                g = alphas[t] * beta[:k]
                total[:k] += g / g.sum(1, keepdims=True)
                b = (e[first[:k] + t] * beta[:k]) @ step.T
                beta[:k] = b / b.sum(1, keepdims=True)
        out = np.zeros((len(lengths), n_labels))
        np.add.at(out, doc, total[where])
        return out


def train(rows: list[tuple[str, str]], rounds: int = 30, rate: float = 0.25, segment: int = 24, switch: float = 0.15, seed: int = 7) -> Crf:
    """Fit weights and transitions on (text, language) pairs.

    Words get the language of their text.  A training sequence is two segments
    of ``segment`` words; a share ``switch`` joins segments of different texts,
    from which transitions learn what changing the language costs.
    """
    labels = sorted({lang for _, lang in rows})
    parts, langs = [], []
    for text, lang in rows:
        words = [w for w in words_of(text) if any(map(str.isalpha, w))]
        if not words:
            continue
        words = (words * (2 * segment // len(words) + 1)) if len(words) < 2 * segment else words
        for at in [*range(0, len(words) - 2 * segment, 2 * segment), len(words) - 2 * segment]:
            parts.append(words[at : at + 2 * segment])
            langs.append(labels.index(lang))
    if not parts:
        return Crf(labels or ["und"], {}, np.zeros((5 << _BITS, max(1, len(labels))), np.float32), np.zeros((max(1, len(labels)),) * 2))
    counts = Counter(w for p in parts for w in p)
    common = sorted(sorted(w for w, n in counts.items() if n >= 3), key=lambda w: -counts[w])[: (1 << _BITS) - 1]
    lexicon = {w: i + 1 for i, w in enumerate(common)}
    vocab = {w: i for i, w in enumerate(sorted(counts))}
    x = np.array([[vocab[w] for w in p] for p in parts])
    y = np.repeat(np.array(langs)[:, None], 2 * segment, 1)
    rng = np.random.default_rng(seed)
    mixed, other = rng.random(len(x)) < switch, rng.permutation(len(x))
    x[mixed, segment:], y[mixed, segment:] = x[other[mixed], segment:], y[other[mixed], segment:]
    feats, at = word_features(list(vocab), lexicon)
    spread = np.diff(np.r_[at, len(feats)])
    n_labels, n_feats = len(labels), 5 << _BITS
    weights, trans = np.zeros((n_feats, n_labels)), np.zeros((n_labels, n_labels))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(trans), np.zeros_like(trans)]
    length, one = x.shape[1], np.eye(n_labels)
    seen_t = sum(one[y[:, t - 1]].T @ one[y[:, t]] for t in range(1, length))
    for r in range(1, rounds + 1):
        emit = np.add.reduceat(weights[feats], at)
        e, step = np.exp(emit - emit.max(1, keepdims=True)) + 1e-30, np.exp(trans)
        alpha, alphas = np.full((len(x), n_labels), 1 / n_labels), []
        for t in range(length):
            alpha = (alpha @ step) * e[x[:, t]]
            alpha /= alpha.sum(1, keepdims=True)
            alphas.append(alpha)
        beta, grad_e, grad_t = np.ones((len(x), n_labels)), np.zeros((len(vocab), n_labels)), seen_t.copy()
        for t in range(length - 1, -1, -1):
            g = alphas[t] * beta
            g = one[y[:, t]] - g / g.sum(1, keepdims=True)
            for k in range(n_labels):
                grad_e[:, k] += np.bincount(x[:, t], g[:, k], len(vocab))
            b = e[x[:, t]] * beta
            if t:
                pair = alphas[t - 1][:, :, None] * step * b[:, None, :]
                grad_t -= (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            beta = b @ step.T
            beta /= beta.sum(1, keepdims=True)
        full = np.repeat(grad_e, spread, axis=0)
        grad_w = np.stack([np.bincount(feats, full[:, k], n_feats) for k in range(n_labels)], 1) / len(x) - 1e-4 * weights
        grad_w[4 << _BITS] = 0
        for p, g, m, v in ((weights, grad_w, *state[:2]), (trans, grad_t / len(x) - 1e-4 * trans, *state[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate / np.sqrt(r) * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Crf(labels, lexicon, weights.astype(np.float32), trans)


def fit_language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 200, max_languages: int = 1000, folds: int = 4, held_out: int = 2) -> Crf:
    """Train on a bounded sample: ``train_rows`` whole documents of each language.

    Only documents whose ``crc32(id as text) mod folds`` isn't ``held_out`` and
    that have text and a language.  A column of more than ``max_languages``
    values isn't one of languages: that raises a ``ValueError``.
    """
    if docs.select(lang_col).distinct().limit(max_languages + 2).count() > max_languages + 1:
        raise ValueError(f"{lang_col} has more than {max_languages} values")
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.crc32(F.coalesce("i", F.lit("")).cast("binary")) % folds != held_out))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("i"), "i", "text")
    rows = rows.withColumn("no", F.row_number().over(order)).where(F.col("no") <= train_rows)
    return train([(r["text"], r["lang"]) for r in rows.select("text", "lang", "i").orderBy("lang", F.xxhash64("i"), "i", "text").collect()])


class Labeller:
    """Predicts documents with a bounded table of word scores."""

    def __init__(self, model: Crf, keep: int = 150_000):
        self.model, self.keep = model, keep
        self.places: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.labels)), np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        docs = [words_of(t) for t in texts]
        wanted = set().union(*docs) if docs else set()
        if len(self.places) + len(wanted) > self.keep:
            self.places, self.scores = {}, self.scores[:0]
        new = sorted(wanted - self.places.keys())
        if new:
            fresh = self.model.emissions(new)
            at = len(self.scores)
            self.scores = np.concatenate([self.scores, fresh.astype(np.float32)])
            self.places.update((w, at + i if any(map(str.isalpha, w)) else -1) for i, w in enumerate(new))
        get = self.places.__getitem__
        ids = [[i for i in map(get, d) if i >= 0] for d in docs]
        lengths = np.array([len(i) for i in ids], dtype=np.int64)
        out = [("und", 0.0)] * len(texts)
        some = np.flatnonzero(lengths)
        if len(some):
            flat = np.concatenate([np.array(ids[i]) for i in some])
            shares = self.model.shares(self.scores[flat], lengths[some])
            best = shares.argmax(1)
            for row, i in enumerate(some.tolist()):
                out[i] = (self.model.labels[best[row]], float(min(1.0, shares[row, best[row]] / lengths[i])))
        return out


def language_id(docs: DataFrame, model: Crf, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the expected share of its words).

    Only the text is read.  Null text and text without a letter get ``und`` and
    0.  Texts of any length are one chain each, read whole.  Input columns named
    like the new ones are replaced; repeated rows are treated alike; an empty table gives an empty one.  A model without labelled
    rows says ``und`` of everything.
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep_text or c != text_col)]
    chosen = docs.select(F.col(text_col).alias("__l_text"), *rest)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for c in rest for f in docs.schema if f.name == c), "lang_pred string", "score double"])

    def run(batches):
        labeller = Labeller(sent.value)
        for whole in batches:
            for part in slices(whole, 0):
                found = labeller.predict(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*rest, "lang_pred", "score"])

    return chosen.mapInArrow(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id(docs.select("doc_id", "text"), fit_language_id(docs), keep_text=False)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
