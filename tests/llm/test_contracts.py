"""Registered queries on the small tables against SQL or brute force."""

import hashlib
import zlib

import numpy as np
import pytest

from marlstone.llm import bpe, html_extract, language_id, near_dedup, pii, queries, token_files


@pytest.fixture(scope="module")
def documents(duck):
    return duck.sql("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.word_bpe_path())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(name, agree):
    agree(queries.QUERIES[name], queries.ORACLES[name])


def test_token_files(spark, sf_dir, documents, library):
    want, start = {}, 0
    for doc, text, _ in documents:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want[doc] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.QUERIES["op1_token_files"](spark, sf_dir).collect()}
    assert got == want


def test_bpe(spark, sf_dir, documents, library):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for doc, text, _ in documents:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc] = (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.QUERIES["op2_bpe"](spark, sf_dir).collect()}
    assert got == want


def words4(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute_components(sets, percent=80):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_near_dedup(spark, sf_dir, documents):
    sets = {d: words4(t) for d, t, _ in documents}
    want = brute_components(sets)
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_near_dedup"](spark, sf_dir).collect()}
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == {d: (len(sets[d]), c, c == d) for d, c in want.items()}


def test_html(spark, sf_dir, duck):
    import html
    import re

    want = {}
    for page, src in duck.sql("SELECT page_id, html FROM pages").fetchall():
        body = re.search("<article>(.*?)(?:</article>|$)", src, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", " " if "<br>" in p else "", p)).split()) for p in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        want[page] = "\n\n".join(p for p in parts if p)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.QUERIES["op4_html"](spark, sf_dir).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_language_accuracy_on_held_out_documents(spark, sf_dir, documents):
    rows = queries.QUERIES["op10_language_id"](spark, sf_dir).collect()
    lang = {d: x for d, _, x in documents}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(documents) and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality(spark, sf_dir, documents, duck):
    import re

    good = dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_quality"](spark, sf_dir).collect()}
    for doc, text, _ in documents:
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else None
        r = got[doc]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum((text or "").count(c) for c in "#*$%&|<>")
        if twice is not None:
            repeat = len({i + j for i, g in enumerate(grams) if g in twice for j in range(3)})
            assert r["n_repeat_words"] == repeat
            assert r["base_failed"] == (len(w) < 50 or 100 * repeat > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    clean = [d for d, q in good.items() if q == 1 and not got[d]["base_failed"]]
    assert sum(got[d]["kept"] for d in clean) >= 0.99 * len(clean)
    junk = [d for d, q in good.items() if q == 0 and not got[d]["base_failed"]]
    assert not junk or sum(not got[d]["kept"] for d in junk) >= 0.5 * len(junk)


def test_labeller_on_pages_it_has_not_seen():
    pages, labels = html_extract.training_pages(60, seed=99)
    found = html_extract.trained_labeller().predict(pages)
    right = np.concatenate([(p >= 0.5) == (y >= 0.5) for p, y in zip(found, labels)])
    assert right.mean() > 0.97


def test_forward_backward_over_blocks_is_that_of_one_chain():
    rng = np.random.default_rng(0)
    model = language_id.Crf(["a", "b", "c"], {}, np.zeros((5 << 15, 3), np.float32), rng.normal(size=(3, 3)))
    lengths = np.array([1, 64, 65, 200])
    emissions = rng.normal(size=(lengths.sum(), 3))
    got, at = model.shares(emissions, lengths), 0
    for k, n in enumerate(lengths):
        e, step, alphas, alpha = np.exp(emissions[at : at + n]), np.exp(model.trans), [], np.ones(3) / 3
        at += n
        for x in e:
            alpha = (alpha @ step) * x
            alpha /= alpha.sum()
            alphas.append(alpha)
        beta, total = np.ones(3), np.zeros(3)
        for x, a in zip(e[::-1], alphas[::-1]):
            total += a * beta / (a * beta).sum()
            beta = step @ (x * beta)
        assert np.allclose(total, got[k])


def test_code_switching_is_labelled_by_parts():
    rows = [(" ".join(["the house and of this with that"] * 20), "en"), (" ".join(["das haus und nicht mit dieser von"] * 20), "de")]
    model = language_id.train(rows * 5)
    words = ["the", "house", "and", "with", "das", "haus", "und", "nicht"]
    share = model.shares(model.emissions(words), np.array([8]))[0] / 8
    assert share.min() > 0.3
    assert language_id.Labeller(model).predict(["the house", None, "12 !", ""]) [1:] == [("und", 0.0)] * 3


def test_blocks_and_signatures_lose_no_link():
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for _ in range(60):
        w = list(base)
        for i in rng.choice(150, rng.integers(1, 7), replace=False):
            w[i] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(w))
    sets = [near_dedup.shingle_set(t, 4) for t in texts]
    sketch = near_dedup.Sketch(24, 3)
    sigs = np.stack([np.frombuffer(sketch.of(s)[0], np.uint8) for s in sets])
    needed = near_dedup.needed_matches(72, 12, 0.8, 1e-6)
    links = near_dedup.exact_forest(sets, sigs, np.zeros(len(sets), int), None, needed, 80)
    got = near_dedup.Forest(len(sets))
    for a, b in links:
        got.join(a, np.array([b]))
    want = brute_components({i: set(s.tolist()) for i, s in enumerate(sets)})
    assert {tuple(sorted(np.flatnonzero(got.root == r).tolist())) for r in set(got.root.tolist())} == {tuple(i for i, c in want.items() if c == r) for r in set(want.values())}
