"""Encoding against the tokenizers library: every code point, odd texts, other files."""

import json
import random

import numpy as np
import pytest

from marlstone.llm import bpe, token_files


@pytest.fixture(scope="module")
def spec():
    with open(bpe.word_bpe_path(), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(spec):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


@pytest.fixture(scope="module")
def codec(spec):
    return bpe.SpeculativeBpe(spec)


@pytest.fixture(scope="module")
def encoder(spec):
    return token_files.Encoder(spec, bpe.tables())


def by_encoder(encoder, texts):
    out = [[]]
    for ids, last in encoder.encode(texts):
        out[-1] += ids.tolist()
        if last:
            out.append([])
    return out[:-1]


def test_every_code_point(codec, encoder, library):
    points = [chr(c) for c in [*range(bpe.LIMIT), *range(bpe.LIMIT, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    for make in (lambda c: f"a{c}b", lambda c: f"!{c}'s{c}"):
        for at in range(0, len(points), 100_000):
            texts = [make(c) for c in points[at : at + 100_000]]
            want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
            ids, ends = codec.known.flat(texts)
            got = [x.tolist() for x in np.split(ids, ends[:-1])]
            assert got == want
            assert by_encoder(encoder, texts) == want


def test_mixed_texts(codec, encoder, library):
    rng = random.Random(5)
    some = ["a", "B", "z", "É", "é", "é", "́", "Σ", "İ", "ﬁ", "½", "中", "7", "42", "!", "..", "'", "'s", "'LL", "'ve", "''", "'t'", " ", "\x1c", "\x85", "\x00", "ᅡ", "ᄀ", "<|endoftext|>", "<|", "😀", "\U000323b0", "﻿", " ", "\n", "\t"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 25))) for _ in range(20_000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [codec.encode(t) for t in texts[:500]] == want[:500]
    assert by_encoder(encoder, texts) == want


def test_vocabulary_mixes_fail_verification_and_are_merged(spec, codec, library):
    rng = random.Random(3)
    vocab = [n.removesuffix("</w>") for n in codec.names if n.isascii() and n.isalpha()]
    words = sorted({"".join(rng.choice(vocab) for _ in range(rng.randint(1, 4))) for _ in range(1500)})
    _, _, wrong = codec.speculate([w.encode() for w in words])
    assert 0 < wrong.sum() < len(words)
    want = [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    small = bpe.SpeculativeBpe(spec, bpe.tables(), keep=50)
    assert [small.encode(w) for w in words] == [codec.encode(w) for w in words] == want


def test_long_words_and_long_texts(codec, encoder, library):
    rng = random.Random(9)
    long = ["x" * 3000, "".join(rng.choice("abcdeéö") for _ in range(20_000)), "!?" * 900, "ab" * 32, "ab" * 33, "1" * 500]
    text = " ".join(f"{w} word{i} and" for i, w in enumerate(long * 3))
    whole = text + " " + " ".join(rng.choice(["the", "of", "que", "été,"]) + str(rng.randint(0, 99)) for _ in range(400_000))
    for t in [*long, text, whole]:
        want = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == want
        assert by_encoder(encoder, ["", t, ""]) == [[], want, []]
    parts = [p for g in codec.cutter.groups(["a b", whole, "c"], size=1000) for _, p, _ in g]
    assert "".join(parts) == "a b" + whole + "c" and max(map(len, parts)) < 21_000


def test_texts_in_parts_are_digested_as_one(codec, library):
    import hashlib

    text = "One two, three's été " * 100_000
    got = list(bpe.encoded(codec, ["", text, "x"], True, True, True))
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.concatenate(got[1].ids).tolist() == ids and got[1].n == len(ids) and (got[0].n, got[2].n) == (0, 1)
    assert b"".join(got[1].names).decode() == library.decode(ids, skip_special_tokens=False)
    assert got[1].digests[0].hexdigest() == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got[1].digests[1].hexdigest() == hashlib.sha256(b"".join(got[1].names)).hexdigest()


@pytest.mark.parametrize("change", [
    lambda d: d.update(normalizer={"type": "Lowercase"}), lambda d: d.update(normalizer=None), lambda d: d["model"].update(byte_fallback=True), lambda d: d["model"].update(dropout=0.5),
    lambda d: d["added_tokens"][0].update(lstrip=True), lambda d: d["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated"), lambda d: d["model"].update(end_of_word_suffix=None)])
def test_files_of_another_form_are_refused_or_left_to_the_library(spark, tmp_path, spec, change):
    data = json.loads(spec)
    change(data)
    path = tmp_path / "t.json"
    path.write_text(json.dumps(data))
    with pytest.raises(ValueError):
        bpe.bpe(spark.createDataFrame([("x",)], "text string"), str(path))
    if data["model"]["end_of_word_suffix"] and not data["model"]["dropout"]:
        from tokenizers import Tokenizer

        other = token_files.Encoder(path.read_text(), bpe.tables())
        assert other.known is None
        texts = ["Ab É x's", " <|endoftext|> 1"]
        assert by_encoder(other, texts) == [e.ids for e in Tokenizer.from_file(str(path)).encode_batch(texts, add_special_tokens=False)]


def test_sequences_and_masks_are_views_of_the_file(spark):
    from marlstone.llm.common import scratch

    rows = spark.createDataFrame([(i, "some words " * i) for i in range(40)], "doc_id long, text string")
    manifest = token_files.write_token_files(rows, scratch(spark, "t"), bpe.word_bpe_path(), seq_len=16, rows=3).collect()
    ids = []
    for row in sorted(manifest, key=lambda r: r["shard"]):
        shard = token_files.Shard(row["path"], row["index"])
        seqs = [shard.sequence(i) for i in reversed(range(row["n_sequences"]))][::-1]
        for part, mask in seqs:
            assert not part.flags.owndata and len(mask) == len(part)
            ids += part[mask.to_numpy(zero_copy_only=False)].tolist()
        batch = shard.batch(0)
        places = {c: batch.column(c).flatten().buffers()[1].address for c in (0, 1)}
        assert shard.sequence(1)[0].ctypes.data == places[0] + 32 and shard.sequence(1)[1].buffers()[1].address == places[1]
    codec = bpe.SpeculativeBpe(open(bpe.word_bpe_path(), encoding="utf-8").read())
    assert ids == [t for i in range(40) for t in [*codec.encode("some words " * i), 1]]
