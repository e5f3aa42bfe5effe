"""The pipeline against a brute-force version of what SQL can't express."""

import corpus_pipeline
from marlstone.llm import bpe, language_id
from tests.llm.test_contracts import brute_components


def test_pipeline(spark, sf_dir, duck):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    labeller = language_id.Labeller(language_id.fit_language_id(docs))
    found = labeller.predict([t for _, t in rows])
    kept = [(d, t or "") for (d, t), (lang, score) in zip(rows, found) if lang != "und" and score >= corpus_pipeline.MIN_SCORE]

    space, seen, texts = " \t\n\x0b\x0c\r", {}, {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, t in kept:
        out = []
        for line in t.split("\n"):
            key = line.strip(space).translate(lower)
            if len(key) < 10 or seen.setdefault(key, d) == d:
                out.append(line)
        texts[d] = "\n".join(out)

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    parts = brute_components({d: shingles(t) for d, t in texts.items()})
    texts = {d: t for d, t in texts.items() if parts[d] == d}

    import re

    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(lower))
    windows = set()
    for (t,) in duck.sql("SELECT text FROM benchmark").fetchall():
        w = cut(t)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    leaks = lambda t: (lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)))(cut(t))
    texts = {d: t for d, t in texts.items() if not leaks(t)}

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.word_bpe_path())
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "bpe"]
