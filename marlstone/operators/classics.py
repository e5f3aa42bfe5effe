"""Term signatures, supersession chains and extractive answers."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators.shared import save

#: Hashes of a signature, bits for each term, least and most bytes.
HASHES, BITS_PER_TERM, MIN_BYTES, MAX_BYTES = 4, 9.6, 8, 128
#: Passages an answer draws on, words of a sentence, share of the best score that is kept.
PASSAGES, MIN_WORDS, KEEP = 10, 4, 0.35
#: Damping and rounds of the sentence graph.
DAMPING, ROUNDS = 0.85, 30


def signature_bytes(terms: Column) -> Column:
    """Bytes of the signature of so many distinct terms."""
    return F.greatest(F.lit(MIN_BYTES), F.least(F.lit(MAX_BYTES), F.ceil(F.floor(terms * F.lit(BITS_PER_TERM)) / 8))).cast("int")


def bit_places(term: Column, n_bytes: Column) -> Column:
    """The places that a term sets in a signature of ``n_bytes``."""
    one = lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(f"{i}:"), term).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.array(*[F.pmod(one(i), 8 * n_bytes.cast("long")) for i in range(HASHES)])


def signature(terms: Column, n_bytes: Column) -> Column:
    """The sorted places set by all terms."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(terms, lambda t: bit_places(t, n_bytes)))))


def match_count(places: Column, n_bytes: Column, asked: list[str]) -> Column:
    """How many of the asked terms may be there; never fewer than are."""
    hit = lambda t: F.forall(bit_places(F.lit(t), n_bytes), lambda p: F.array_contains(places, p))
    return sum((hit(t).cast("int") for t in asked), F.lit(0)).cast("long")


def resolve_supersession(docs: DataFrame) -> DataFrame:
    """``id, superseded_by`` with ``resolved``, the last of its chain, and ``unresolved``.

    A document without ``superseded_by`` is current and has neither.  A chain
    that leaves the corpus or runs in a circle is unresolved.  Pointers double
    in each round, so a chain of n takes log2(n) rounds, and one that still
    moves after that is a circle.  Pointers that have arrived take no part any
    more, so a document that many chains end in is no hot key.
    """
    known = save(docs.select("id", F.col("superseded_by").alias("next")), "chains")
    step = known.where("next IS NOT NULL").select(F.col("id").alias("at"), F.col("next").alias("to"))
    n = step.count()
    moving = known.where("next IS NOT NULL").select("id", F.col("next").alias("at"))
    arrived = None
    for _ in range(max(1, n.bit_length()) + 1):
        joined = save(moving.join(step, "at", "left"), "moving")
        there = joined.where("to IS NULL").select("id", "at")
        arrived = there if arrived is None else arrived.unionByName(there)
        moving = joined.where("to IS NOT NULL").select("id", F.col("to").alias("at"))
        if moving.isEmpty():
            break
        # two steps of ``step`` are one of the next
        step = save(step.join(step.select(F.col("at").alias("to"), F.col("to").alias("far")), "to", "left").select("at", F.coalesce("far", "to").alias("to")), "steps")
    ends = arrived.join(known.select(F.col("id").alias("at"), F.lit(True).alias("real")), "at", "left")
    ends = ends.select("id", F.when(F.col("real"), F.col("at")).alias("resolved"))
    out = known.join(ends, "id", "left")
    return out.select("id", F.col("next").alias("superseded_by"), "resolved", (F.col("next").isNotNull() & F.col("resolved").isNull()).alias("unresolved"))


_FENCE = re.compile(r"\s*(?:```|~~~)")
_BULLET = re.compile(r"^(?:[-*+]|\d+\.)\s+")


def sentences(text: str) -> Iterator[tuple[int, str]]:
    """(line, sentence) of the prose: no code, tables or headings, and no fragments.

    Lines of a paragraph are one run of text; a sentence is cited by the line on
    which it begins, counted from 1.
    """
    prose, fenced = [], False
    for line in text.split("\n"):
        edge = bool(_FENCE.match(line))
        fenced ^= edge
        bare = line.strip()
        prose.append("" if edge or fenced or bare[:1] in ("#", "|") else _BULLET.sub("", bare))
    at = 0
    while at < len(prose):
        end = next((i for i in range(at, len(prose)) if not prose[i]), len(prose))
        run = " ".join(prose[at:end])
        begins = np.cumsum([0, *(len(p) + 1 for p in prose[at:end])])
        for m in re.finditer(r"\S.*?(?:(?<=[.!?])(?=\s)|$)", run):
            if len(m[0].split()) >= MIN_WORDS:
                yield at + int(np.searchsorted(begins, m.start(), "right")), m[0].strip()
        at = end + 1


def centrality(terms: list[set[str]]) -> np.ndarray:
    """Standing of each sentence in the graph of shared terms, 1 for the first."""
    n = len(terms)
    if n < 2:
        return np.ones(n)
    names = {t: i for i, t in enumerate(sorted(set().union(*terms)))}
    has = np.zeros((n, len(names)))
    for i, ts in enumerate(terms):
        has[i, [names[t] for t in ts]] = len(ts) > 1
    size = np.log([max(2, len(ts)) for ts in terms])
    weight = has @ has.T / (size[:, None] + size[None, :])
    np.fill_diagonal(weight, 0)
    out = weight.sum(1)
    flow = weight / np.where(out > 0, out, 1)[:, None]
    score = np.full(n, 1 / n)
    for _ in range(ROUNDS):
        score = (1 - DAMPING) / n + DAMPING * flow.T @ score
    return score / (score.max() or 1)


def extract_one(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """Answer of one question from ``query, file, start, text, score`` of its passages."""
    tokens = lambda t: re.findall("[a-z0-9_]+", t.lower())
    rows = rows.sort_values(["score", "file", "start"], ascending=[False, True, True]).head(PASSAGES)
    found = [(r.file, int(r.start) + line - 1, s, r.score) for r in rows.itertuples() for line, s in sentences(r.text)]
    empty = pd.DataFrame({"file": [], "line": [], "text": [], "score": []}).astype({"file": str, "line": "int64", "text": str, "score": float})
    if not found:
        return empty
    asked = set(tokens(rows["query"].iloc[0]))
    asked = asked - set(T.STOP_WORDS) or asked
    sets = [set(tokens(s)) for _, _, s, _ in found]
    top = rows["score"].max() or 1.0
    scored = []
    for (file, line, text, passage), ts, c in zip(found, sets, centrality(sets)):
        overlap = len(asked & ts) / len(asked) if asked else 0.0
        scored.append((round(passage / top * (overlap + 0.05) * (0.5 + 0.5 * float(c)), 9), file, line, text))
    scored.sort(key=lambda s: (-s[0], *s[1:]))
    chosen: dict[tuple[str, ...], tuple] = {}
    for s in scored:
        if s[0] >= KEEP * scored[0][0] and len(chosen) < most:
            chosen.setdefault(tuple(tokens(s[3])), s)
    out = pd.DataFrame(sorted(chosen.values(), key=lambda s: (s[1], s[2])), columns=["score", "file", "line", "text"])
    return out[["file", "line", "text", "score"]] if len(out) and math.isfinite(out["score"].iloc[0]) else empty


def extractive_answer(passages: DataFrame, most: int = 3) -> DataFrame:
    """``query_id, file, line, text, score``: the best sentences of each question's passages.

    ``passages`` has ``query_id, query, file, start, text, score``.  A group is
    one question, of which only the ten best passages are read: the report's
    own depth.
    """
    def run(key, pdf):
        out = extract_one(pdf, most)
        out.insert(0, "query_id", key[0])
        return out

    kind = passages.schema["query_id"].dataType.simpleString()
    return passages.groupBy("query_id").applyInPandas(run, f"query_id {kind}, file string, line long, text string, score double")
