"""Quality rules: Heuristic counts, then divergence from language references.

A document's character-class histogram and its histogram over common function
words are compared with those of each language by the Jensen-Shannon distance
(base 2, so 0 to 1).  The references are sums over all documents of a language
that are long enough; there are as many as there are languages, and each is a
vector of fixed length.  All of it is column arithmetic inside one scan: the
narrow counts are written once, and references and verdicts read only those.
The words of a document are sorted and their runs counted, so its histogram
lists only the common words that it holds.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, table

#: Frequent function words of four languages.
COMMON_WORDS = (
    "the of and to in a is that for it as was with be by on not this are or from at which "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es "
    "de la le et les des en un du une que est pour qui dans par au sur pas avec "
    "el los y las del se con una su al lo como más o pero sus para"
).split()
_COMMON = tuple(dict.fromkeys(COMMON_WORDS))

#: Character classes, in the order of the histogram.
CLASSES = ("lower", "upper", "digit", "space", "symbol", "punct", "other")

_SPACE_RE = r"[ \t\n\x0B\f\r]+"


#: Punctuation that is trimmed off a word before it is looked up.
_ENDS = ".,;:!?"


def _modulus() -> int:
    """The least modulus that keeps the checksums of all common words apart."""
    sums, m = [zlib.crc32(w.encode()) for w in _COMMON], len(_COMMON)
    while len({x % m for x in sums}) < len(sums):
        m += 1
    return m


def _number(word: Column) -> Column:
    """Place of a word that is known to be a common one."""
    m = _modulus()
    places = dict((zlib.crc32(w.encode()) % m, i) for i, w in enumerate(_COMMON))
    return F.get(F.array(*[F.lit(places.get(i, -1)) for i in range(m)]), (F.crc32(word.cast("binary")) % m).cast("int"))


def _kept(text: str, drop: str) -> Column:
    """How many code points of ``text`` are left without the pattern ``drop``."""
    return F.length(F.regexp_replace(F.col(text), drop, ""))


def _repeated_words() -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are told apart by 64-bit hashes inside one document.  The windows
    are sorted with their places; equal neighbours are repeats, and their
    places spread over three words each.
    """
    places = F.sequence(F.lit(0), F.size("__q_win") - 1)
    ordered = F.array_sort(F.arrays_zip(F.col("__q_win").alias("h"), places.alias("i")))
    same = lambda s, a, b: F.get(s, a).getField("h") == F.get(s, b).getField("h")
    hit = lambda x, k: F.coalesce(same("__q_ord", k, k + 1), F.lit(False)) | ((k > 0) & F.coalesce(same("__q_ord", k, k - 1), F.lit(False)))
    return ordered, F.size(F.array_distinct(F.flatten(F.transform(F.filter("__q_ord", hit), lambda x: F.array(x.getField("i"), x.getField("i") + 1, x.getField("i") + 2)))))


def document_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts of whole texts: the base heuristics and the two histograms.

    Adds ``n_words word_chars n_symbols n_dup_lines n_repeat_words`` (long),
    ``class_hist`` (array of long) and ``word_hist`` (array of (no, n), one for
    each common word that the text holds and, last, one for all other words),
    and drops the text.  Null text has no words and empty histograms.
    """
    clash = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_hist", "word_hist"} - {text_col}
    keep = [c for c in docs.columns if c not in clash and c != text_col]
    df = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__q_text"))
    blank = " \t\n\x0b\x0c\r"
    split = lambda t, by: F.when(t != "", F.split(t, by, -1)).otherwise(F.array().cast("array<string>"))
    df = df.withColumns({
        "__q_words": split(F.btrim("__q_text", F.lit(blank)), _SPACE_RE),
        "__q_lines": F.filter(F.split("__q_text", "\n", -1), lambda x: F.btrim(x, F.lit(blank)) != ""),
        "__q_chars": F.length("__q_text"),
        "__q_lower": _kept("__q_text", r"\p{Lu}+"),
        "__q_rest": F.regexp_replace("__q_text", r"\p{L}+", ""),
    }).drop("__q_text")
    df = df.withColumns({
        "__q_left": F.length("__q_rest"),
        "__q_nospace": _kept("__q_rest", _SPACE_RE),
        "__q_nodigit": _kept("__q_rest", "[0-9]+"),
        "__q_nosymbol": _kept("__q_rest", "[#*$%&|<>]+"),
        "__q_nopunct": _kept("__q_rest", r"[.,;:!?'\"()\-]+"),
        "__q_n": F.size("__q_words"),
        "__q_common": F.sort_array(F.filter(F.transform("__q_words", lambda w: F.btrim(F.lower(w), F.lit(_ENDS))), lambda w: w.isin(*_COMMON))),
        "__q_win": F.when(
            F.size("__q_words") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("__q_words") - 3), lambda i: F.xxhash64(F.get("__q_words", i), F.get("__q_words", i + 1), F.get("__q_words", i + 2))),
        ),
    }).drop("__q_words", "__q_rest")
    ordered, repeated = _repeated_words()
    twice = F.size(F.array_distinct("__q_win")) < F.size("__q_win")
    df = df.withColumns({
        "__q_ord": F.when(twice, ordered),
        "__q_k": F.size("__q_common"),
        "__q_starts": F.when(F.size("__q_common") > 0, F.filter(
            F.sequence(F.lit(0), F.size("__q_common") - 1), lambda i: (i == 0) | (F.get("__q_common", i) != F.get("__q_common", i - 1)))),
    })
    part = lambda no, n: F.struct(no.cast("int").alias("no"), n.cast("long").alias("n"))
    runs = F.transform("__q_starts", lambda i, j: part(_number(F.get("__q_common", i)), F.coalesce(F.get("__q_starts", j + 1), F.col("__q_k")) - i))
    none = F.array().cast("array<struct<no:int,n:bigint>>")
    size = F.col("__q_left")
    space, digit, symbol, punct = (size - F.col(c) for c in ("__q_nospace", "__q_nodigit", "__q_nosymbol", "__q_nopunct"))
    letter, upper = F.col("__q_chars") - size, F.col("__q_chars") - F.col("__q_lower")
    return df.select(
        *keep,
        F.col("__q_n").cast("long").alias("n_words"),
        (F.col("__q_chars") - space).cast("long").alias("word_chars"),
        symbol.cast("long").alias("n_symbols"),
        (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__q_ord").isNull(), F.lit(0)).otherwise(repeated).cast("long").alias("n_repeat_words"),
        F.array(letter - upper, upper, digit, space, symbol, punct, size - space - digit - symbol - punct).cast("array<long>").alias("class_hist"),
        F.concat(F.coalesce(runs, none), F.array(part(F.lit(len(_COMMON)), F.col("__q_n") - F.col("__q_k")))).alias("word_hist"),
    )


def language_references(stats: DataFrame, lang_col: str = "lang", min_words: int = 50, max_languages: int = 1000) -> list[tuple[str, list[float], list[float]]]:
    """Shares of each class and common word in each language.

    Documents of fewer than ``min_words`` words or without a language are left
    out.  One entry for each language, with two lists of fixed length.  A column
    of more than ``max_languages`` values isn't one of languages: that raises.
    """
    n, m = len(CLASSES), len(_COMMON) + 1
    long = stats.where((F.col("n_words") >= min_words) & F.col(lang_col).isNotNull())
    sums = lambda k: F.array(*[F.coalesce(F.sum(F.when(F.col("no") == i, F.col("n"))), F.lit(0)) for i in range(k)])
    classes = long.select(F.col(lang_col).alias("lang"), F.posexplode("class_hist").alias("no", "n"))
    words = long.select(F.col(lang_col).alias("lang"), F.inline("word_hist").alias("no", "n")).groupBy("lang", "no").agg(F.sum("n").alias("n"))
    share = lambda c: F.transform(c, lambda x: x / F.greatest(F.lit(1), F.aggregate(c, F.lit(0).cast("long"), lambda s, y: s + y)))
    classes = classes.groupBy("lang", "no").agg(F.sum("n").alias("n")).groupBy("lang").agg(sums(n).alias("c"))
    words = words.groupBy("lang").agg(sums(m).alias("w"))
    found = classes.join(words, "lang").select("lang", share("c").alias("classes"), share("w").alias("words")).limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"{lang_col} has more than {max_languages} values")
    return sorted((r["lang"], r["classes"], r["words"]) for r in found)


def js_distance(p: Column, q: Column, total: Column) -> Column:
    """Jensen-Shannon distance (base 2) between shares and a reference.

    ``p`` is an array of (no, p) with the places that are not 0, and ``q`` the
    reference's whole array, whose sum is ``total``.  A place that only the
    reference has adds its whole share, so those need no look.
    """
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    both = lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2) - b
    found = F.aggregate(p, F.lit(0.0), lambda s, x: s + both(x.getField("p"), F.get(q, x.getField("no"))))
    return F.sqrt(F.greatest(F.lit(0.0), (found + total) / 2))


def judge(stats: DataFrame, references: list[tuple[str, list[float], list[float]]], min_words: int = 50, max_repeat_percent: int = 50, max_class_js: float = 0.28, max_word_js: float = 0.25, word_slack: float = 1.0) -> DataFrame:
    """Add ``base_failed``, ``class_js``, ``word_js`` and ``kept``.

    The distances are those to the language whose sum of both is least.  A
    document that fails the base rules is not kept; one of fewer than
    ``min_words`` words never gets to the distances.  A histogram of n words
    strays from its language by about 1/sqrt(n), so ``max_word_js`` is widened
    by ``word_slack / sqrt(n_words)``.  Without any reference the distances are
    null and only the base rules decide.  The references are one literal, so
    the plan doesn't grow with the languages.
    """
    share = lambda h: F.transform(h, lambda x: F.struct(x.getField("no").alias("no"), (x.getField("n") / F.greatest(F.lit(1), F.aggregate(h, F.lit(0).cast("long"), lambda s, y: s + y.getField("n")))).alias("p")))
    listed = json.dumps([{"classes": c, "words": w, "tc": sum(c), "tw": sum(w)} for _, c, w in references])
    listed = F.from_json(F.lit(listed), "array<struct<classes:array<double>,words:array<double>,tc:double,tw:double>>")
    df = stats.withColumns({
        "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
        "__q_c": share(F.transform("class_hist", lambda x, i: F.struct(i.alias("no"), x.alias("n")))),
        "__q_w": share(F.col("word_hist")),
    })
    apart = F.transform(listed, lambda r: F.struct(
        js_distance(F.col("__q_c"), r.getField("classes"), r.getField("tc")).alias("c"), js_distance(F.col("__q_w"), r.getField("words"), r.getField("tw")).alias("w")))
    df = df.withColumn("__q_apart", apart)
    df = df.withColumn("__q_best", F.array_min(F.transform("__q_apart", lambda x: F.struct((x.getField("c") + x.getField("w")).alias("s"), x.getField("c").alias("c"), x.getField("w").alias("w")))))
    df = df.withColumns({"class_js": F.col("__q_best.c"), "word_js": F.col("__q_best.w")})
    near = (F.coalesce("class_js", F.lit(0.0)) <= max_class_js) & (F.coalesce("word_js", F.lit(0.0)) <= max_word_js + word_slack / F.sqrt(F.greatest(F.lit(1), "n_words")))
    return df.drop("__q_c", "__q_w", "__q_apart", "__q_best").withColumn("kept", ~F.col("base_failed") & near)


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """Judge every document; the text is dropped, other columns stay.

    Input columns named like an added one are replaced.  Null and empty texts
    have no words and fail the base rules.  Texts of any length are read whole,
    as one row each.  Repeated rows are judged alike and an empty table gives an
    empty one.
    """
    clash = [c for c in ("base_failed", "class_js", "word_js", "kept") if c in docs.columns]
    stats = materialise(document_stats(docs.drop(*clash), text_col), "quality")
    return judge(stats, language_references(stats, lang_col), **limits)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all ``documents``."""
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """DuckDB SQL of the registered query, verdicts included."""
    common = ", ".join(f"'{w}'" for w in _COMMON)
    n, m = len(CLASSES), len(_COMMON) + 1
    rest = lambda keep: f"length(regexp_replace(t, '[^{keep}]+', '', 'g'))"
    share = lambda h: f"list_transform({h}, lambda x: x / greatest(1, list_sum({h}))::DOUBLE)"
    sums = lambda h, k: "[" + ", ".join(f"sum({h}[{i + 1}])" for i in range(k)) + "]"
    term = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    js = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {term('z[1]')} + {term('z[2]')})) / 2))"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents
), w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS ls FROM d
), g AS (SELECT doc_id, s, (ws[s], ws[s + 1], ws[s + 2]) AS gram FROM w, unnest(range(1, len(ws) - 1)) AS u(s)
), twice AS (SELECT doc_id, gram FROM g GROUP BY ALL HAVING count(*) > 1
), rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT g.doc_id, unnest([s, s + 1, s + 2]) AS p FROM g JOIN twice ON g.doc_id = twice.doc_id AND g.gram = twice.gram) GROUP BY doc_id
), c AS (SELECT *, list_filter(list_transform(ws, lambda x: trim(lower(x), '.,;:!?')), lambda x: x IN ({common})) AS cw, length(t) AS n_chars,
  {rest(r' \t\n\x0B\f\r')} AS sp, {rest(r'\p{L}')} AS le, {rest(r'\p{Lu}')} AS up, {rest('0-9')} AS di, {rest('#*$%&|<>')} AS sy, {rest(r".,;:!?''" + r'"()\-')} AS pu FROM w
), h AS (SELECT *, [le - up, up, di, sp, sy, pu, n_chars - le - di - sp - sy - pu] AS ch,
  list_append(list_transform([{common}], lambda k: len(list_filter(cw, lambda x: x = k))), len(ws) - len(cw)) AS wh FROM c
), sums AS (SELECT lang, {sums('ch', n)} AS cs, {sums('wh', m)} AS wsum FROM h WHERE len(ws) >= 50 AND lang IS NOT NULL GROUP BY lang
), refs AS (SELECT {share('cs')} AS cq, {share('wsum')} AS wq FROM sums
), p AS (SELECT doc_id, {share('ch')} AS cp, {share('wh')} AS wp FROM h
), js AS (SELECT doc_id, {js('cp', 'cq')} AS c, {js('wp', 'wq')} AS w FROM p, refs
), best AS (SELECT doc_id, min({{'s': c + w, 'c': c, 'w': w}}) AS b FROM js GROUP BY doc_id
), base AS (SELECT h.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n_chars - sp AS BIGINT) AS word_chars, CAST(sy AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words FROM h LEFT JOIN rep ON h.doc_id = rep.doc_id
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT f.*, NOT base_failed AND coalesce(b.c, 0) <= 0.28 AND coalesce(b.w, 0) <= 0.25 + 1 / sqrt(greatest(1, n_words)) AS kept
FROM f LEFT JOIN best ON f.doc_id = best.doc_id
"""


ORACLE = _oracle()
