"""Text analysis as column expressions; the same analyser on both sides of a match."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The analyser's English stop words.
STOP_WORDS = tuple(
    """a an and are as at be but by for from has have how i if in into is it its of on or that
    the their then there these this to was were what when where which who why will with you
    your we our not can may""".split()
)
#: Weights of heading and body occurrences, and how many headings are kept.
HEADING_WEIGHT, BODY_WEIGHT, MAX_PHRASES = 3, 1, 12

HEADING = r"(?md)^(#{1,6})[\s\x0B]+(.+?)[\s\x0B]*$"
LINK = r'\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)'
CODE_SPAN = r"`([^`\n]+)`"


def tokens(text: Column) -> Column:
    """Runs of ``[a-z0-9_]`` of the lower-cased text without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def query_terms(text: Column) -> Column:
    """Distinct tokens in order of first occurrence."""
    return F.array_distinct(tokens(text))


def headings(body: Column) -> Column:
    """Texts of the Markdown headings, in order; fences are not looked at."""
    return F.transform(F.regexp_extract_all(body, F.lit(HEADING), F.lit(2)), F.trim)


def without_headings(body: Column) -> Column:
    return F.regexp_replace(body, HEADING, "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def title(front: Column, heads: Column, path: Column) -> Column:
    """Front matter's title, else the first heading, else the file's name."""
    return F.coalesce(F.nullif(F.trim(front), F.lit("")), F.get(heads, F.lit(0)), basename(path))


def plain_title(html: Column) -> Column:
    """Text of the first ``<title>`` without attributes; of references only four, closed by ``;``, are read."""
    out = F.regexp_extract(html, "<title>([^<]*)</title>", 1)
    for name, sign in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.regexp_replace(out, r"^\p{Zs}+|\p{Zs}+\z", "")


def phrases(heads: Column) -> Column:
    return F.slice(heads, 1, MAX_PHRASES)


def heading_tokens(heads: Column, name: Column) -> Column:
    """Tokens of the headings, and of the title if it is none of them."""
    extra = F.when(F.array_contains(heads, name), F.array().cast("array<string>")).otherwise(F.array(name))
    return tokens(F.array_join(F.concat(heads, extra), " "))


def link_targets(body: Column) -> Column:
    """Targets of ``[text](target "title")`` links, in order."""
    return F.regexp_extract_all(body, F.lit(LINK), F.lit(1))


def code_spans(body: Column) -> Column:
    """Inline code spans that stay on one line."""
    return F.regexp_extract_all(body, F.lit(CODE_SPAN), F.lit(1))


def tags(raw: Column) -> Column:
    """Tags of a list: trimmed, lower case, distinct, sorted, none empty."""
    clean = F.transform(raw, lambda t: F.lower(F.trim(t)))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda t: t != "")))


def normalise_path(path: Column) -> Column:
    """Resolve ``.``, ``..`` and empty segments; ``..`` at the top goes nowhere."""
    step = lambda acc, x: (
        F.when(x.isin("", "."), acc)
        .when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(x == "..", acc)
        .otherwise(F.concat(acc, F.array(x)))
    )
    return F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")


def parent_dir(path: Column) -> Column:
    """All but the last segment; empty at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob.

    ``*`` and ``?`` stay inside a segment, ``**`` doesn't; all else is literal.
    """
    parts = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(parts.get(p) or re.escape(p) for p in re.findall(r"\*\*|\*|\?|[^*?]+", pattern))
    return f"(?s)^{body}\\z"


def glob_match(pattern: str, path: Column) -> Column:
    """A pattern without ``/`` is held against the file's name."""
    return (path if "/" in pattern else basename(path)).rlike(glob_regex(pattern))


def any_glob(patterns: list[str], path: Column) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | glob_match(p, path)
    return out


def ancestors(path: Column) -> Column:
    """The path and every directory above it, shortest first."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def excluded_by(patterns: list[str], path: Column) -> Column:
    """The first pattern that matches the path or a directory above it, else null."""
    def above(p: str) -> Column:
        return F.exists(ancestors(path), lambda a: glob_match(p, a))

    hits = [F.when(above(p), F.lit(p)) for p in patterns]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def accepted_type(path: Column, allow: list[str], deny: list[str] = ()) -> Column:
    """Deny wins; then any allowed pattern is enough."""
    return ~any_glob(list(deny), path) & any_glob(list(allow), path)


def is_archived(loc: Column, dirs: list[str]) -> Column:
    """Whether ``loc`` is one of ``dirs`` or lies below one."""
    out = F.lit(False)
    for d in dirs:
        out = out | (loc == d) | F.startswith(loc, F.lit(f"{d}/"))
    return out


def sanitise_url_text(text: Column) -> Column:
    """Newlines to LF, exotic line breaks to spaces, no NUL."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    return F.translate(text, "\u2028\u2029\u0085\x00", "   ")


def locator(loc: Column, ordinal: Column) -> Column:
    return F.concat(loc, F.lit("#p"), ordinal.cast("string"))


def cost_bytes(text: Column, overhead: int = 80) -> Column:
    """UTF-8 bytes and what a citation costs besides."""
    return F.octet_length(text) + overhead


def base64url(raw: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(raw), "+/\r\n", "-_"), F.lit("="))


def resolve_doc(name: Column) -> Column:
    """An id as it is, a bare path as a file id."""
    return F.when(name.rlike("^(file|url|tag):"), name).otherwise(F.concat(F.lit("file:"), name))


def loc_of(doc_id: Column) -> Column:
    return F.regexp_replace(doc_id, "^(file|url):", "")
