"""Source lists: line-based lists of folders, addresses and types.

A line is a value with ``key=value`` attributes; ``!`` subtracts; ``#`` after
white space or at the start begins a comment.  Lists are small configuration,
so they are read on the driver and handed on as a DataFrame.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "kind string, value string, exclude boolean, attrs map<string,string>"


class ListError(ValueError):
    """A line that can't be read, with its place."""


@dataclass(frozen=True)
class ListKind:
    """What a list may hold: attributes with their values, the first the default.

    ``checks`` are patterns that a value must not match, and what is wrong then.
    """

    name: str
    attributes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    exclusions: bool = True
    checks: tuple[tuple[str, str], ...] = ()


_INSIDE = ((r"/", "isn't relative to the root"), (r"(?:.*/)?\.\.(?:/|$)", "leaves the root"))

#: The kinds of lists.
KINDS = {
    "dirs": ListKind("dirs", {"archived": ("false", "true")}, checks=_INSIDE),
    "urls": ListKind("urls", {"fetch": ("http", "cdp"), "meta": ("hashed", "plain")}, exclusions=False, checks=((r"(?!https?://)", "is no http(s) address"),)),
    "types": ListKind("types", checks=(*_INSIDE, (r".*/$", "names a folder, and types match files"))),
}


@dataclass(frozen=True)
class Entry:
    value: str
    attrs: dict[str, str]
    exclude: bool
    declared: int
    line: int


def _entry(text: str, kind: ListKind, line: int, origin: str) -> Entry | None:
    fail = lambda why: ListError(f"{origin}:{line}: {why}")
    words = re.sub(r"(^|(?<=[ \t]))#.*", "", text).split()
    if not words:
        return None
    value, given = words[0], words[1:]
    exclude = value.startswith("!")
    if exclude:
        value = value[1:]
        if not kind.exclusions:
            raise fail(f"nothing can be subtracted from {kind.name}")
        if not value or value.startswith("!") or given:
            raise fail("an exclusion is one pattern without attributes")
    for pattern, wrong in kind.checks:
        if re.match(pattern, value):
            raise fail(f"{value!r} {wrong}")
    attrs = {k: v[0] for k, v in kind.attributes.items()}
    seen: set[str] = set()
    for word in given:
        key, equals, val = word.partition("=")
        if not equals or key not in kind.attributes or val not in kind.attributes[key] or key in seen:
            raise fail(f"{word!r} is not an attribute of {kind.name}, or is given twice")
        seen.add(key)
        attrs[key] = val
    return Entry(value, attrs, exclude, len(seen), line)


def read(text: str, kind: str, origin: str = "list") -> list[Entry]:
    """Entries without repeats, inclusions first, each part in order of value.

    Repeats that agree are one entry, the one that states more; repeats that
    differ are an error.
    """
    found: dict[tuple[bool, str], Entry] = {}
    for no, line in enumerate(text.split("\n"), 1):
        entry = _entry(line, KINDS[kind], no, origin)
        if entry is None:
            continue
        other = found.setdefault((entry.exclude, entry.value), entry)
        if other.attrs != entry.attrs:
            raise ListError(f"{origin}:{other.line} and {no}: {entry.value!r} stands twice with different attributes")
        if entry.declared > other.declared:
            found[entry.exclude, entry.value] = entry
    return [found[k] for k in sorted(found)]


def frame(spark: SparkSession, entries: dict[str, list[Entry]]) -> DataFrame:
    """All lists as one table."""
    rows = [(kind, e.value, e.exclude, e.attrs) for kind, es in sorted(entries.items()) for e in es]
    return spark.createDataFrame(rows, SCHEMA)


def add(text: str, value: str, kind: str, **attrs: str) -> str:
    """The list with a line for ``value``; one that is there is replaced."""
    line = " ".join([value, *(f"{k}={v}" for k, v in sorted(attrs.items()))])
    kept = [x for x in text.split("\n") if x.split()[:1] != [value]]
    out = "\n".join([*(x for i, x in enumerate(kept) if x or i < len(kept) - 1), line]) + "\n"
    read(out, kind)
    return out


def remove(text: str, value: str, kind: str) -> tuple[str, str]:
    """The list without ``value``, and how: its line went, or an exclusion came.

    A value that only lies below a listed folder is excluded; one that nothing
    covers is an error.
    """
    entries = read(text, kind)
    if any(e.value == value and not e.exclude for e in entries):
        return "\n".join(x for x in text.split("\n") if x.split()[:1] != [value]), "removed"
    if KINDS[kind].exclusions and any(not e.exclude and (e.value in ("", ".") or value.startswith(e.value.rstrip("/") + "/")) for e in entries):
        return text.rstrip("\n") + f"\n!{value}\n", "excluded"
    raise ListError(f"{value!r} is in no list")
