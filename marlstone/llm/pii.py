"""PII surrogates: keyed replacements of the same type and format.

Entities are found by patterns with checks (card and account checksums, address
ranges, a cue or a two-part name for persons) and replaced by surrogates that
look alike: digits by digits, letters by letters of the same case and script,
names by names of the same gender, numbers with valid check digits.

A surrogate is the value's successor on one keyed circle of all values of its
exact format.  Values that would leave the type or the format (a public address
for a private one, hexadecimal digits for other letters, a listed name for an
unlisted one) are passed over, which leaves a circle of the rest.  So a surrogate
depends on the key and the entity alone: an entity has the same one in the whole
corpus, whichever task meets it; different entities of a format have different
ones; formats don't share values; and no value is its own surrogate.  Coreference
and distinctness need no table, no shuffle and no second draw.

Entities are compared without what their writing may vary: the case of emails
and names, the separators of numbers, the notation of addresses.  The surrogate
then takes on the writing of the mention that it replaces.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.batches import slices
from marlstone.llm.common import table

#: Given names by gender, and family names.
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emma Olivia Sophia Anna Maria Julia Laura Marie Claire Camille Lucia Carmen Elena Sofia Greta Ingrid Heike Ursula Monika Petra".split()
MALE = "James Robert John Michael David William Richard Joseph Thomas Charles Daniel Matthew Paul Peter Hans Klaus Jürgen Wolfgang Stefan Andreas Pierre Jean Luc Antoine Nicolas Carlos Javier Miguel Pablo Diego".split()
FAMILY = "Smith Johnson Williams Brown Jones Miller Davis Garcia Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Walker Hall Young Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Dubois Durand Lefebvre Moreau Laurent Bernard Petit Rousseau".split()
_GENDER = {**{n.lower(): FEMALE for n in FEMALE}, **{n.lower(): MALE for n in MALE}}
_FAMILY = {n.lower(): FAMILY for n in FAMILY}

#: Runs of letters that are permuted among themselves, so that script and case stay.
_ALPHABETS = [
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüý", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
]
_CLASS = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}
#: In names vowels stay vowels, so that they can be spoken.
_SPOKEN = {**_CLASS, **{c: (a, i) for a in ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûü", "çñý", "αεηιουω", "βγδζθκλμνξπρστφχψ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщъь") for i, c in enumerate(a)}}
#: Beginnings that tell what a secret is for.
_PREFIX = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza)?")
#: Address ranges whose addresses stay among themselves.
_RANGES = [ipaddress.IPv4Network(n) for n in "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16 224.0.0.0/3".split()]
_HEX = {"0123456789abcdef": re.compile(r"[0-9a-f]+"), "0123456789ABCDEF": re.compile(r"[0-9A-F]+")}


class Permutation:
    """Keyed permutations of 0..n-1 without a fixed point, for any n > 1."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, r: int, x: int, size: int) -> int:
        digest = hmac.new(self.key, b"%b|%d|%d" % (tweak, r, x), hashlib.sha256).digest()
        return int.from_bytes(digest, "big") % size

    def _walk(self, tweak: bytes, x: int, n: int, rounds: list[int]) -> int:
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        sign = 1 if rounds[0] == 0 else -1
        while True:
            hi, lo = divmod(x, b)
            for r in rounds:
                if r % 2:
                    hi = (hi + sign * self._round(tweak, r, lo, a)) % a
                else:
                    lo = (lo + sign * self._round(tweak, r, hi, b)) % b
            x = hi * b + lo
            if x < n:
                return x

    def of(self, x: int, n: int, tweak: bytes) -> int:
        """The image of ``x``: to a shuffled circle, one step on, and back."""
        if n < 2:
            return x
        there = self._walk(tweak, x, n, [0, 1, 2, 3, 4, 5])
        return self._walk(tweak, (there + 1) % n, n, [5, 4, 3, 2, 1, 0])


def luhn(digits: str) -> bool:
    """Whether a digit string has a valid Luhn check digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


class Surrogates:
    """Replacements under one key; ``find`` depends on the kind and the value alone."""

    def __init__(self, key: bytes):
        self.perm = Permutation(key)
        self.find = lru_cache(100_000)(self._find)

    def _next(self, value: int, size: int, tweak: str, stays=lambda v: True) -> int:
        """The next value on the circle that ``stays`` allows."""
        while True:
            value = self.perm.of(value, size, tweak.encode())
            if stays(value):
                return value

    def letters(self, text: str, kind: str, stays=lambda t: True, classes=_CLASS) -> str:
        """The next text of the same exact format; characters without a class stay."""
        places = [(i, *classes[c]) for i, c in enumerate(text) if c in classes]
        total, value = 1, 0
        for _, alphabet, digit in places:
            total *= len(alphabet)
            value = value * len(alphabet) + digit
        shape = "".join(classes[c][0][0] if c in classes else c for c in text)

        def spell(value: int) -> str:
            out = list(text)
            for i, alphabet, _ in reversed(places):
                value, digit = divmod(value, len(alphabet))
                out[i] = alphabet[digit]
            return "".join(out)

        return spell(self._next(value, total, f"{kind}|{shape}", lambda v: stays(spell(v))))

    def _secret(self, text: str) -> str:
        head = _PREFIX.match(text)[0]
        rest = text[len(head) :]
        for digits, pattern in _HEX.items():
            if _hexadecimal(rest, pattern):
                spell = lambda v: format(v, f"0{len(rest)}{'x' if digits[-1] == 'f' else 'X'}")
                return head + spell(self._next(int(rest, 16), 16 ** len(rest), f"hex|{head}|{len(rest)}|{digits[-1]}", lambda v: _hexadecimal(spell(v), pattern)))
        return head + self.letters(rest, f"secret|{head}", lambda t: not any(_hexadecimal(t, p) for p in _HEX.values()) and not _PREFIX.match(t)[0])

    def _digits(self, text: str, kind: str, keep: int = 0, check: bool = False) -> str:
        """The digits after the first ``keep`` change; the last may be a Luhn digit."""
        at = [i for i, c in enumerate(text) if c.isdigit()]
        body = at[keep : len(at) - check]
        head = "".join(text[i] for i in at[:keep])
        n = len(body)

        def spell(value: int) -> str:
            out = head + str(value).zfill(n)
            return next(out + c for c in "0123456789" if luhn(out + c)) if check else out

        stays = (lambda v: True) if kind != "card" or check else (lambda v: not luhn(spell(v)))
        found = iter(spell(self._next(int("".join(text[i] for i in body)), 10**n, f"{kind}|{head}|{n}|{check}", stays)))
        return "".join(next(found) if c.isdigit() else c for c in text)

    def _address(self, text: str) -> str:
        if ":" in text:
            return self._address6(text)
        value = int(ipaddress.IPv4Address(text))
        for net in _RANGES:
            if ipaddress.IPv4Address(value) in net:
                base = int(net.network_address)
                return str(ipaddress.IPv4Address(base + self._next(value - base, net.num_addresses, f"ip4|{net}")))
        return str(ipaddress.IPv4Address(self._next(value, 1 << 32, "ip4", lambda v: not any(ipaddress.IPv4Address(v) in net for net in _RANGES))))

    def _address6(self, text: str) -> str:
        """Groups of zeros and the first group stay; others keep their number of digits."""
        groups = [int(g, 16) for g in ipaddress.IPv6Address(text).exploded.split(":")]
        moved = [i for i, g in enumerate(groups) if g and i] or [0]
        sizes = [len(format(groups[i], "x")) for i in moved]
        total, value = 1, 0
        for i, n in zip(moved, sizes):
            total *= 15 * 16 ** (n - 1)
            value = value * 15 * 16 ** (n - 1) + groups[i] - 16 ** (n - 1)
        shape = ":".join(format(g, "x") if i not in moved else "*" * len(format(g, "x")) for i, g in enumerate(groups))
        value = self._next(value, total, f"ip6|{shape}")
        made = list(groups)
        for i, n in zip(reversed(moved), reversed(sizes)):
            value, low = divmod(value, 15 * 16 ** (n - 1))
            made[i] = low + 16 ** (n - 1)
        shown = text.split(":")
        before = shown.index("") if "::" in text else 8
        places = [i if i < before else 8 - len(shown) + i for i in range(len(shown))]
        return ":".join(g and (format(made[p], f"0{len(g)}x").upper() if g.upper() == g else format(made[p], f"0{len(g)}x")) for g, p in zip(shown, places))

    def _iban(self, text: str) -> str:
        flat = text.replace(" ", "")
        made = flat[:2] + "00" + self.letters(flat[4:], f"iban|{flat[:2]}")
        number = "".join(str(int(c, 36)) for c in made[4:] + made[:4])
        it = iter(f"{made[:2]}{98 - int(number) % 97:02d}{made[4:]}")
        return "".join(" " if c == " " else next(it) for c in text)

    def _name(self, text: str) -> str:
        """Listed names become names of the same list; in others vowels stay vowels and a final vowel stays."""
        out = []
        for part in re.split(r"([\s-]+)", text):
            low = part.lower()
            pool = _GENDER.get(low) or _FAMILY.get(low)
            if pool:
                new = pool[self._next([n.lower() for n in pool].index(low), len(pool), f"name|{pool[0]}")]
                out.append(new.upper() if part.isupper() else new.lower() if part.islower() else new)
            else:
                stem = low[:-1] if low and _SPOKEN.get(low[-1], ("",))[0][:1] in tuple("aàαа") else low
                new = self.letters(stem, f"name|{low[len(stem):]}", lambda t: t + low[len(stem) :] not in _GENDER and t + low[len(stem) :] not in _FAMILY, _SPOKEN)
                out.append(_cased(new + low[len(stem) :], part))
        return "".join(out)

    def _find(self, kind: str, value: str) -> str:
        if kind == "email":
            local, _, host = value.rpartition("@")
            name, dot, top = host.rpartition(".")
            made = f"{self.letters(local.lower(), 'local|' + host.lower())}@{self.letters(name.lower(), 'host|' + top.lower())}{dot}{top.lower()}"
            return _cased(made, value)
        if kind == "card":
            return self._digits(value, kind, 1, luhn(re.sub(r"\D", "", value)))
        if kind == "phone":
            digits = re.sub(r"\D", "", value)
            return self._digits(value, f"phone{value[:1] == '+'}", min(2, len(digits) - 1) if value[:1] == "+" else int(digits[0] == "0"))
        if kind == "ssn":
            return self._digits(value, kind)
        if kind == "ip":
            return self._address(value)
        if kind == "iban":
            return self._iban(value)
        if kind == "secret":
            return self._secret(value)
        return self._name(value)


def _hexadecimal(text: str, pattern: re.Pattern) -> bool:
    return bool(pattern.fullmatch(text) and re.search("[a-fA-F]", text) and re.search("[0-9]", text))


def _cased(made: str, like: str) -> str:
    """``made`` with the case of ``like``, letter by letter; both are of one length but for rare letters."""
    if len(made) != len(like):
        return made
    return "".join(u if o.isupper() and len(u := c.upper()) == 1 else c for c, o in zip(made, like))


#: What each type looks like, in order of precedence.
PATTERNS = {
    "email": r"[^\s@<>()\[\],;:\"'|=]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}",
    "secret": r"(?i:(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|key)[\"']?\s*[=:]\s*)[\"']?(?P<secret>[A-Za-z0-9+/_\-.]{8,})|\b(?P<prefixed>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,})\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)|(?<![\w:.])(?=[0-9a-fA-F:]*[0-9])[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7}(?![\w:.])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{1,4}[ /-]\d{3,4}[ -]?\d{3,5})(?![\w-])",
}
_TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra?)\.?"
_CAP = r"[^\W\d_a-zà-ÿ][^\W\d_]+"
_PERSON = re.compile(rf"(?i:\b(?:my name is|mein Name ist|je m'appelle|me llamo)) (?P<cued>{_CAP}(?:[ -]{_CAP}){{0,2}})|\b{_TITLES} (?P<titled>{_CAP}(?:[ -]{_CAP}){{0,2}})|\b(?P<known>(?:{'|'.join(sorted({*FEMALE, *MALE}, key=len, reverse=True))}) (?:{_CAP}[ -])?(?:{'|'.join(sorted(FAMILY, key=len, reverse=True))}))\b")
_COMPILED = {k: re.compile(v) for k, v in PATTERNS.items()}
_MAYBE = re.compile(r"[0-9@=:]")


def _is_address6(text: str) -> bool:
    try:
        return int(ipaddress.IPv6Address(text)) > 0
    except ValueError:
        return False


def entities(text: str) -> list[tuple[int, int, str]]:
    """Spans and types, in order and without overlap; earlier types win."""
    found: list[tuple[int, int, str]] = []
    if _MAYBE.search(text):
        for kind, pattern in _COMPILED.items():
            if (kind == "email" and "@" not in text) or (kind == "phone" and not re.search(r"\d{3}", text)):
                continue
            for m in pattern.finditer(text):
                group = next((g for g in ("secret", "prefixed") if g in pattern.groupindex and m[g]), 0)
                span = m.span(group)
                if kind == "card" and not 13 <= sum(c.isdigit() for c in m[0]) <= 19:
                    continue
                if kind == "ip" and ":" in m[0] and not _is_address6(m[0]):
                    continue
                found.append((*span, kind))
    for m in _PERSON.finditer(text):
        found.append((*m.span(m.lastgroup), "person"))
    if len(found) > 1:
        rank = {k: i for i, k in enumerate([*PATTERNS, "person"])}
        taken = bytearray(len(text))
        kept = []
        for a, b, kind in sorted(found, key=lambda x: (rank[x[2]], x[0])):
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                kept.append((a, b, kind))
        found = sorted(kept)
    return found


def _form(kind: str, value: str) -> str:
    """What of a value tells entities apart."""
    if kind in ("email", "person"):
        return value.lower()
    if kind in ("card", "phone", "ssn"):
        return ("+" if value[:1] == "+" else "") + re.sub(r"\D", "", value)
    if kind == "ip":
        return str(ipaddress.ip_address(value))
    return value.replace(" ", "") if kind == "iban" else value


def replace(text: str, make: Surrogates) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (type, entity, surrogate) in order.

    Each surrogate is a function of the key, the type and the value.
    """
    spans = entities(text)
    if not spans:
        return text, []
    out, at, made = [], 0, []
    for a, b, kind in spans:
        value = text[a:b]
        new = make.find(kind, value)
        out += [text[at:a], new]
        made.append((kind, value, new))
        at = b
    return "".join([*out, text[at:]]), made


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", with_entities: bool = True) -> DataFrame:
    """Replace the detected entities of every whole text by surrogates.

    Returns the columns of ``docs`` with ``text_col`` replaced, ``n_entities``
    (long) and, unless left out, ``entities``, an array of (kind, digest,
    surrogate): the digest is keyed, so that mentions of an entity can be
    matched without the entity itself.  Input columns of these names are
    replaced.

    Null text stays null and has no entities; text without entities stays as it
    is; texts of any length are read whole.  Rows are independent and equal entities get equal surrogates under a
    key, so repeated rows stay repeated.  An empty table gives an empty one.
    """
    added = [("n_entities", "long", pa.int64())]
    item = pa.list_(pa.struct([("kind", pa.string()), ("digest", pa.string()), ("surrogate", pa.string())]))
    if with_entities:
        added.append(("entities", "array<struct<kind:string,digest:string,surrogate:string>>", item))
    names = [c for c in docs.columns if c not in [a[0] for a in added]]
    at_text = names.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names), *(f"{a[0]} {a[1]}" for a in added)])
    secret = key.encode()

    def run(batches):
        make = Surrogates(secret)
        digest = lambda k, v: hmac.new(secret, f"{k}|{_form(k, v)}".encode(), hashlib.sha256).hexdigest()[:16]
        for whole in batches:
            for part in slices(whole, at_text):
                done = [(None, []) if t is None else replace(t, make) for t in part.column(at_text).to_pylist()]
                cols = [pa.array([d[0] for d in done], part.schema.field(i).type) if i == at_text else c for i, c in enumerate(part.columns)]
                cols.append(pa.array([len(d[1]) for d in done], pa.int64()))
                if with_entities:
                    cols.append(pa.array([[{"kind": k, "digest": digest(k, v), "surrogate": s} for k, v, s in d[1]] for d in done], item))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *(a[0] for a in added)])

    return docs.select(*names).mapInArrow(run, schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole ``documents`` with surrogates for personal data and secrets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = replace_pii(docs, key="marlstone", with_entities=False)
    return out.select("doc_id", "n_entities", "text")
