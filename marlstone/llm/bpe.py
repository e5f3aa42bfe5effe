"""BPE encoding and decoding by speculation and verification.

Texts are cut into words with numpy, over tables that hold the class and the
lower case of each code point as the ``tokenizers`` library itself gives them.
For all new words of a group together, greedy longest match proposes tokens.  A
proposal is the BPE encoding exactly if every token encodes itself and every
adjacent pair is compatible, that is, no merge across the pair's border would
have come before the merges that make its two tokens.  All distinct pairs are
tested together; only the words that fail are merged step by step.

Known words are kept in a table that is bounded by entries and by bytes, so a
text mostly costs its cutting and one lookup for each distinct word of a group.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.batches import slices
from marlstone.llm.common import table

_FAR = np.int64(1) << 40
#: Words of more bytes are merged one by one with a heap, and never remembered.
LONG_WORD = 64
#: Code points from here on (planes without letters that any text uses, private use) are left to the library.
LIMIT = 0x32400
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)

# The one form of tokenizer file that is cut into words here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def unlike(data: dict) -> str | None:
    """Why a tokenizer file isn't of the form that this module cuts; None if it is."""
    if data.get("normalizer") != NORMALIZER:
        return "its normalizer is another"
    if data.get("pre_tokenizer") != PRE_TOKENIZER:
        return "its pre-tokenizer is another"
    if data.get("post_processor") or data.get("decoder"):
        return "it has a post-processor or a decoder"
    if {k: data["model"].get(k) for k in MODEL} != MODEL or not data["model"].get("end_of_word_suffix"):
        return "its model has other options"
    for token in data.get("added_tokens") or []:
        if {k: token.get(k) for k in ADDED} != ADDED or not token["content"] or re.search(r"\s", token["content"]):
            return "its added tokens have other options"
    letters = set(byte_letters())
    for name in data["model"]["vocab"]:
        if not name or not letters.issuperset(name.removesuffix(data["model"]["end_of_word_suffix"])):
            return "its vocabulary isn't one of bytes"
    return None


class Tables(NamedTuple):
    """Class and lower case of the code points below ``LIMIT``, as the library has them."""

    kinds: bytes
    lower: bytes

    @classmethod
    def ask(cls) -> Tables:
        """Ask the library once for all code points.

        A code point is odd, and its stretch between white space is left to the
        library's own normalizer and splitter, unless normalization provably
        leaves it alone: it is assigned, no combining mark, no second part of a
        composite, its own NFC, and its lower case is one such code point.
        """
        from tokenizers import Regex, normalizers, pre_tokenizers

        points = [c for c in range(LIMIT) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, points))
        kinds = np.full(LIMIT, OTHER, dtype=np.uint8)
        seconds = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
        plain = np.zeros(LIMIT, dtype=bool)
        for c in points:
            parts = unicodedata.decomposition(chr(c)).split()
            if len(parts) == 2 and not parts[0].startswith("<"):
                seconds.add(int(parts[1], 16))
            plain[c] = unicodedata.category(chr(c)) != "Cn" and not unicodedata.combining(chr(c)) and unicodedata.is_normalized("NFC", chr(c))
        plain[list(seconds)] = False
        lower = np.arange(LIMIT, dtype=np.uint32)
        cased = [c for c in points if c != 10]
        for c, low in zip(cased, normalizers.Lowercase().normalize_str("\n".join(map(chr, cased))).split("\n"), strict=True):
            if len(low) == 1 and ord(low) < LIMIT and plain[ord(low)]:
                lower[c] = ord(low)
            else:
                plain[c] = False
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for run, _ in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
                kinds[list(map(ord, run))] = kind
        kinds = np.where((kinds == SPACE) | plain, kinds[lower], ODD).astype(np.uint8)
        return cls(kinds.tobytes(), lower.tobytes())


_ASKED: list[Tables] = []


def tables() -> Tables:
    """The tables, made once in a process."""
    if not _ASKED:
        _ASKED.append(Tables.ask())
    return _ASKED[0]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b], extra = chr(extra), extra + 1
    return [names[b] for b in range(256)]


class Cutter:
    """Cuts texts into the words that the library's pre-tokenizer would give.

    Words are UTF-8 bytes in lower case.  A stretch between white space that
    holds an odd code point or an added token stays whole and as it is, with
    the white space before it in front; no word begins with white space
    otherwise, so ``pieces`` can tell it apart.
    """

    def __init__(self, spec: str, found: Tables):
        data = json.loads(spec)
        reason = unlike(data)
        if reason:
            raise ValueError(f"tokenizer file can't be cut into words here: {reason}")
        self.spec, self.library = spec, None
        self.kinds = np.frombuffer(found.kinds, np.uint8)
        self.lower = np.frombuffer(found.lower, np.uint32)
        self.low8 = self.lower[:128].astype(np.uint8)
        self.leads = {chr(c).encode()[0] for c in np.flatnonzero(self.kinds == SPACE)}
        self.blank = re.compile("[" + "".join(chr(c) for c in np.flatnonzero(self.kinds == SPACE)) + "]")
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
        self.added_re = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def cut(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Number of each word, the distinct words, and where each text's words end."""
        joined = "\n".join(["", *texts])
        if joined.isascii():
            raw = np.frombuffer(joined.encode(), np.uint8)
            kinds, low = self.kinds[:128][raw], self.low8[raw]
        else:
            raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            near = np.minimum(raw, LIMIT - 1)
            kinds, low = self.kinds[near], self.lower[near]
            far = raw >= LIMIT
            if far.any():
                kinds[far] = ODD
        begins = np.empty(len(kinds), bool)
        begins[0] = False
        np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
        begins |= kinds == NUMBER
        begins &= kinds != SPACE
        self._contractions(low, kinds, begins)
        keep = kinds != SPACE
        odd = kinds == ODD
        if self.added_re and any(name in joined for name in self.added):
            for m in self.added_re.finditer(joined):
                odd[m.start()] = True
        if odd.any():
            low = low.copy()
            blanks = np.flatnonzero(kinds == SPACE)
            after = np.unique(np.searchsorted(blanks, np.flatnonzero(odd)))
            for lo, hi in zip(blanks[after - 1].tolist(), np.r_[blanks, len(kinds)][after].tolist()):
                begins[lo:hi], keep[lo], low[lo:hi] = False, True, raw[lo:hi]
                begins[lo] = True
        at = np.flatnonzero(begins)
        kept = low[keep]
        if low.dtype == np.uint8:
            data = kept.tobytes()
            place = np.cumsum(keep, dtype=np.int32)[at] - 1
        else:
            data = kept.tobytes().decode("utf-32-le").encode()
            width = keep * (1 + (low >= 0x80) + (low >= 0x800) + (low >= 0x10000)).astype(np.int8)
            place = np.cumsum(width, dtype=np.int32)[at] - width[at]
        offsets = np.append(place, len(data)).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        return words.indices.to_numpy(), words.dictionary.to_pylist(), np.searchsorted(at, ends)

    @staticmethod
    def _contractions(low: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> None:
        """An apostrophe that begins a word takes the ending of a contraction with it."""
        marks = np.flatnonzero((low == 39) & begins)
        marks = marks[marks + 1 < len(low)]
        if not len(marks):
            return
        first = low[marks + 1]
        second = low[np.minimum(marks + 2, len(low) - 1)] * (marks + 2 < len(low))
        size = np.zeros(len(marks), dtype=np.int64)
        for end in CONTRACTIONS:
            hit = (first == end[0]) & ((len(end) == 1) | (second == end[-1]))
            size[hit & (size == 0)] = len(end) + 1
        marks, size = marks[size > 0], size[size > 0]
        begins[marks + 1] = False
        after = marks + size
        after = after[after < len(low)]
        begins[after] = kinds[after] != SPACE

    def pieces(self, stretch: str) -> list[tuple[bytes, int]]:
        """Words of a stretch that the library has to cut, with ids of added tokens (else -1)."""
        if self.library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            self.library = (Tokenizer.from_str(self.spec).normalizer, pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True))
        normalizer, splitter = self.library
        out: list[tuple[bytes, int]] = []
        at = 0
        for m in [*(self.added_re.finditer(stretch) if self.added_re else ()), None]:
            part = stretch[at : m.start() if m else None]
            out += [(w.encode(), -1) for w, _ in splitter.pre_tokenize_str(normalizer.normalize_str(part))]
            if m:
                out.append((b"", self.added[m.group()]))
                at = m.end()
        return out

    def groups(self, texts: list[str], size: int = 1 << 20) -> Iterator[list[tuple[int, str, bool]]]:
        """Parts of texts, ``size`` code points together: number of the text, part, whether its last.

        A longer text is cut at white space, where no word is.
        """
        held, n = [], 0
        for i, text in enumerate(texts):
            at = 0
            while True:
                cut = self.blank.search(text, at + size) if len(text) - at > size else None
                part = text[at : cut.start() if cut else None] if at or cut else text
                if held and n + len(part) > size:
                    yield held
                    held, n = [], 0
                held.append((i, part, cut is None))
                n += len(part)
                if cut is None:
                    break
                at = cut.start()
        if held:
            yield held


class Known:
    """Ids of known words in flat arrays, bounded by entries and by bytes.

    ``make`` gives the ids of new words and the number of each one's ids.  When
    the table is full it begins again; words of more than ``LONG_WORD`` bytes
    are only held for their group.
    """

    def __init__(self, cutter: Cutter, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], keep: int = 500_000, keep_bytes: int = 24 << 20):
        self.cutter, self.make, self.keep, self.keep_bytes = cutter, make, keep, keep_bytes
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.held = 0
        self.ids = np.empty(1 << 16, np.int32)
        self.starts = np.empty(1 << 14, np.int64)
        self.sizes = np.empty(1 << 14, np.int32)
        self.n_words = self.n_ids = 0

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Append words; returns the slot of the first."""
        first, n, m = self.n_words, self.n_words + len(sizes), self.n_ids + len(ids)
        while n > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while m > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.n_ids : m] = ids
        self.sizes[first:n] = sizes
        self.starts[first:n] = self.n_ids + np.cumsum(sizes) - sizes
        self.n_words, self.n_ids = n, m
        return first

    def _stretches(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches that the library cuts, all together."""
        parts = [self.cutter.pieces(s.decode()[1:]) for s in stretches]
        given = np.array([i for p in parts for _, i in p], dtype=np.int64)
        made, sizes = self.make([w for p in parts for w, i in p if i < 0])
        spans = np.ones(len(given), dtype=np.int64)
        spans[given < 0] = sizes
        ids = np.repeat(given, spans)
        ids[ids < 0] = made
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        return ids.astype(np.int32), np.bincount(of, spans, len(parts)).astype(np.int32)

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids end."""
        numbers, words, ends = self.cutter.cut(texts)
        if len(self.slots) + len(words) > self.keep or self.held > self.keep_bytes or 4 * self.n_ids > self.keep_bytes:
            self.clear()
        get = self.slots.get
        slots = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(slots < 0)
        if len(new):
            fresh = list(map(words.__getitem__, new.tolist()))
            whole = np.array([w[0] in self.cutter.leads and bool(self.cutter.blank.match(w.decode())) for w in fresh])
            usual = [w for w, odd in zip(fresh, whole.tolist()) if not odd] if whole.any() else fresh
            at = self._add(*self.make(usual)) if usual else 0
            slots[new[~whole]] = np.arange(at, at + len(usual))
            if whole.any():
                at = self._add(*self._stretches([w for w, odd in zip(fresh, whole.tolist()) if odd]))
                slots[new[whole]] = np.arange(at, at + int(whole.sum()))
            for w, slot in zip(fresh, slots[new].tolist()):
                if len(w) <= LONG_WORD:
                    self.slots[w] = slot
                    self.held += len(w)
        of = slots[numbers]
        sizes = self.sizes[of]
        stops = np.cumsum(sizes, dtype=np.int64)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.ids[np.repeat(self.starts[of] - stops + sizes, sizes) + np.arange(total)]
        return ids, np.r_[0, stops][ends]


class SpeculativeBpe:
    """A byte-level BPE with word ends, read from a ``tokenizers`` JSON file.

    Files of another form are refused with a ``ValueError``.
    """

    def __init__(self, spec: str, found: Tables | None = None, keep: int = 500_000):
        self.cutter = Cutter(spec, found or tables())
        model = json.loads(spec)["model"]
        self.suffix: str = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        size = max([*vocab.values(), *self.cutter.added.values()]) + 1
        self.names = [""] * size
        for name, i in [*vocab.items(), *self.cutter.added.items()]:
            self.names[i] = name
        ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]):
            ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.ranks = ranks
        keys = np.array([a * size + b for a, b in ranks], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks, self.key_made = (x[order] for x in (keys, *np.array(list(ranks.values()), dtype=np.int64).T))
        self.size = size
        self._hash()
        self.birth = np.full(size, -1, dtype=np.int64)
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        for (a, b), (rank, new) in ranks.items():
            if self.birth[new] < 0:
                self.birth[new], self.left[new], self.right[new] = rank, a, b
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in letters], dtype=np.int64)
        made = np.flatnonzero(self.birth >= 0)
        self.sound = np.zeros(size, dtype=bool)
        self.sound[self.inner] = self.sound[self.final] = True
        self.sound[made] = False
        inner = self._clash(self.left[made], self.right[made], self.birth[made])
        for i, bad in sorted(zip(made.tolist(), inner.tolist()), key=lambda x: self.birth[x[0]]):
            self.sound[i] = not bad and self.sound[self.left[i]] and self.sound[self.right[i]]
        self._trie(vocab, {c: b for b, c in enumerate(letters)})
        self.known = Known(self.cutter, self.encode_words, keep)
        self.decimals = pa.array([f"{i} " for i in range(size)], pa.string())
        self.spelled = pa.array([f"{name} " for name in self.names], pa.string())

    def _hash(self) -> None:
        """An open table of the merges: a pair is found with one or two looks."""
        bits = int(self.size * 4).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, dtype=np.int64)
        self.entry = np.zeros(1 << bits, dtype=np.int64)
        left = np.arange(len(self.keys))
        at = self._slot(self.keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.table[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.table[at[put]], self.entry[at[put]] = self.keys[put], put
            left = np.setdiff1d(left, put)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _find(self, want: np.ndarray) -> np.ndarray:
        """Index of each pair among the merges, or -1."""
        at = self._slot(want)
        seen = self.table[at]
        out = np.where(seen == want, self.entry[at], -1)
        on = np.flatnonzero((seen != want) & (seen >= 0))
        while len(on):
            at[on] = (at[on] + 1) & self.mask
            seen = self.table[at[on]]
            hit = seen == want[on]
            out[on[hit]] = self.entry[at[on[hit]]]
            on = on[~hit & (seen >= 0)]
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self._find(a * self.size + b)
        return np.where(found >= 0, self.key_ranks[found], _FAR)

    def _trie(self, vocab: dict[str, int], byte_of: dict[str, int]) -> None:
        """Tokens as a trie over bytes: ``child`` by node and byte, and the token that ends at a node."""
        nodes: dict[tuple[int, int], int] = {}
        inner, final = [-1], [-1]
        for name, i in vocab.items():
            node, ends = 0, name.endswith(self.suffix) and name != self.suffix
            for c in name[: -len(self.suffix)] if ends else name:
                key = (node, byte_of[c])
                node = nodes.get(key)
                if node is None:
                    node = nodes[key] = len(inner)
                    inner.append(-1)
                    final.append(-1)
            (final if ends else inner)[node] = i
        parents = sorted({p for p, _ in nodes})
        row = np.full(len(inner), -1, dtype=np.int32)
        row[parents] = np.arange(len(parents))
        self.row, self.ends_inner, self.ends_final = row, np.array(inner, np.int32), np.array(final, np.int32)
        self.child = np.full((len(parents), 256), -1, dtype=np.int32)
        edges = np.array([(p, b, c) for (p, b), c in nodes.items()], dtype=np.int64)
        self.child[row[edges[:, 0]], edges[:, 1]] = edges[:, 2]

    def _clash(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether a merge across the border comes before those of both sides.

        The two sides are unmade step by step, the latest merge first.  A
        crossing merge wins if it comes before the left neighbour's own next
        merge, or not after the right one's: equal merges go from the left.
        ``until`` is the rank at which the pair itself is meant to merge.
        """
        bad = np.zeros(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        end_a = np.full(len(a), _FAR - 1) if until is None else until.copy()
        end_b = end_a.copy()
        while len(live):
            rank = self._rank(a, b)
            hit = (rank < end_a) & (rank <= end_b) & (rank < _FAR)
            if until is not None:
                hit &= rank < until[live]
            bad[live[hit]] = True
            on_left = self.birth[a] > self.birth[b]
            on = ~hit & (np.maximum(self.birth[a], self.birth[b]) >= 0)
            end_a = np.where(on_left, self.birth[a], end_a)[on]
            end_b = np.where(on_left, end_b, self.birth[b])[on]
            a, b = np.where(on_left, self.right[a], a)[on], np.where(on_left, b, self.left[b])[on]
            live = live[on]
        return bad

    def propose(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words side by side: tokens and their words.

        The tokens of a word are in order; one that gets stuck has a -1.
        """
        tokens, owners = [], []
        live, at, stops = np.arange(len(starts)), starts.copy(), stops.copy()
        while len(live):
            best = np.full(len(live), -1, dtype=np.int64)
            reach = at.copy()
            going, node, q = np.arange(len(live)), np.zeros(len(live), dtype=np.int64), at.copy()
            while len(going):
                node = self.child[self.row[node], data[q]]
                ok = node >= 0
                going, node, q = going[ok], node[ok], q[ok] + 1
                full = q == stops[going]
                found = np.where(full, self.ends_final[node], self.ends_inner[node])
                hit = found >= 0
                best[going[hit]], reach[going[hit]] = found[hit], q[hit]
                on = ~full & (self.row[node] >= 0)
                going, node, q = going[on], node[on], q[on]
            tokens.append(best)
            owners.append(live)
            on = (best >= 0) & (reach < stops)
            live, at, stops = live[on], reach[on], stops[on]
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(tokens)[order], owner[order]

    def merge(self, sym: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of words side by side, from their letters: tokens and their words.

        In each round every word merges its pair of least rank, the leftmost of
        equals; a word without a pair is done.
        """
        done_ids, done_owner = [], []
        rank, made = self._pairs(sym, owner, np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank * len(sym) + np.arange(len(sym)), first)
            ends = np.r_[first[1:], len(sym)]
            done = best // len(sym) >= _FAR
            over = np.repeat(done, ends - first)
            done_ids.append(sym[over])
            done_owner.append(owner[over])
            at = best[~done] % len(sym)
            sym[at] = made[at]
            stay = ~over
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            sym, owner, rank, made, at = sym[stay], owner[stay], rank[stay], made[stay], moved[at]
            fresh = np.r_[at, at[at > 0] - 1]
            rank[fresh], made[fresh] = self._pairs(sym, owner, fresh)
        return np.concatenate(done_ids), np.concatenate(done_owner)

    def _pairs(self, sym: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs that begin at ``at``."""
        nxt = np.minimum(at + 1, len(sym) - 1)
        found = self._find(sym[at] * self.size + sym[nxt])
        found[(nxt == at) | (owner[nxt] != owner[at])] = -1
        return np.where(found >= 0, self.key_ranks[found], _FAR), np.where(found >= 0, self.key_made[found], 0)

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merging of one long word with a heap of its pairs."""
        sym = [*self.inner[list(word[:-1])].tolist(), int(self.final[word[-1]])]
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap = [(found[0], i, a, b) for i, (a, b) in enumerate(zip(sym, sym[1:])) if (found := self.ranks.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= len(sym) or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = self.ranks[a, b][1], -1, after[j]
            if after[i] < len(sym):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(sym):
                    found = self.ranks.get((sym[k], sym[after[k]]))
                    if found:
                        heapq.heappush(heap, (found[0], k, sym[k], sym[after[k]]))
        return [s for s in sym if s >= 0]

    def speculate(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Proposed tokens, their words, and which words fail the verification."""
        data = np.frombuffer(b"".join(words), np.uint8)
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        flat, owner = self.propose(data, np.r_[0, stops[:-1]], stops)
        wrong = np.zeros(len(words), dtype=bool)
        wrong[owner[(flat < 0) | ~self.sound[flat]]] = True
        same = (owner[1:] == owner[:-1]) & ~wrong[owner[1:]]
        pairs, back = np.unique(flat[:-1][same] * self.size + flat[1:][same], return_inverse=True)
        if len(pairs):
            wrong[owner[1:][same][self._clash(pairs // self.size, pairs % self.size)[back]]] = True
        return flat, owner, wrong

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and the number of each one's ids."""
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int32)
        flat, owner, wrong = self.speculate(words)
        good = ~wrong[owner]
        ids, owners = [flat[good]], [owner[good]]
        spans = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero(wrong & (spans <= LONG_WORD))
        if len(short):
            data = np.frombuffer(b"".join(map(words.__getitem__, short.tolist())), np.uint8)
            sym, last = self.inner[data], np.cumsum(spans[short]) - 1
            sym[last] = self.final[data[last]]
            merged, of = self.merge(sym, np.repeat(short, spans[short]))
            ids.append(merged)
            owners.append(of)
        for i in np.flatnonzero(wrong & (spans > LONG_WORD)).tolist():
            ids.append(np.array(self.merge_long(words[i])))
            owners.append(np.full(len(ids[-1]), i))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(ids)[order].astype(np.int32), np.bincount(owner, minlength=len(words)).astype(np.int32)

    def encode(self, text: str) -> list[int]:
        return [i for group in self.cutter.groups([text]) for i in self.known.flat([p for _, p, _ in group])[0].tolist()]

    def decode(self, ids: list[int]) -> str:
        """Names of the tokens joined by a space: the file has no decoder."""
        return " ".join(self.names[i] for i in ids)

    def rest(self) -> None:
        """Let go of the known words: an idle worker shouldn't hold them."""
        self.known.clear()


_LOADED: dict[str, SpeculativeBpe] = {}


def load(spec: str, found: Tables) -> SpeculativeBpe:
    """The tokenizer of a worker process, made once for each file."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = SpeculativeBpe(spec, found)
    return _LOADED[key]


class _Text:
    """What is asked for of one text, from the ids of its parts."""

    def __init__(self, codec: SpeculativeBpe, ids: bool, decoded: bool, digests: bool):
        self.codec, self.n = codec, 0
        self.ids = [] if ids else None
        self.names = [] if decoded else None
        self.digests = (hashlib.sha256(), hashlib.sha256()) if digests else None

    def add(self, ids: np.ndarray, decimal: memoryview, names: memoryview) -> None:
        """Take a part; both views hold its tokens, each followed by a space."""
        if not len(ids):
            return
        gap = b" " if self.n else b""
        self.n += len(ids)
        if self.ids is not None:
            self.ids.append(ids)
        if self.names is not None:
            self.names += [gap, bytes(names[:-1])]
        for digest, view in zip(self.digests or (), (decimal, names)):
            digest.update(gap)
            digest.update(view[:-1])


def _views(strings: pa.StringArray, ids: np.ndarray, ends: list[int]) -> list[memoryview]:
    """The strings of all ids written one after another, a view for each run of ids."""
    if not len(ids):
        return [memoryview(b"")] * len(ends)
    taken = strings.take(pa.array(ids))
    places = np.frombuffer(taken.buffers()[1], np.int32)
    stops = places[np.array([0, *ends])].tolist()
    whole = memoryview(taken.buffers()[2])
    return [whole[a:b] for a, b in zip(stops, stops[1:])]


def encoded(codec: SpeculativeBpe, texts: list[str], ids: bool, decoded: bool, digests: bool) -> Iterator[_Text]:
    """The texts in order, each encoded and decoded as asked for."""
    text = None
    for group in codec.cutter.groups(texts):
        flat, stops = codec.known.flat([part for _, part, _ in group])
        ends = stops.tolist()
        none = [memoryview(b"")] * len(ends)
        decimal = _views(codec.decimals, flat, ends) if digests else none
        names = _views(codec.spelled, flat, ends) if digests or decoded else none
        for (_, _, last), lo, hi, dec, name in zip(group, [0, *ends], ends, decimal, names):
            text = text or _Text(codec, ids, decoded, digests)
            text.add(flat[lo:hi], dec, name)
            if last:
                yield text
                text = None


def bpe(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids: bool = True, decoded: bool = True, digests: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns the columns of ``docs`` without the text, then ``n_tokens`` (long),
    ``ids`` (array of int), ``decoded`` (string) and, with ``digests``,
    ``ids_sha256`` and ``decoded_sha256``; input columns of these names are
    replaced.  ``ids`` and ``decoded`` can be left out, where only digests are
    wanted.

    Null text is empty, and empty text has no tokens.  Texts of any length are
    taken whole, in parts of a million code points.  Rows are independent:
    repeated rows give repeated rows, and an empty table gives an empty one.  A
    tokenizer file of another form than ``unlike`` accepts raises a
    ``ValueError`` here, on the driver.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    reason = unlike(json.loads(text))
    if reason:
        raise ValueError(f"{tokenizer_path}: {reason}")
    spec = spark.sparkContext.broadcast((text, tables()))
    added = {"n_tokens": ("long", pa.int64())}
    added |= {"ids": ("array<int>", pa.list_(pa.int32()))} if ids else {}
    added |= {"decoded": ("string", pa.string())} if decoded else {}
    added |= {"ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())} if digests else {}
    rest = [c for c in docs.columns if c not in added and c != text_col]
    chosen = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("__b_text"), *rest)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest), *(f"{k} {v[0]}" for k, v in added.items())])

    def run(batches):
        codec = load(*spec.value)
        for whole in batches:
            for batch in slices(whole, 0, 4096, 4_000_000):
                out: dict[str, list] = {k: [] for k in added}
                for made in encoded(codec, batch.column(0).to_pylist(), ids, decoded, digests):
                    out["n_tokens"].append(made.n)
                    if ids:
                        out["ids"] += made.ids
                    if decoded:
                        out["decoded"].append(b"".join(made.names))
                    if digests:
                        out["ids_sha256"].append(made.digests[0].hexdigest())
                        out["decoded_sha256"].append(made.digests[1].hexdigest())
                cols = {k: pa.array(v, added[k][1]) for k, v in out.items() if k != "ids"}
                if ids:
                    ends = np.cumsum([0, *out["n_tokens"]]).astype(np.int32)
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *out["ids"]])))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(cols[k] for k in added)], names=[*rest, *added])
        codec.rest()

    return chosen.mapInArrow(run, schema)


def word_bpe_path() -> str:
    """Where the word-level tokenizer of the registered queries lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole ``documents``, encoded and decoded, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe(docs, word_bpe_path(), ids=False, decoded=False, digests=True)
