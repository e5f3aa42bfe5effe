"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks.  A bidirectional LSTM in numpy
reads for each block a vector of its tag path and a vector of its hashed words,
so that every block is judged with the whole document as context.  The network
is trained here, on pages drawn from a seeded generator; nothing is downloaded
or stored.  Pages of a batch run side by side, longest first.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.batches import slices
from marlstone.llm.common import table

_SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "select", "button", "textarea", "object", "canvas"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input br".split())
#: What a start tag closes, and the elements beyond which it closes nothing.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_P_CLOSERS = set("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SCOPE = {"td", "th", "table", "body", "article", "section", "div", "main", "aside", "nav", "blockquote"}


class _Blocks(HTMLParser):
    """Collects (path, text, characters inside links) of the leaf blocks.

    A path lists the names of the open elements with the number of times each
    is open, so that deep nesting of the same elements costs nothing.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.open: dict[str, int] = {}
        self.blocks: list[tuple[tuple[tuple[str, int], ...], str, int]] = []
        self.text: list[str] = []
        self.silent = self.links = self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((tuple(self.open.items()), text, self.linked))
        self.text, self.linked = [], 0

    def _pop(self, k: int) -> None:
        for tag, names in self.stack[k:]:
            self.silent -= tag in _SILENT
            self.links -= tag == "a"
            for name in names if tag not in _INLINE else ():
                self.open[name] -= 1
                if not self.open[name]:
                    del self.open[name]
        del self.stack[k:]

    def _close(self, tags: set[str], scope: set[str]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                return self._pop(k)
            if self.stack[k][0] in scope:
                return None

    def handle_starttag(self, tag, attrs):
        if tag not in _INLINE:
            self.flush()
        elif tag in ("br", "img", "input"):
            self.text.append(" ")
        if tag in _P_CLOSERS:
            self._close({"p"}, _SCOPE)
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if tag == "body":
            self._pop(0)
        if tag in _VOID:
            return
        names = [tag]
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                names += [f"{tag if key == 'role' else ''}.{w}" for w in re.findall(r"[a-z]+", value.lower())]
            elif key in ("hidden", "aria-hidden") and value != "false":
                names.append(".hidden")
        self.silent += tag in _SILENT
        self.links += tag == "a"
        self.stack.append((tag, tuple(names)))
        for name in names if tag not in _INLINE else ():
            self.open[name] = self.open.get(name, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in _INLINE:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                return self._pop(k)
            if tag in _INLINE and self.stack[k][0] not in _INLINE:
                return None
        return None

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def leaf_blocks(html: str) -> list[tuple[tuple[tuple[str, int], ...], str, int]]:
    """Leaf blocks of a page in order; scripts, styles and markup are gone."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


_TAGS, _WORDS, _DIM_T, _DIM_W, _PLAIN, _HIDDEN = 1024, 1024, 16, 8, 4, 12


@lru_cache(20_000)
def _path_ids(path: tuple[tuple[str, int], ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    return tuple(zlib.crc32(t.encode("utf-8", "replace")) % _TAGS for t, _ in path), tuple(n for _, n in path)


def features(blocks: list[tuple[tuple[tuple[str, int], ...], str, int]]) -> list[tuple[tuple[tuple[int, ...], tuple[int, ...]], list[int], list[float]]]:
    """Hashed names of the path with their counts, hashed words of the whole block and plain numbers."""
    out = []
    for path, text, linked in blocks:
        words = text.lower().encode("utf-8", "replace").split()
        out.append((
            _path_ids(path), [h % _WORDS for h in map(zlib.crc32, words)],
            [min(1.0, np.log1p(len(words)) / 6), linked / max(1, len(text)), float(text[-1] in ".!?:;\"'"), 1.0],
        ))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Bidirectional LSTM over blocks; one probability of content for each."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, h = _DIM_T + _DIM_W + _PLAIN, _HIDDEN
        init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"tags": rng.normal(0, 0.3, (_TAGS, _DIM_T)), "words": rng.normal(0, 0.1, (_WORDS, _DIM_W)), "out": init(2 * h + d, 1)[:, 0], "bias": np.zeros(1)}
        for way in "fb":
            self.p |= {f"x{way}": init(d, 4 * h), f"h{way}": init(h, 4 * h), f"c{way}": np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]}

    def _inputs(self, docs: list) -> tuple[np.ndarray, list, np.ndarray]:
        """Padded inputs, longest first; what each place was made of; lengths."""
        n = np.array([len(d) for d in docs])
        x = np.zeros((len(docs), n.max(initial=0), _DIM_T + _DIM_W + _PLAIN))
        flat = [f for d in docs for f in d]
        row, col = np.repeat(np.arange(len(docs)), n), np.concatenate([np.arange(k) for k in n]) if len(n) else np.zeros(0, int)
        parts = []
        tags = [f[0] for f in flat]
        given = (("tags", _DIM_T, [t[0] for t in tags], [n for t in tags for n in t[1]]), ("words", _DIM_W, [f[1] for f in flat], None))
        for name, size, lists, times in given:
            ids = np.fromiter(chain.from_iterable(lists), np.int64)
            owner = np.repeat(np.arange(len(flat)), np.fromiter(map(len, lists), np.int64, len(flat)))
            times = np.ones(len(ids)) if times is None else np.array(times, dtype=float)
            total = np.maximum(1, np.bincount(owner, times, len(flat)))
            weight = times / (np.sqrt(total) if name == "tags" else total)[owner]
            v = np.stack([np.bincount(owner, self.p[name][ids, j] * weight, len(flat)) for j in range(size)], 1)
            x[row, col, (0 if name == "tags" else _DIM_T) : (size if name == "tags" else _DIM_T + _DIM_W)] = v
            parts.append((ids, owner, weight))
        x[row, col, _DIM_T + _DIM_W :] = np.array([f[2] for f in flat]).reshape(-1, _PLAIN)
        return x, [row, col, *parts], n

    def _run(self, x: np.ndarray, n: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states in one direction; documents must come longest first."""
        hid = np.zeros((*x.shape[:2], _HIDDEN))
        h, c = np.zeros((len(x), _HIDDEN)), np.zeros((len(x), _HIDDEN))
        wx, wh, b = self.p[f"x{way}"], self.p[f"h{way}"], self.p[f"c{way}"]
        times = range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1)
        for t in times:
            k = int((n > t).sum())
            z = x[:k, t] @ wx + h[:k] @ wh + b
            i, f, o = (_sigmoid(z[:, j * _HIDDEN : (j + 1) * _HIDDEN]) for j in range(3))
            g = np.tanh(z[:, 3 * _HIDDEN :])
            before = (h[:k].copy(), c[:k].copy()) if keep is not None else None
            c[:k] = f * c[:k] + i * g
            th = np.tanh(c[:k])
            h[:k] = o * th
            hid[:k, t] = h[:k]
            if keep is not None:
                keep.append((t, k, i, f, o, g, th, *before))
        return hid

    def predict(self, docs: list) -> list[np.ndarray]:
        """Probabilities for the feature lists of some pages."""
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        order = [i for i in order if docs[i]]
        out = [np.zeros(0)] * len(docs)
        if order:
            x, _, n = self._inputs([docs[i] for i in order])
            state = np.concatenate([self._run(x, n, "f"), self._run(x, n, "b"), x], 2)
            prob = _sigmoid(state @ self.p["out"] + self.p["bias"])
            for row, i in enumerate(order):
                out[i] = prob[row, : n[row]]
        return out

    def train(self, docs: list, labels: list[np.ndarray], epochs: int = 6, size: int = 40, rate: float = 0.02, seed: int = 3) -> None:
        """Back-propagation through time with Adam."""
        rng, moment, step = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}, 0
        for _ in range(epochs):
            shuffled = rng.permutation(len(docs))
            for at in range(0, len(docs), size):
                chosen = sorted(shuffled[at : at + size], key=lambda i: -len(docs[i]))
                x, made, n = self._inputs([docs[i] for i in chosen])
                row, col = made[:2]
                keep = {"f": [], "b": []}
                state = np.concatenate([self._run(x, n, "f", keep["f"]), self._run(x, n, "b", keep["b"]), x], 2)
                prob = _sigmoid(state @ self.p["out"] + self.p["bias"])
                err = np.zeros(x.shape[:2])
                err[row, col] = (prob[row, col] - np.concatenate([labels[i] for i in chosen])) / len(row)
                grad = {"out": np.einsum("btd,bt->d", state, err), "bias": np.array([err.sum()])}
                back = err[:, :, None] * self.p["out"]
                dx = back[:, :, 2 * _HIDDEN :].copy()
                for way, lo in (("f", 0), ("b", _HIDDEN)):
                    grad |= {f"x{way}": 0.0, f"h{way}": 0.0, f"c{way}": 0.0}
                    dh, dc = np.zeros((len(x), _HIDDEN)), np.zeros((len(x), _HIDDEN))
                    for t, k, i, f, o, g, th, h0, c0 in reversed(keep[way]):
                        d = dh[:k] + back[:k, t, lo : lo + _HIDDEN]
                        e = dc[:k] + d * o * (1 - th * th)
                        dz = np.concatenate([e * g * i * (1 - i), e * c0 * f * (1 - f), d * th * o * (1 - o), e * i * (1 - g * g)], 1)
                        dc[:k] = e * f
                        dh[:k] = dz @ self.p[f"h{way}"].T
                        dx[:k, t] += dz @ self.p[f"x{way}"].T
                        grad[f"x{way}"] = grad[f"x{way}"] + x[:k, t].T @ dz
                        grad[f"h{way}"] = grad[f"h{way}"] + h0.T @ dz
                        grad[f"c{way}"] = grad[f"c{way}"] + dz.sum(0)
                flat = dx[row, col]
                for k, name, lo, dim in ((2, "tags", 0, _DIM_T), (3, "words", _DIM_T, _DIM_W)):
                    ids, owner, weight = made[k]
                    full = flat[owner, lo : lo + dim] * weight[:, None]
                    grad[name] = np.stack([np.bincount(ids, full[:, j], len(self.p[name])) for j in range(dim)], 1)
                step += 1
                for k, v in self.p.items():
                    m, s = moment[k]
                    m += 0.1 * (grad[k] - m)
                    s += 0.01 * (grad[k] ** 2 - s)
                    v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)


#: Names that pages give to parts that are no main text, and words used there.
_PARTS = {
    "nav": ("nav menu navbar navigation breadcrumb breadcrumbs topnav links skip toc pagination pager", "home about contact next previous menu"),
    "header": ("header masthead topbar banner branding logo siteheader search", "search login sign menu"),
    "footer": ("footer bottom copyright legal colophon siteinfo credits", "© copyright rights reserved privacy terms imprint"),
    "aside": ("sidebar aside widget related recommended popular trending rail teaser tags author bio", "related popular more read recent also"),
    "notice": ("notice cookie cookies consent gdpr alert banner popup modal message disclaimer warning toast paywall hidden", "cookies accept consent privacy policy javascript please"),
    "ad": ("ad ads advert advertisement sponsor sponsored promo promotion banner adbox", "advertisement sponsored buy now offer"),
    "form": ("form newsletter subscribe signup login register search contact", "email subscribe name password submit"),
    "comments": ("comments comment discussion responses replies respond reply commentlist disqus", "reply says ago comment comments posted"),
    "share": ("share social sharing buttons follow meta", "share tweet facebook follow print"),
}
_CONTENT = "content article post entry story body main text page articlebody richtext prose"


def training_pages(n: int = 500, seed: int = 11) -> tuple[list, list[np.ndarray]]:
    """Block sequences of generated pages, with 1 for main text."""
    rng = np.random.default_rng(seed)
    pick = lambda s: rng.choice(s.split() if isinstance(s, str) else s)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvzéßñ"), rng.integers(1, 9)))
    pages, labels = [], []
    for _ in range(n):
        blocks: list[tuple[tuple[str, ...], str, int, int]] = []

        def say(k: int, extra: str = "") -> str:
            words = [word() for _ in range(max(1, k))]
            if extra and rng.random() < 0.5:
                words[rng.integers(len(words))] = pick(extra)
            return " ".join(words).capitalize()

        def part(kind: str, inside: tuple[str, ...]) -> None:
            names, words = _PARTS[kind]
            tag = pick({"nav": "nav nav div ul section", "header": "header header div", "footer": "footer footer div", "aside": "aside aside div section ul", "form": "form form div", "comments": "section div ol", "ad": "div div aside section", "notice": "div div p section", "share": "div ul p"}[kind])
            path = (*inside, tag, *([f".{pick(names)}"] if tag in ("div", "ul", "ol", "section", "p") or rng.random() < 0.4 else []))
            links = kind in ("nav", "aside", "header", "share", "footer") and rng.random() < 0.7
            for _ in range(rng.integers(1, 9 if kind in ("nav", "comments", "aside") else 4)):
                leaf = pick("li p div span" if links else "p p div h3 label li span")
                leaf = () if leaf == "span" else (("ul", "li") if leaf == "li" else (leaf,))
                text = say(rng.integers(1, 6) if links else rng.integers(2, 40 if kind in ("comments", "aside", "notice", "ad") else 12), words)
                text += "." if not links and rng.random() < 0.6 else ""
                blocks.append(((*path, *leaf), text, len(text) if links else 0, 0))

        def article(inside: tuple[str, ...]) -> None:
            for _ in range(rng.integers(0, 2)):
                blocks.append(((*inside, "h1"), say(rng.integers(2, 14)), 0, 1))
            for _ in range(int(rng.choice([1, 2, 3, 5, 8, 14, 25]))):
                kind = rng.random()
                text = say(int(rng.choice([1, 1, 2, 4, 8, 15, 30, 60, 120, 300]))) + ("." if rng.random() < 0.85 else "")
                leaf = ("p",) if kind < 0.75 else (pick("h2 h3"),) if kind < 0.82 else ("ul", "li") if kind < 0.88 else ("blockquote", "p") if kind < 0.92 else ("pre",) if kind < 0.94 else ("table", "tr", "td") if kind < 0.97 else ("figure", "figcaption")
                blocks.append(((*inside, *leaf), text, int(rng.random() < 0.1) * len(text) // 2, 1))
                if rng.random() < 0.06:
                    part(pick("ad aside form share notice"), inside)

        top: tuple[str, ...] = ("html", "body")
        if rng.random() < 0.3:
            top = (*top, "div", f".{pick('wrapper container page site layout')}")
        for kind, chance in (("notice", 0.3), ("header", 0.5), ("nav", 0.7), ("ad", 0.4), ("form", 0.15), ("aside", 0.2)):
            if rng.random() < chance:
                part(kind, top)
        style = rng.random()
        if style < 0.6:
            inside = (*top, *(("main",) if rng.random() < 0.3 else ()), "article")
        elif style < 0.75:
            inside = (*top, "main")
        elif style < 0.95:
            inside = (*top, pick("div section"), f".{pick(_CONTENT)}")
        else:
            inside = top
        article(inside)
        if rng.random() < 0.15:
            part("comments", inside)
        for kind, chance in (("share", 0.2), ("aside", 0.4), ("comments", 0.4), ("form", 0.2), ("ad", 0.3), ("nav", 0.2), ("notice", 0.15), ("footer", 0.8)):
            if rng.random() < chance:
                part(kind, top)
        pages.append(features([(tuple(Counter(b[0]).items()), *b[1:3]) for b in blocks]))
        labels.append(np.array([b[3] for b in blocks], dtype=float))
    return pages, labels


@lru_cache(1)
def trained_labeller(n: int = 500) -> BlockLabeller:
    """The labeller, trained once in a process; the same wherever it is made."""
    model = BlockLabeller()
    model.train(*training_pages(n))
    return model


def extract(htmls: list[str | None], model: BlockLabeller, threshold: float = 0.5) -> list[str]:
    """Main texts of some pages: content blocks joined by an empty line."""
    blocks = [leaf_blocks(h or "") for h in htmls]
    found = model.predict([features(b) for b in blocks])
    return ["\n\n".join(b[1] for b, p in zip(bs, ps) if p >= threshold) for bs, ps in zip(blocks, found)]


def extract_pages(pages: DataFrame, model: BlockLabeller, html_col: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` (its code points) to pages, without their html.

    Character references are decoded, white space inside a block is one space,
    blocks stay in page order.  Null and empty html, and pages without main
    text, have empty text.  Input columns named like the new ones are replaced.
    Pages are independent: repeated rows give repeated rows, and an empty table
    gives an empty one.
    """
    rest = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    chosen = pages.select(F.col(html_col).alias("__h_html"), *rest)
    sent = pages.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for c in rest for f in pages.schema if f.name == c), "text string", "n_chars long"])

    def run(batches):
        for whole in batches:
            for part in slices(whole, 0, 128):
                texts = extract(part.column(0).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    return chosen.mapInArrow(run, schema)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), trained_labeller())
