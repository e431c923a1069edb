"""HTML main text by a recurrent block labeller: a bidirectional LSTM in numpy over the leaf blocks of a page."""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.session import ship_package

SAMPLE = 240  # pages that the labeller is fitted on
MOST_CHARS = 200_000  # of a page in the sample
VARIANTS = 8  # rewritten layouts of each of them
HIDDEN = 24  # units a direction
PATH_DIM, WORD_DIM, EXTRA = 24, 12, 6
EPOCHS = 10
WINDOW = 400  # blocks that the recurrent net reads at once; its states go on to the next ones. Training reads no more of a page

# Fixed names of HTML elements.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu "
    "nav noscript ol option p pre section select summary table tbody td tfoot th thead title tr ul button textarea label iframe object video audio template".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style".split())
INLINE_BREAKS = frozenset(["br", "wbr"])
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

_ATTRIBUTES = re.compile(r"""\b(class|id|role|hidden|aria-label)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PIECES = re.compile(r"[a-z0-9]+")


class Path:
    """The words of an element on top of those of the elements around it, which share them: a page with deep nesting holds
    each element's words once, and sums their vectors once. ``new`` are its words that no element around it has."""

    __slots__ = ("above", "words", "new", "size", "distinct", "total")

    def __init__(self, words: tuple[str, ...], above: Path | None, new: tuple[str, ...]):
        self.above, self.words, self.new, self.total = above, words, new, None
        self.size = len(words) + (above.size if above else 0)
        self.distinct = len(new) + (above.distinct if above else 0)

    def __len__(self) -> int:
        return self.size

    def __iter__(self):
        levels, at = [], self
        while at is not None:
            levels.append(at.words)
            at = at.above
        return chain.from_iterable(reversed(levels))

    def __getitem__(self, at):
        return tuple(self)[at]

    def sum(self) -> np.ndarray:
        """The sum of the vectors of all its different words: many elements of one kind say no more than one."""
        open_, at = [], self
        while at is not None and at.total is None:
            open_.append(at)
            at = at.above
        total = at.total if at is not None else np.zeros(PATH_DIM)
        for level in reversed(open_):
            total = level.total = total + _LEVELS[level.new] if level.new else total
        return total


@dataclass
class Block:
    path: tuple[str, ...] | Path  # tag and class words of the elements around it
    text: str
    linked: int  # characters inside links


def _tag_end(page: str, at: int) -> int:
    """Behind the ``>`` that ends the tag at ``at``; a ``>`` in a quoted value without ``<`` does not."""
    end = page.find(">", at)
    if end < 0:
        return -1
    for quote in ('"', "'"):
        if page.count(quote, at, end) % 2 and page.count('="' if quote == '"' else "='", at, end):
            following = page.find("<", end)
            close = page.find(quote, end, following if following > 0 else len(page))
            further = page.find(">", close) if close > 0 else -1
            if further > 0:
                return further + 1
    return end + 1


def _words_of_tag(name: str, rest: str) -> tuple[str, ...]:
    words = [name]
    if rest:
        for key, value in _ATTRIBUTES.findall(rest):
            words += [f".{w}" for w in _PIECES.findall(value.lower())] if key.lower() != "hidden" else [".hidden"]
    return tuple(words)


def leaf_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order: runs of text that no block element begins or ends in.

    Scripts, styles and comments are left out. Unclosed elements end with the elements around them or with the next one
    that closes them; a page cut in the middle of a tag ends there. Nothing is nested in calls, so depth is no matter.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, Path]] = []
    places: dict[str, list[int]] = {}  # of each element name, where it is open on the stack
    held: Counter[str] = Counter()  # words of the open elements
    run: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = "".join(run)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                blocks.append(Block(stack[-1][1] if stack else (), text, linked))
            run.clear()
        linked = 0

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            name, path = stack.pop()
            places[name].pop()
            held.subtract(path.words)

    at, size = 0, len(page)
    while at < size:
        tag = page.find("<", at)
        if tag < 0:
            tag = size
        if tag > at:
            piece = page[at:tag]
            run.append(piece)
            if links:
                linked += len(piece)
        if tag >= size:
            break
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = size if end < 0 else end + 3
            continue
        lead = page[tag + 1 : tag + 2]
        if lead in "!?" and lead:
            end = page.find(">", tag)
            at = size if end < 0 else end + 1
            continue
        closing = lead == "/"
        first = page[tag + 2 : tag + 3] if closing else lead
        if not (first.isascii() and first.isalpha()):
            run.append("<")
            at = tag + 1
            continue
        at = _tag_end(page, tag)
        if at < 0:
            break
        body = page[tag + 1 + closing : at - 1]
        cut = re.match(r"[^\s/>]+", body)
        name = cut[0].lower()
        if name in RAW_TAGS and not closing:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = size if end is None else end.end()
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in BLOCK_TAGS:
            flush()
        elif name in INLINE_BREAKS:
            run.append(" ")
        if name in VOID_TAGS or name not in BLOCK_TAGS:
            continue
        if closing:
            if places.get(name):
                close(places[name][-1])
        else:
            while stack and name in CLOSES and stack[-1][0] in CLOSES[name]:
                close(len(stack) - 1)
            if stack and stack[-1][0] == "p" and name not in CLOSES:
                close(len(stack) - 1)
            words = _words_of_tag(name, body[cut.end() :])
            new = tuple(w for w in dict.fromkeys(words) if not held[w])
            held.update(words)
            places.setdefault(name, []).append(len(stack))
            stack.append((name, Path(words, stack[-1][1] if stack else None, new)))
    flush()
    return blocks


# ---- features -----------------------------------------------------------------------------------

_RNG = np.random.default_rng(99)
_PATH = _RNG.standard_normal((4096, PATH_DIM)).astype(np.float32)
_WORD = _RNG.standard_normal((8192, WORD_DIM)).astype(np.float32)


class _Hashes(dict):
    """Checksums of words, kept for the words a worker has met."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = zlib.crc32(word.encode("utf-8", "replace"))
        return found


_HASHED = _Hashes()


class _Levels(dict):
    """Sums of the vectors of an element's words, kept for the elements a worker has met."""

    def __missing__(self, words: tuple[str, ...]) -> np.ndarray:
        if len(self) > 20_000:
            self.clear()
        total = _PATH[[_HASHED[w] % len(_PATH) for w in words]].sum(axis=0, dtype=np.float64)
        if len(words) <= 40:
            self[words] = total
        return total


_LEVELS = _Levels()


def _sums(words: list[list[str]], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the vectors of each list of words, and the lengths of the lists."""
    sizes = np.array([len(w) for w in words])
    out = np.zeros((len(words), table.shape[1]), np.float32)
    flat = np.fromiter(map(_HASHED.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(sizes.sum())) % len(table)
    ends = np.cumsum(sizes)
    step = 200_000  # words whose vectors are held at once
    for at in range(0, len(flat), step):
        owner = np.searchsorted(ends, np.arange(at, min(len(flat), at + step)), side="right")
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[first]] += np.add.reduceat(table[flat[at : at + step]], first, axis=0)
    return out, np.maximum(sizes, 1)


def features(blocks: list[Block]) -> np.ndarray:
    """Vectors of the blocks: sums of the different hashed tag-path words, means of hashed words, and a few sizes."""
    return page_features([blocks])[0]


def page_features(pages: list[list[Block]]) -> list[np.ndarray]:
    blocks = [b for page in pages for b in page]
    out = np.zeros((len(blocks), PATH_DIM + WORD_DIM + EXTRA), np.float32)
    if blocks:
        words = [b.text.split() for b in blocks]
        total, sizes = _sums([() if isinstance(b.path, Path) else tuple(dict.fromkeys(b.path)) for b in blocks], _PATH)
        for k, b in enumerate(blocks):
            if isinstance(b.path, Path):
                total[k], sizes[k] = b.path.sum(), b.path.distinct
        out[:, :PATH_DIM] = total / np.sqrt(sizes)[:, None]
        total, sizes = _sums(words, _WORD)
        out[:, PATH_DIM : PATH_DIM + WORD_DIM] = total / sizes[:, None]
        chars = np.array([len(b.text) for b in blocks])
        out[:, -6] = np.log1p(chars) / 3
        out[:, -5] = np.log1p(sizes) / 3
        out[:, -4] = np.minimum(1.0, np.array([b.linked for b in blocks]) / chars)
        out[:, -3] = np.concatenate([np.arange(1, len(p) + 1) / max(1, len(p)) for p in pages])
        out[:, -2] = [b.text[-1] in ".!?" for b in blocks]
        out[:, -1] = 1.0
    ends = np.cumsum([len(p) for p in pages])
    return [out[e - len(p) : e] for e, p in zip(ends, pages, strict=True)]


# ---- the recurrent net -----------------------------------------------------------------------------


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """One LSTM layer in each direction and a logistic output for every block."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = (rng.standard_normal((inputs + hidden, 4 * hidden)) / np.sqrt(inputs + hidden)).astype(np.float32)
            self.p[f"c{d}"] = np.concatenate([np.ones(hidden), np.zeros(3 * hidden)]).astype(np.float32)
        self.p["wo"] = (rng.standard_normal((2 * hidden, 1)) / np.sqrt(2 * hidden)).astype(np.float32)
        self.p["co"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, start: tuple[np.ndarray, np.ndarray] | None = None):
        """What each step holds, and the states behind the last one."""
        n, steps, _ = x.shape
        h, c = start or (np.zeros((n, self.hidden), np.float32),) * 2
        states, k = [None] * steps, self.hidden
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = np.concatenate([x[:, t], h], axis=1)
            a = z @ self.p[f"w{d}"] + self.p[f"c{d}"]
            f, i, o, g = _sigmoid(a[:, :k]), _sigmoid(a[:, k : 2 * k]), _sigmoid(a[:, 2 * k : 3 * k]), np.tanh(a[:, 3 * k :])
            m = mask[:, t : t + 1]
            new = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(new)
            states[t] = (z, f, i, o, g, c, tc, m)
            h = m * (o * tc) + (1 - m) * h
            c = new
            states[t] += (h,)
        return states, (h, c)

    def forward(self, x: np.ndarray, mask: np.ndarray):
        sides = [self._run(x, mask, d)[0] for d in "fb"]
        both = np.concatenate([np.stack([s[-1] for s in side], axis=1) for side in sides], axis=2)
        return _sigmoid((both @ self.p["wo"] + self.p["co"])[..., 0]), both, sides

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        out, both, sides = self.forward(x, mask)
        diff = ((out - y) * mask / max(1.0, mask.sum()))[..., None].astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["wo"] = both.reshape(-1, both.shape[2]).T @ diff.reshape(-1, 1)
        grad["co"] = diff.sum(axis=(0, 1))
        d_both = diff @ self.p["wo"].T
        k, steps = self.hidden, x.shape[1]
        for d, states, at in (("f", sides[0], 0), ("b", sides[1], k)):
            dh = dc = np.zeros((len(x), k), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                z, f, i, o, g, c, tc, m, _ = states[t]
                dh = dh + d_both[:, t, at : at + k]
                own = dh * m
                new = dc + own * o * (1 - tc * tc)
                live = new * m
                da = np.concatenate([live * c * f * (1 - f), live * g * i * (1 - i), own * tc * o * (1 - o), live * i * (1 - g * g)], axis=1)
                grad[f"w{d}"] += z.T @ da
                grad[f"c{d}"] += da.sum(axis=0)
                dh = dh * (1 - m) + (da @ self.p[f"w{d}"].T)[:, x.shape[2] :]
                dc = live * f + new * (1 - m)
        return grad

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01, batch: int = 32, seed: int = 3) -> None:
        """Adam over batches of pages of like length."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        parts = [order[i : i + batch] for i in range(0, len(order), batch)]
        step = 0
        for _ in range(epochs):
            for j in rng.permutation(len(parts)):
                x, mask = padded([pages[i] for i in parts[j]])
                y = np.zeros(mask.shape, np.float32)
                for r, i in enumerate(parts[j]):
                    y[r, : len(labels[i])] = labels[i]
                step += 1
                for key, g in self.gradients(x, y, mask).items():
                    m[key] = 0.9 * m[key] + 0.1 * g
                    v[key] = 0.999 * v[key] + 0.001 * g * g
                    self.p[key] -= (rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of each block of each page. Each direction goes over the whole page; it reads ``WINDOW`` blocks
        at a time and takes its states from one such part to the next, so that a long page needs no more memory."""
        both = [np.zeros((len(p), 2 * self.hidden), np.float32) for p in pages]
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        for at in range(0, len(order), 256):
            some = order[at : at + 256]
            parts = range(0, len(pages[some[-1]]), WINDOW)
            for d, col in (("f", 0), ("b", self.hidden)):
                h, c = np.zeros((2, len(some), self.hidden), np.float32)
                for lo in parts if d == "f" else reversed(parts):
                    live = [r for r, i in enumerate(some) if len(pages[i]) > lo]
                    x, mask = padded([pages[some[r]][lo : lo + WINDOW] for r in live])
                    states, (h[live], c[live]) = self._run(x, mask, d, (h[live], c[live]))
                    out = np.stack([s[-1] for s in states], axis=1)
                    for k, r in enumerate(live):
                        own = both[some[r]][lo : lo + WINDOW]
                        own[:, col : col + self.hidden] = out[k, : len(own)]
        return [_sigmoid((b @ self.p["wo"] + self.p["co"])[:, 0]) for b in both]


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max((len(p) for p in pages), default=0)
    x = np.zeros((len(pages), longest, PATH_DIM + WORD_DIM + EXTRA), np.float32)
    mask = np.zeros((len(pages), longest), np.float32)
    for r, p in enumerate(pages):
        x[r, : len(p)] = p
        mask[r, : len(p)] = 1
    return x, mask


# ---- labels for training ----------------------------------------------------------------------------

# Fixed markers: elements and class words that say what a block is on pages that are written with care.
MAIN = frozenset(["article", "main"])
ASIDE = frozenset("nav header footer aside form button select option textarea label menu noscript title head .ad .ads .advert .sponsor .sidebar .cookie .consent .notice .banner .comment .comments .menu .nav .share .related .hidden".split())


def weak_labels(blocks: list[Block]) -> np.ndarray:
    """1 for blocks inside the article element and outside everything that is no article."""
    return np.array([float(bool(MAIN & set(b.path)) and not ASIDE & set(b.path)) for b in blocks], np.float32)


# Fixed wrappers in which the layouts differ: (opening words of the path) for the article, and for what is not.
_ARTICLES = [("article",), ("main", "article"), ("div", ".content"), ("div", ".post", ".body"), ("section", ".entry"), ("div", ".main"), ("td", ".text"), ("div", ".story"), ("div",), ("article", ".post"), ("main",), ("div", ".article", ".body")]
_OTHERS = {
    "head": [("nav", "ul", "li"), ("header", "div"), ("div", ".menu", "ul", "li"), ("header", "nav", "ul", "li"), ("div", ".topbar"), ("ul", ".nav", "li"), ("div", ".breadcrumbs"), ("header", "h1"), ("header", "p")],
    "near": [("div", ".ad"), ("div", ".advert"), ("aside", ".sponsor"), ("div", ".cookie", ".notice"), ("div", ".share", ".buttons"), ("form", ".newsletter", "label"), ("form", "p"), ("div", ".promo"), ("div", ".banner"), ("div", ".notice"), ("form", "button"), ("div", ".alert"), ("div", ".ads", ".sponsored", "p")],
    "tail": [("aside", ".sidebar", "ul", "li"), ("div", ".sidebar", "p"), ("aside", "p"), ("div", ".related", "ul", "li"), ("section", ".comments", "div", ".comment", "p"), ("div", ".comments", "p"), ("ol", ".commentlist", "li", "p"), ("div", ".comment", ".body", "p"), ("section", ".comments", "article", ".comment", "p"), ("div", ".widget", "h3"), ("aside", ".sidebar", "h2"), ("section", ".comments", "h2")],
    "foot": [("footer",), ("footer", "p"), ("div", ".footer", "p"), ("div", ".copyright"), ("footer", "ul", "li"), ("div", ".legal", "small")],
}


# Fixed elements that the blocks of an article may stand in.
_INNER = [("p",), ("ul", "li"), ("ol", "li"), ("ul", "li", "p"), ("blockquote",), ("blockquote", "p"), ("table", "tr", "td"), ("table", "tbody", "tr", "td"), ("table", "tr", "th"), ("pre",), ("h2",), ("h3",), ("dl", "dd"), ("dl", "dt"), ("div",), ("figure", "figcaption"), ("section", "p"), ("section", "h2"), ()]


def rewritten(blocks: list[Block], labels: np.ndarray, rng: random.Random) -> tuple[list[Block], np.ndarray]:
    """The same article in another layout: other elements around it and in it, and other blocks before, within and behind
    it. Some articles have lists, quotes, tables and plain ``div`` text, some are of one kind of block, some are short."""
    article = [b for b, y in zip(blocks, labels, strict=True) if y]
    if rng.random() < 0.25:
        article = article[: rng.randint(1, 3)]
    mixed, only = rng.choice([0.0, 0.3, 0.7]), rng.choice(_INNER) if rng.random() < 0.25 else None
    words = [w for b in blocks for w in b.text.split()] or ["x"]

    def other(kind: str) -> Block:
        path = ("html", "body", *((rng.choice([("div", ".page"), ("div", ".wrap"), ("div",)])) if rng.random() < 0.5 else ()), *rng.choice(_OTHERS[kind]))
        link = rng.random() < (0.8 if "li" in path else 0.2)
        n = rng.randint(1, 4) if link or rng.random() < 0.4 else rng.randint(4, 60 if kind == "tail" else 25)
        at = rng.randrange(len(words))
        text = " ".join((words + words)[at : at + n])
        if kind == "foot" and rng.random() < 0.5:
            text = f"© {text}"
        return Block(path, text, len(text) if link else 0)

    def some(kind: str, most: int) -> list[Block]:
        out = []
        for _ in range(rng.randint(0, most)):
            b = other(kind)
            out += [b] + [Block(b.path, " ".join(rng.choices(words, k=rng.randint(1, 4))), b.linked) for _ in range(rng.randint(1, 6) if b.path[-1] == "li" else 0)]
        return out

    around = ("html", "body", *((rng.choice([("div", ".page"), ("div", ".wrap"), ("div",)])) if rng.random() < 0.5 else ()), *rng.choice(_ARTICLES))
    inside = rng.random() < 0.3
    made: list[tuple[Block, float]] = [(b, 0.0) for b in some("head", 3) + some("near", 2)]
    for k, b in enumerate(article):
        last = b.path[-1:] if b.path and not b.path[-1].startswith(".") and b.path[-1] not in MAIN else ("p",)
        text = b.text
        if only is not None and last == ("p",):
            last = only
        elif rng.random() < mixed:
            last = rng.choice(_INNER)
            if last[-1:] != ("p",) and rng.random() < 0.5:
                text = " ".join(text.split()[: rng.randint(1, 12)])
        made.append((Block((*around, *last), text, min(b.linked, len(text)) if rng.random() < 0.95 else len(text)), 1.0))
        if k + 1 < len(article) and rng.random() < 0.08:
            extra = other("near")
            made.append((Block((*around, *extra.path[-2:]), extra.text, extra.linked) if inside else extra, 0.0))
    made += [(b, 0.0) for b in some("near", 1) + some("tail", 3) + some("foot", 2)]
    return [b for b, _ in made], np.array([y for _, y in made], np.float32)


def fit(pages: DataFrame, sample: int = SAMPLE, variants: int = VARIANTS, most_chars: int = MOST_CHARS) -> Labeller:
    """A labeller fitted on at most ``sample`` pages of at most ``most_chars`` characters, chosen by a hash of their html,
    with their weak labels, and on ``variants`` rewritten layouts of each. The sample comes to the driver, so its bound is
    the product of the two."""
    rows = pages.select(F.col("html").cast("string").alias("html")).filter("html is not null")
    n = rows.count()
    place = F.pmod(F.xxhash64("html"), F.lit(1_000_003)) / F.lit(1_000_003)
    near = rows.filter((place < min(1.0, 2.0 * sample / max(1, n) + 0.001)) & (F.length("html") <= most_chars))
    chosen = near.orderBy(F.xxhash64("html"), "html").limit(sample).collect()
    return fit_pages([r["html"] for r in chosen], variants)


def fit_pages(pages: list[str], variants: int = VARIANTS) -> Labeller:
    rng = random.Random(17)
    x, y = [], []
    for page in pages:
        blocks = leaf_blocks(page)[:WINDOW]
        labels = weak_labels(blocks)
        if not labels.any():
            continue
        x.append(features(blocks))
        y.append(labels)
        for _ in range(variants):
            b, more = rewritten(blocks, labels, rng)
            x.append(features(b[:WINDOW]))
            y.append(more[:WINDOW])
    net = Labeller(PATH_DIM + WORD_DIM + EXTRA)
    net.fit(x, y)
    return net


def extract(pages: DataFrame, net: Labeller, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    The whole page is cut into leaf blocks, the labeller reads the sequence both ways, and the blocks at ``threshold``
    or above are joined by line ends in page order. Null, empty and textless pages have an empty text. Repeated rows
    get equal results; other columns are ignored.
    """
    spark = pages.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                blocks = [leaf_blocks(h or "") for h in part.column(2).to_pylist()]
                marks = shared.value.label(page_features(blocks))
                texts = ["\n".join(x.text for x, m in zip(b, p, strict=True) if m >= threshold) for b, p in zip(blocks, marks, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
