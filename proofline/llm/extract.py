"""Main text of HTML pages by a recurrent labeller of blocks.

A page becomes a sequence of leaf blocks: runs of text between block-level tags, scripts, styles, comments and what a head may hold left out. Each block has a
vector: the sum of learned vectors of the tags, classes and ids above it (hashed), the mean of learned vectors of its words
(hashed), and a few measures. A bidirectional LSTM in numpy reads the whole sequence and labels every block main text or not.

It is trained here, in a few seconds, on pages that a seeded generator composes of menus, headers, notices, adverts, sidebars,
forms, articles, reader comments and footers in many layouts, whose labels are known; its weights stand beside this module (`python -m proofline.llm.extract` learns and writes them).
It is applied in tasks, batch by batch.
"""

from __future__ import annotations

import html
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cuts

# Elements of HTML by how they are read.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input picture source "
    "math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is taken up to their own end tag as it stands. Without one, script and style take the rest of the page, the others nothing but the tag itself.
RAW = frozenset("script style textarea title".split())
REST = frozenset({"script", "style"})
#: What stands in them is left out if their own end tag closes them; where an element around them ends first, or the page, only their tag is left out.
OUT = frozenset("template noscript svg iframe object select button".split())
#: None of these holds another of its name: where one begins, the one before it had no end tag.
SINGLE = frozenset({"noscript", "select", "button"})
#: An open element of these ends where another of the same group begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: A quoted value stands behind =, and before white space, / or > if it has a < in it. Any other quote is a character like others, so that one without a partner takes no text with it.
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"<]*+"|"[^"]*+"(?=[\s/>])|'[^'<]*+'|'[^']*+'(?=[\s/>]))|=)*+)>|[^<]+|<""", re.S)
_UNQUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW}
_LEFT_OUT = re.compile(rf"<(?:{'|'.join(sorted(OUT))})(?=[\s/>])", re.I | re.A)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"\w+|[^\w\s]")
_PART = re.compile(r"[a-z]+|[0-9]+")

PATH_SLOTS, WORD_SLOTS, EMBED, MEASURES, HIDDEN = 512, 1024, 12, 8, 16
INPUT = 2 * EMBED + MEASURES
#: Generated pages to learn from, passes over them, pages of a step.
PAGES, EPOCHS, STEP_PAGES = 1000, 8, 16
CACHE = 100_000


@dataclass
class Block:
    text: str
    path: frozenset[int]  # slots of the tags and name parts above it
    linked: int  # characters inside links


class _Path:
    """Slots of open elements: those of an element and of all above it. Paths with the same slots are one object, so that what they take is bounded by the slots, not by the depth."""

    known: dict[frozenset[int], _Path] = {}

    def __init__(self, slots: frozenset[int]):
        self.slots, self.inner, self.blocks = slots, {}, {}

    @classmethod
    def of(cls, slots: frozenset[int]) -> _Path:
        if (found := cls.known.get(slots)) is None:
            if len(cls.known) >= CACHE:
                cls.known.clear()
            found = cls.known[slots] = cls(slots)
        return found

    def within(self, tag: str, names: str) -> _Path:
        """The path of an element that stands here."""
        if (found := self.inner.get((tag, names))) is None:
            if len(self.inner) >= CACHE // 100:
                self.inner.clear()
            found = self.inner[tag, names] = _Path.of(self.slots | {_slot(f"t {tag}"), *(_slot(f"n {p}") for p in _PART.findall(names))})
        return found

    def block(self, tag: str | None) -> frozenset[int]:
        """The slots of a block whose innermost element has this tag, which counts again as such."""
        if (found := self.blocks.get(tag)) is None:
            if len(self.blocks) >= CACHE // 100:
                self.blocks.clear()
            found = self.blocks[tag] = self.slots | {_slot(f"in {tag}")} if tag else self.slots
        return found


def _slot(item: str) -> int:
    return zlib.crc32(item.encode("utf-8", "surrogatepass")) % PATH_SLOTS


def _tokens(page: str, left_out: dict[int, int]) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, text or "", tag with a / in front if it is an end tag, attributes) of a page in order; raw contents and comments are passed over.

    left_out: where elements that are left out begin and end. Each character is looked at a bounded number of times: a tag whose quotes run to the end of the page ends
    at the next > instead, as do all tags behind it.
    """
    at, size = 0, len(page)
    last_end = page.rfind(">")
    quotes = True
    unclosed: set[str] = set()  # raw elements that have no end tag from here on
    while at < size:
        start = at
        if at in left_out:
            at = left_out[at]
            yield start, at, " ", "", ""
            continue
        tag = page[at] == "<" and page[at + 1 : at + 2] not in ("!", "?")
        if tag and at > last_end:
            yield start, size, page[at:], "", ""
            return
        m = _TOKEN.match(page, at) if quotes or not tag else _UNQUOTED.match(page, at)
        if tag and quotes and m[2] is None and (plain := _UNQUOTED.match(page, at)):
            quotes, m = False, plain
        if m is None:
            at += 1
            yield start, at, "<", "", ""
            continue
        at += len(m[0])
        if m[2] is None:
            if m[0][0] != "<" or m[0] == "<":
                yield start, at, m[0], "", ""
            continue
        name = m[2].lower()
        if name in RAW and not m[1]:
            end = None if name in unclosed or m[3].endswith("/") else _ENDS[name].search(page, at)
            if end:
                at = page.find(">", end.start()) + 1 or size
            elif name in REST and not m[3].endswith("/"):
                at = size
            else:
                unclosed.update({name} - REST if not m[3].endswith("/") else ())
            yield start, at, " ", "", ""
        else:
            yield start, at, "", m[1] + name, m[3]


def _spans_left_out(page: str) -> dict[int, int]:
    """Start and end of each element of OUT that its own end tag closes, outermost ones first met."""
    out: dict[int, int] = {}
    if not _LEFT_OUT.search(page):
        return out
    stack: list[tuple[str, int]] = []
    open_: dict[str, int] = {}

    def pop() -> tuple[str, int]:
        top = stack.pop()
        open_[top[0]] -= 1
        return top

    for start, end, _, tag, attributes in _tokens(page, {}):
        name = tag.lstrip("/")
        # A paragraph's end tag is often left away, and ends nothing around it.
        if not tag or name in INLINE or name in VOID or name == "p":
            continue
        if tag[0] != "/":
            if attributes.endswith("/"):
                if name in OUT:
                    out[start] = end
                continue
            if name in SINGLE and open_.get(name):
                while pop()[0] != name:
                    pass
            stack.append((name, start))
            open_[name] = open_.get(name, 0) + 1
        elif open_.get(name):
            while (top := pop())[0] != name:
                pass
            if name in OUT:
                out[top[1]] = end
    return out


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order, character references decoded, white space made single. A page cut off anywhere is read as far as it goes.

    What a head may hold has no text, and anything else ends it, so that it needs no end: its tags are read over. The time that it takes grows with the page and
    not faster, whatever is nested, unclosed or unpaired in it.
    """
    out: list[Block] = []
    stack: list[tuple[str, _Path]] = []
    open_: dict[str, int] = {}
    parts: list[str] = []
    links = linked = 0
    root = _Path.of(frozenset())

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1][1].block(stack[-1][0]) if stack else root.slots, linked))
            parts.clear()
        linked = 0

    def pop() -> str:
        name = stack.pop()[0]
        open_[name] -= 1
        return name

    for _, _, piece, tag, attributes in _tokens(page, _spans_left_out(page)):
        if not tag:
            text = html.unescape(piece) if "&" in piece else piece
            parts.append(text)
            linked += len(text) * (links > 0)
        elif tag[0] == "/":  # an end tag
            name = tag[1:]
            if name == "a":
                links = 0
            elif name in INLINE or name in OUT:
                pass
            elif name == "p" and not open_.get("p"):
                close()
            elif open_.get(name):
                close()
                while pop() != name:
                    pass
                links = 0
        elif tag in OUT:
            parts.append(" ")
        elif tag in INLINE:
            if tag == "a":
                links = 1
            elif tag in ("br", "img", "input", "mtd"):
                parts.append(" ")
        else:
            close()
            for group in (CLOSES.get(tag, ()), ("p",)):
                if group and any(t in group for t, _ in stack[-3:]):
                    while stack and stack[-1][0] in group:
                        pop()
            links = 0
            if tag not in VOID and not attributes.endswith("/") and tag not in ("html", "head", "body"):
                names = " ".join("".join(g) for g in _NAMES.findall(attributes)).lower() if "=" in attributes else ""
                stack.append((tag, (stack[-1][1] if stack else root).within(tag, names)))
                open_[tag] = open_.get(tag, 0) + 1
    close()
    return out


class _Slots(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        at = self[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_SLOTS
        return at


@dataclass
class Page:
    """Blocks as numbers: path slots and word slots with the block that each belongs to, and the measures."""

    paths: np.ndarray
    path_block: np.ndarray
    words: np.ndarray
    word_block: np.ndarray
    n_words: np.ndarray
    measures: np.ndarray


def numbered(blocks: list[Block], slots: _Slots, paths: dict[frozenset[int], np.ndarray]) -> Page:
    n = len(blocks)
    words, own, measures = [], [], np.zeros((n, MEASURES))
    for i, b in enumerate(blocks):
        if b.path not in paths:
            if len(paths) >= CACHE:
                paths.clear()
            paths[b.path] = np.array(sorted(b.path), np.int64)
        found = _WORD.findall(b.text)
        words.append(np.fromiter(map(slots.__getitem__, found), np.int64, len(found)))
        own.append(paths[b.path])
        size = len(b.text)
        measures[i] = (np.log1p(size) / 6, min(1.0, b.linked / size), np.log1p(len(found)) / 5, b.text[-1] in ".!?", i / n, (n - i) / n, sum(map(b.text.count, ".,")) / (len(found) + 1), 1.0)
    count = np.array([len(w) for w in words], np.int64)
    return Page(np.concatenate(own), np.repeat(np.arange(n), [len(p) for p in own]), np.concatenate(words), np.repeat(np.arange(n), count), count, measures)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The network: learned vectors of paths and words, one LSTM in each direction, and a logistic output that also sees the block's own vector."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.weights = {
            "path": rng.normal(0, 0.1, (PATH_SLOTS, EMBED)),
            "word": rng.normal(0, 0.1, (WORD_SLOTS, EMBED)),
            "out": rng.normal(0, 0.1, 2 * HIDDEN + INPUT),
            "bias": np.zeros(1),
        }
        for d in "fb":
            self.weights[f"x{d}"] = rng.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * HIDDEN))
            self.weights[f"h{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.weights[f"c{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)

    def inputs(self, page: Page) -> np.ndarray:
        n = len(page.n_words)
        out = np.zeros((n, INPUT))
        for k, (slots, block, table) in enumerate(((page.paths, page.path_block, "path"), (page.words, page.word_block, "word"))):
            # Sums by block through counts of slots: a block's words are many, its slots few.
            rows, counts = np.unique(block * (1 << 20) + slots, return_counts=True)
            vectors = self.weights[table][rows % (1 << 20)] * counts[:, None]
            owner = rows >> 20
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            if len(starts):
                out[owner[starts], k * EMBED : (k + 1) * EMBED] = np.add.reduceat(vectors, starts)
        out[:, EMBED : 2 * EMBED] /= np.maximum(page.n_words, 1)[:, None]
        out[:, 2 * EMBED :] = page.measures
        return out

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states of one direction over (steps, pages, INPUT); past a page's end the state stands still."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        out, trace = np.zeros((steps, pages, HIDDEN)), []
        ahead = x @ self.weights[f"x{d}"] + self.weights[f"c{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = ahead[t] + h @ self.weights[f"h{d}"]
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 3 * HIDDEN :])
            g = np.tanh(z[:, 2 * HIDDEN : 3 * HIDDEN])
            m = mask[t][:, None]
            new_c = np.where(m, f * c + i * g, c)
            tanh_c = np.tanh(new_c)
            new_h = np.where(m, o * tanh_c, h)
            if keep:
                trace.append((t, i, f, g, o, c, h, tanh_c, m))
            h, c = new_h, new_c
            out[t] = h
        return out, trace

    def _padded(self, pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(p.n_words) for p in pages)
        x, mask = np.zeros((steps, len(pages), INPUT)), np.zeros((steps, len(pages)), bool)
        for k, p in enumerate(pages):
            n = len(p.n_words)
            x[:n, k], mask[:n, k] = self.inputs(p), True
        return x, mask

    def label(self, pages: list[Page]) -> list[np.ndarray]:
        """For each page whether each block is main text. Pages of like length go through together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if len(p.n_words)), key=lambda k: len(pages[k].n_words))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < 128 and (hi + 1 - lo) * len(pages[order[hi]].n_words) <= 32_768:
                hi += 1
            x, mask = self._padded([pages[k] for k in order[lo:hi]])
            states = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"] + [x], 2)
            main = states @ self.weights["out"] + self.weights["bias"] > 0
            for k, which in enumerate(order[lo:hi]):
                out[which] = main[: len(pages[which].n_words), k]
            lo = hi
        return out

    def gradients(self, pages: list[Page], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Of the mean log-loss over the blocks of some pages, by backpropagation through both directions."""
        x, mask = self._padded(pages)
        y = np.zeros(mask.shape)
        for k, own in enumerate(labels):
            y[: len(own), k] = own
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0], x], 2)
        error = np.where(mask, _sigmoid(states @ self.weights["out"] + self.weights["bias"]) - y, 0.0) / mask.sum()
        grads = {"out": np.einsum("tp,tps->s", error, states), "bias": error.sum(keepdims=True).reshape(1)}
        back = error[:, :, None] * self.weights["out"]
        dx = back[:, :, 2 * HIDDEN :].copy()
        for k, d in enumerate("fb"):
            dh_out = back[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            dz_all = np.zeros((*mask.shape, 4 * HIDDEN))
            dh_next, dc_next = np.zeros_like(dh_out[0]), np.zeros_like(dh_out[0])
            gh = np.zeros_like(self.weights[f"h{d}"])
            for t, i, f, g, o, c, h, tanh_c, m in reversed(runs[d][1]):
                dh = dh_next + dh_out[t]
                dc = dc_next + np.where(m, dh * o * (1 - tanh_c**2), 0.0)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dc * i * (1 - g**2), dh * tanh_c * o * (1 - o)], 1) * m
                dz_all[t] = dz
                gh += h.T @ dz
                dh_next = np.where(m, dz @ self.weights[f"h{d}"].T, dh)
                dc_next = np.where(m, dc * f, dc)
            grads[f"x{d}"] = np.einsum("tpi,tpz->iz", x, dz_all)
            grads[f"h{d}"], grads[f"c{d}"] = gh, dz_all.sum((0, 1))
            dx += dz_all @ self.weights[f"x{d}"].T
        grads["path"], grads["word"] = np.zeros_like(self.weights["path"]), np.zeros_like(self.weights["word"])
        for k, p in enumerate(pages):
            own = dx[: len(p.n_words), k]
            np.add.at(grads["path"], p.paths, own[p.path_block, :EMBED])
            mean = own[:, EMBED : 2 * EMBED] / np.maximum(p.n_words, 1)[:, None]
            np.add.at(grads["word"], p.words, mean[p.word_block])
        return grads

    def fit(self, pages: list[Page], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.02, seed: int = 3) -> Labeller:
        """Adam over shuffled steps of STEP_PAGES pages; the rate falls to a tenth."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(w) for k, w in self.weights.items()}
        second = {k: np.zeros_like(w) for k, w in self.weights.items()}
        steps = epochs * -(-len(pages) // STEP_PAGES)
        n = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for lo in range(0, len(pages), STEP_PAGES):
                pick = order[lo : lo + STEP_PAGES]
                n += 1
                for k, g in self.gradients([pages[i] for i in pick], [labels[i] for i in pick]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    step = rate * (1 - 0.9 * n / steps) * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)
                    self.weights[k] -= step
        return self


# What the generated pages name their parts, and words that stand in them.
_PARTS = {
    "menu": ("nav|div|ul|header", "nav menu navbar navigation topnav main-menu site-nav breadcrumb breadcrumbs pagination pager toc skip-link tabs", "home about contact archive next previous login menu search more"),
    "header": ("header|div", "header site-header masthead page-header topbar brand logo banner-top tagline", "welcome daily news official site"),
    "notice": ("div|section|aside|p", "notice cookie cookies consent gdpr alert cookie-banner privacy-notice popup modal overlay message paywall disclaimer", "we use cookies accept consent privacy policy settings agree subscribe to continue"),
    "advert": ("div|aside|ins|section|p", "ad ads advert advertisement sponsored sponsor promo promotion banner adsbygoogle ad-slot ad-container commercial outbrain", "advertisement sponsored buy now offer sale discount shop"),
    "sidebar": ("aside|div|section", "sidebar aside widget related related-posts recommended popular trending recent-posts tags tag-cloud most-read rail secondary author-bio share social sharing", "related popular recent also read more share follow tweet"),
    "form": ("form|div|section", "form newsletter subscribe signup sign-up search search-form login contact-form mailing-list", "email name subscribe sign up send password search your"),
    "comments": ("section|div|ol|ul|aside", "comments comment comment-list comment-body respond reply replies discussion disqus user-comments reader-comments thread responses", "reply says comment posted ago thanks great i think agree anonymous user"),
    "footer": ("footer|div", "footer site-footer page-footer bottom copyright colophon legal credits footer-links foot", "copyright all rights reserved terms privacy imprint © 2024 powered by ·"),
}
_MAIN = ("article|main|div|section|article", "article content post entry main story body text post-content entry-content article-body page-content main-content story-body prose", "")


class _Generator:
    """Composes pages with known labels."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        syllables = [a + b for a in ("b", "th", "r", "st", "m", "n", "l", "ch", "d", "é", "sch", "ñ", "") for b in ("a", "e", "on", "er", "ing", "ou", "ä", "io")]
        self.lexicon = ["".join(self.rng.choice(syllables, self.rng.integers(1, 4))) or "a" for _ in range(3000)]

    def pick(self, items):
        items = items.split("|") if isinstance(items, str) else items
        return items[self.rng.integers(len(items))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def prose(self, n: int, some: str = "") -> str:
        words = [self.pick(self.lexicon) for _ in range(n)]
        if some:
            own, share = some.split(), self.rng.random() * 0.8
            words = [self.pick(own) if self.chance(share) else w for w in words]
        style = self.rng.random()
        if style < 0.08:
            words = [w.upper() + "!!" for w in words]
        elif style < 0.16:
            words = [w + self.pick(["***", "$$$", "###", "%%%", "&amp;"]) for w in words]
        elif style < 0.2:
            words = [x for w in words for x in (w, "|")]
        out, left = [], 0
        for w in words:
            if left <= 0:
                left = int(self.rng.integers(3, 14))
                out.append(w.capitalize())
            else:
                out.append(w)
            left -= 1
            if left == 0 and self.chance(0.9):
                out[-1] += "."
        if self.chance(0.1):
            out.insert(len(out) // 2, self.pick(["<em>x</em>", "<a href='/x'>link</a>", "<b>bold</b>", "&eacute;", "<br>", "\n"]))
        return " ".join(out)

    def named(self, tags: str, names: str, plain: float) -> tuple[str, str]:
        """(start tag, name): an element of a part; plain is the chance that no class or id tells it where its tag does."""
        tag = self.pick(tags)
        telling = tag in ("nav", "header", "footer", "aside", "form", "article", "main", "ins")
        if telling and self.chance(plain):
            return f"<{tag}>", tag
        own = self.pick(names.split(" "))
        extra = self.pick(["", "", " clearfix", " col-md-8", " box", " inner", " x12", " wrapper"])
        return f'<{tag} {self.pick(["class", "class", "id"])}="{own}{extra}">', tag

    def part(self, kind: str) -> list[tuple[str, int]]:
        """Pieces of HTML with their labels; -1: no text."""
        tags, names, some = _PARTS[kind]
        start, tag = self.named(tags, names, 0.6)
        out = [(start, -1)]
        for _ in range(int(self.rng.integers(1, 2 if tag == "p" else 5))):
            style, inner = self.rng.random(), self.pick("div|div|article|li")
            if tag == "p":
                out.append((self.prose(int(self.rng.integers(2, 16)), some), 0))
            elif kind == "menu" or style < 0.25:
                items = "".join(f'<li><a href="/{i}">{self.prose(int(self.rng.integers(1, 3)), some)}</a></li>' for i in range(int(self.rng.integers(2, 7))))
                out.append((f"<ul>{items}</ul>", 0))
            elif style < 0.35:
                out.append((f"<h3>{self.prose(int(self.rng.integers(1, 5)), some)}</h3>", 0))
            elif style < 0.65 or kind in ("advert", "footer", "header") and style < 0.9:
                out.append((self.prose(int(self.rng.integers(2, 22)), some) + ("" if tag in ("ul", "ol") else self.pick(["", "<br>"])), 0))
                if self.chance(0.6):
                    break
            elif kind == "comments" and style < 0.85:
                out.append((f'<{inner} class="{self.pick(["comment", "comment-body", "reply", "user", "meta"])}"><p>{self.prose(int(self.rng.integers(4, 60)), some)}</p></{inner}>', 0))
            else:
                out.append((f"<p>{self.prose(int(self.rng.integers(3, 40)), some)}</p>", 0))
        return [*out, (f"</{tag}>", -1)]

    def main(self) -> list[tuple[str, int]]:
        tags, names, _ = _MAIN
        out, ends = [], []
        for _ in range(int(self.rng.integers(1, 3))):
            start, tag = self.named(tags, names, 0.5)
            out.append((start, -1))
            ends.append((f"</{tag}>", -1))
        if self.chance(0.75):
            title = self.prose(int(self.rng.integers(1, 14)), self.pick(list(_PARTS.values()))[2] if self.chance(0.3) else "")
            out.append((f"<h1>{title}</h1>", 1))
            if self.chance(0.3):  # some begin with their title once more
                out.append((f"<p>{title}" + self.pick(["</p>", f" {self.prose(20)}</p>"]), 1))
        for k in range(int(self.rng.integers(1, 14))):
            n = int(self.rng.integers(1, 6)) if self.chance(0.25) else int(self.rng.integers(6, 160))
            style = self.rng.random()
            text = self.prose(n)
            if style < 0.7:
                out.append((f"<p>{text}" + ("" if self.chance(0.15) else "</p>"), 1))
            elif style < 0.8:
                out.append((f"<p><b>{text}<br>", 1))
            elif style < 0.86:
                out.append((f"<h2>{self.prose(min(n, 8))}</h2>", 1))
            elif style < 0.92:
                out.append((f"<ul><li>{text}</li><li>{self.prose(4)}</li></ul>", 1))
            elif style < 0.96:
                out.append((f"<blockquote>{text}</blockquote>", 1))
            else:
                out.append((f"<table><tr><td>{self.prose(3)}</td><td>{text}</td></tr></table>", 1))
            if self.chance(0.2):  # articles too speak of rights, comments and offers
                out.append((f"<p>{self.prose(int(self.rng.integers(1, 8)), self.pick(list(_PARTS.values()))[2])}</p>", 1))
            if k and self.chance(0.06):
                out += self.part(self.pick(["advert", "sidebar", "form", "notice"]))
        return out + ends[::-1]

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        parts: list[tuple[str, int]] = []
        bare = self.chance(0.06)
        if not bare:
            for kind, p in (("notice", 0.25), ("header", 0.45), ("menu", 0.8), ("advert", 0.4), ("sidebar", 0.15), ("notice", 0.1)):
                if self.chance(p):
                    parts += self.part(kind)
        if bare and self.chance(0.5):
            parts += [(f"<p>{self.prose(int(self.rng.integers(1, 80)))}</p>", 1) for _ in range(int(self.rng.integers(1, 5)))]
        elif not self.chance(0.04):
            parts += self.main()
        if not bare:
            for kind, p in (("advert", 0.2), ("comments", 0.4), ("form", 0.2), ("sidebar", 0.4), ("menu", 0.15), ("footer", 0.85)):
                if self.chance(p):
                    parts += self.part(kind)
        return parts


def generated(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    """(blocks, labels) of n pages. Each piece is marked by its label's character before it is read, so that the blocks tell theirs."""
    make, out = _Generator(seed), []
    while len(out) < n:
        pieces = make.page()
        marks = {0: "", 1: ""}
        source = "".join(re.sub(r"(>|^)(?=[^<>\s])", lambda m: m[1] + marks[y], piece) if y >= 0 else piece for piece, y in pieces)
        blocks = blocks_of(f"<html><head><title>x</title></head><body>{source}</body></html>")
        labels = np.array(["" in b.text for b in blocks])
        blocks = [Block(" ".join(b.text.replace("", "").replace("", "").split()) or "x", b.path, b.linked) for b in blocks]
        if blocks:
            out.append((blocks, labels))
    return out


@lru_cache(maxsize=1)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 5) -> Labeller:
    slots, paths = _Slots(), {}
    made = generated(pages, seed)
    return Labeller().fit([numbered(b, slots, paths) for b, _ in made], [y for _, y in made], epochs)


#: The weights that trained() gives, kept with the module; a test learns them anew.
WEIGHTS = os.path.join(os.path.dirname(__file__), "labeller.npz")


@lru_cache(maxsize=1)
def kept_labeller() -> Labeller:
    """The trained network, its weights read from WEIGHTS."""
    net = Labeller()
    with np.load(WEIGHTS, allow_pickle=False) as kept:
        net.weights = {k: kept[k] for k in net.weights}
    return net


def main_texts(pages: list[str], labeller: Labeller, slots: _Slots, paths: dict[frozenset[int], np.ndarray]) -> list[str]:
    """The main text of each page: its main blocks in order, joined by spaces."""
    blocks = [blocks_of(p) for p in pages]
    kept = [k for k, b in enumerate(blocks) if b]
    main = labeller.label([numbered(blocks[k], slots, paths) for k in kept])
    out = [""] * len(pages)
    for k, m in zip(kept, main):
        out[k] = " ".join(b.text for b, take in zip(blocks[k], m) if take)
    return out


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """({id_col}, *keep, text): a row for each row of pages.

    A null or empty page, one without text, and one without main text have an empty text. Repeated rows and null ids stay; columns other than keep aren't returned.
    """
    sent = pages.sparkSession.sparkContext.broadcast(kept_labeller())  # of fixed size

    @F.pandas_udf("string")
    def text(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        labeller, slots, paths = sent.value, _Slots(), {}
        for f in frames:
            out: list[str] = []
            for lo, hi in cuts([*map(len, f)], 1 << 20):
                out += main_texts(f.iloc[lo:hi].tolist(), labeller, slots, paths)
            yield pd.Series(out)

    return pages.select(id_col, *keep, text(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))


def op6(pages: DataFrame) -> DataFrame:
    """Every page's main text and its number of code points."""
    return extract_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **trained().weights)
