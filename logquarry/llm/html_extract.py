"""HTML extraction: a bidirectional LSTM in numpy labels every block of a page in the context of the whole page.

A page becomes the sequence of its leaf blocks. A block is read as a hashed vector of its tag path (open elements with
the words of their class, id and role), a hashed vector of its words, and a few measures; forward and backward passes
over the sequence give each block the context of the document, and a logistic unit says whether it is main text. The
network is trained here by back-propagation through time on generated pages whose blocks have known labels.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATHS, WORDS, PATH_WIDTH, WORD_WIDTH, MEASURES, HIDDEN = 4096, 32768, 24, 4, 4, 16
#: Pages that are read together, and the blocks that they may have with their padding; a longer page is read alone, whole.
TOGETHER, BLOCKS = 128, 1 << 17

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|textarea|select|iframe|object|title)\b[^>]*+(?:>.*?(?:</(?P=raw)[^>]*+(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[/!?a-z][^>]*+(?:>|\Z)",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop|hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - {"br", "button", "label", "body", "html", "head"}
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Open:
    """An open element: its tag and words, what it is in, and those of its words that no element around it has."""

    __slots__ = ("tag", "words", "parent", "fresh")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Open | None, fresh: tuple[str, ...] | None = None):
        self.tag, self.words, self.parent = tag, words, parent
        self.fresh = tuple(dict.fromkeys(words)) if fresh is None else fresh


class Block:
    """A leaf block: the element that it is in (or its path's words), its text and the share of it that is link."""

    __slots__ = ("element", "text", "link")

    def __init__(self, element: Open | tuple[str, ...] | None, text: str, link: float):
        self.element = Open(element[0], element, None) if isinstance(element, tuple) else element
        self.text, self.link = text, link

    @property
    def path(self) -> tuple[str, ...]:
        """The words of all its open elements, outermost first."""
        found, at = [], self.element
        while at:
            found.append(at.words)
            at = at.parent
        return tuple(w for words in reversed(found) for w in words)


def path_words(tag: str, attrs: str) -> tuple[str, ...]:
    words = [tag]
    if attrs:
        for name, *values in ATTRIBUTE.findall(attrs):
            words += [f"={w}" for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(values)).lower())]
    return tuple(words)


def blocks_of(page: str | None) -> list[Block]:
    """The page's leaf blocks in order: text outside markup, with references decoded and white space runs as one space.

    The stack of open elements is indexed by tag, so that elements close in constant time however deep a page nests.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[Open] = []
    places: dict[str, list[int]] = {}  # where a tag is open
    outer: list[int] = []  # where a block other than p is
    held: set[str] = set()  # the words of all open elements
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(stack[-1] if stack else None, text, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if any(e.tag == "a" for e in stack[-4:]):
                linked += len(text.strip())

    def leave(index: int) -> None:
        while len(stack) > index:
            closed = stack.pop()
            places[closed.tag].pop()
            held.difference_update(closed.fresh)
        while outer and outer[-1] >= index:
            outer.pop()

    def innermost(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        block = tag in BLOCK
        if block:
            flush()
        if m["end"]:
            if (k := innermost(tag)) >= 0:
                leave(k)
        else:
            if tag in CLOSES_P and (k := innermost("p")) >= 0 and k > (outer[-1] if outer else -1):
                leave(k)
            for other in SELF_CLOSING.get(tag, ()):
                if (k := innermost(other)) > innermost("ul", "ol", "table", "dl"):
                    leave(k)
            if tag not in VOID and not (m["attrs"] or "").endswith("/"):
                places.setdefault(tag, []).append(len(stack))
                if block and tag != "p":
                    outer.append(len(stack))
                words = path_words(tag, m["attrs"])
                fresh = tuple(w for w in dict.fromkeys(words) if w not in held)
                held.update(fresh)
                stack.append(Open(tag, words, stack[-1] if stack else None, fresh))
    rest = page[at:]
    add(rest)
    flush()
    return out


def bucket(word: str, n: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % n


class Page:
    """What the network reads of a page: for each block its element and hashed text words, and measures.

    The elements are a tree, parents first, each with the hashed words that it adds to its parent's, so that a page of any
    depth takes space by its length.
    """

    def __init__(self, blocks: list[Block]):
        place: dict[int, int] = {}
        self.parent, self.depth, self.fresh = [0], [0], [[]]  # the root holds what is in no element
        self.at, self.last, self.words = [], [], []
        self.measures = np.zeros((len(blocks), MEASURES), np.float32)
        for k, b in enumerate(blocks):
            self.at.append(self.number(b.element, place))
            self.last.append(bucket(f"last {b.element.words[-1] if b.element else ''}", PATHS))
            words = b.text.lower().split()
            self.words.append([bucket(w, WORDS) for w in set(words)])
            self.measures[k] = (b.link, min(1.0, len(b.text) / 400), min(1.0, len(words) / 12), b.text[-1] in ".!?:;\"")

    def __len__(self) -> int:
        return len(self.at)

    def number(self, element: Open | None, place: dict[int, int]) -> int:
        new = []
        while element and id(element) not in place:
            new.append(element)
            element = element.parent
        k = place[id(element)] if element else 0
        for e in reversed(new):
            self.parent.append(k)
            self.depth.append(self.depth[k] + 1)
            self.fresh.append([bucket(w, PATHS) for w in e.fresh])
            k = place[id(e)] = len(self.parent) - 1
        return k

    @cached_property
    def paths(self) -> list[list[int]]:
        """The hashed path words of each block, written out: for training, whose pages are shallow."""
        down: list[list[int]] = []
        for k, fresh in enumerate(self.fresh):
            down.append(down[self.parent[k]] + fresh if k else fresh)
        return [[*down[k], last] for k, last in zip(self.at, self.last, strict=True)]

    def path_sums(self, table: np.ndarray) -> np.ndarray:
        """The sum of the table's rows over each block's path words, summed down the tree, a depth at a time."""
        sums = mean_rows(table, self.fresh) * np.array([[len(f)] for f in self.fresh], np.float32)
        parent, depth = np.array(self.parent), np.array(self.depth)
        order = np.argsort(depth, kind="stable")
        for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[1:]:
            sums[level] += sums[parent[level]]
        return sums[self.at] + table[self.last]


def mean_rows(table: np.ndarray, ids: list[list[int]]) -> np.ndarray:
    sizes = np.array([len(i) for i in ids])
    if not sizes.sum():
        return np.zeros((len(ids), table.shape[1]), np.float32)
    flat = np.fromiter((x for i in ids for x in i), np.int64, sizes.sum())
    at = np.repeat(np.arange(len(ids)), sizes)
    out = np.zeros((len(ids), table.shape[1]), np.float32)
    np.add.at(out, at, table[flat])
    return out / np.maximum(sizes, 1)[:, None]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        width = PATH_WIDTH + WORD_WIDTH + MEASURES

        def small(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * 0.2).astype(np.float32)

        self.p = {"path": np.zeros((PATHS, PATH_WIDTH), np.float32), "word": np.zeros((WORDS, WORD_WIDTH), np.float32),  # unseen words say nothing
             "out": small(2 * HIDDEN), "skip": small(width), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p[f"w{d}"], self.p[f"u{d}"], self.p[f"b{d}"] = small(width, 4 * HIDDEN), small(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32)
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1

    def inputs(self, page: Page) -> np.ndarray:
        return np.concatenate([page.path_sums(self.p["path"]) / 3, mean_rows(self.p["word"], page.words) * np.minimum(1, np.array([[len(w)] for w in page.words], np.float32) / 6), page.measures], axis=1)

    def sweep(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = True) -> tuple[np.ndarray, list]:
        """One direction of the LSTM over x (time, pages, width); mask is 0 where a page has ended. keep: for training."""
        steps, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        gates_in = x @ self.p[f"w{d}"] + self.p[f"b{d}"]
        out, kept = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates_in[t] + h @ self.p[f"u{d}"]
            i, f, o = sigmoid(z[:, :HIDDEN]), sigmoid(z[:, HIDDEN : 2 * HIDDEN]), sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g, m = np.tanh(z[:, 3 * HIDDEN :]), mask[t][:, None]
            start = (t, h, c, i, f, o, g, m)
            c = m * (f * c + i * g) + (1 - m) * c
            h = m * (o * np.tanh(c)) + (1 - m) * h
            out[t] = h
            if keep:
                kept.append((*start, c))
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = True) -> tuple[np.ndarray, tuple]:
        hf, kf = self.sweep(x, mask, "f", keep)
        hb, kb = self.sweep(x, mask, "b", keep)
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.p["out"] + x @ self.p["skip"] + self.p["bias"][0], (h, kf, kb)

    def gradients(self, pages: list[Page], labels: list[np.ndarray]) -> tuple[float, dict, np.ndarray, list, np.ndarray]:
        steps, n = max(len(y) for y in labels), len(pages)
        xs = [self.inputs(p) for p in pages]
        for k, a in enumerate(xs):
            if k % 4:
                a[:, PATH_WIDTH:] = 0  # three pages of four are learnt by their tags alone
        x, y, mask = np.zeros((steps, n, xs[0].shape[1]), np.float32), np.zeros((steps, n), np.float32), np.zeros((steps, n), np.float32)
        for k, (a, b) in enumerate(zip(xs, labels, strict=True)):
            x[: len(b), k], y[: len(b), k], mask[: len(b), k] = a, b, 1
        z, (h, kf, kb) = self.forward(x, mask)
        p = sigmoid(z)
        loss = -(mask * np.log(np.where(y > 0, p, 1 - p) + 1e-9)).sum() / mask.sum()
        dz = mask * (p - y) / mask.sum()
        grads = {"out": np.einsum("tn,tnh->h", dz, h), "skip": np.einsum("tn,tnw->w", dz, x), "bias": dz.sum(keepdims=True).reshape(1)}
        dx = dz[:, :, None] * self.p["skip"]
        dh_all = dz[:, :, None] * self.p["out"]
        for d, kept, part in (("f", kf, slice(0, HIDDEN)), ("b", kb, slice(HIDDEN, None))):
            u, w = self.p[f"u{d}"], self.p[f"w{d}"]
            gu, gb, dzs = np.zeros_like(u), np.zeros(4 * HIDDEN, np.float32), np.zeros((steps, n, 4 * HIDDEN), np.float32)
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, h0, c0, i, f, o, g, m, c1 in reversed(kept):
                dh = dh + dh_all[t][:, part]
                tc = np.tanh(c1)
                dct = dc + m * dh * o * (1 - tc**2)
                gates = np.concatenate([m * dct * g * i * (1 - i), m * dct * c0 * f * (1 - f), m * dh * tc * o * (1 - o), m * dct * i * (1 - g**2)], axis=1)
                gu += h0.T @ gates
                gb += gates.sum(axis=0)
                dzs[t] = gates
                dh = gates @ u.T + (1 - m) * dh
                dc = m * dct * f + (1 - m) * dct
            grads[f"u{d}"], grads[f"b{d}"] = gu, gb
            grads[f"w{d}"] = np.einsum("tnw,tng->wg", x, dzs)
            dx = dx + dzs @ w.T
        return float(loss), grads, dx, xs, mask

    def train(self, pages: list[tuple[Page, np.ndarray]], epochs: int = 6, batch: int = 16, rate: float = 0.01, seed: int = 9) -> float:
        """Adam on the weights, and on the rows of the embeddings that a batch meets."""
        rng = np.random.default_rng(seed)
        m, v, step, loss = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0, 0.0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            lr, total = rate * (0.5 if epoch >= epochs // 2 else 1), 0.0
            for start in range(0, len(order), batch):
                part = [pages[i] for i in order[start : start + batch]]
                loss, grads, dx, _, _ = self.gradients([p for p, _ in part], [y for _, y in part])
                total += loss
                for name, width, at in (("path", PATH_WIDTH, 0), ("word", WORD_WIDTH, PATH_WIDTH)):
                    grads[name] = np.zeros_like(self.p[name])
                    for k, (p, y) in enumerate(part):
                        if name == "word" and k % 4:
                            continue
                        ids = p.paths if name == "path" else p.words
                        sizes = np.array([len(i) for i in ids])
                        flat = np.fromiter((x for i in ids for x in i), np.int64, sizes.sum())
                        rows = np.repeat(np.arange(len(y)), sizes)
                        np.add.at(grads[name], flat, dx[rows, k, at : at + width] / (3 if name == "path" else np.maximum(sizes, 6)[rows][:, None]))
                step += 1
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= ((5 * lr if k == "path" else lr) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            loss = total / max(1, -(-len(order) // batch))
        return loss

    def label(self, pages: list[Page]) -> list[np.ndarray]:
        """Is each block main text? Pages of like length are read together, each from its first block to its last."""
        out = [np.zeros(len(p), bool) for p in pages]
        waiting = sorted((k for k, p in enumerate(pages) if len(p)), key=lambda k: len(pages[k]))
        while waiting:
            n = 1
            while n < min(TOGETHER, len(waiting)) and (n + 1) * len(pages[waiting[n]]) <= BLOCKS:
                n += 1
            some, waiting = waiting[:n], waiting[n:]
            steps = len(pages[some[-1]])
            x, mask = np.zeros((steps, n, PATH_WIDTH + WORD_WIDTH + MEASURES), np.float32), np.zeros((steps, n), np.float32)
            for j, k in enumerate(some):
                x[: len(out[k]), j], mask[: len(out[k]), j] = self.inputs(pages[k]), 1
            z, _ = self.forward(x, mask, keep=False)
            for j, k in enumerate(some):
                out[k][:] = z[: len(out[k]), j] > 0
        return out


# Names that pages give to their parts, for the generated training pages (fixed values).
ASIDES = {
    "nav": "nav menu navigation navbar topnav breadcrumb breadcrumbs pagination pager tabs toolbar sitemap skip links toc",
    "header": "header masthead topbar banner branding logo site head tagline search",
    "footer": "footer bottom copyright legal colophon credits imprint",
    "aside": "sidebar aside widget related recommended recommendations popular trending more recent archive tags categories promo teaser rail secondary complementary",
    "notice": "cookie consent notice alert gdpr privacy popup modal overlay warning message announcement disclaimer toast banner infobar paywall",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion commercial banner adsense outbrain taboola affiliate",
    "form": "form login signup subscribe newsletter search contact register input field feedback poll survey",
    "comments": "comment comments discussion reply replies respond thread disqus responses commentlist reader feedback",
    "social": "share social sharing follow twitter facebook like buttons addthis bookmark author bio meta byline",
}
MAIN = "content main article post entry story body text page hentry maincontent articlebody paragraph prose"
ASIDE_TAGS = {"nav": ("nav", "div", "ul", "menu"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"), "notice": ("div", "section", "dialog", "p", "aside"), "advert": ("div", "aside", "section", "p"), "form": ("form", "div", "section"), "comments": ("section", "div", "ol", "ul", "article"), "social": ("div", "ul", "aside")}
ASIDE_WORDS = "home about contact news login sign up subscribe menu search share tweet like follow us cookies accept policy terms privacy copyright reserved rights all comment reply said advertisement sponsored related read more next previous newsletter email password send submit tags archive".split()


def generated_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page of known labels: its HTML, and for each of its blocks whether it is main text."""
    syllables = [chr(97 + a) + chr(97 + b) for a, b in rng.integers(0, 26, (60, 2))]

    def prose(low: int, high: int) -> str:
        words = ["".join(syllables[i] for i in rng.integers(0, 60, rng.integers(1, 5))) for _ in range(rng.integers(low, high))]
        words[0] = words[0].capitalize()
        odd = rng.random()
        if odd < 0.06:
            words = words[:3] * max(1, len(words) // 3)
        elif odd < 0.12:
            words = str(rng.choice([" | ", "!! ", "### "])).join(words).split(" ")
        elif odd < 0.4:
            words[rng.integers(len(words))] = str(rng.choice(ASIDE_WORDS))
        return " ".join(words) + str(rng.choice([".", ".", "!", "?", ""]))

    out: list[str] = []
    labels: list[bool] = []

    def put(markup_open: str, text: str, close: str, main: bool) -> None:
        out.append(f"{markup_open}{text}{close}")
        labels.append(main)

    def named(tag: str, kind: str, always: bool) -> str:
        words = (MAIN if kind == "main" else ASIDES[kind]).split()
        if always or rng.random() < 0.5:
            pick = [str(w) for w in rng.choice(words, rng.integers(1, 3), replace=False)]
            if rng.random() < 0.2:
                pick.append(str(rng.choice(["wrap", "box", "inner", "container", "list", "item", "block", "area", "x"])))
            return f'<{tag} {rng.choice(["class", "class", "id"])}="{rng.choice([" ", "-", "_"]).join(pick)}">'
        return f"<{tag}>"

    def aside(kind: str) -> None:
        tag = str(rng.choice(ASIDE_TAGS[kind]))
        out.append(named(tag, kind, tag in ("div", "section", "p", "ol", "ul", "article", "dialog", "menu")))
        shape = rng.random()
        if kind == "comments" or shape < 0.35:
            for _ in range(rng.integers(1, 5)):
                if rng.random() < 0.4:
                    put(str(rng.choice(["<h2>", "<h3>", "<h4>", "<p>"])), prose(1, 5), "", False)
                inner = str(rng.choice(["p", "div", "li", "p"]))
                put(f"<{inner}>", prose(3, 60) if kind in ("comments", "advert", "notice", "aside", "footer") else prose(2, 12), f"</{inner}>", False)
        elif shape < 0.75 and tag != "p":
            out.append("<ul>")
            for _ in range(rng.integers(2, 9)):
                put("<li><a href='/x'>" if rng.random() < 0.8 else "<li>", str(rng.choice(ASIDE_WORDS)) if rng.random() < 0.5 else prose(1, 4), "</li>", False)
            out.append("</ul>")
        else:
            put("", str(rng.choice(ASIDE_WORDS)) + " " + prose(1, 14), "", False)
        out.append(f"</{tag}>")

    def main_part() -> None:
        for _ in range(rng.integers(1, 14) if rng.random() < 0.9 else 60):
            shape = rng.random()
            if shape < 0.72:
                put("<p>" if rng.random() < 0.8 else "<p><b>", prose(1, 70) if rng.random() < 0.6 else prose(1, 6), "</p>" if rng.random() < 0.8 else "", True)
            elif shape < 0.82:
                n = rng.integers(2, 5)
                put(f"<h{n}>", prose(1, 8), f"</h{n}>", True)
            elif shape < 0.9:
                out.append("<ul>")
                for _ in range(rng.integers(1, 5)):
                    put("<li>", prose(2, 20), "</li>", True)
                out.append("</ul>")
            elif shape < 0.95:
                put("<blockquote>", prose(3, 30), "</blockquote>", True)
            else:
                put("<div>", prose(5, 50), "</div>", True)

    kinds = list(ASIDES)
    if rng.random() < 0.5:
        out.append("<body>")
    for kind in rng.choice(kinds, rng.integers(0, 5), replace=False):
        aside(str(kind))
    wrap = named("div", "main", True) if rng.random() < 0.3 else ""
    tag = str(rng.choice(["article", "article", "main", "div", "section"]))
    out.append(wrap + named(tag, "main", tag in ("div", "section")))
    if rng.random() < 0.7:
        head = rng.random() < 0.25
        put("<header><h1>" if head else "<h1>", prose(1, 10), "</h1></header>" if head else "</h1>", True)
    main_part()
    if rng.random() < 0.5:
        for kind in rng.choice(["aside", "advert", "form", "social", "notice", "comments"], rng.integers(1, 3), replace=False):
            aside(str(kind))
        main_part()
    out.append(f"</{tag}>" + ("</div>" if wrap else ""))
    for kind in rng.choice(kinds, rng.integers(0, 5), replace=False):
        aside(str(kind))
    return "".join(out), labels


@lru_cache(maxsize=1)
def trained(pages: int = 1200, seed: int = 11) -> Labeller:
    """The labeller, trained on that many generated pages; the same for the same seed."""
    rng, found = np.random.default_rng(seed), []
    while len(found) < pages:
        markup, labels = generated_page(rng)
        blocks = blocks_of(markup)
        if len(blocks) == len(labels) and blocks:
            found.append((Page(blocks), np.array(labels, np.float32)))
    net = Labeller()
    net.train(found)
    return net


def main_text(pages: list[str | None], net: Labeller) -> list[str]:
    blocks = [blocks_of(p) for p in pages]
    labels = net.label([Page(b) for b in blocks])
    return [" ".join(b.text for b, main in zip(bs, ls, strict=True) if main) for bs, ls in zip(blocks, labels, strict=True)]


def extract(pages: DataFrame, net: Labeller | None = None, html_col: str = "html") -> DataFrame:
    """Every row of pages as `row` (struct of all its columns) with text, the page's main text; '' where there is none.

    Null and empty pages give ''. Repeated rows give repeated results, an empty table an empty one. No shuffle.
    """
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(f"`{html_col}`").cast("string").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(net or trained())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(main_text(part.column(1).to_pylist(), shared.value), pa.string())], ["row", "text"])

    return rows.mapInArrow(read, f"row {rows.schema['row'].dataType.simpleString()}, text string")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op2_html_extraction": op2_html_extraction}
ORACLES: dict[str, str] = {}
