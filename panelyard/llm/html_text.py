"""Main text of web pages by a recurrent block labeller."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import map_arrow, ship

# HTML element names by kind.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "select"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "br", "wbr"}

# HTML elements whose standard meaning is that they are not the article, and elements that are a paragraph of what holds them.
ASIDE = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button"}
PARAGRAPHS = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "td", "th", "dt", "dd", "figcaption"}
#: A text on this many different pages of the sample is repeated.
REPEATED = 3

#: Comments, declarations and tags; a quote opens only after an equals sign.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""", re.S)
_NAMED = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
PATH_DIM, WORD_DIM, NUMBERS = 512, 64, 6


class Block(NamedTuple):
    """A leaf of a page: words of every level of its tag path, its text, characters inside links, and the numbers of the elements it stands in."""

    path: tuple[tuple[str, ...], ...]
    text: str
    links: int
    nodes: tuple[int, ...]


def blocks(page: str | None) -> list[Block]:
    """The leaf sequence of a page: every block with text.

    A block ends wherever a tag that is not inline opens or closes. Contents of
    scripts, styles and the like are no text. Character references are decoded,
    white space becomes one space and the ends are trimmed. Unclosed and
    misnested tags are closed with the nearest tag that closes them; markup that
    never ends is text.
    """
    page = page or ""
    out, stack, held, links, at, anchors, opened = [], [], [], 0, 0, 0, 0

    def text_to(end):
        nonlocal links
        if end > at:
            piece = entities.unescape(page[at:end])
            held.append(piece)
            if anchors:
                links += len(piece.strip())

    def flush():
        nonlocal links
        if text := " ".join("".join(held).split()):
            out.append(Block(tuple(words for _, words, _ in stack), text, links, tuple(n for _, _, n in stack)))
        held.clear()
        links = 0

    while m := _TAG.search(page, at):
        text_to(m.start())
        closing, name, attrs = m[1], m[2], m[3]
        at = m.end()
        if not name:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                anchors = 0 if closing else 1
            elif name == "br":
                held.append(" ")
            continue
        flush()
        anchors = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name in RAW:
            if not attrs.endswith("/"):
                # its end is looked for as text: what stands inside is not markup
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif name not in VOID and not attrs.endswith("/"):
            if stack and (name == stack[-1][0] in ("p", "li", "td", "th", "tr", "option", "dt", "dd") or stack[-1][0] == "p"):
                stack.pop()
            words = [name]
            for value in _NAMED.findall(attrs):
                words += _WORD.findall(value.lower())
            opened += 1
            stack.append((name, tuple(words), opened))
    text_to(len(page))
    flush()
    return out


def structural_labels(pages: list[list[Block]]) -> list[list[int]]:
    """1 for blocks of the article, from the structure of pages seen together; no word of a class or text has a part in it.

    A text on REPEATED pages or more is repeated; pages that are copies of each
    other count as one (``originals``). Every element is scored by the
    characters, not repeated and not in links, of the paragraphs that it holds
    itself; from the element with most, ``lifted`` goes up to the one that holds
    all the article's parts. Of what stands in it, blocks count unless they are
    mostly links, stand in an element that by its standard meaning is no part of
    the article, or have a tag path whose texts are mostly repeated.
    """
    on = Counter(t for _, t in {(g, b.text) for g, leaf in zip(originals(pages), pages, strict=True) for b in leaf})
    tags = lambda b: tuple(words[0] for words in b.path)
    seen, again = Counter(), Counter()
    for leaf in pages:
        for b in leaf:
            seen[tags(b)] += 1
            again[tags(b)] += on[b.text] >= REPEATED
    out = []
    for leaf in pages:
        mass: Counter = Counter()
        held: Counter = Counter()
        plain = [not ASIDE.intersection(tags(b)) and 2 * b.links < len(b.text) for b in leaf]
        for b, ok in zip(leaf, plain, strict=True):
            if ok and on[b.text] < REPEATED and b.nodes:
                up = b.path[-1][0] in PARAGRAPHS and len(b.nodes) > 1
                mass[b.nodes[-2] if up else b.nodes[-1]] += len(b.text)
                if up:
                    for n in b.nodes[:-1]:
                        held[n] += len(b.text)
        best = lifted(leaf, max(mass, key=lambda n: (mass[n], -n), default=0), held)
        bare = not any(b.nodes for b in leaf)  # a page without elements
        out.append([int(ok and (bare or best in b.nodes) and 2 * again[tags(b)] <= seen[tags(b)]) for b, ok in zip(leaf, plain, strict=True)])
    return out


def originals(pages: list[list[Block]], least: int = 40) -> list[int]:
    """For every page the first of those it is a copy of, by the running text that they share.

    Two pages are copies if the blocks that both have (of ``least`` characters
    and more, not mostly links) hold most characters of those blocks of either.
    Pages are few (the sample of ``fit``); only such as share a block are compared.
    """
    texts = [{b.text for b in leaf if len(b.text) >= least and 2 * b.links < len(b.text)} for leaf in pages]
    sizes, where = [sum(map(len, t)) for t in texts], {}
    up = list(range(len(pages)))

    def top(k: int) -> int:
        while up[k] != k:
            k = up[k]
        return k

    for k, own in enumerate(texts):
        shared: Counter = Counter()
        for t in own:
            for j in where.setdefault(t, []):
                shared[j] += len(t)
            where[t].append(k)
        for j, n in shared.items():
            if 2 * n > max(sizes[k], sizes[j]):
                a, b = sorted((top(k), top(j)))
                up[b] = a
    return [top(k) for k in range(len(pages))]


#: An element is one of several parts of an article if those of its tag beside it hold this many times its paragraphs together.
PARTS = 1.15


def lifted(leaf: list[Block], best: int, held: Counter) -> int:
    """The element above ``best`` that holds all parts of an article whose paragraphs or sections stand in elements of their own.

    ``held`` has the characters of the paragraphs in every element. As long as
    the elements of one tag under one parent hold clearly more together than the
    one alone, the parent takes its place. Elements that stand alone in their
    parent are passed on the way, as wrappers of wrappers are; what holds text
    but no paragraph, as adverts do, has no part in it.
    """
    tag, parent, children = {}, {}, {}
    for b in leaf:
        for k, n in enumerate(b.nodes):
            if n not in tag:
                tag[n], parent[n] = b.path[k][0], b.nodes[k - 1] if k else 0
                children.setdefault(parent[n], []).append(n)
    at = best
    while (up := parent.get(at, 0)) and tag[at] not in ("body", "html", "main", "article"):
        together = sum(held[n] for n in children[up] if tag[n] == tag[at])
        if together >= PARTS * max(held[at], 1):
            best = up
        elif together < held[up] / PARTS:
            break  # what stands beside it is of another kind
        at = up
    return best


def features(leaf: list[Block]) -> np.ndarray:
    """A row for each block: hashed path words (those of its own element again, marked), hashed words of its text, and six numbers."""
    x = np.zeros((len(leaf), PATH_DIM + WORD_DIM + NUMBERS), dtype=np.float32)
    for k, (path, text, links, _) in enumerate(leaf):
        for level in path:
            for w in level:
                x[k, _slot(w)] = 1
        if path:
            x[k, _slot("=" + path[-1][0])] = 1
        words = text.split()
        hit = np.bincount([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_DIM for w in words], minlength=WORD_DIM)
        x[k, PATH_DIM : PATH_DIM + WORD_DIM] = np.sqrt(hit) / np.sqrt(len(words))
        n = len(text)
        x[k, -NUMBERS:] = (min(np.log1p(n) / 8, 2), links / n, (text.count(".") + text.count(",")) / n * 10, k / len(leaf), min(len(words) / 50, 2), 1)
    return x


_slots: dict[str, int] = {}


def _slot(word: str) -> int:
    if (at := _slots.get(word)) is None:
        if len(_slots) > 100_000:
            _slots.clear()
        at = _slots[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % PATH_DIM
    return at


class BiLSTM:
    """A bidirectional LSTM over a page's blocks with one logistic output a block, in numpy."""

    def __init__(self, inputs: int, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p["W" + d] = rng.normal(0, 0.15, (inputs, 4 * hidden)).astype(np.float32)
            self.p["U" + d] = rng.normal(0, 0.15, (hidden, 4 * hidden)).astype(np.float32)
            self.p["c" + d] = np.zeros(4 * hidden, dtype=np.float32)
            self.p["c" + d][hidden : 2 * hidden] = 1
        self.p["v"], self.p["o"] = rng.normal(0, 0.15, 2 * hidden).astype(np.float32), np.zeros(1, dtype=np.float32)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str):
        """Hidden states over time (T, B, H); what is masked keeps the state before it."""
        t, b, _ = x.shape
        h, c, hid = np.zeros((b, self.h), np.float32), np.zeros((b, self.h), np.float32), self.h
        z_in = x.reshape(t * b, -1) @ self.p["W" + d] + self.p["c" + d]
        z_in = z_in.reshape(t, b, -1)
        steps, states = [], np.zeros((t, b, hid), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = z_in[k] + h @ self.p["U" + d]
            g = 1 / (1 + np.exp(-z[:, : 3 * hid]))
            i, f, o, u = g[:, :hid], g[:, hid : 2 * hid], g[:, 2 * hid :], np.tanh(z[:, 3 * hid :])
            c_new = f * c + i * u
            tc = np.tanh(c_new)
            m = mask[k][:, None]
            steps.append((k, h, c, i, f, o, u, tc, m))
            c, h = m * c_new + (1 - m) * c, m * (o * tc) + (1 - m) * h
            states[k] = h
        return states, steps

    def forward(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hf, hb = self._pass(x, mask, "f")[0], self._pass(x, mask, "b")[0]
        return 1 / (1 + np.exp(-(np.concatenate([hf, hb], axis=2) @ self.p["v"] + self.p["o"])))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        t, b, n = x.shape
        hid, out = self.h, {}
        runs = {d: self._pass(x, mask, d) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        e = (1 / (1 + np.exp(-(both @ self.p["v"] + self.p["o"]))) - y) * mask / max(1.0, mask.sum())
        out["v"], out["o"] = (both * e[:, :, None]).sum(axis=(0, 1)), np.array([e.sum()], np.float32)
        for d, part in (("f", slice(0, hid)), ("b", slice(hid, 2 * hid))):
            dh_out = e[:, :, None] * self.p["v"][part]
            dz_all, du = np.zeros((t, b, 4 * hid), np.float32), np.zeros_like(self.p["U" + d])
            dh, dc = np.zeros((b, hid), np.float32), np.zeros((b, hid), np.float32)
            for k, h, c, i, f, o, u, tc, m in reversed(runs[d][1]):
                dh = dh + dh_out[k]
                g = dh * m
                dct = dc * m + g * o * (1 - tc * tc)
                dz = np.concatenate([dct * u * i * (1 - i), dct * c * f * (1 - f), g * tc * o * (1 - o), dct * i * (1 - u * u)], axis=1)
                dz_all[k] = dz
                du += h.T @ dz
                dh, dc = dz @ self.p["U" + d].T + dh * (1 - m), dct * f + dc * (1 - m)
            out["U" + d], out["c" + d] = du, dz_all.sum(axis=(0, 1))
            out["W" + d] = x.reshape(t * b, n).T @ dz_all.reshape(t * b, -1)
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(p) for p in pages)
    x, mask = np.zeros((t, len(pages), pages[0].shape[1]), np.float32), np.zeros((t, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def disguised(leaf: list[Block], labels: list[int], rng: np.random.Generator, others: list[list[Block]], said: list[str] = ()) -> tuple[list[Block], list[int]]:
    """A page made from a real one: container elements and their words renamed or dropped, paragraphs wrapped, runs of other pages' blocks outside the article set in, and readers' remarks behind it.

    So the net cannot go by one site's names; what stays is how blocks follow
    each other, their texts and their places.
    """
    drop, names = rng.random() < 0.6, {}

    def level(words):
        if words[0] in PARAGRAPHS or words[0] in ("html", "body", "head", "title", "ul", "ol", "dl", "table", "tbody", "tr"):
            return words[:1] if drop else words
        tag = names.setdefault(words[0], str(rng.choice(["div", "div", "section", words[0]])))
        kept = () if drop else tuple(names.setdefault((words[0], w), w if rng.random() < 0.4 else f"x{rng.integers(1 << 30)}") for w in words[1:])
        return (tag, *kept)

    def renamed(b):
        return b._replace(path=tuple(level(w) for w in b.path))

    out, kinds = [], []
    wrap = rng.random() < 0.3  # every paragraph in an element of its own
    for b, y in zip(leaf, labels, strict=True):
        if wrap and y and b.path and b.path[-1][0] in PARAGRAPHS:
            b = b._replace(path=(*b.path[:-1], ("div",), b.path[-1]))
        if others and rng.random() < 0.08:
            run = others[rng.integers(len(others))]
            out += [renamed(o) for o in run]
            kinds += [0] * len(run)
        out.append(renamed(b))
        kinds.append(y)
    last = max((k for k, y in enumerate(kinds) if y), default=None)
    if last is not None and rng.random() < 0.35:
        run = remarks(said, rng)
        out[last + 1 : last + 1] = [renamed(o) for o in run]
        kinds[last + 1 : last + 1] = [0] * len(run)
    return out, kinds


def remarks(said: list[str], rng: np.random.Generator) -> list[Block]:
    """What readers write below an article, made up from pieces of other pages' texts: lists or boxes of short runs of words, most under a name.

    The given pages have none; a net that has never seen any takes them for the
    article's last paragraphs.
    """
    outer, inner = [(("section",), ("ol",), ("li",)), (("div",), ("div",)), (("ul",), ("li",)), (("section",), ("article",)), (("div",),)][rng.integers(5)], [("p",), ("div",), None][rng.integers(3)]
    base = (("html",), ("body",), *outer)

    def words(most: int) -> str:
        text = said[rng.integers(len(said))].split() if said else ["yes"]
        at = int(rng.integers(len(text)))
        return " ".join(text[at : at + int(rng.integers(1, most + 1))])

    out, named, lead = [], rng.random() < 0.75, rng.random() < 0.6
    if lead:
        out.append(Block((*base[:2], outer[0], (str(rng.choice(["h2", "h3", "h4"])),)), words(3), 0, ()))
    for _ in range(int(rng.integers(1, 7))):
        if named:
            out.append(Block((*base, (str(rng.choice(["div", "h4", "p", "header"])),)), words(3), 0, ()))
        out.append(Block((*base, inner) if inner else base, words(24), 0, ()))
    return out


def runs_outside(leaf: list[Block], labels: list[int]) -> list[list[Block]]:
    """Runs of blocks outside the article, at most eight long, without those of the page's head."""
    runs: list[list[Block]] = [[]]
    for b, y in zip(leaf, labels, strict=True):
        if y or any(w[0] == "head" for w in b.path) or len(runs[-1]) == 8:
            runs.append([])
        if not y and not any(w[0] == "head" for w in b.path):
            runs[-1].append(b)
    return [r for r in runs if r]


def fit(pages: DataFrame, rows: int = 384, rounds: int = 180, batch: int = 24, most_blocks: int = 60, seed: int = 11) -> BiLSTM:
    """Trains the labeller on a bounded sample of ``rows`` pages, those whose ids have the smallest hashes.

    Pages are counted first, so that each partition sends only rows below the
    hash limit, about twice as many as are used in all; equal pages count once.

    There are no labels, so blocks are labelled by the structure of the sampled
    pages (``structural_labels``); more than half of the training pages are
    disguised ones. Of a sampled page that has more blocks, training reads a
    window of ``most_blocks``; labelling reads all.
    """
    limit = min(2**31, int(2 * rows / max(1, pages.count()) * 2**31) + 1)
    near = pages.where("html IS NOT NULL").select("html", F.pmod(F.xxhash64("page_id", "url"), F.lit(2**31)).alias("h")).where(F.col("h") < limit)
    picked = near.groupBy(F.xxhash64("html").alias("k")).agg(F.min(F.struct("h", "html")).alias("x")).orderBy("x.h", "k").limit(rows).collect()
    return train([b for r in picked if (b := blocks(r["x"]["html"]))], rounds, batch, most_blocks, seed)


def train(leaves: list[list[Block]], rounds: int = 180, batch: int = 24, most_blocks: int = 60, seed: int = 11) -> BiLSTM:
    """The labeller fitted to the structural labels of these pages."""
    net = BiLSTM(PATH_DIM + WORD_DIM + NUMBERS)
    if not leaves:
        return net
    rng = np.random.default_rng(seed)
    known = structural_labels(leaves)
    others = [run for leaf, labels in zip(leaves, known, strict=True) for run in runs_outside(leaf, labels)]
    said = [b.text for leaf, labels in zip(leaves, known, strict=True) for b, y in zip(leaf, labels, strict=True) if y and len(b.text) > 60][:4096]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    for step in range(1, rounds + 1):
        xs, ys = [], []
        for k in rng.integers(len(leaves), size=batch):
            leaf, labels = leaves[k], known[k]
            if rng.random() < 0.6:
                leaf, labels = disguised(leaf, labels, rng, others, said)
            at = int(rng.integers(0, max(1, len(leaf) - most_blocks + 1)))
            xs.append(features(leaf)[at : at + most_blocks])
            ys.append(labels[at : at + most_blocks])
        x, mask = padded(xs)
        y = np.zeros(mask.shape, np.float32)
        for k, v in enumerate(ys):
            y[: len(v), k] = v
        rate = 0.02 * (1 - step / (rounds + 1))
        for k, g in net.gradients(x, mask, y).items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def label(pages: DataFrame, net: BiLSTM, key: str = "page_id", html: str = "html") -> DataFrame:
    """``page_id``, ``url`` and ``blocks``: every block's text, probability and whether it is main text.

    A null or blank page has no blocks. Pages are read whole and every block is
    labelled in sight of all others of its page. Repeated rows and null ids give
    a row each, other columns are ignored, and an empty table gives an empty
    result.
    """
    held = ship(pages.sparkSession, net)

    def start():
        model = held()

        def step(batch):
            leaves = [blocks(h) for h in batch.column(2).to_pylist()]
            probs: list[np.ndarray] = [np.zeros(0)] * len(leaves)
            order = sorted((k for k, v in enumerate(leaves) if v), key=lambda k: len(leaves[k]))
            at = 0
            while at < len(order):  # pages of like length together, so that little is padded
                size = max(1, min(64, 4096 // len(leaves[order[min(at + 63, len(order) - 1)]])))
                group = order[at : at + size]
                p = model.forward(*padded([features(leaves[k]) for k in group]))
                for c, k in enumerate(group):
                    probs[k] = p[: len(leaves[k]), c]
                at += size
            rows = [[{"text": b.text, "main": float(v), "kept": bool(v >= 0.5)} for b, v in zip(leaf, p, strict=True)] for leaf, p in zip(leaves, probs, strict=True)]
            return [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.struct([("text", pa.string()), ("main", pa.float64()), ("kept", pa.bool_())])))]

        return step

    kind = pages.schema[key].dataType.simpleString()
    return map_arrow(pages.select(key, "url", html), start, f"page_id {kind}, url string, blocks array<struct<text: string, main: double, kept: boolean>>")


def extract(pages: DataFrame, net: BiLSTM | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars``: the main blocks of every page, one a line."""
    got = label(pages, net or fit(pages))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["kept"]), lambda b: b["text"]), "\n")
    return got.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
