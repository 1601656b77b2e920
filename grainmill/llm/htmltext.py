"""Main text of web pages by minimum cut.

Method. A page is cut into blocks at block markup. A logistic classifier, which sees a block's text and its neighbours'
but none of the markup, gives each block a probability of being content; its log-odds (at most MOST either way) are the
capacities to the two terminals. Markup is the graph: a block is tied to the next one (adjacency) and to the element
that holds it, elements to the elements that hold them (DOM proximity). An element whose markup says what it is
(article, main; nav, footer, form, an advert's or a comment section's class) is a seed, one with its terminal.
The minimum cut of that graph, found by max-flow over the whole page, separates content from boilerplate: a lone short
paragraph follows the paragraphs around it, a long notice follows the footer that holds it.

Seeds hold by ties of finite weight. What an article holds is tied to it by a weight for each block, fitted to how often
text agrees with articles and always below what text can pull: a menu or a run of adverts inside an article goes, a lone odd line
stays. Boilerplate of known kinds holds harder, as its text can be prose. A class name that only has such a word as a part
(sidebar-left, related-work) is weak evidence: it pulls less than prose does, and nothing inside an article.

The classifier is fitted on blocks of a bounded, documented sample of pages (`sample` pages, at most PER_PAGE evenly
spaced blocks of each), labelled by the seeds that hold them, around prior weights that say what each feature means
where the sample lacks it. Seeds are not among its features.

Defined results. Null and empty html: text '' and 0 characters. Pages without content: ''. Pages without any seed are
divided by their text and ties alone; where that leaves nothing of a page without an article or main element, all that
no aside holds and that isn't mostly links is content. In a page with an article or main element, text outside of these needs ties to
be content. A form that holds an article, and an element with an aside's class that holds the page's only articles, is no seed;
where other articles stand free, those inside such elements, or named so themselves, aren't the page's. An article within an
aside's element (nav, footer, ...) isn't one either. Unclosed elements end with the page, an unclosed head where its content does, an unfinished tag
with the page; only void elements (and self-closing svg) are closed by '/>'. Text of script, style, title, noscript, template, iframe,
textarea and svg is never content. Character references are decoded; white space in a block becomes one space. Repeated
rows: one output row each. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from dataclasses import dataclass, field
from html import unescape
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, pick
from .linededup import BLOCKS as LINE_BLOCKS

#: A tag's attributes: '>' inside a quoted value doesn't end it.
ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\Z))"
RAW = "script|style|title|noscript|template|iframe|textarea|svg"
MARKUP = re.compile(
    rf"{COMMENT}|<svg\b{ATTRS}(?<=/)>|<(?P<raw>{RAW})\b{ATTRS}(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    # a head ends at its end tag, or where what can't be in one begins
    rf"|(?P<head><head\b{ATTRS}>(?:\s|{COMMENT}|</?(?:base|link|meta)\b{ATTRS}>|<(?P<in>title|script|style|noscript|template)\b{ATTRS}>.*?(?:</(?P=in)\s*>|\Z))*+(?:</head\s*>)?)"
    rf"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>{ATTRS})(?:>|\Z)|<[!?/][^>]*>",
    re.S | re.I,
)
NAMES = re.compile(r"""(?<![^\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that start and end blocks; br is white space inside one.
BLOCKS = frozenset(LINE_BLOCKS) - {"br"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_SELF = frozenset("p li dt dd option tr td th".split())
MAIN, ASIDE = frozenset(("article", "main")), frozenset("nav footer aside form menu dialog select button".split())
#: Words in class, id or role that mark what isn't the article (fixed values).
ASIDE_NAMES = frozenset(
    "ad ads advert advertisement adverts adsbygoogle banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: A compound name that begins so tells of a page's layout, not of the element.
LAYOUT = frozenset("has no not with without is show hide".split())
#: Beside words that mark what isn't the article, these leave a compound name's meaning as it is (comment-list, ad-slot).
HOLDERS = frozenset("area bar block body box button buttons container item items link links list message posts section signup slot top bottom unit wrap wrapper".split())
#: In a compound name with one of these, header and banner are the article's own.
OWN = frozenset("article content entry post story".split())
LEGAL = re.compile(r"©|\(c\)|all rights reserved", re.I)

FEATURES = ("bias", "link_share", "words", "sentence", "digits", "legal", "words_before", "words_after", "links_before", "links_after")
PRIOR = np.array([-2.0, -3.0, 1.2, 0.8, -1.0, -2.5, 0.5, 0.5, -0.5, -0.5])
SAMPLE, PER_PAGE = 1000, 64
#: Largest log-odds of a block; ties of neighbours under one element and under two, of an element's parts where boilerplate
#: holds them (more than log-odds and neighbours can pull) and elsewhere; what a page's article takes from the text outside.
MOST, TIE, FAR_TIE, HELD, LOOSE, OUTSIDE = 3.0, 0.7, 0.35, 6.0, 0.8, 3.0
#: For each block: what holds it to its article, at most and at least; what a weak name pulls.
OWN_HELD, LEAST_HELD, WEAK = 2.4, 1.0, 1.0


@dataclass
class Page:
    """Blocks with their text facts and elements; elements with the one that holds them, a seed (1 content, -1 not, 0
    none) and the seed that they are held by or are (region). Element 0 is the page."""

    texts: list[str] = field(default_factory=list)
    facts: list[tuple[float, ...]] = field(default_factory=list)  # FEATURES without bias and neighbours
    element: list[int] = field(default_factory=list)
    up: list[int] = field(default_factory=lambda: [0])
    seed: list[int] = field(default_factory=lambda: [0])
    soft: set[int] = field(default_factory=set)  # seeds that an article inside takes back: forms, named elements
    weak: set[int] = field(default_factory=set)  # elements whose name has a part that tells of boilerplate
    later: list[int] = field(default_factory=list)  # articles that a class name, their own or one outside, speaks against
    region: list[int] = field(default_factory=list)

    def regions(self) -> None:
        """Settles which elements are seeds, and by which each is held."""
        for e in self.later if not any(x > 0 for x in self.seed) else ():
            self.seed[e] = 1
            self.take_back(e)
        self.region = [0] * len(self.up)
        for e in range(1, len(self.up)):  # an element comes after the one that holds it
            if self.region[self.up[e]] < 0 and self.seed[e] > 0:
                self.seed[e] = 0
            self.region[e] = self.seed[e] or self.region[self.up[e]]

    def take_back(self, e: int) -> None:
        """Elements that hold e are no seeds by their names, nor forms."""
        while e := self.up[e]:
            if e in self.soft:
                self.seed[e] = 0
            self.weak.discard(e)

    def features(self) -> np.ndarray:
        x = np.zeros((len(self.texts), len(FEATURES)))
        if len(x):
            x[:, 0], x[:, 1:6] = 1, self.facts
            x[1:, 6], x[:-1, 7], x[1:, 8], x[:-1, 9] = x[:-1, 2], x[1:, 2], x[:-1, 1], x[1:, 1]
        return x


def named(attrs: str, in_main: bool) -> float:
    """-1 if class, id or role say that an element isn't part of an article, -0.5 if a part of a name hints at that, 1 if
    they say that it is an article's."""
    out = 0.0
    for found in NAMES.findall(attrs):
        for name in "".join(found).lower().split():
            words = re.split(r"[_-]+", name)
            own = not OWN.isdisjoint(words)
            told = [w in ASIDE_NAMES and not ((own or in_main) and w in ("header", "banner")) for w in words]
            if words[0] not in LAYOUT and any(told):
                if all(t or w in HOLDERS for t, w in zip(told, words)):
                    return -1
                out = out or -0.5
            elif own:
                out = 1
    return out


def read(html: str) -> Page:
    """The page's blocks with text, in page order, and its elements."""
    page = Page()
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # open elements: tag, element, whether an article or main holds it
    count: Counter = Counter()
    parts: list[str] = []
    linked = at = 0
    forms: set[int] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                digits = sum(map(str.isdigit, text)) / len(text) if len(text) < 400 else 0.0
                page.texts.append(text)
                page.facts.append((min(1.0, linked / len(text)), min(3.0, log1p(text.count(" ") + 1) / 2), text[-1] in ".!?:;…\"»”", digits, len(text) < 400 and LEGAL.search(text) is not None))
                page.element.append(stack[-1][1])
            parts.clear()
        linked = 0

    def silenced(e: int) -> bool:
        """Whether an element's name speaks against all that e holds."""
        while e:
            if page.seed[e] < 0 and e in page.soft and e not in forms:
                return True
            e = page.up[e]
        return False

    def close(depth: int) -> None:
        for t, _, _ in stack[depth:]:
            count[t] -= 1
        del stack[depth:]

    def text_to(stop: int) -> None:
        nonlocal linked
        if stop > at:
            parts.append(unescape(html[at:stop]))
            if count["a"]:
                linked += len(parts[-1])

    for m in MARKUP.finditer(html):
        text_to(m.start())
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag in BLOCKS:
                flush()
            if count[tag]:
                depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag)
                if tag in BLOCKS or not any(x[0] in BLOCKS for x in stack[depth + 1 :]):
                    close(depth)
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_SELF and count[tag]:  # ends an open one of its kind, unless another block element holds it
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in BLOCKS), 0)
                if depth and stack[depth][0] == tag:
                    close(depth)
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        _, element, in_main = stack[-1]
        name = named(m["attrs"], in_main) if m["attrs"] and tag not in ("html", "body") else 0
        seed, by_name = 0, name == -1
        if tag in MAIN:
            seed = 0 if by_name or silenced(element) else 1
        elif by_name or tag in ASIDE or (tag == "header" and not in_main and name <= 0):
            seed = -1
        if seed or tag in MAIN or (tag in BLOCKS and (tag not in CLOSES_SELF or (name == -0.5 and not in_main))):
            page.up.append(element)
            element = len(page.up) - 1
            page.seed.append(seed)
            if tag in MAIN:
                if seed:
                    page.take_back(element)
                else:
                    page.later.append(element)
            elif by_name or tag == "form":
                page.soft.add(element)
                if not by_name:
                    forms.add(element)
            elif name == -0.5 and not in_main and not seed:
                page.weak.add(element)
        stack.append((tag, element, in_main or tag in MAIN))
        count[tag] += 1
    text_to(len(html))
    flush()
    page.regions()
    return page


def max_flow(n: int, arcs: list[tuple[int, int, float, float]], source: int, sink: int) -> list[bool]:
    """Dinic's algorithm; arcs: from, to, capacity, capacity back. Returns whether each node is on the source's side."""
    to, cap, out = [], [], [[] for _ in range(n)]
    for a, b, c, d in arcs:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += (b, a)
        cap += (c, d)
    while True:
        level = [-1] * n
        level[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level]
        turn, path, a = [0] * n, [], source
        while True:  # augment along level edges until none is left
            if a == sink:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                cut = next(i for i, e in enumerate(path) if cap[e] <= 1e-12)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if cap[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(e)
                a = to[e]
            elif a == source:
                break
            else:
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1


def minimum_cut(odds: list[float], ties: list[tuple[int, int, float]], n: int) -> list[bool]:
    """Whether each of n nodes is content in the minimum cut. odds: log-odds of content of the first nodes, others have
    none. ties: (node, node, weight); node -1 is the content terminal, -2 the other."""
    s, t = n, n + 1
    to_s, to_t = [max(x, 0.0) for x in odds] + [0.0] * (n - len(odds)), [max(-x, 0.0) for x in odds] + [0.0] * (n - len(odds))
    arcs = []
    for i, j, w in ties:
        i, j = max(i, j), min(i, j)
        if i < 0:
            continue
        if j == -1:
            to_s[i] += w
        elif j == -2:
            to_t[i] += w
        else:
            arcs.append((i, j, w, w))
    for i in range(n):  # what flows through a node from terminal to terminal is in any cut
        both = min(to_s[i], to_t[i])
        if to_s[i] > both:
            arcs.append((s, i, to_s[i] - both, 0.0))
        elif to_t[i] > both:
            arcs.append((i, t, to_t[i] - both, 0.0))
    return max_flow(n + 2, arcs, s, t)[:n]


def ties(page: Page, own: float = OWN_HELD) -> tuple[list[tuple[int, int, float]], int]:
    """The smoothness edges and the number of nodes: blocks first, then the elements that hold any and are no seed. own: what
    holds a block to its article."""
    out, node, size = [], {}, len(page.texts)
    held = [0] * len(page.up)  # blocks of each element
    for e in page.element:
        held[e] += 1
    for e in range(len(page.up) - 1, 0, -1):
        held[page.up[e]] += held[e]

    def weight(e: int, blocks: int) -> float:
        return own * blocks if page.region[e] > 0 else HELD if page.region[e] else LOOSE

    def of(e: int) -> int:
        """The node of element e; its edges upwards are made when it is met first."""
        nonlocal size
        if page.seed[e]:
            return -1 if page.seed[e] > 0 else -2
        if e not in node:
            new = []
            while e and e not in node and not page.seed[e]:
                node[e] = size
                size += 1
                new.append(e)
                e = page.up[e]
            for x in new:
                up = page.up[x]
                if page.region[x] or up:  # the page itself ties nothing
                    out.append((node[x], -1 if page.seed[up] > 0 else -2 if page.seed[up] < 0 else node[up], weight(x, held[x])))
                if x in page.weak:
                    out.append((node[x], -2, WEAK * held[x]))
            return node[new[0]]
        return node[e]

    for i, e in enumerate(page.element):
        if e:
            out.append((i, of(e), weight(e, 1) if e not in page.weak else max(LOOSE, 2 * WEAK)))
        if i and page.region[e] == page.region[page.element[i - 1]]:
            out.append((i - 1, i, TIE if page.element[i - 1] == e else FAR_TIE))
    return out, size


def labelled(html: str, weights: np.ndarray, own: float = OWN_HELD) -> tuple[Page, list[bool], list[bool]]:
    """The page, whether each block is content in the cut, and whether the classifier alone would say so."""
    page = read(html)
    if not page.texts:
        return page, [], []
    odds = np.clip(page.features() @ weights, -MOST, MOST)
    alone = (odds > 0).tolist()
    if any(s > 0 for s in page.seed):
        odds = odds - OUTSIDE * np.array([not page.region[e] for e in page.element])
    edges, n = ties(page, own)
    content = minimum_cut(odds.tolist(), edges, n)[: len(page.texts)]
    if not any(content) and not any(s > 0 for s in page.seed):
        content = [page.region[e] == 0 and f[0] < 0.5 for e, f in zip(page.element, page.facts)]
    return page, content, alone


def main_text(html: str, weights: np.ndarray = PRIOR, own: float = OWN_HELD) -> str:
    page, content, _ = labelled(html, weights, own)
    return "\n".join(t for t, c in zip(page.texts, content) if c)


def fit(features: np.ndarray, content: np.ndarray, pull: float = 5.0, steps: int = 25) -> np.ndarray:
    """Logistic weights by Newton steps, drawn to the prior weights."""
    w = PRIOR.copy()
    for _ in range(steps if len(features) else 0):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        grad = features.T @ (p - content) + pull * (w - PRIOR)
        hess = (features * (p * (1 - p))[:, None]).T @ features + pull * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_pages(pages: DataFrame, id_col: str, html_col: str, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The classifier's weights from blocks of at most `sample` pages, those whose ids have the smallest hashes, and what
    holds a block to its article: the log-odds of text saying the same as an article, within bounds."""

    def setup():
        def step(b: pa.RecordBatch) -> dict:
            rows = []
            for t in b.column(0).to_pylist():
                page = read(t.decode("utf-8", "replace"))
                x = page.features()
                # the last of a row: the region that labels the block
                rows += [[*x[i].tolist(), float(page.region[page.element[i]])] for i in sorted({k * len(x) // PER_PAGE for k in range(PER_PAGE)})] if len(x) else []
            return {"f": rows}

        return step

    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    base = pages.select(key.alias("key"), as_bytes(html_col).alias("html"))
    n = pages.count()
    if n > 2 * sample:  # tasks sort and send about two samples in all, rather than one each
        base = base.where(F.col("key") < f"{int(2 * sample / n * 16**8):08x}")
    chosen = base.orderBy("key").limit(sample)
    x = np.array([r.f for r in arrow_map(chosen.select("html"), setup, "f array<double>").collect()]).reshape(-1, len(FEATURES) + 1)
    known = x[:, -1] != 0
    half = np.arange(len(x)) % 2 == 0  # agreement is counted on blocks that weren't learned from
    tried = fit(x[known & half, :-1], (x[known & half, -1] > 0).astype(float))
    others = x[known & ~half & (x[:, -1] > 0), :-1]
    agree = float((others @ tried > 0).sum())
    own = float(np.clip(np.log((agree + 1) / (len(others) - agree + 1)), LEAST_HELD, OWN_HELD))
    return fit(x[known, :-1], (x[known, -1] > 0).astype(float)), own


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """(id, url, text, n_blocks, n_cut), one row for each row of pages; n_cut: blocks of which the cut says otherwise than
    the classifier alone. Narrow but for the classifier's sample."""
    weights, own = fit_pages(pages, id_col, html_col, sample)

    def setup():
        def step(b: pa.RecordBatch) -> dict:
            text, blocks, moved = [], [], []
            for t in b.column(2):
                page, content, alone = labelled(t.as_py().decode("utf-8", "replace"), weights, own)
                text.append("\n".join(x for x, c in zip(page.texts, content) if c))
                blocks.append(len(content))
                moved.append(sum(c != a for c, a in zip(content, alone)))
            return {"id": b.column(0), "url": b.column(1), "text": text, "n_blocks": blocks, "n_cut": moved}

        return step

    base = pick(pages, {"id": F.col(id_col).cast("long"), "url": F.col(url_col), "html": as_bytes(html_col)})
    return arrow_map(base, setup, "id long, url string, text string, n_blocks int, n_cut int")
