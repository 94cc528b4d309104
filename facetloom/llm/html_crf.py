"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: the text between boundaries of block-level elements,
with the tags, classes, ids and roles of the elements around it.  A two-label chain
(content or not) over the blocks of a page has weights for those ancestors, for
features of the text and for neighbouring labels.  It is trained on labelled pages by
maximum likelihood with exact forward-backward sums, and decodes by Viterbi.

The labelled pages come from ``labelled_pages``, a seeded generator of page layouts
that labels the blocks it writes; pages labelled elsewhere may be passed instead.
Training is small and runs on the driver; extraction is one narrow pass.

Defined results: a null or empty page has empty text; a page without content blocks
too.  Unclosed and mismatched tags are tolerated, comments, scripts, styles and the
head never count; the text of other embedded elements is for the chain to judge.  Any
page costs time and memory in proportion to its length, however deep or broken.  An
empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N_PAGES, EPOCHS, RATE, RIDGE, SEED = 1000, 12, 0.25, 1e-5, 11

#: Elements whose boundaries end a block, elements without content, and elements whose text is no text of the page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style title textarea iframe".split())
#: An opening tag of the second kind ends an open element of the first.
ENDS = {"p": BLOCK_TAGS - {"br", "button", "label"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Words that speak for boilerplate wherever they stand.
CUES = frozenset("cookie cookies copyright subscribe newsletter login password comment comments reply share advertisement sponsored menu rights reserved privacy terms sign search".split())

#: A comment, a declaration, or the beginning of a tag.
MARK = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: What a tag's attributes are made of up to its end: an unquoted value or the opening of a quoted one.
VALUE = re.compile(r">|=\s*(?:([\"'])|([^\s>]*))")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")
RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW_TAGS}


class Element:
    """An open element; those around it are its parents."""

    __slots__ = ("parent", "key", "tag", "inner", "depth")

    def __init__(self, parent: Element | None, tag: str, key: str):
        self.parent, self.tag, self.key = parent, tag, key
        self.depth = parent.depth + 1 if parent else 0
        self.inner = tag if tag in BLOCK_TAGS else parent.inner if parent else "none"

    def path(self) -> list[str]:
        """The keys of the elements around a block, outermost first."""
        out, at = [], self
        while at:
            out.append(at.key)
            at = at.parent
        return out[::-1]


#: A block: its text, the innermost element around it, and the share of its text inside links.
Block = tuple[str, Element | None, float]


#: Keys of elements seen, so that a task reads each combination of attributes once.
KEYS: dict[tuple[str, str], str] = {}


def element_key(tag: str, attributes: str) -> str:
    """Tag and the words of class, id and role, space-joined."""
    key = KEYS.get((tag, attributes))
    if key is None:
        words = []
        for m in ATTRIBUTE.finditer(attributes):
            words += re.findall(r"[a-z]+", (m[2] or m[3] or m[4] or "").lower())
        if len(KEYS) >= 4096:
            KEYS.clear()
        key = " ".join([tag, *words])
        if len(attributes) < 1024:
            KEYS[tag, attributes] = key
    return key


def tag_end(page: str, at: int) -> tuple[int, bool]:
    """Where a tag's ``>`` is (-1 if it has none), and whether a slash that is no part of a value stands before it."""
    value = at
    while m := VALUE.search(page, at):
        if m[0] == ">":
            return m.start(), m.start() > value and page[m.start() - 1] == "/"
        at = m.end()
        if m[1]:
            close = page.find(m[1], at)
            if close < 0:  # a quote that is never closed opens nothing
                return page.find(">", at), False
            at = close + 1
        value = at
    return -1, False


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order.

    One pass: each character is read a bounded number of times, and elements are kept
    by their parents, so neither depth nor broken markup makes a page cost more than
    its length.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[Element] = []
    places: dict[str, list[int]] = {}  # of the open elements of each tag
    outer: list[int] = []  # places of the open block elements
    texts: list[str] = []
    linked = at = 0
    low = 0  # the elements around the block since its first text

    def cut_to(depth: int) -> None:
        nonlocal low
        while len(stack) > depth:
            gone = stack.pop()
            places[gone.tag].pop()
            if gone.tag in BLOCK_TAGS:
                outer.pop()
        low = min(low, depth)

    def flush() -> None:
        nonlocal linked
        if texts:
            joined = "".join(texts)
            text = SPACE.sub(" ", html.unescape(joined) if "&" in joined else joined).strip()
            if text:
                # Elements that end or begin inside the block are not around it.
                out.append((text, stack[low - 1] if low else None, min(1.0, linked / max(1, len(joined)))))
            texts.clear()
        linked = 0

    while True:
        m = MARK.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece and (texts or not piece.isspace()):
            if not texts:
                low = len(stack)
            texts.append(piece)
            if places.get("a"):
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), m[1]
        end, slash = tag_end(page, at)
        if end < 0:
            break  # a tag that never ends takes the rest
        attributes, at = page[at:end], end + 1
        own = places.get(tag)
        if closing:
            if tag in BLOCK_TAGS:
                flush()
                if own:
                    cut_to(own[-1])
            elif own and (not outer or own[-1] > outer[-1]):
                cut_to(own[-1])  # a stray inline end tag closes nothing outside its block
            continue
        if tag in BLOCK_TAGS:
            flush()
            if outer and tag in ENDS.get(stack[outer[-1]].tag, ()):
                cut_to(outer[-1])
        if tag in RAW_TAGS:
            close = RAW_ENDS[tag].search(page, at)
            if not close:
                break
            at = close.end()
            continue
        if tag not in VOID_TAGS and not slash:
            stack.append(Element(stack[-1] if stack else None, tag, element_key(tag, attributes)))
            places.setdefault(tag, []).append(len(stack) - 1)
            if tag in BLOCK_TAGS:
                outer.append(len(stack) - 1)
    flush()
    return out


def key_features(key: str) -> list[str]:
    tag, *words = key.split()
    return [f"in:{tag}", *[f"word:{w}" for w in words]]


def path_features(around: Element | None) -> set[str]:
    """What the elements around a block say: every tag, every class word, and the innermost block tag."""
    own = {f for key in (around.path() if around else []) for f in key_features(key)}
    return own | {f"at:{around.inner if around else 'none'}"}


def text_features(block: Block, place: int, total: int) -> list[str]:
    text, _, linked = block
    n = text.count(" ") + 1
    out = [f"size:{min(7, int(math.log2(n)))}", f"linked:{round(linked * 3)}", f"end:{text[-1] in '.!?:;'}"]
    if "©" in text:
        out.append("sign")
    if n <= 40 and not CUES.isdisjoint(re.findall(r"[a-z]+", text.lower())):
        out.append("cue")
    if place == 0 or place == total - 1:
        out.append("first" if place == 0 else "last")
    return out


class ChainModel:
    """Weights of a two-label chain; positive means content."""

    def __init__(self, weights: dict[str, float], same: np.ndarray):
        self.weights, self.same = weights, same
        self.keys: dict[str, list[tuple[str, float]]] = {}

    def key_weights(self, key: str) -> list[tuple[str, float]]:
        """The features of an element that have weight; unknown words have none."""
        found = self.keys.get(key)
        if found is None:
            if len(self.keys) > 50_000:
                self.keys.clear()
            found = [(f, w) for f in sorted(set(key_features(key))) if (w := self.weights.get(f, 0.0))]
            if len(key) < 1024:
                self.keys[key] = found
        return found

    def path_scores(self, page: list[Block]) -> list[float]:
        """What the elements around each block say; a feature counts once, however many of them have it.

        Blocks come in page order, so each element is entered and left once.
        """
        chain: list[tuple[Element, float, list[str]]] = []  # elements, their scores so far, features they were first to have
        had: set[str] = set()
        out = []
        for _, around, _ in page:
            ahead, at = [], around
            while at and not (at.depth < len(chain) and chain[at.depth][0] is at):
                ahead.append(at)
                at = at.parent
            while len(chain) > (at.depth + 1 if at else 0):
                had.difference_update(chain.pop()[2])
            for e in reversed(ahead):
                score, first = chain[-1][1] if chain else 0.0, []
                for f, w in self.key_weights(e.key):
                    if f not in had:
                        had.add(f)
                        first.append(f)
                        score += w
                chain.append((e, score, first))
            inner = around.inner if around else "none"
            out.append((chain[-1][1] if chain else 0.0) + self.weights.get(f"at:{inner}", 0.0) + self.weights.get("bias", 0.0))
        return out

    def emissions(self, page: list[Block]) -> list[float]:
        get = self.weights.get
        return [s + sum(get(f, 0.0) for f in text_features(b, i, len(page))) for i, (b, s) in enumerate(zip(page, self.path_scores(page), strict=True))]

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi: the most likely labels."""
        if not page:
            return []
        (t00, t01), (t10, t11) = self.same.tolist()
        emissions, back = self.emissions(page), []
        a, b = 0.0, emissions[0]
        for e in emissions[1:]:
            from_a, from_b = a + t00 >= b + t10, a + t01 >= b + t11
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = (a + t00 if from_a else b + t10), (a + t01 if from_b else b + t11) + e
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def extract(self, page: str | None) -> str:
        found = blocks(page)
        return " ".join(b[0] for b, y in zip(found, self.decode(found), strict=True) if y)


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> ChainModel:
    """Maximum likelihood by stochastic ascent; expectations by forward-backward."""
    names: dict[str, int] = {}
    rows = []
    for page, labels in pages:
        own = [[names.setdefault(f, len(names)) for f in [*sorted(path_features(b[1])), *text_features(b, i, len(page)), "bias"]] for i, b in enumerate(page)]
        if own:
            rows.append((own, np.array(labels, float)))
    w, same = np.zeros(len(names)), np.zeros((2, 2))
    order = random.Random(seed)
    for epoch in range(epochs):
        order.shuffle(rows)
        step = rate / (1 + epoch)
        for own, y in rows:
            n = len(own)
            potential = np.zeros((n, 2))
            potential[:, 1] = [w[f].sum() for f in own]
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = potential[0]
            for i in range(1, n):
                forward[i] = potential[i] + np.logaddexp.reduce(forward[i - 1][:, None] + same, axis=0)
            for i in range(n - 2, -1, -1):
                backward[i] = np.logaddexp.reduce(same + potential[i + 1] + backward[i + 1], axis=1)
            z = np.logaddexp.reduce(forward[-1])
            p = np.exp(forward + backward - z)[:, 1]
            both = np.zeros((2, 2))
            for i in range(1, n):
                both -= np.exp(forward[i - 1][:, None] + same + potential[i] + backward[i] - z)
                both[int(y[i - 1]), int(y[i])] += 1
            for f, d in zip(own, y - p, strict=True):
                w[f] += step * (d - RIDGE * w[f])
            same += step * both / n
    return ChainModel({f: float(w[i]) for f, i in names.items()}, same)


#: Containers of content and of boilerplate that the labelled pages are built from.
CONTENT_BOXES = (
    "<article>", "<main>", '<div class="content">', '<div id="main-content">', '<div class="post-body">', '<div class="entry-content">', '<section class="article-body">', '<div class="story text">', '<div role="main">', '<article class="post">', "<div>", "<section>", "<table><tr><td>", "",
    '<div id="content"><div class="post">', '<main><article>', '<div id="page"><div>',
)
CHROME_BOXES = (
    "<nav>", '<nav id="main-nav">', '<div class="menu">', '<div id="menu">', '<ul class="navigation">', '<div class="navbar">', '<div class="breadcrumb">', '<ol class="breadcrumbs">', '<div role="navigation">', "<menu>",
    "<header>", '<header class="top">', '<div class="site-header">', '<div class="header">', '<div id="header">', '<div role="banner">', "<footer>", '<footer class="site">', '<div id="footer">', '<div class="footer">', '<div class="site-footer">', '<div role="contentinfo">',
    "<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="widget">', '<div role="complementary">', '<div class="related">', '<div class="related-posts">',
    '<div class="ad">', '<div id="google-ads">', '<div class="ads banner">', '<div class="advert">', '<div class="sponsored promo">', '<div class="advertisement">', '<section class="advertisement">',
    '<div class="cookie-notice">', '<div class="cookie-banner">', '<div class="notice">', '<div id="consent">', '<div class="popup modal">', '<div class="alert">', '<div role="alert">', '<div role="dialog">', "<dialog>", '<div class="gdpr">', "<noscript>", '<noscript><div class="warning">',
    "<form>", '<form class="search">', '<form class="newsletter subscribe">', '<div class="newsletter">', '<div class="login">', '<div role="search">',
    '<section class="comments">', '<div id="comments">', '<div class="comment">', '<article class="comment">', '<ol class="comment-list">', '<div class="replies">', '<div class="disqus">', '<div class="share social">', '<div class="social-share">', '<div class="pagination">', '<div class="tags">',
)


def labelled_pages(n: int = N_PAGES, seed: int = SEED) -> list[tuple[str, list[tuple[str, int]]]]:
    """Pages and their blocks (text, label) in order, in layouts drawn at random."""
    rng = random.Random(seed)
    syllables = [c + v + e for c in "bcdfglmnprst" for v in "aeiouéü" for e in ("", "n", "r", "s")]

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(low, high)))

    def sentence() -> str:
        return words(3, 18).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def paragraph() -> str:
        return rng.choice([words(1, 3) + ".", sentence(), " ".join(sentence() for _ in range(rng.randint(2, 9))), words(4, 30).upper(), " | ".join(words(1, 2) for _ in range(8))])

    pages = []
    for _ in range(n):
        truth: list[tuple[str, int]] = []

        def say(text: str, label: int, truth: list = truth) -> str:
            truth.append((text, label))
            kind, written = rng.random(), html.escape(text)
            if kind < 0.1:
                tag = rng.choice(["b", "em", "span", "strong", "i", "small"])
                return f"<{tag}>{written}</{tag}>"
            if kind < 0.22 and " " in written:
                head, _, tail = written.partition(" ")
                return f'{head} <a href="/y">{tail}</a>' if kind < 0.14 else f"<b>{head}</b> {tail}" if kind < 0.18 else f'<a href="/z">{head}</a> {tail}'
            return written

        def box(opening: str, inner: str) -> str:
            return opening + inner + "".join(f"</{t}>" for t in reversed(re.findall("<([a-z]+)", opening)))

        def chrome(opening: str, say: Callable = say) -> str:
            kind = rng.random()
            heading = rng.choice(["h1", "h2", "h3", "h4"])
            head = f"<{heading}>{say(words(1, 5), 0)}</{heading}>" if rng.random() < 0.3 else ""
            if opening.startswith("<form") or "login" in opening or "search" in opening:
                label = f"<label>{say(words(1, 3), 0)}</label><input name=q>"
                options = f"<select><option>{say(words(1, 2), 0)}</option></select>" if rng.random() < 0.3 else ""
                return box(opening, f"{head}{label}{options}<button>{say(rng.choice(['Search', 'Subscribe', 'Sign in', words(1, 2)]), 0)}</button>")
            if "omment" in opening or "repl" in opening or "disqus" in opening:
                item = rng.choice(["p", "li", "div"])
                return box(opening, head + "".join(f"<{item}>{say(paragraph(), 0)}</{item}>" for _ in range(rng.randint(1, 4))))
            if kind < 0.3 or "nav" in opening or "menu" in opening:
                if rng.random() < 0.25:
                    return box(opening, f"{head}<a href=/a>{say(words(1, 2), 0)}</a>")
                return box(opening, head + "<ul>" + "".join(f'<li><a href="/x">{say(words(1, 3), 0)}</a></li>' for _ in range(rng.randint(2, 7))) + "</ul>")
            if kind < 0.42:
                return box(opening, head + say(rng.choice(["© ", "Copyright "]) + words(2, 12), 0))
            if kind < 0.6:
                return box(opening, head + say(paragraph(), 0))
            item = rng.choice(["p", "p", "div", "blockquote", "td"])
            inner = "".join(f"<{item}>{say(paragraph(), 0)}</{item}>" for _ in range(rng.randint(1, 3)))
            return box(opening, head + (f"<table><tr>{inner}</tr></table>" if item == "td" else inner))

        def content(opening: str, say: Callable = say) -> str:
            parts = []
            if rng.random() < 0.7:
                parts.append(f"<h1>{say(words(2, 9), 1)}</h1>")
            for _ in range(rng.randint(1, 9)):
                kind = rng.random()
                if kind < 0.2:
                    parts.append(chrome(rng.choice(CHROME_BOXES)))
                elif kind < 0.27:
                    parts.append(f"<h2>{say(words(1, 6), 1)}</h2>")
                elif kind < 0.33:
                    parts.append("<ul>" + "".join(f"<li>{say(sentence(), 1)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
                elif kind < 0.36:
                    parts.append(f"<blockquote>{say(paragraph(), 1)}</blockquote>")
                elif kind < 0.42:
                    parts.append("<table><tr>" + "".join(f"<td>{say(words(1, 4), 1)}</td>" for _ in range(3)) + "</tr></table>")
                elif kind < 0.48:
                    parts.append(f"<pre>{say(words(3, 12), 1)}</pre>")
                elif kind < 0.56:
                    parts.append(f"<p><b>{say(paragraph(), 1)}<br>")
                elif kind < 0.62:
                    parts.append(say(paragraph(), 1) + "<br>")
                else:
                    parts.append(f"<p>{say(paragraph(), 1)}</p>")
            return box(opening, "".join(parts))

        top = "".join(chrome(rng.choice(CHROME_BOXES)) for _ in range(rng.randint(0, 4)))
        middle = content(rng.choice(CONTENT_BOXES))
        if rng.random() < 0.3:
            middle = f"<div class='{rng.choice(['wrapper', 'container', 'page', 'row', 'layout'])}'>{middle}</div>"
        bottom = "".join(chrome(rng.choice(CHROME_BOXES)) for _ in range(rng.randint(0, 4)))
        if rng.random() < 0.3:
            top, middle, bottom = f"<div id=page>{top}", middle, f"{bottom}</div>"
        pages.append((f"<html><head><title>t</title></head><body>{top}{middle}{bottom}</body></html>", truth))
    return pages


@lru_cache(maxsize=1)
def default_model() -> ChainModel:
    pages = []
    for page, truth in labelled_pages():
        found = blocks(page)
        labels = align(found, truth)
        if labels is not None:
            pages.append((found, labels))
    return train(pages)


def align(found: list[Block], truth: list[tuple[str, int]]) -> list[int] | None:
    """Labels for the blocks found on a labelled page; None if they are not the blocks written."""
    if [b[0] for b in found] != [SPACE.sub(" ", t).strip() for t, _ in truth]:
        return None
    return [y for _, y in truth]


def extractor(model: ChainModel) -> Callable[[Column], Column]:
    weights, same = model.weights, model.same

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        own = ChainModel(weights, same)
        return pd.Series([own.extract(p) for p in pages], dtype=object)

    return extract


def extract_pages(df: DataFrame, html_col: str = "html", model: ChainModel | None = None) -> DataFrame:
    """``df`` with text and n_chars, which replace columns of the same names."""
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("text", "n_chars")]
    text = extractor(model or default_model())(F.col(f"`{html_col}`"))
    return df.select(*kept, text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
