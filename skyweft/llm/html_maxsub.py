"""Main text of web pages by the maximum-scoring contiguous region.

A page is read as a sequence of words and tags. The log odds that a word in its place is main text are
learnt from labelled pages: what is known of the place are the elements around it (their tags, their
class, id and role names, their share of linked words) and its block (length, linked words, kind,
copyright mark), each seen relative to the page's article or main elements where it has such. A word's
score is these odds, or a little above zero where they are below; a tag's score is its learnt cost and,
on both sides of a block with odds below zero, those of its words, so that tags are always negative.
One linear scan finds the contiguous region of the highest sum. A second one over the opposite scores
inside it finds its holes (adverts, menus, forms between paragraphs): all maximal regions there. What
the region reaches but for its holes is the main text; nothing else decides. However long, a run of
side matter weighs no more than SIDE_COST, so that it does not cut the content around it in two.

The labelled pages are made by :func:`labelled_pages` from a seed, in several layouts. Own ones may be
given instead. Weights come from a logistic regression over their blocks.

Reading is linear in the length of a page: what an element adds is worked out once and inherited.

Defined cases: a null or empty page, or one without words that score above zero, gives the empty
string. Unclosed tags, comments and cut pages are read as far as they go. Of regions of one sum the
first counts. Repeated rows each get a row, a null page_id stays null, an empty table gives no rows,
further columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from functools import cache
from itertools import cycle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|title|svg)(?=[\s/>]|\Z)[^>]*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_PART = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
COPYRIGHT = re.compile(r"(?:copyright\b\W*)?(?:©|\(c\)|copyright\s+(?:19|20)\d\d)", re.I)
#: Elements whose words are not main text wherever they stand (fixed by what is asked for).
NEVER_MAIN = frozenset("head nav form button select option menu dialog object embed canvas audio video".split())
#: Elements whose words do not count when it is asked which element holds most of a page.
APART = NEVER_MAIN | frozenset("header footer aside".split())
HOMES = frozenset(("article", "main"))
BLOCKS = frozenset(
    "p div section article main body html h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre hr"
    " figure figcaption address details summary fieldset center nav header footer aside form menu dialog".split()
)
VOID = frozenset("br hr img input meta link area base col source track wbr".split())
#: An opening tag of the key ends an open element of the values.
ENDS = {t: ("p",) for t in BLOCKS - {"html", "body"}} | {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",), "body": ("head",)}
#: An element of the key is not ended from inside of one of the values.
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "p": tuple("html body div section article main td center table th li blockquote ul ol nav header footer aside form".split()), "option": ("select",), "head": ()}
#: From this share of a page's words on an element's names say nothing of what it holds.
MOST = 0.9
#: Bounds of a word's and a tag's score, and the most that a run of side matter weighs.
WORD_SCORE, TAG_SCORE, SIDE_COST = (1.0, 6.0), (-0.3, -0.02), 3.0
#: What a word of main text weighs against side matter when holes are looked for.
KEEP = 2.0


class Element:
    __slots__ = ("parent", "name", "names", "words", "linked", "homes", "apart", "is_home", "home")

    def __init__(self, parent: int, name: str, names: tuple[str, ...], apart: bool, is_home: bool, home: bool):
        self.parent, self.name, self.names, self.apart, self.is_home, self.home = parent, name, names, apart, is_home, home
        self.words = self.linked = self.homes = 0


class Frame:
    """An open tag: its element, whether it is in a link, and where what it may end stands."""

    __slots__ = ("name", "element", "link", "near", "heading")

    def __init__(self, name: str, element: int, link: bool, near: dict[str, int], heading: str):
        self.name, self.element, self.link, self.near, self.heading = name, element, link, near, heading


def _names(attrs: str) -> tuple[str, ...]:
    """Whole class, id and role names and their first and last parts, as features."""
    out = []
    for kind, a, b, c in ATTRIBUTE.findall(attrs):
        for token in (a or b or c).lower().split():
            if kind.lower() == "role" and token == "main":
                out.append("role:main")
                continue
            parts = NAME_PART.findall(token)
            if parts:
                out += ["name:" + "-".join(parts), f"first:{parts[0]}", f"last:{parts[-1]}"]
    return tuple(dict.fromkeys(out))


class Reader:
    """A page's ``tokens`` (tag or None, words, block), ``blocks`` (text, element, words, linked words, heading) and ``elements``."""

    def __init__(self, page: str):
        self.tokens: list[tuple[str | None, int, int]] = []
        self.blocks: list[tuple[str, int, int, int, str]] = []
        self.elements = [Element(-1, "", (), False, False, False)]
        stack = [Frame("", 0, False, {}, "")]
        open_: dict[str, int] = {}
        parts: list[str] = []
        pending = [0, 0, 0]  # words and linked words of the block, and its first token
        tokens, blocks, elements = self.tokens, self.blocks, self.elements

        def flush() -> None:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
            parts.clear()
            if text:
                top = stack[-1]
                blocks.append((text, top.element, pending[0], pending[1], top.heading))
                e = elements[top.element]
                e.words += pending[0]
                e.linked += pending[1]
            elif pending[0]:  # spaces written as character references
                tokens[pending[2] :] = [t for t in tokens[pending[2] :] if t[0] is not None]
            pending[:] = 0, 0, len(tokens)

        def close(at: int) -> None:
            if any(f.name in BLOCKS or f.element != stack[at - 1].element for f in stack[at:]):
                flush()
            for f in stack[at:]:
                open_[f.name] -= 1
            del stack[at:]

        for m in TOKEN.finditer(page):
            text = m["text"]
            if text is not None:
                parts.append(text)
                n = len(text.split())
                if n:
                    tokens.append((None, n, len(blocks)))
                    pending[0] += n
                    if stack[-1].link:
                        pending[1] += n
                continue
            name = m["name"] or m["name2"]
            if name is None:
                continue
            name = name.lower()
            if m["close"] or m["close2"]:
                if open_.get(name):
                    at = len(stack) - 1
                    while stack[at].name != name:
                        at -= 1
                    close(at)
                elif name in BLOCKS:
                    flush()
                tokens.append((name, 0, -1))
                continue
            if name == "br":
                parts.append(" ")
                continue
            if name in VOID:
                if name in BLOCKS:
                    flush()
                tokens.append((name, 0, -1))
                continue
            for old in ENDS.get(name, ()):
                at = stack[-1].near.get(old, 0)
                if at:
                    close(at)
            attrs = m["attrs"] or m["attrs2"] or ""
            if attrs.endswith("/") and name not in BLOCKS:
                continue
            top = stack[-1]
            element, names = top.element, _names(attrs) if attrs else ()
            if name in BLOCKS or name in NEVER_MAIN or names:
                flush()
                above = elements[element]
                is_home = name in HOMES or "role:main" in names
                elements.append(Element(element, name, names, above.apart or name in APART, is_home, above.home or is_home))
                element = len(elements) - 1
            tokens.append((name, 0, -1))
            near = top.near
            if name in SCOPE or name in _SCOPES:
                near = {old: at for old, at in near.items() if name not in SCOPE[old]}
                if name in SCOPE:
                    near[name] = len(stack)
            stack.append(Frame(name, element, top.link or name == "a", near, name if name in ("h1", "h2", "h3", "li", "td", "p") else top.heading))
            open_[name] = open_.get(name, 0) + 1
        flush()
        self.total = 0  # words outside elements that stand apart
        for e in elements:
            if not e.apart:
                self.total += e.words
        for e in reversed(elements[1:]):
            up = elements[e.parent]
            up.words += e.words
            up.linked += e.linked
            up.homes += e.homes + (e.is_home and e.words > 0)
        self.has_home = elements[0].homes > 0

    def element_features(self, e: Element) -> list[str]:
        """What an element adds to what is known of the words in it."""
        where = "around" if e.homes and not e.home else "in" if e.home else "out" if self.has_home else "no"
        out = [f"{e.name}|{where}"]
        if where != "around" and e.names and not (not e.apart and e.words >= MOST * self.total):
            out += e.names
        return out

    def block_features(self, block: tuple[str, int, int, int, str]) -> list[str]:
        _, at, words, linked, heading = block
        e = self.elements[at]
        where = "in" if e.home else "out" if self.has_home else "no"
        parent = self.elements[e.parent] if e.parent >= 0 else e
        return ["bias", f"place|{where}", f"linked:{round(4 * linked / max(1, words))}|{where}", f"around:{round(4 * parent.linked / max(1, parent.words))}|{where}", f"length:{min(6, words.bit_length())}|{where}", f"kind:{heading}|{where}", *(("mark:copyright",) if COPYRIGHT.match(block[0]) else ())]

    def scores(self, weights: dict[str, float]) -> list[float]:
        """Log odds of the words of each block."""
        get = weights.get
        down = [0.0] * len(self.elements)
        for i, e in enumerate(self.elements):
            if i:
                own = -WORD_SCORE[1] * 4 if e.name in NEVER_MAIN else sum(get(f, 0.0) for f in self.element_features(e))
                down[i] = max(-50.0, min(50.0, down[e.parent] + own))
        return [down[b[1]] + sum(get(f, 0.0) for f in self.block_features(b)) for b in self.blocks]

    def line(self, weights: dict[str, float]) -> tuple[list[float], list[bool]]:
        """The score of every token between two marks of the page's ends, and which tokens are side matter.

        Words are positive. A tag bears its own cost; where the words of a block are rather side matter, the tag before and
        the tag after them bear the block's log odds a word as well, each enough to outweigh the words.
        """
        least, most = WORD_SCORE
        odds = self.scores(weights)
        word = [min(most, max(least, x)) if x > 0 else min(0.05, -x / 4) for x in odds]
        rest = weights.get("<>", TAG_SCORE[1])
        line = [0.0, *(weights.get(f"<{name}>", rest) if name is not None else n * word[b] for name, n, b in self.tokens), 0.0]
        side = [False] * len(line)
        ends: dict[int, list[int]] = {}
        for i, (name, _, b) in enumerate(self.tokens, 1):
            if name is None and odds[b] <= 0:
                ends.setdefault(b, [i - 1, 0])[1] = i + 1
        for b, (first, last) in ends.items():
            cost = self.blocks[b][2] * max(-most, odds[b])
            line[first] += cost
            line[last] += cost
            side[first : last + 1] = [True] * (last + 1 - first)
        return line, side

    def region(self, weights: dict[str, float], side_cost: float | None = None) -> tuple[list[float], int, int]:
        """The tokens' scores, where a run of side matter weighs at most ``side_cost``, and the best region's first and last token."""
        line, side = self.line(weights)
        bound = SIDE_COST if side_cost is None else side_cost
        eased, i = line.copy(), 0
        while i < len(line):
            if not side[i]:
                i += 1
                continue
            end, last = i, i
            while end < len(line) and (side[end] or self._is_tag(end)):
                last = end if side[end] else last
                end += 1
            total = sum(line[i : last + 1])
            if total < -bound:
                eased[i : last + 1] = [x * bound / -total if x < 0 else 0.0 for x in line[i : last + 1]]
            i = end
        return eased, *best_region(eased)

    def _is_tag(self, at: int) -> bool:
        return not 0 < at <= len(self.tokens) or self.tokens[at - 1][0] is not None

    def text(self, weights: dict[str, float], side_cost: float | None = None, keep: float | None = None) -> str:
        """The words of the best region but for its holes: the maximal regions of the scores' opposites inside it."""
        line, first, last = self.region(weights, side_cost)
        keep = KEEP if keep is None else keep
        inside = [-x * keep if x > 0 else -x for x in line[first:last]]
        out = [False] * len(inside)
        for lo, hi in maximal_regions(inside):
            out[lo:hi] = [True] * (hi - lo)
        reached: dict[int, None] = {}
        for i in range(first, last):
            if not out[i - first] and not self._is_tag(i):
                reached[self.tokens[i - 1][2]] = None
        return "\n\n".join(self.blocks[b][0] for b in reached)


_SCOPES = frozenset(name for names in SCOPE.values() for name in names)


def best_region(scores: list[float]) -> tuple[int, int]:
    """[first, last) of the contiguous region with the highest sum; the earliest, then longest of equals."""
    best, at, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run < 0:
            run, start = 0.0, i
        run += s
        if run > best or run == best and start == at[0]:
            best, at = run, (start, i + 1)
    return at


def maximal_regions(scores: list[float]) -> list[tuple[int, int]]:
    """All disjoint maximal-scoring regions [first, last), left to right, in one linear scan.

    A region is kept apart from the one before while joining them would not score more than each of them.
    """
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, nearest one with a lower sum before
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        at, first = len(found) - 1, i
        while True:
            while at >= 0 and found[at][0] >= before:
                at = found[at][4]
            if at < 0 or found[at][1] >= total:
                break
            before, _, first, _, left = found[at]
            del found[at:]
            at = left
        found.append((before, total, first, i + 1, at))
    return [f[2:4] for f in found]


#: Names that page authors give to side matter and to content (fixed values of the made-up pages).
SIDE_WORDS = (
    "ad ads advert advertisement sponsor sponsored promo cookie cookies consent gdpr notice notices nav navbar navigation menu sidebar"
    " footer header banner breadcrumb breadcrumbs comment comments reply replies disqus share sharing social related newsletter"
    " subscribe subscription popup modal overlay pagination pager toolbar complementary contentinfo discussion responses feedback"
).split()
MAIN_WORDS = "main content post entry story text body article page node copy prose".split()


def labelled_pages(n: int = 1000, seed: int = 5) -> list[tuple[str, str]]:
    """(html, main text) of made-up pages in several layouts, with side matter before, after and inside the content."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(400)]
    some = lambda a, b: " ".join(r.choice(words) for _ in range(r.randint(a, b)))
    links = lambda: "".join(f'<li><a href="/{w}">{w}</a></li>' for w in r.sample(words, r.randint(3, 12)))

    bar = lambda: " ".join(f"<a href='/{w}'>{w}</a>" for w in r.sample(words, r.randint(2, 6)))

    turn = cycle(SIDE_WORDS)  # each name as often as the others

    def side_name() -> str:
        w = next(turn)
        return r.choice([w, w, w, f"site-{w}", f"top-{w}", f"{w}-box", f"{w}-list", f"{w}-container", f"{w}-area"])

    def main_name() -> str:
        w, s = r.choice(MAIN_WORDS), r.choice(SIDE_WORDS)
        return r.choice([w, w, w, w, f"{w}-body", f"{w}-text", f"{w} has-{s}", f"{w} with-{s}", f"{w} {s}-open", f"no-{s}", "widget-text", "search-results", "search-page", "header-image", "entry-header", "related-work"])

    def side(inside: bool) -> str:
        body = r.choice([f"<p>{some(3, 40)}</p>", some(2, 25), f"<ul>{links()}</ul>", f"<p>{some(1, 6)} <a href='/x'>{some(1, 4)}</a></p>", f"<h3>{some(1, 4)}</h3><ul>{links()}</ul>", bar(), f"<p>{some(5, 30)}</p><p>{some(5, 30)}</p>"])
        if r.random() < 0.5:
            where = r.choice(["class", "class", "id"])
            return f"<{(t := r.choice(['div', 'div', 'section', 'ul' if body.startswith('<li') else 'div']))} {where}='{side_name()}'>{body}</{t}>"
        if inside:
            return r.choice([f"<aside>{body}</aside>", f"<form>{body}<input></form>", f"<footer>{body}</footer>", f"<nav><ul>{links()}</ul></nav>"])
        return r.choice([f"<nav><ul>{links()}</ul></nav>", f"<header>{body}</header>", f"<header><h1>{some(1, 4)}</h1><nav><ul>{links()}</ul></nav></header>", f"<footer>{body}</footer>", f"<footer>{some(3, 25)}</footer>", f"<p>{r.choice(['&copy;', '©', '(c)', 'Copyright ©'])} {r.randint(1999, 2030)} {some(1, 9)}</p>", f"<aside>{body}</aside>", f"<form>{body}<input></form>", f"<div><ul>{links()}</ul></div>", f"<div>{bar()}</div>", f"<div id='{r.choice(['top', 'bottom'])}'>{bar()}</div>", f"<div role='{r.choice(['navigation', 'banner', 'contentinfo', 'complementary'])}'>{body}</div>"])

    def piece(blocks: list[str]) -> str:
        kind = r.random()
        if kind < 0.72:
            b = some(1, 90)
            blocks.append(b)
            return r.choice([f"<p>{b}</p>", f"<p>{b}</p>", f"<p>{b}", f"<div>{b}</div>", f"<blockquote>{b}</blockquote>", f"<p class='{main_name()}'>{b}</p>"])
        if kind < 0.8:
            a, b = some(1, 8), some(1, 12)
            blocks.extend([a, b])
            return f"<ul><li>{a}</li><li>{b}</li></ul>"
        if kind < 0.86:
            b = some(1, 7)
            blocks.append(b)
            return f"<h2>{b}</h2>"
        if kind < 0.93:
            a, b, c = some(1, 20), some(1, 4), some(1, 20)
            blocks.append(f"{a} {b} {c}")
            return f"<p>{a} <a href='/y'>{b}</a> {c}</p>"
        if kind < 0.96:
            b = some(1, 8)
            blocks.append(b)
            return f"<p><a href='/z'>{b}</a></p>"
        b = some(3, 30)
        blocks.append(b)
        return f"<div class='{main_name()}'><p>{b}</p></div>"

    out = []
    for _ in range(n):
        title = some(2, 9)
        blocks = [title]
        head = r.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", f"<div class='{r.choice(['entry-header', 'post-header', 'title-header'])}'><h1>{title}</h1></div>"])
        plain = f"<h1>{title}</h1>"
        body = [piece(blocks) for _ in range(r.randint(1, 9))]
        if sum(len(b.split()) for b in blocks) < 25:
            blocks.append(some(25, 60))
            body.append(f"<p>{blocks[-1]}</p>")
        while r.random() < 0.55:
            body.insert(r.randrange(len(body) + 1), side(True))
        half = len(body) // 2
        rest, first = "".join(body), "".join(body[:half])
        main = r.choice(
            [
                f"<article>{head}{rest}</article>",
                f"<article class='{main_name()}'>{head}{rest}</article>",
                f"<main>{head}{rest}</main>",
                f"<div role='main'>{head}{rest}</div>",
                f"<main><article>{head}{rest}</article></main>",
                f"<main>{plain}{first}<article>{''.join(body[half:])}</article></main>",
                f"<div class='{main_name()}'>{plain}{rest}</div>",
                f"<div id='{r.choice(MAIN_WORDS)}'>{plain}<div class='{main_name()}'>{rest}</div></div>",
                f"<div id='{r.choice(MAIN_WORDS)}'><section>{plain}{first}</section><section>{''.join(body[half:])}</section></div>",
                f"<div>{plain}{rest}</div>",
                f"<div class='{r.choice(SIDE_WORDS)}'><article>{head}{rest}</article></div>",
                f"<table><tr><td>{plain}{rest}</td></tr></table>",
            ]
        )
        before, after = "".join(side(False) for _ in range(r.randint(0, 3))), "".join(side(False) for _ in range(r.randint(0, 3)))
        whole = f"{before}{main}{after}"
        wrap = r.choice(["", "", "<div class='wrap'>", "<div id='page'>"])
        out.append((f"<html><head><title>{some(2, 6)}</title></head><body{r.choice(['', '', f' class={chr(39)}{main_name()}{chr(39)}'])}>{wrap}{whole}{'</div>' if wrap else ''}</body></html>", "\n\n".join(blocks)))
    return out


def train_weights(pages: list[tuple[str, str]], ridge: float = 4e-6, least: int = 3, steps: int = 14) -> dict[str, float]:
    """Log odds of features by logistic regression over the pages' blocks, and costs of tags by their share beside main text."""
    index: dict[str, int] = {}
    rows: list[dict[int, float]] = []
    label: list[bool] = []
    inside: dict[str, int] = {}
    outside: dict[str, int] = {}
    for page, main in pages:
        read, kept = Reader(page), set(main.split("\n\n"))
        good = [b[0] in kept for b in read.blocks]
        down: list[dict[int, float]] = []
        for i, e in enumerate(read.elements):
            f = dict(down[e.parent]) if i else {}
            for name in read.element_features(e) if i and e.name not in NEVER_MAIN else ():
                k = index.setdefault(name, len(index))
                f[k] = f.get(k, 0.0) + 1
            down.append(f)
        ever = [False] * len(read.elements)
        for i, e in enumerate(read.elements):
            ever[i] = bool(i) and (ever[e.parent] or e.name in NEVER_MAIN)
        for b, ok in zip(read.blocks, good, strict=True):
            if not ever[b[1]]:
                f = dict(down[b[1]])
                for name in read.block_features(b):
                    k = index.setdefault(name, len(index))
                    f[k] = f.get(k, 0.0) + 1
                rows.append(f)
                label.append(ok)
        spots = [i for i, (name, _, b) in enumerate(read.tokens) if name is None and good[b]]
        lo, hi = (spots[0], spots[-1]) if spots else (0, -1)
        for i, (name, _, _) in enumerate(read.tokens):
            if name is not None:
                count = inside if lo <= i <= hi else outside
                count[name] = count.get(name, 0) + 1
    weights: dict[str, float] = {}
    if rows:
        x = np.zeros((len(rows), len(index)))
        for i, f in enumerate(rows):
            x[i, list(f)] = list(f.values())
        known = (x > 0).sum(0) >= least
        x, index = x[:, known], {n: k for k, n in enumerate(n for n, k in index.items() if known[k])}
        y, w = np.array(label, float), np.zeros(len(index))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hess = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
            w -= np.linalg.solve(hess, x.T @ (p - y) / len(x) + ridge * w)
        weights |= {name: round(float(w[k]), 6) for name, k in index.items()}
    names = inside.keys() | outside.keys()
    a, b = sum(inside.values()) + len(names) + 1, sum(outside.values()) + len(names) + 1
    low, high = TAG_SCORE
    ratio = {t: math.log((inside.get(t, 0) + 1) / a) - math.log((outside.get(t, 0) + 1) / b) for t in names}
    weights |= {f"<{t}>": round(min(high, max(low, v / 10)), 6) for t, v in ratio.items()}
    weights["<>"] = round(sum(weights[f"<{t}>"] for t in names) / max(1, len(names)), 6) if names else high
    return weights


@cache
def default_weights() -> tuple[tuple[str, float], ...]:
    return tuple(sorted(train_weights(labelled_pages()).items()))


def main_text(page: str | None, weights: dict[str, float]) -> str:
    return Reader(page).text(weights) if page else ""


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``."""
    weights = train_weights(labelled) if labelled else dict(default_weights())

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(p, weights) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
