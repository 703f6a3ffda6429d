"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read once into leaf blocks: runs of text between block-level tags, each with the tags and
class words of its ancestors. Features of a block are these ancestors, its own tag, properties of its
whole text (length, links, punctuation, digits, place), the length and links of its neighbours, and whether
most of the page's unlinked text stands under its tag. The field has two labels, main and other, with
weights for (feature, label) and for label pairs; it is trained by maximum likelihood (forward-backward,
AdaGrad, L2) on labelled pages and decoded by Viterbi.

Labelled pages come from the caller or from ``labelled_pages`` and ``noted_pages``, generators of page layouts whose
blocks are labelled by construction; their number is a parameter. The second kind has no telling markup, so the words of
notices, calls, comments and menus (SAYS) get weights too. Training is bounded and runs on the driver.

Defined cases: null or empty html gives an empty text; broken markup never fails: unclosed tags end with
their parents, an unfinished tag or comment at the end is dropped. Repeated rows stay, other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Container, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

# Groups of HTML elements.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "select", "object", "math", "title")
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
#: A new one of these ends an open one of the same group within the same parent.
ENDS = {"p": "p", "li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}
#: Block elements that end an open paragraph.
CLOSES_P = frozenset(("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"))

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<[!?/a-zA-Z][^>]*\Z", re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: What blocks beside an article say, by kind, in the languages covered; each is a feature of a block that says it, and
#: another of one that is short.
SAYS = {
    "consent": ("cookie", "cookies", "consent", "privacy policy", "datenschutz", "accept all", "we use cookies", "politique de confidentialité", "privacidad"),
    "call": ("subscribe", "newsletter", "sign up", "inbox", "unsubscribe", "abonnieren", "abonnez", "suscríbete", "download our app", "follow us", "donate"),
    "talk": ("comment", "comments", "commented", "reply", "replied", "posted by", "says:", "wrote:", "thanks for sharing", "great article", "great post", "nice article", "nice post", "kommentar", "commentaire", "comentario", "i agree with", "leave a reply", "upvote"),
    "legal": ("copyright", "all rights reserved", "terms of use", "terms of service", "impressum", "powered by"),
    "advert": ("advertisement", "sponsored", "buy now", "limited offer", "free shipping", "anzeige", "publicité", "publicidad", "special offer"),
    "way": ("menu", "home", "log in", "login", "sign in", "skip to", "search", "contact us", "about us", "back to top", "read more", "related articles", "share this", "next page", "previous"),
}
SAID = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, v)) + r")(?!\w)") for k, v in SAYS.items()}
SHORT_WORDS = 32
NAME = re.compile(r"[a-z]+")
DIGIT = re.compile(r"\d")


def blocks(html: str, known: Container[str] | None = None) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, marks of ancestors, share of characters in links) of the leaf blocks, in page order.

    Marks are the tags and class words of all open elements, each once; where ``known`` is given, those in
    it only. The last one is the innermost element's tag, marked as own. Elements, and marks, are counted as
    they open and close, so a page costs time in proportion to its length whatever stays open.
    """
    out: list[tuple[str, tuple[str, ...], float]] = []
    stack: list[tuple[str, list[str]]] = []  # open elements and their marks
    tags: Counter[str] = Counter()  # how many of each are open
    marks: dict[str, int] = {}
    parts: list[str] = []
    linked, link_open = 0, 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, (*marks, f"own<{stack[-1][0]}") if stack else (), min(1.0, linked / len(text))))
            parts, linked = [], 0

    def leave() -> None:
        name, names = stack.pop()
        tags[name] -= 1
        for m in names:
            marks[m] -= 1
            if not marks[m]:
                del marks[m]

    at = 0
    for m in MARKUP.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            parts.append(piece)
            if link_open:
                linked += len(piece.strip())
        at = m.end()
        name = m.group(3)
        if name is None:
            if m.group(1):
                parts.append(" ")
            continue
        name = name.lower()
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                link_open = 0 if m.group(2) else 1
            continue
        close()
        if m.group(2):
            if tags[name] > 0:
                while stack[-1][0] != name:
                    leave()
                leave()
            link_open = 0
            continue
        if name in VOID:
            continue
        if name in CLOSES_P and stack and stack[-1][0] == "p":
            leave()
        elif name in ENDS:
            group = ENDS[name]
            for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if ENDS.get(stack[i][0]) == group:
                    while len(stack) > i:
                        leave()
                    break
        names = [f"<{name}"]
        if m.group(4):
            for key, a, b, c in ATTRIBUTE.findall(m.group(4)):
                names += [f"{'role' if key.lower() == 'role' else 'c'}={w}" for w in NAME.findall((a or b or c).lower())]
        names = [x for x in names if known is None or x in known]
        for x in names:
            marks[x] = marks.get(x, 0) + 1
        stack.append((name, names))
        tags[name] += 1
    if at < len(html):
        parts.append(html[at:])
    close()
    return out


def features(page: list[tuple[str, tuple[str, ...], float]]) -> list[list[str]]:
    out, n = [], len(page)
    # how much of the page's unlinked text stands in paragraphs of its own tag, in tenths
    plain = [len(text) * (1 - links) for text, _, links in page]
    by_tag: Counter[str] = Counter()
    for (_, marks, _), size in zip(page, plain, strict=True):
        by_tag[marks[-1] if marks else ""] += size
    most = max(by_tag.values(), default=0.0)
    for i, (text, marks, links) in enumerate(page):
        words = text.count(" ") + 1
        marked = sum(map(text.count, ".,;:!?"))
        f = ["bias", f"len{min(6, words.bit_length())}", f"links{round(links * 3)}", f"stop{min(3, marked)}", f"place{4 * i // n}"]
        if DIGIT.search(text):
            f.append("digit")
        if "©" in text:
            f.append("copyright")
        low = text.lower()
        said = [k for k, p in SAID.items() if p.search(low)]
        f += [f"says {k}" for k in said]
        if words <= SHORT_WORDS:
            f += [f"short {k}" for k in said]
        if i == 0:
            f.append("first")
        if i == n - 1:
            f.append("last")
        if most and by_tag[marks[-1] if marks else ""] == most:
            f.append("mosttext")
        for side, j in (("before", i - 1), ("after", i + 1)):
            if 0 <= j < n:
                f.append(f"{side}{'links' if page[j][2] > 0.5 else min(4, (page[j][0].count(' ') + 1).bit_length() // 2)}")
        out.append([*f, *marks])
    return out


class Field:
    """Weights of a two-label chain: 1 is main, 0 other."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, pairs: np.ndarray):
        self.index, self.weights, self.pairs = index, weights, pairs

    def potentials(self, page: list[list[str]]) -> np.ndarray:
        get = self.index.get
        return np.array([self.weights[[k for f in b if (k := get(f)) is not None]].sum(axis=0) for b in page])

    def decode(self, page: list[list[str]]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not page:
            return []
        score = self.potentials(page).tolist()
        (aa, ab), (ba, bb) = self.pairs.tolist()
        x, y = score[0]
        back = []
        for u, v in score[1:]:
            from0 = (0, x + aa) if x + aa >= y + ba else (1, y + ba)
            from1 = (0, x + ab) if x + ab > y + bb else (1, y + bb)
            back.append((from0[0], from1[0]))
            x, y = from0[1] + u, from1[1] + v
        label = int(y > x)
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]


def both_ways(e: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log of the sum over all label paths, and the log-sums over their beginnings and ends at each block."""
    n = len(e)
    fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
    fwd[0] = e[0]
    for i in range(1, n):
        fwd[i] = e[i] + np.logaddexp.reduce(fwd[i - 1][:, None] + t, axis=0)
    for i in range(n - 2, -1, -1):
        bwd[i] = np.logaddexp.reduce(t + (e[i + 1] + bwd[i + 1])[None, :], axis=1)
    return float(np.logaddexp.reduce(fwd[-1])), fwd, bwd


def train(pages: list[tuple[str, list[int]]], *, epochs: int = 8, rate: float = 0.3, l2: float = 1e-4, seed: int = 3) -> Field:
    """Maximum-likelihood training on (html, label of each leaf block)."""
    made = [(features(blocks(h)), y) for h, y in pages]
    index: dict[str, int] = {}
    for x, _ in made:
        for b in x:
            for f in b:
                index.setdefault(f, len(index))
    data = [([np.array([index[f] for f in b]) for b in x], y) for x, y in made if x]
    w, t = np.zeros((len(index), 2)), np.zeros((2, 2))
    gw, gt = np.full_like(w, 1e-8), np.full_like(t, 1e-8)
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for x, y in data:
            n = len(x)
            e = np.array([w[b].sum(axis=0) for b in x])
            z, fwd, bwd = both_ways(e, t)
            wrong = np.exp(fwd + bwd - z)
            wrong[np.arange(n), y] -= 1
            d = np.zeros_like(w)
            for b, g in zip(x, wrong, strict=True):
                np.add.at(d, b, g)
            dt = np.zeros_like(t)
            for i in range(1, n):
                dt += np.exp(fwd[i - 1][:, None] + t + (e[i] + bwd[i])[None, :] - z)
                dt[y[i - 1], y[i]] -= 1
            d += l2 * w
            gw += d * d
            gt += dt * dt
            w -= rate * d / np.sqrt(gw)
            t -= rate * dt / np.sqrt(gt)
    return Field(index, w, t)


#: Boxes that say nothing of the article in them.
BARE = (("", ""), ("", ""), ("<div>", "</div>"), ('<div class="wrap">', "</div>"), ("<center>", "</center>"), ("<section>", "</section>"))


def plain_page(layout: str, draw: random.Random, words, items) -> tuple[str, list[int]]:
    """A page without semantic tags: columns of a layout table, or nested divs of meaningless classes."""
    name = lambda: draw.choice(["", "", f' class="{draw.choice("abcxyz")}{draw.randint(1, 99)}"', ' class="box"', ' class="col row"', ' width="60%"'])
    labels: list[int] = []

    def links() -> str:
        k = draw.randint(2, 9)
        if draw.random() < 0.4:
            labels.extend([0] * k)
            return f"<ul>{items(k)}</ul>"
        labels.append(0)
        return draw.choice([" | ", " ", "<br>"]).join(f'<a href="/{i}">{words(1, 3)}</a>' for i in range(k))

    def short() -> str:
        labels.append(0)
        return draw.choice([f"&copy; {words(1, 10)}", f"Copyright 20{draw.randint(10, 29)} {words(1, 6)}", f'<a href="/x">{words(1, 4)}</a> {words(1, 2)}', f'<small><a href="/">{words(1, 3)}</a> | <a href="/y">{words(1, 2)}</a></small>'])

    def article() -> str:
        made = []
        if draw.random() < 0.6:
            h = draw.choice(["h1", "h1", "h2"])
            made.append(f"<{h}>{words(2, 9)}</{h}>")
        tag = draw.choice(["p", "p", "div"])
        made += [f"<{tag}{name() if tag == 'div' else ''}>{words(8, 110)}</{tag}>" for _ in range(draw.randint(1, 9))]
        labels.extend([1] * len(made))
        return "".join(made)

    cell = "td" if layout == "table" else "div"
    cells, top, bottom = [], "", ""
    if draw.random() < 0.7:
        top = f"<{cell}{name()}>{links()}</{cell}>"
    for part in draw.choice([(links, article), (article, links), (links, article, links), (article,), (links, article, short)]):
        cells.append(f"<{cell}{name()}>{part()}</{cell}>")
    if draw.random() < 0.8:
        bottom = f"<{cell}{name()}>{short()}</{cell}>"
    if layout == "table":
        rows = [r for r in (top, "".join(cells), bottom) if r]
        body = f"<table{name()}>{''.join(f'<tr>{r}</tr>' for r in rows)}</table>"
    else:
        body = f"<div{name()}>{top}<div{name()}>{''.join(cells)}</div>{bottom}</div>"
    return f"<html><head><title>{words(2, 8)}</title></head><body>{body}</body></html>", labels


def labelled_pages(n: int = 480, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Pages of varied layouts whose blocks are labelled by construction: (html, labels)."""
    draw = random.Random(seed)

    def words(a: int, b: int) -> str:
        made = ["".join(draw.choice("aeioubcdlmnrst") for _ in range(draw.randint(2, 9))) for _ in range(draw.randint(a, b))]
        made = [w if draw.random() > 0.02 else f"{draw.randint(1, 2030)}" for w in made]
        made = [w if draw.random() > 0.1 else w.capitalize() for w in made]
        text = " ".join(w + draw.choice(["", "", "", ",", "."]) for w in made)
        return text[:1].upper() + text[1:] + draw.choice([".", "", "."])

    def items(k: int, link: bool = True) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' if link else f"<li>{words(2, 9)}</li>" for i in range(k))

    out = []
    for k in range(n):
        labels: list[int] = []
        body: list[str] = []
        layout = ("boxes", "boxes", "boxes", "boxes", "bare", "table", "soup", "alone")[k % 8]

        def other(html: str, k: int = 1) -> None:
            body.append(html)  # noqa: B023
            labels.extend([0] * k)  # noqa: B023

        def main(html: str, k: int = 1) -> None:
            body.append(html)  # noqa: B023
            labels.extend([1] * k)  # noqa: B023

        if layout in ("table", "soup"):
            out.append(plain_page(layout, draw, words, items))
            continue
        if layout == "alone":  # nothing but the article
            made = [f"<{(h := draw.choice(['p', 'p', 'p', 'h1', 'div', 'pre']))}>{words(1, draw.choice([6, 12, 80]))}</{h}>" for _ in range(draw.choice([1, 1, 1, 2, 3, 5]))]
            box = draw.choice(BARE)
            frame = draw.choice([("<html><body>", "</body></html>"), ("", ""), ("<body>", "")])
            if draw.random() < 0.15:
                made, box = [words(3, 40)], BARE[0]
            out.append((f"{frame[0]}{box[0]}{''.join(made)}{box[1]}{frame[1]}", [1] * len(made)))
            continue
        if draw.random() < 0.5:
            kind = draw.choice(['class="header"', 'id="masthead"', ""])
            other(f"<header {kind}><h1>{words(1, 4)}</h1><p>{words(2, 8)}</p></header>", 2)
        if draw.random() < 0.9:
            k = draw.randint(2, 8)
            box = draw.choice([("<nav>", "</nav>"), ('<div class="menu">', "</div>"), ('<div role="navigation">', "</div>"), ('<ul class="breadcrumb nav">', "</ul>")])
            other(f"{box[0]}<ul>{items(k)}</ul>{box[1]}", k)
        for kind in ("ad", "advert banner", "cookie notice", "promo", "newsletter", "share social"):
            if draw.random() < 0.3:
                other(f'<div class="{kind}">{words(2, 18)}</div>')
        if draw.random() < 0.3:
            k = draw.randint(1, 4)
            other(f'{draw.choice(["<aside>", "<aside class=sidebar>"])}{"".join(f"<p>{words(3, 20)}</p>" for _ in range(k))}</aside>', k)
        box = draw.choice(BARE if layout == "bare" else [("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div role="main">', "</div>"), ('<div class="content">', "</div>"), ('<div id="article" class="post entry">', "</div>"), ("<main><article>", "</article></main>")])
        body.append(box[0])
        if draw.random() < 0.8:
            main(f"<h1>{words(2, 9)}</h1>")
        for _ in range(draw.randint(1, 14)):
            r = draw.random()
            if r < 0.6:
                main(f"<p>{words(1, 90)}</p>")
            elif r < 0.7:
                main(f"<p><b>{words(1, 12)}<br><p>{words(1, 40)}</p>", 2)
            elif r < 0.78:
                main(f"<{(h := draw.choice(['h2', 'h3', 'h4']))}>{words(1, 7)}</{h}>")
            elif r < 0.84:
                k = draw.randint(1, 5)
                main(f"<ul>{items(k, False)}</ul>", k)
            elif r < 0.88:
                main(f"<blockquote>{words(4, 40)}</blockquote>")
            elif r < 0.91:
                main(f"<pre>{words(3, 30)}</pre>")
            elif r < 0.94:
                main(f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", 2)
            elif r < 0.97:
                other(f'<div class="{draw.choice(["ad", "share", "related", "advert", "promo"])}">{words(2, 12)}</div>')
            else:
                other(f"<aside>{words(3, 20)}</aside>")
        if draw.random() < 0.3:  # a short last line
            main(f"<p>{words(2, 9)}")
        body.append(box[1])
        if draw.random() < 0.35:
            k = draw.randint(1, 5)
            kind = draw.choice(['<section class="comments">', '<div id="comments">', '<div class="comment list">', '<section class="responses comments">'])
            end = "</section>" if kind.startswith("<section") else "</div>"
            other(f"{kind}{''.join(f'<p>{words(2, 50)}</p>' for _ in range(k))}{end}", k)
        if draw.random() < 0.3:
            other(f"<form><p>{words(1, 6)}</p></form>")
        if draw.random() < 0.3:
            k = draw.randint(1, 5)
            other(f'<div class="sidebar related">{"".join(f"<p>{words(2, 12)}</p>" for _ in range(k))}</div>', k)
        if draw.random() < 0.9:
            other(f'{draw.choice(["<footer>", "<footer class=footer>"])}&copy; {words(1, 12)}</footer>')
        out.append((f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title></head><body>{''.join(body)}</body></html>", labels))
    return out


def noted_pages(n: int = 240, seed: int = 13) -> list[tuple[str, list[int]]]:
    """Pages whose menus, notices, calls and comments have no telling tags or classes: only what they say, and where, gives them away.

    Articles of these pages use the same words now and then, in longer paragraphs; where markup does tell an article, its
    short lines say them too and belong to it.
    """
    draw = random.Random(seed)
    plain = ("the", "river", "stone", "quiet", "morning", "letter", "harbour", "walked", "under", "winter", "between", "garden", "light", "slowly", "old", "paper", "and", "was", "with", "road", "small", "market", "people", "years", "their")

    def prose(a: int, b: int) -> str:
        w = [draw.choice(plain) for _ in range(draw.randint(a, b))]
        if len(w) > SHORT_WORDS and draw.random() < 0.3:
            w[draw.randrange(len(w))] = draw.choice(draw.choice(list(SAYS.values())))
        text = "".join(x + draw.choice([" ", " ", " ", " ", ", ", ". "]) for x in w).strip(" ,.")
        return text[:1].upper() + text[1:] + "."

    def said(kind: str) -> str:
        """A short text with words of the kind, among others."""
        parts = [draw.choice(SAYS[kind])]
        if draw.random() < 0.6:
            parts.append(draw.choice(SAYS[kind]))
        filler = lambda: " ".join(draw.choice(plain) for _ in range(draw.randint(1, 9)))
        text = " ".join([*([filler()] if draw.random() < 0.6 else []), *(f"{p} {filler()}" for p in parts)])
        return text[:1].upper() + text[1:] + draw.choice([".", "!", "", "?"])

    out = []
    for _ in range(n):
        labels: list[int] = []
        body: list[str] = []
        tag = draw.choice(["p", "p", "p", "div"])

        def put(label: int, text: str, of: str) -> None:
            body.append(f"<{of}>{text}</{of}>")  # noqa: B023
            labels.append(label)  # noqa: B023

        if draw.random() < 0.5:
            put(0, draw.choice(["Menu", "Home", "Navigation", said("way"), "Home | About us | Contact us"]), draw.choice(["nav", "nav", "div", "header"]))
        for kind in ("consent", "call", "advert", "way"):
            if draw.random() < 0.25:
                put(0, said(kind), tag)
        told = draw.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>")]) if draw.random() < 0.5 else None
        if told:
            body.append(told[0])
        if draw.random() < 0.7:
            put(1, prose(2, 9).rstrip("."), draw.choice(["h1", "h1", "h2"]))
        for _ in range(draw.randint(1, 9)):
            put(1, prose(12, 90), tag)
            if told and draw.random() < 0.3:
                put(1, draw.choice([said(draw.choice(list(SAYS))), "All rights reserved."]), tag)
            elif not told and draw.random() < 0.06:
                put(0, said(draw.choice(["call", "advert"])), tag)
        if draw.random() < 0.25:
            put(1, prose(3, 11) if draw.random() < 0.6 else f"{prose(3, 7)[:-1]} {draw.choice(SAYS['way'])}.", tag)
        if told:
            body.append(told[1])
        for kind in ("call", "consent", "talk", "talk", "talk", "way", "legal"):
            if draw.random() < 0.35:
                put(0, said(kind), draw.choice([tag, tag, "footer"]) if kind == "legal" else tag)
        frame = draw.choice([("<html><body>", "</body></html>"), ("<body>", "</body>"), ("<html><body><div>", "</div></body></html>")])
        out.append((frame[0] + "".join(body) + frame[1], labels))
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages() + noted_pages())


def extract(html: str | None, field: Field) -> str:
    page = blocks(html or "", field.index)
    return "\n".join(b[0] for b, y in zip(page, field.decode(features(page)), strict=True) if y)


def extract_pages(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, main text and its length in code points."""
    small_batches(pages.sparkSession)
    field = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [extract(h, field) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
