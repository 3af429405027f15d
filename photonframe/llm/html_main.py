"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: stretches of text between block-level tags. Each has features of its ancestors (tags, and the
kinds of thing that their class, id and role names speak of) and of its text (length, links, punctuation). A two-label chain
(main, other) is fitted on labelled pages by gradient ascent of the penalised likelihood, and Viterbi decoding labels the
blocks of a page. The labelled pages are laid out by `labelled_pages` from a seed, so that names, nesting and text lengths vary; a part of the names
says nothing or misleads, so that tags, links and texts must decide.

Null, empty and tag-only pages give an empty text. Unclosed tags, comments and scripts run to the end of the page, as in
browsers. Whole pages are read, whatever their length. Repeated rows are extracted each. Extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import per_text

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page; all else, formulas and fallbacks too, is left to the field.
DROPPED = ("script", "style", "template", "iframe", "title", "textarea")
#: Inline elements whose text is a block of its own, as it belongs to a form wherever it stands.
APART = frozenset(("button", "label"))
#: An opening tag ends an open element of its kind, unless one of the others was opened since.
_ENDS_OWN = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "option": (("option",), ("select",))}
#: Names in class, id and role attributes, by the kind of thing that they speak of.
KINDS = {
    "ad": "ad ads adv advert adverts advertisement adsense adslot banner sponsor sponsored sponsors promo promoted promotion promotions dfp commercial",
    "nav": "nav navbar navigation navi menu menus breadcrumb breadcrumbs pagination pager toc tabs tab toolbar sitemap links skip",
    "foot": "footer foot copyright legal colophon contentinfo bottom imprint",
    "head": "header masthead topbar logo branding head hero top",
    "side": "sidebar side aside rail related recommended recommendations complementary widget widgets trending popular teaser teasers more latest",
    "notice": "notice notices cookie cookies consent gdpr privacy alert popup modal overlay newsletter subscribe subscription signup paywall disclaimer warning dialog toast message",
    "comment": "comment comments commentlist reply replies disqus respond discussion feedback reader readers",
    "share": "share shares social sharing follow tools buttons",
    "form": "form forms login search searchbox contact survey poll register",
    "main": "article content post entry story main body text prose articlebody maincontent richtext",
}
KIND_OF = {name: kind for kind, names in KINDS.items() for name in names.split()}
TAG_KIND = {"nav": "nav", "menu": "nav", "footer": "foot", "header": "head", "aside": "side", "form": "form", "fieldset": "form", "select": "form", "button": "form", "label": "form", "article": "main", "main": "main", "dialog": "notice"}
# Quotes count after an equals sign only. Every pattern runs forward without giving back, and what is not closed ends the page.
_MARK = re.compile(r"<(?:(!--)|([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>?)|/([a-zA-Z][^\s/>]*+)[^>]*+(>?)|[!?/][^>]*+(>?))")
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|style)(?![\w-])(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in DROPPED}
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _kinds(tag: str, attributes: str) -> tuple[str, ...]:
    found = [TAG_KIND[tag]] if tag in TAG_KIND else []
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, a, b, c in _ATTR.findall(attributes):
            value = a or b or c
            if name.lower() == "hidden" or name.lower() == "style" and re.search(r"display\s*+:\s*+none", value):
                found.append("hidden")
            elif name.lower() in ("class", "id", "role"):
                # Within one name the other kinds tell more than main does ("comment-body", "main-nav").
                for word in value.split():
                    own = dict.fromkeys(KIND_OF[w] for w in (x.lower() for x in _NAME.findall(word)) if w in KIND_OF)
                    found += [k for k in own if k != "main" or len(own) == 1]
    kinds = tuple(dict.fromkeys(found))
    # An element that is named main and something else says little: its own kind.
    return ("mixed",) if "main" in kinds and len(kinds) > 1 and tag not in TAG_KIND else kinds


class _Frame:
    """An open element with what its features need of all its ancestors, so that no step walks the stack."""

    __slots__ = ("tag", "holder", "linked", "inner", "before", "after", "main", "open_p", "names")

    def __init__(self, tag: str, kinds: tuple[str, ...], up: _Frame | None, place: int):
        self.tag = tag
        self.holder = tag if tag in BLOCK else up.holder if up else "body"
        self.linked = tag == "a" or bool(up and up.linked)
        self.inner = kinds[0] if kinds else up.inner if up else "none"
        before, after, main = (up.before, up.after, up.main) if up else (frozenset(), frozenset(), False)
        for k in kinds:
            if main:
                after |= {k} - {"main"}
            elif k == "main":
                main = True
            else:
                before |= {k}
        self.before, self.after, self.main = before, after, main
        # The place of the nearest paragraph with only inline elements inside.
        self.open_p = place if tag == "p" else -1 if tag in BLOCK or not up else up.open_p
        self.names: list[str] | None = None

    def features(self) -> list[str]:
        """Names of the features that hold for all text in this element."""
        if self.names is None:
            out = ["bias", "in:" + ("h" if self.holder in _HEADING else self.holder), "inner:" + self.inner]
            out += [f"any:{k}" for k in sorted(self.before | self.after | ({"main"} if self.main else set()))]
            if self.main:
                out.append("main>" + ",".join(sorted(self.after)))
                out += [f"main>{k}" for k in sorted(self.after)] + [f"{k}>main" for k in sorted(self.before)]
            self.names = out
        return self.names


class _Stack:
    """The open elements, with the places of each tag and of block elements."""

    def __init__(self):
        self.frames: list[_Frame] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, kinds: tuple[str, ...]) -> None:
        place = len(self.frames)
        self.frames.append(_Frame(tag, kinds, self.frames[-1] if place else None, place))
        self.places.setdefault(tag, []).append(place)
        if tag in BLOCK:
            self.blocks.append(place)

    def cut(self, place: int) -> None:
        while len(self.frames) > place:
            tag = self.frames.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def opens(self, tag: str) -> None:
        """Closes what a block element that opens ends: a paragraph with its inline elements, and items of its kind."""
        if self.frames and tag not in ("body", "html", "option", "optgroup") and (p := self.frames[-1].open_p) >= 0:
            self.cut(p)
        if tag in _ENDS_OWN:
            own, stop = map(self.last, _ENDS_OWN[tag])
            if own > stop:
                self.cut(own)

    def closes(self, tag: str) -> None:
        place = self.last((tag,))
        if place >= 0 and (tag in BLOCK or not self.blocks or self.blocks[-1] < place):
            self.cut(place)


_BODY = _Frame("body", (), None, 0)


def leaf_blocks(page: str | None) -> list[tuple[str, list[str]]]:
    """(text, features) of each leaf block that has text, in page order; time and memory follow the page's length."""
    page = page or ""
    blocks: list[tuple[str, list[str]]] = []
    stack = _Stack()
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((text, features(text, stack.frames[-1] if stack.frames else _BODY, linked)))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if stack.frames and stack.frames[-1].linked:
                linked += len(text.strip())

    while found := _MARK.search(page, at):
        add(page[at : found.start()])
        at = found.end()
        comment, opened, attributes, ends, closed, closed_ends, other_ends = found.groups()
        if comment:
            # "<!-->" and "<!--->" are whole comments.
            close = _COMMENT_END.search(page, at - 2)
            at = close.end() if close else len(page)
        elif opened:
            if not ends:
                at = len(page)
                break
            tag = opened.lower()
            itself = attributes.endswith("/")
            if tag in _ENDS and not itself:
                close = _ENDS[tag].search(page, at)
                at = close.end() if close else len(page)
            elif tag == "br":
                parts.append(" ")
            else:
                if tag in BLOCK:
                    flush()
                    stack.opens(tag)
                elif tag in APART:
                    flush()
                if tag not in VOID and not (itself and tag not in BLOCK):
                    stack.push(tag, _kinds(tag, attributes))
        elif closed:
            if not closed_ends:
                at = len(page)
                break
            tag = closed.lower()
            if tag in BLOCK or tag in APART:
                flush()
            stack.closes(tag)
        elif not other_ends:
            at = len(page)
            break
    add(page[at:])
    flush()
    return blocks


def features(text: str, frame: _Frame, linked: int) -> list[str]:
    """Names of the features that hold for a block."""
    out = list(frame.features())
    words = text.count(" ") + 1
    out.append("words:" + ("1" if words < 3 else "2" if words < 8 else "3" if words < 25 else "4"))
    share = linked / max(1, len(text))
    out.append("links:" + ("0" if linked == 0 else "1" if share < 0.4 else "2" if share < 0.85 else "3"))
    if text[-1] in ".!?:;\"'”»…。":
        out.append("ends")
    if "©" in text or "(c)" in text.lower():
        out.append("copyright")
    return out


class Chain:
    """Weights of the two-label chain."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves

    def decode(self, rows: list[list[str]]) -> list[bool]:
        """Whether each block is main text, by Viterbi; ties go to main text."""
        if not rows:
            return []
        score = [self.weights[[self.names[f] for f in r if f in self.names]].sum(axis=0) for r in rows]
        best, back = score[0], []
        for s in score[1:]:
            step = best[:, None] + self.moves
            pick = np.where(step[1] >= step[0], 1, 0)
            back.append(pick)
            best = step[pick, [0, 1]] + s
        label = int(best[1] >= best[0])
        out = [label]
        for pick in reversed(back):
            label = int(pick[label])
            out.append(label)
        return [bool(x) for x in reversed(out)]


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 120, penalty: float = 0.02, rate: float = 0.15) -> Chain:
    """Weights of greatest penalised likelihood over pages of (features of blocks, labels), by Adam over all pages at once."""
    names = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for r in rows for f in r}))}
    longest, n = max(len(r) for r, _ in pages), len(pages)
    x = np.zeros((n, longest, len(names)), np.float32)
    y, mask = np.zeros((n, longest), int), np.zeros((n, longest), np.float32)
    for i, (rows, labels) in enumerate(pages):
        y[i, : len(labels)], mask[i, : len(labels)] = labels, 1
        for t, r in enumerate(rows):
            x[i, t, [names[f] for f in r]] = 1
    theta = np.zeros(len(names) * 2 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    onehot = np.eye(2)[y] * mask[..., None]
    pairs = np.einsum("ita,itb->ab", onehot[:, :-1], onehot[:, 1:])
    for step in range(1, rounds + 1):
        w, moves = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        s = x @ w.astype(np.float32)
        s = s.astype(np.float64)
        a, b = np.zeros_like(s), np.zeros_like(s)
        a[:, 0] = s[:, 0]
        for t in range(1, longest):
            a[:, t] = np.where(mask[:, t, None] > 0, np.logaddexp.reduce(a[:, t - 1, :, None] + moves, axis=1) + s[:, t], a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(mask[:, t + 1, None] > 0, np.logaddexp.reduce(moves + (b[:, t + 1] + s[:, t + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(a[:, -1], axis=1)
        p = np.exp(a + b - z[:, None, None]) * mask[..., None]
        q = np.exp(a[:, :-1, :, None] + moves + (s + b)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        grad = np.concatenate((np.tensordot(x, (onehot - p).astype(np.float32), ((0, 1), (0, 1))).ravel(), (pairs - q.sum(axis=(0, 1))).ravel())) / n - penalty / 10 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(names, theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2))


def labelled_pages(count: int = 400, seed: int = 11) -> Iterator[str]:
    """Made-up pages of many layouts, names and lengths. A block is main text if it holds the mark `qz`."""
    rng = random.Random(seed)
    pick = rng.choice

    def text(low: int, high: int, main: bool) -> str:
        words = ["".join(pick("abcdeilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high))]
        if main:
            words[0] = "qz" + words[0]
        return " ".join(words).capitalize().replace("Qz", "qz") + pick([".", ".", "!", "", "?"])

    def named(kind: str, tags: tuple[str, ...], inside: str) -> str:
        tag, attribute = pick(tags), pick(("class", "class", "id"))
        name = pick(KINDS[kind].split())
        name = pick((name, f"{name}-{pick(('box', 'wrap', 'inner', 'area', 'x1'))}", f"site-{name}", f"{name} clearfix"))
        if (odd := rng.random()) < 0.2:
            # A name that says nothing, as on sites whose names are made by tools.
            name = "".join(pick("bcdfghjklmnpqrstvwxyz") for _ in range(rng.randint(2, 6))) + pick(("", "-1", "_k"))
        elif odd < 0.27:
            # A name that speaks of something else as well.
            other_kind = pick([k for k in KINDS if k != kind]) if kind == "main" else "main"
            name = f"{name} {pick(KINDS[other_kind].split())}"
        plain = TAG_KIND.get(tag) == kind and rng.random() < 0.6
        return f"<{tag}>{inside}</{tag}>" if plain else f'<{tag} {attribute}="{name}">{inside}</{tag}>'

    def links(n: int) -> str:
        made = [f'<a href="/{i}">{text(1, 4, False)}</a>' for i in range(n)]
        return pick(("<ul>" + "".join(f"<li>{x}</li>" for x in made) + "</ul>", " | ".join(made), "".join(f"<p>{x}</p>" for x in made)))

    def prose(n: int, main: bool) -> str:
        out = []
        for _ in range(n):
            kind = rng.random()
            if kind < 0.1 and main:
                out.append(f"<h{rng.randint(2, 4)}>{text(1, 9, main)}</h3>" if rng.random() < 0.2 else f"<h2>{text(1, 9, main)}</h2>")
            elif kind < 0.17 and main:
                out.append("<ul>" + "".join(f"<li>{text(1, 20, main)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.22 and main:
                out.append(f"<blockquote>{text(4, 40, main)}</blockquote>")
            elif kind < 0.25 and main:
                out.append(f"<table><tr><td>{text(1, 6, main)}</td><td>{text(1, 6, main)}</td></tr></table>")
            elif kind < 0.4:
                out.append(f'<p>{text(1, 60, main)} <a href="/">{text(1, 4, False)}</a> {text(1, 20, False)}</p>')
            else:
                out.append(f"<p>{text(1, pick((6, 40, 160)), main)}" + pick(("</p>", "</p>", "", "<br>")))
        return "".join(out)

    def other() -> str:
        kind = pick(("ad", "ad", "nav", "side", "notice", "comment", "share", "form", "side"))
        if kind in ("ad", "notice", "share", "comment") and rng.random() < 0.25:
            return named(kind, ("p", "p", "span", "li"), text(2, 40, False))
        tags = {"nav": ("nav", "div", "ul"), "side": ("aside", "div", "section"), "form": ("form", "form", "div"), "notice": ("div", "section", "dialog"), "comment": ("div", "section", "ol")}.get(kind, ("div", "section", "aside"))
        if kind == "form":
            inside = f"<label>{text(1, 5, False)}</label><input><button>{text(1, 3, False)}</button>"
        elif kind in ("nav", "share") or rng.random() < 0.25:
            inside = links(rng.randint(1, 6))
        elif kind == "comment":
            inside = "".join(f'<div class="{pick(("c", "comment", "item"))}"><p>{text(2, 60, False)}</p></div>' for _ in range(rng.randint(1, 4)))
        else:
            inside = pick((text(2, 40, False), prose(rng.randint(1, 2), False)))
        return named(kind, tags, inside)

    for _ in range(count):
        title = f"<h1>{text(1, 14, True)}</h1>"
        if rng.random() < 0.2:
            title = f"<header>{title}</header>"
        body = []
        for _ in range(rng.randint(1, 7)):
            body.append(prose(rng.randint(1, 3), True))
            if rng.random() < 0.22:
                body.append(other())
        inside = (title if rng.random() < 0.85 else "") + "".join(body)
        holder = pick(("article", "article", "article", "main", "div", "section", "bare"))
        main = f"<div>{inside}</div>" if holder == "bare" else named("main", (holder,), inside)
        if holder == "article" and rng.random() < 0.3:
            main = f"<main>{main}</main>"
        before, after = "", ""
        if rng.random() < 0.7:
            before += pick(("<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead">{}</div>')).format(pick((text(1, 6, False), links(3), f"<h2>{text(1, 4, False)}</h2>" + links(4))))
        before += "".join(other() for _ in range(rng.randint(0, 3))) + (f"<nav>{links(rng.randint(2, 7))}</nav>" if rng.random() < 0.6 else "")
        after += "".join(other() for _ in range(rng.randint(0, 3)))
        mark = pick(("© ", "&copy; ", "", "(c) "))
        after += pick(("<footer>{}</footer>", "<footer><p>{}</p></footer>", '<div class="footer">{}</div>', "<footer>{}</footer>")).format(mark + text(1, 30, False)) if rng.random() < 0.9 else ""
        yield f"<!DOCTYPE html><html><head><title>{text(1, 5, False)}</title><style>p{{}}</style></head><body>{before}{main}{after}</body></html>"


@cache
def default_chain() -> Chain:
    """The chain fitted on the made-up labelled pages."""
    pages = []
    for page in labelled_pages():
        blocks = leaf_blocks(page)
        pages.append(([f for _, f in blocks], [int("qz" in t) for t, _ in blocks]))
    return fit(pages)


def extract(page: str | None, chain: Chain) -> str:
    """The main text of a page: its main blocks joined by one space."""
    blocks = leaf_blocks(page)
    return " ".join(t for (t, _), keep in zip(blocks, chain.decode([f for _, f in blocks]), strict=True) if keep)


def main_texts(pages: DataFrame, keep: list[str], html_col: str = "html", chain: Chain | None = None) -> DataFrame:
    """The columns `keep` with text and n_chars (code points) of every page."""
    shipped = pages.sparkSession.sparkContext.broadcast(chain or default_chain())

    def start():
        model = shipped.value

        def apply(found: list[str | None]) -> list[pa.Array]:
            texts = [extract(p, model) for p in found]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return apply

    return per_text(pages, keep, html_col, "text string, n_chars long", start)
