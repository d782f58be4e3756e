"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: the text between two boundaries of block elements, with its chain of open block elements.
Each block has features from its ancestors' tags, their class and id words, and its text.  The field has two labels
(main text or not), a weight for each feature and label, and one for each pair of neighbouring labels; it is trained in
numpy by maximum likelihood (forward-backward, L2) on labelled pages, and decoded by Viterbi.

The labelled pages are made by :func:`labelled_page`: page frames of many shapes with made-up words, whose blocks are
labelled as they are written.  Training reads no input table, so a fixed seed gives the same model on every machine.

Defined cases: null and empty pages, and pages without main text, give the empty text.  Unclosed elements are closed by
their parents' ends; a page cut off inside a tag keeps what stood before.  br is white space.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Names of HTML elements.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "title", "textarea", "select", "head_only", "object")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: An element that opens closes these where they are still open inside the nearest of ``SCOPES``.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
    "body": {"head"},
}
SCOPES = frozenset("ul ol dl table menu article aside section nav main div td th body html form blockquote".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words of classes and ids, by what they hint at.
HINTS = {
    "ad": "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner dfp affiliate outbrain taboola",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay privacy disclaimer toast",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs topbar toolbar pagination pager tabs skip toc",
    "side": "sidebar aside rail widget widgets related recommended trending popular more tags tagcloud latest",
    "foot": "footer foot copyright legal colophon bottom",
    "head": "header masthead head logo branding top site hero",
    "talk": "comment comments comentarios kommentare commentaires disqus reply replies respond discussion reader reviews responses",
    "share": "share sharing social follow subscribe newsletter signup login search form",
    "text": "article content entry post story body main text page body-text articlebody prose",
}
HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}
TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "figure", "table", "ul", "ol", "dl", "li", "p", "blockquote", "pre", "button", "label", "fieldset", "dialog", "address", "div", "td")

_TAG = re.compile(
    # an svg that closes itself has no end tag; a tag with an open quote ends at its first >
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<svg\b(?:[^>"']|"[^"]*"|'[^']*')*+(?<=/)>|<(?P<raw>%s)\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>"']*)[^<>]*>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""" % "|".join(RAW),
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PIECES = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[a-z]+")
ROLES = {"navigation": "menu", "banner": "head", "contentinfo": "foot", "complementary": "side", "search": "share", "dialog": "notice", "alert": "notice", "form": "share", "main": "text", "article": "text"}


@lru_cache(4096)
def _hints(attrs: str) -> frozenset[str]:
    found = set()
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in ROLES:
            found.add(ROLES[value])
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            found.add("hidden")
        elif name in ("class", "id"):
            found.update(HINT_OF[w] for w in _PIECES.findall(value) if w in HINT_OF)
    return frozenset(found)


class Block:
    """A leaf block: its text, the words of it inside links, and its open block elements from the outside in."""

    __slots__ = ("text", "linked", "path")

    def __init__(self, text: str, linked: int, path: tuple[tuple[str, frozenset[str]], ...]):
        self.text, self.linked, self.path = text, linked, path


def leaf_blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page in page order, without empty ones."""
    out: list[Block] = []
    if not html:
        return out
    stack: list[tuple[str, frozenset[str]]] = []
    text: list[str] = []
    linked: list[str] = []
    in_link, at = 0, 0

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            if joined and not (stack and stack[0][0] == "head") and not any(t == "head" for t, _ in stack):
                out.append(Block(joined, len(" ".join(linked).split()), tuple(stack)))
            text.clear()
            linked.clear()

    def add(raw: str) -> None:
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            text.append(raw)
            if in_link:
                linked.append(raw)

    for m in _TAG.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:-3])
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "a":
                in_link = 0
            if tag in BLOCKS:
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                    if stack[i][0] in ("td", "th", "table") and tag not in SCOPES and tag not in ("tr", "tbody", "thead", "tfoot"):
                        break
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = 1
        elif tag in BLOCKS:
            flush()
            in_link = 0
            if tag != "hr":
                if stack and stack[-1][0] == "p":
                    stack.pop()
                closing = CLOSES.get(tag)
                if closing:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in closing:
                            del stack[i:]
                        elif stack[i][0] in SCOPES:
                            break
                stack.append((tag, _hints(m["attrs"]) if m["attrs"] else frozenset()))
        elif tag not in VOID:
            pass
    add(html[at:])
    flush()
    return out


# --- features ----------------------------------------------------------------------------------------------------

FEATURES = (
    ["bias"]
    + [f"in:{t}" for t in TAGS]
    + [f"hint:{h}" for h in (*HINTS, "hidden")]
    + ["in:article/header", "in:main-or-article", "hint:inner-not-text", "leaf:heading", "leaf:p", "leaf:h1", "leaf:li", "leaf:div"]
    + [f"words:{k}" for k in ("1", "2-4", "5-11", "12-39", "40")]
    + [f"links:{k}" for k in ("none", "some", "most", "all")]
    + ["ends:stop", "has:copyright"]
)
PLACE = {f: i for i, f in enumerate(FEATURES)}


@lru_cache(8192)
def _path_features(path: tuple[tuple[str, frozenset[str]], ...]) -> tuple[int, ...]:
    tags = [t for t, _ in path]
    have = set(tags)
    names = ["bias", *(f"in:{t}" for t in TAGS if t in have)]
    hints = set().union(*(h for t, h in path if t not in ("html", "body"))) if path else set()
    names += [f"hint:{h}" for h in hints]
    if "article" in have and "header" in tags[tags.index("article") :]:
        names.append("in:article/header")
    if have & {"article", "main"}:
        names.append("in:main-or-article")
    inner = next((h for _, h in reversed(path) if h), frozenset())
    if inner and "text" not in inner:
        names.append("hint:inner-not-text")
    leaf = tags[-1] if tags else ""
    if leaf in HEADINGS:
        names.append("leaf:heading")
    names += [f"leaf:{leaf}"] if f"leaf:{leaf}" in PLACE else []
    return tuple(PLACE[n] for n in names)


#: A mark of copyright, and its word with a year near it or all rights reserved.
_RIGHTS = re.compile(r"©|\(c\)|\bcopyright\b.{0,40}\b(?:19|20)\d\d\b|\ball rights reserved\b", re.I)


def features(block: Block) -> list[int]:
    """The places of the features that a block has."""
    n = block.text.count(" ") + 1
    size = "1" if n == 1 else "2-4" if n < 5 else "5-11" if n < 12 else "12-39" if n < 40 else "40"
    share = block.linked / n
    links = "none" if not block.linked else "some" if share < 0.5 else "most" if share < 0.95 else "all"
    out = [*_path_features(block.path), PLACE[f"words:{size}"], PLACE[f"links:{links}"]]
    if block.text[-1] in ".!?…:;\"'”»":
        out.append(PLACE["ends:stop"])
    if _RIGHTS.search(block.text):
        out.append(PLACE["has:copyright"])
    return out


# --- labelled pages ----------------------------------------------------------------------------------------------


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page of random shape and the label of each of its leaf blocks (1: main text)."""
    labels: list[int] = []

    def words(n: int) -> str:
        style = rng.random()
        out = ["".join(rng.choice("abcdefghijklmnoprstuvéüñ") for _ in range(rng.randint(1, 11))) for _ in range(n)]
        if style < 0.1:
            out = [w.upper() + "!!" for w in out]
        elif style < 0.2:
            out = [w + rng.choice(("***", "###", "$$$", "&amp;&amp;")) for w in out]
        return " ".join(out) + rng.choice((".", ".", "", "?", "!"))

    def leaf(tag: str, label: int, n: int, attrs: str = "", link: float = 0.0, close: bool = True) -> str:
        labels.append(label)
        body = words(n)
        if link and rng.random() < link:
            body = f'<a href="/{rng.random()}">{body}</a>' if rng.random() < 0.7 else f'<a href="#">{body}</a> {words(rng.randint(1, 9))}'
        elif rng.random() < 0.2:
            body = f"<b>{body}<br>" if rng.random() < 0.5 else f"<i>{body}</i> {words(2)}"
        return f"<{tag}{attrs}>{body}" + (f"</{tag}>" if close else "")

    def named(kind: str, chance: float = 0.9) -> str:
        if rng.random() > chance:
            return ""
        return f' {rng.choice(("class", "id"))}="{rng.choice(HINTS[kind].split())}{rng.choice(("", "-box", " wrap", "_1"))}"'

    def menu(kind: str = "menu") -> str:
        items = "".join(leaf("li", 0, rng.randint(1, 3), link=1.0, close=rng.random() < 0.8) for _ in range(rng.randint(2, 7)))
        own = rng.random() < 0.6
        tag = "nav" if own else "div"
        return f"<{tag}{named(kind, 0.3 if own else 1)}><ul>{items}</ul></{tag}>"

    def box(kind: str, tags: tuple[str, ...], own: tuple[str, ...], low: int, high: int, link: float) -> str:
        tag = rng.choice(tags)
        inner = "".join(leaf(rng.choice(("p", "div", "h3", "span-free")) .replace("span-free", "p"), 0, rng.randint(low, high), link=link) for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.4:
            return leaf(tag, 0, rng.randint(low, high), named(kind, 0.2 if tag in own else 1), link) if not labels_pop(inner) else ""
        return f"<{tag}{named(kind, 0.3 if tag in own else 1)}>{inner}</{tag}>"

    def labels_pop(inner: str) -> bool:
        for _ in range(inner.count("<p") + inner.count("<h3") + inner.count("<div")):
            labels.pop()
        return False

    def advert() -> str:
        return box("ad", ("div", "div", "section", "aside"), ("aside",), 2, 25, 0.4)

    def talk() -> str:
        rows = "".join(leaf(rng.choice(("p", "div", "li")), 0, rng.randint(1, 40), rng.choice(("", named("talk")))) for _ in range(rng.randint(1, 5)))
        tag = rng.choice(("div", "section", "ul", "ol"))
        return f"<{tag}{named('talk', 1)}>{rows}</{tag}>"

    def form() -> str:
        rows = "".join(leaf(rng.choice(("label", "p", "div", "button")) .replace("label", "p"), 0, rng.randint(1, 6)) for _ in range(rng.randint(1, 3)))
        return f"<form{named('share', 0.4)}>{rows}<input type=text></form>"

    def main_part() -> str:
        rows = []
        if rng.random() < 0.85:
            head = leaf(rng.choice(("h1", "h1", "h2")), 1, rng.randint(2, 12))
            rows.append(f"<header>{head}</header>" if rng.random() < 0.15 else head)
        for _ in range(rng.randint(1, 9)):
            r = rng.random()
            if r < 0.72:
                n = rng.choice((1, 2, 3, rng.randint(4, 15), rng.randint(15, 90), rng.randint(15, 90)))
                rows.append(leaf("p", 1, n, link=0.12, close=rng.random() < 0.8))
            elif r < 0.79:
                rows.append(leaf(rng.choice(("h2", "h3")), 1, rng.randint(1, 6)))
            elif r < 0.85:
                rows.append("<ul>" + "".join(leaf("li", 1, rng.randint(1, 12), link=0.15) for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.88:
                rows.append("<blockquote>" + leaf("p", 1, rng.randint(5, 30)) + "</blockquote>")
            elif r < 0.91:
                rows.append("<table><tr>" + "".join(leaf("td", 1, rng.randint(1, 5)) for _ in range(rng.randint(2, 4))) + "</tr></table>")
            elif r < 0.93:
                rows.append(leaf(rng.choice(("pre", "div")), 1, rng.randint(3, 40)))
            elif r < 0.96:
                rows.append(advert())
            elif r < 0.98:
                rows.append(box("share", ("div", "aside"), ("aside",), 1, 4, 0.7))
            else:
                rows.append(menu("side"))
        if rng.random() < 0.12:
            rows.append(talk())
        body = "".join(rows)
        shape = rng.random()
        if shape < 0.6:
            body = f"<article{named('text', 0.3)}>{body}</article>"
        elif shape < 0.75:
            body = f"<main{named('text', 0.3)}>{body}</main>"
        else:
            body = f"<div{named('text', 1)}>{body}</div>"
        return f"<main>{body}</main>" if rng.random() < 0.2 else f'<div id="wrap">{body}</div>' if rng.random() < 0.2 else body

    parts = []
    if rng.random() < 0.3:
        parts.append(box("notice", ("div", "div", "section", "dialog"), ("dialog",), 3, 30, 0.3))
    if rng.random() < 0.5:
        tag = rng.choice(("header", "header", "div"))
        inner = leaf(rng.choice(("h1", "p", "div", "h2")), 0, rng.randint(1, 6), link=0.5) + (menu() if rng.random() < 0.5 else "")
        parts.append(f"<{tag}{named('head', 0.3 if tag == 'header' else 1)}>{inner}</{tag}>")
    if rng.random() < 0.8:
        parts.append(menu())
    if rng.random() < 0.6:
        parts.append(advert())
    if rng.random() < 0.25:
        parts.append(box("side", ("aside", "aside", "div"), ("aside",), 1, 20, 0.6))
    if rng.random() < 0.95:
        parts.append(main_part())
    if rng.random() < 0.3:
        parts.append(box("side", ("aside", "aside", "div"), ("aside",), 1, 30, 0.6))
    if rng.random() < 0.3:
        parts.append(talk())
    if rng.random() < 0.3:
        parts.append(form())
    if rng.random() < 0.2:
        parts.append(advert())
    if rng.random() < 0.2:
        parts.append(box("notice", ("div", "div", "section", "dialog"), ("dialog",), 3, 30, 0.3))
    if rng.random() < 0.85:
        tag = rng.choice(("footer", "footer", "div"))
        labels.append(0)
        mark = rng.choice(("&copy; ", "&copy; ", "(c) ", f"Copyright {rng.randint(1990, 2029)} ", "All rights reserved. ")) if rng.random() < 0.7 else ""
        body = mark + words(rng.randint(2, 25))
        if rng.random() < 0.3:
            extra = leaf("p", 0, rng.randint(1, 12), link=0.4)
            body = f"{body}{extra}"
        # a footer that nothing but its mark tells apart
        parts.append(f"<{tag}{named('foot', 0.3 if tag == 'footer' else 0.6 if mark else 1)}>{body}</{tag}>")
    page = "<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>" + "".join(parts) + "<script>var t='</p>';</script></body></html>"
    return page, labels


def labelled_pages(count: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """Pages whose blocks and labels agree in number (a made-up word that is a tag's name can't occur)."""
    rng, out = random.Random(seed), []
    while len(out) < count:
        page, labels = labelled_page(rng)
        blocks = leaf_blocks(page)
        if blocks and len(blocks) == len(labels):
            out.append((blocks, labels))
    return out


# --- the field ---------------------------------------------------------------------------------------------------


class Field:
    """Weights of features by label, of neighbouring labels, and of the first label."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.weights, self.moves, self.start = weights, moves, start

    def scores(self, blocks: list[Block]) -> np.ndarray:
        return np.array([self.weights[features(b)].sum(0) for b in blocks])

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most likely labels, by Viterbi."""
        if not blocks:
            return []
        s = self.scores(blocks).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = s[0][0] + float(self.start[0]), s[0][1] + float(self.start[1])
        back = []
        for x, y in s[1:]:
            from_a, from_b = a + m00 >= b + m10, a + m01 > b + m11
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = x + max(a + m00, b + m10), y + max(a + m01, b + m11)
        out = [int(b > a)]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 200, l2: float = 0.02, step: float = 0.1) -> Field:
    """Maximum likelihood by Adam on all pages at once; forward-backward runs over pages side by side."""
    pages = [p for p in pages if p[0]]
    n, longest = len(pages), max(len(b) for b, _ in pages)
    x = np.zeros((n, longest, len(FEATURES)))
    y = np.zeros((n, longest), int)
    mask = np.zeros((n, longest))
    for i, (blocks, labels) in enumerate(pages):
        for t, b in enumerate(blocks):
            x[i, t, features(b)] = 1
            y[i, t] = labels[t]
            mask[i, t] = 1
    gold = np.eye(2)[y] * mask[..., None]
    params = [np.zeros((len(FEATURES), 2)), np.zeros((2, 2)), np.zeros(2)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    pair_gold = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    flat = x.reshape(-1, len(FEATURES))
    for k in range(1, rounds + 1):
        w, moves, start = params
        s = (flat @ w).reshape(n, longest, 2)
        alpha = np.zeros((n, longest, 2))
        beta = np.zeros((n, longest, 2))
        alpha[:, 0] = s[:, 0] + start
        for t in range(1, longest):
            nxt = np.logaddexp.reduce(alpha[:, t - 1, :, None] + moves, axis=1) + s[:, t]
            alpha[:, t] = np.where(mask[:, t, None] > 0, nxt, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = np.logaddexp.reduce(moves + (s[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None] > 0, nxt, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        single = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + moves + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        grads = [
            (flat.T @ (gold - single).reshape(-1, 2)) / n - l2 * w,
            (pair_gold - pair.sum((0, 1))) / n - l2 * moves,
            (gold[:, 0] - single[:, 0]).sum(0) / n - l2 * start,
        ]
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p += step * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.999**k)) + 1e-8)
    return Field(*params)


#: Pages that the field is trained on, and their seed.
TRAIN_PAGES, TRAIN_SEED = 600, 7


@lru_cache(1)
def trained() -> Field:
    return train(labelled_pages(TRAIN_PAGES, TRAIN_SEED))


#: Elements whose text is a control's, wherever they stand.
CONTROLS = frozenset(("button", "option"))


def main_text(html: str | None, field: Field) -> str:
    blocks = [b for b in leaf_blocks(html) if not any(t in CONTROLS for t, _ in b.path)]
    return "\n".join(b.text for b, label in zip(blocks, field.decode(blocks), strict=True) if label)


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` without ``html``, with ``text``; a column of ``df`` named text gives way to the new one."""
    field = trained()
    kept = [c for c in df.columns if c not in (html, "text")]
    base = df.select(*kept, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = pa.array([main_text(h.as_py(), field) for h in b.column(len(kept))], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=[*kept, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != html)
    return base.mapInArrow(run, f"{schema}, text string")
