"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks: runs of text within one block element, with the tags and the class, id and role words
of its ancestors. Each block has binary features of its ancestors and its text; the field labels the blocks `main` or
`other`, and Viterbi decoding gives the best labelling of the whole page. It is trained here, by gradient ascent on the
log-likelihood, on labelled pages that `labelled_pages` lays out from a seed: articles among menus, headers, footers,
sidebars, notices, adverts, forms and reader comments, told by elements, by class names, by both or, for some pages, by
neither. No page of a corpus is used for training.

Scripts, styles, templates, comments and the head are no blocks; a head without its end tag ends at the body, at the
first element that no head may hold or at the first text, and a self-closed svg holds nothing. Character references are decoded, white space within
a block becomes one blank, and the main blocks are joined by line feeds in page order.

Defined results: null and empty pages, and pages without a main block, give an empty text; unclosed elements end where
the next block begins or the page ends; pages of any length and depth are read in steps that grow with their length;
ties between labels go to "other"; repeated rows are extracted one by one; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutewise.llm.token_counts import slices

SKIPPED = "script|style|noscript|template|svg|iframe|object|canvas|textarea"
TOKEN = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<({SKIPPED})(?=[\s/>])(?:(?<=<svg)[^>]*+(?<=/)>|[^>]*+>.*?(?:</\1\s*>|\Z))|<(/?)([a-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/a-z][^>]*+(?:>|\Z)""", re.S | re.I
)
#: What a head may hold; anything else, and text, begins the body, as the end tag of the head may be left out.
IN_HEAD = frozenset("head html base basefont bgsound link meta title script style noscript template".split())
TITLE_END = re.compile(r"</title\s*>|(?=</head[\s>]|<body[\s/>])", re.I)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open paragraph are all block elements; these end an open one of their own kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TAGS = frozenset("nav header footer aside form article main section figure figcaption table ul ol li dl h1 h2 h3 h4 h5 h6 p blockquote pre div td address button select textarea fieldset dialog menu details".split())
LANDMARKS = frozenset("nav header footer aside form article main dialog menu button".split())
#: Words in class, id and role names, by what they tell.
NAMED = {
    "advert": "ad ads adv advert advertisement advertorial adslot adsense banner sponsor sponsored promo promoted promotion",
    "comment": "comment comments commentlist reply replies respond disqus discussion reader feedback",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc",
    "aside": "sidebar side aside widget related recommended complementary trending popular rail more",
    "notice": "cookie cookies consent notice gdpr alert alertdialog popup modal overlay paywall warning disclaimer",
    "foot": "footer foot bottom copyright legal contentinfo colophon imprint",
    "head": "header masthead topbar top logo branding branding site",
    "form": "form login signin signup search newsletter subscribe subscription register poll",
    "share": "share sharing social toolbar actions tags byline meta",
    "main": "content article post entry story main body text articlebody maincontent page",
}
WORD_OF = {w: k for k, ws in NAMED.items() for w in ws.split()}
CALLS = re.compile(r"©|\(c\)|copyright|all rights reserved|cookie|privacy|subscribe|sign up|log ?in|click here|read more|share|advert|sponsor", re.I)


class Path:
    """An open block element and all above it, as features: each level adds to its parent's, whose number is bounded by the
    tables of tags and words, so a page of any depth is read in steps that grow with its length."""

    __slots__ = ("parts", "closest", "article", "features")

    def __init__(self, parent: Path | None, tag: str, names: str):
        self.parts, self.closest, self.article = (parent.parts, parent.closest, parent.article) if parent else (frozenset(), frozenset(), False)
        told = [WORD_OF[w] for w in re.split(r"[^a-z]+", names) if w in WORD_OF]
        own = {f"named {k}" for k in told} | ({f"in {tag}"} if tag in TAGS else set())
        if not own <= self.parts:
            self.parts = self.parts | own
        # The innermost element that tells what it holds.
        if told or tag in LANDMARKS:
            closest = {f"closest {k}" for k in told or [tag]} | {f"closest {k} within {self.article}" for k in told or [tag]}
            if told and tag in LANDMARKS:
                closest.add(f"closest {tag} named {told[0]}")
            self.closest = frozenset(closest)
        self.article = self.article or tag in ("article", "main")
        self.features = tuple(sorted({"bias", f"leaf {tag}"} | self.parts | self.closest))


NO_PATH = ("bias", "leaf none")


class Block:
    """A leaf block: `path` are the features of the elements that hold it."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def leaf_blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order."""
    blocks: list[Block] = []
    #: Open elements by tag, each with the path of the innermost block element; and how many of each tag are open.
    stack: list[tuple[str, Path | None]] = []
    open_now: dict[str, int] = {}
    parts: list[str] = []
    linked = anchors = 0
    in_head, titles_end = False, True

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path = stack[-1][1] if stack else None
                blocks.append(Block(path.features if path else NO_PATH, text, linked))
            parts.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal anchors
        for tag, _ in stack[upto:]:
            anchors -= tag == "a"
            open_now[tag] -= 1
        del stack[upto:]

    def text_of(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if anchors:
                linked += len(piece)

    at = 0
    while m := TOKEN.search(page, at):
        piece = page[at : m.start()]
        at = m.end()
        tag = m[3]
        if in_head:
            name = (m[1] or tag or "head").lower()
            in_head = not piece.strip() and (name in IN_HEAD if not m[2] else name not in ("head", "body", "html"))
        if not in_head:
            text_of(piece)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "head" and not m[2]:
            flush()
            in_head = True
            continue
        if in_head:
            if tag == "title" and not m[2]:
                # Its text is no markup; without an end tag it ends where the next tag begins.
                end = TITLE_END.search(page, at) if titles_end else None
                titles_end = end is not None
                following = page.find("<", at)
                at = end.end() if end else following if following >= 0 else len(page)
            continue
        if m[2]:
            if not open_now.get(tag):
                if tag not in INLINE:
                    flush()
            elif tag in INLINE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            else:
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            # A block element ends an open paragraph; an item ends its open sibling.
            ends = SIBLINGS.get(tag, set()) | {"p"}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag in VOID or m[4].endswith("/"):
            continue
        names = " ".join(a or b or c for a, b, c in NAMES.findall(m[4])) if m[4] else ""
        above = stack[-1][1] if stack else None
        stack.append((tag, above if tag in INLINE else Path(above, tag, names.lower())))
        open_now[tag] = open_now.get(tag, 0) + 1
        anchors += tag == "a"
    text_of(page[at:])
    flush()
    return blocks


def bucket(n: float, edges: tuple[float, ...]) -> int:
    return sum(n >= e for e in edges)


def text_features(block: Block) -> tuple[str, ...]:
    text = block.text
    words = text.count(" ") + 1
    return (
        f"words {bucket(words, (2, 4, 8, 16, 32, 64))}",
        f"linked {bucket(block.linked / len(text), (0.01, 0.3, 0.7))}",
        f"end {text[-1] in '.!?:;…»”\"'}",
        f"stops {bucket(sum(text.count(c) for c in '.,;'), (1, 3, 8))}",
        f"calls {bool(CALLS.search(text)) if words < 40 else False}",
    )


class Field:
    """A linear-chain conditional random field with the labels 0 (other) and 1 (main)."""

    def __init__(self, weights: dict[str, tuple[float, float]], step: np.ndarray, first: np.ndarray):
        self.weights, self.step, self.first = weights, step.tolist(), first.tolist()
        self.paths: dict[tuple, tuple[float, float]] = {}

    def score(self, features: tuple[str, ...]) -> tuple[float, float]:
        found = [self.weights[f] for f in features if f in self.weights]
        return sum(x for x, _ in found), sum(y for _, y in found)

    def of_path(self, path: tuple[str, ...]) -> tuple[float, float]:
        """The score of a path's features, kept for the paths to come."""
        if path not in self.paths:
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.paths[path] = self.score(path)
        return self.paths[path]

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most probable labels (Viterbi)."""
        if not blocks:
            return []
        back = []
        best = list(self.first)
        for k, b in enumerate(blocks):
            e0, e1 = map(sum, zip(self.of_path(b.path), self.score(text_features(b)), strict=True))
            if k:
                s = self.step
                from0 = 0 if best[0] + s[0][0] >= best[1] + s[1][0] else 1
                from1 = 0 if best[0] + s[0][1] >= best[1] + s[1][1] else 1
                back.append((from0, from1))
                best = [best[from0] + s[from0][0] + e0, best[from1] + s[from1][1] + e1]
            else:
                best = [best[0] + e0, best[1] + e1]
        label = int(best[1] > best[0])
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[str, list[int]]], rounds: int = 120, rate: float = 0.3, decay: float = 2e-4) -> Field:
    """Fits a field to labelled pages (page, label of each leaf block) by Adam on the mean log-likelihood."""
    found = [(leaf_blocks(p), y) for p, y in pages]
    found = [(b, y) for b, y in found if b and len(b) == len(y)]
    names = sorted({f for b, _ in found for x in b for f in (*x.path, *text_features(x))})
    number = {f: i for i, f in enumerate(names)}
    n, longest, width = len(found), max(len(b) for b, _ in found), len(names)
    x = np.zeros((n, longest, width), np.float32)
    y = np.zeros((n, longest), np.int64)
    there = np.zeros((n, longest), bool)
    for i, (blocks, labels) in enumerate(found):
        for t, b in enumerate(blocks):
            for f in (*b.path, *text_features(b)):
                x[i, t, number[f]] = 1
        y[i, : len(labels)] = labels
        there[i, : len(labels)] = True
    gold = np.zeros((n, longest, 2))
    gold[np.arange(n)[:, None], np.arange(longest), y] = there
    pairs = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    flat = x.reshape(-1, width)
    params = [np.zeros((width, 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        w, s, a = params
        e = (flat @ w).reshape(n, longest, 2)
        # Forward and backward sums over all pages at once; places past a page's end pass its last sums on.
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = a + e[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(there[:, t, None], np.logaddexp.reduce(alpha[:, t - 1, :, None] + s, axis=1) + e[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(there[:, t + 1, None], np.logaddexp.reduce(s + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2), 0.0)
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        node = np.exp(alpha + beta - total[:, None, None]) * there[:, :, None]
        edge = np.exp(alpha[:, :-1, :, None] + s + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * there[:, 1:, None, None]
        grads = [flat.T @ (gold - node).reshape(-1, 2), pairs - edge.sum(axis=(0, 1)), (gold[:, 0] - node[:, 0]).sum(axis=0)]
        for p, g, u, v in zip(params, grads, first, second, strict=True):
            g = g / n - decay * p
            u += 0.1 * (g - u)
            v += 0.001 * (g * g - v)
            p += rate * 0.1 * (u / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return Field({f: tuple(params[0][i].tolist()) for f, i in number.items()}, params[1], params[2])


def labelled_pages(n: int = 300, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages laid out from a seed, with the label of each leaf block."""
    rng = random.Random(seed)
    syllables = "an be co da el fi go ha in ka lo mi ne or pa qui ra se ti un ve wa xo ys zu".split()
    some = lambda *choices: rng.choice(choices)

    def word() -> str:
        return "".join(rng.choices(syllables, k=rng.randrange(1, 4)))

    def sentence(low: int = 3, high: int = 18) -> str:
        ws = [word() for _ in range(rng.randrange(low, high))]
        return " ".join(ws).capitalize() + some(".", ".", ".", "!", "?", ".&quot;")

    def paragraph() -> str:
        if rng.random() < 0.2:
            return some(word().capitalize() + ".", sentence(1, 3), "*** ### &amp;&amp;&amp;", sentence(2, 5).replace(" ", " | "))
        return " ".join(sentence() for _ in range(rng.randrange(1, 7)))

    pages = []
    for _ in range(n):
        style = some("tags", "tags", "both", "names", "names", "bare")
        labels: list[int] = []

        def block(text: str, label: int, labels: list[int] = labels) -> str:
            labels.append(label)
            return text

        def wrap(inner: str, tag: str, names: tuple[str, ...], style: str = style) -> str:
            name = some(*names)
            attr = some(f' class="{name}"', f' id="{name}"', f" class='x {name} y'")
            if style == "tags" and tag != "div":
                return f"<{tag}>{inner}</{tag}>"
            if style == "both":
                return f"<{tag}{attr}>{inner}</{tag}>"
            if style == "bare" and tag not in ("form",):
                return f"<div>{inner}</div>"
            return f"<div{attr}>{inner}</div>"

        def links(label: int, k: int) -> str:
            return "<ul>" + "".join("<li>" + block(f'<a href="/{word()}">{some(word(), word().capitalize(), sentence(1, 4))}</a>', label) + some("</li>", "</li>", "") for _ in range(k)) + "</ul>"

        def clutter(kind: str) -> str:
            if kind == "menu":
                return wrap(links(0, rng.randrange(3, 9)), "nav", ("nav", "menu", "navbar", "breadcrumbs"))
            if kind == "ad":
                return wrap(block(some(paragraph(), sentence(), f'<a href="#">{sentence()}</a>'), 0), some("div", "aside"), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot"), some("names", style))
            if kind == "notice":
                return wrap("<p>" + block(some("We use cookies. ", "") + sentence(), 0) + "</p><button>" + block(some("OK", "Accept"), 0) + "</button>", some("div", "dialog"), ("cookie-notice", "notice", "consent", "alert"), some("names", style))
            if kind == "form":
                return "<form action='/'>" + "<label>" + block(some("Search ", "Email ", "Sign up ") + f'<input name="{word()}"> ' + some("", word()), 0) + "</label><button>" + block(some("Go", "Send", word()), 0) + "</button></form>"
            if kind == "side":
                return wrap("<h3>" + block(some("Related", "More", sentence(1, 4)), 0) + "</h3>" + links(0, rng.randrange(2, 6)) + "<p>" + block(paragraph(), 0) + "</p>", "aside", ("sidebar", "related", "widget", "trending"))
            if kind == "comments":
                shown = "".join("<div>" + "<p>" + block(paragraph(), 0) + "</p></div>" for _ in range(rng.randrange(1, 5)))
                return wrap(some("<h2>", "<h3>") + block(some("Comments", "Replies", "3 comments", "Discussion"), 0) + "</h3>" + shown, some("section", "div", "ol"), ("comments", "comment-list", "replies", "disqus", "reader-comments", "user-comments", "discussion"), some("names", "both"))
            if kind == "share":
                return wrap(links(0, 3), "div", ("share", "social", "share-bar"), "names")
            return ""

        body = []
        if rng.random() < 0.6:
            inner = some("<h1>", "<div>", "<p>")
            body.append(wrap(inner + block(some(word().capitalize(), sentence(1, 5)), 0) + inner.replace("<", "</") + ("<p>" + block(paragraph(), 0) + "</p>" if rng.random() < 0.4 else "") + (clutter("menu") if rng.random() < 0.5 else ""), "header", ("header", "masthead", "site-header", "topbar")))
        for kind in ("menu", "notice", "ad", "form", "side"):
            if rng.random() < (0.8 if kind == "menu" else 0.35):
                body.append(clutter(kind))
        story = [f"<h1>{block(sentence(3, 9), 1)}</h1>"] if rng.random() < 0.85 else []
        for k in range(rng.randrange(1, 14)):
            r = rng.random()
            if r < 0.72:
                story.append("<p>" + some("", "<b>", "<span>") + block(paragraph() + some("", "", "<br>", f" <a href='/x'>{word()}</a> {word()}."), 1) + some("</p>", "</p>", "</p>", ""))
            elif r < 0.80:
                story.append(f"<h2>{block(sentence(1, 6), 1)}</h2>")
            elif r < 0.86:
                story.append("<ul>" + "".join(f"<li>{block(some(sentence(), word()), 1)}</li>" for _ in range(rng.randrange(1, 5))) + "</ul>")
            elif r < 0.90:
                story.append(f"<blockquote>{block(paragraph(), 1)}</blockquote>")
            elif r < 0.93:
                story.append("<div>" + block(paragraph(), 1) + "</div>")
            elif k:
                story.append(clutter(some("ad", "share", "form", "side", "notice", "ad")))
        if rng.random() < 0.15:
            story[:1] = [f"<header>{story[0]}</header>"]
        for kind in ("share", "side", "notice", "form", "ad", "comments", "comments"):
            if rng.random() < 0.15:
                story.append(clutter(kind))
        if rng.random() < 0.1:
            story.append("<footer>" + block(sentence(2, 6), 0) + "</footer>")
        body.append(wrap("".join(story), some("article", "article", "main"), ("content", "article", "post", "entry-content", "story")))
        for kind in ("comments", "ad", "side", "form", "notice"):
            if rng.random() < 0.3:
                body.append(clutter(kind))
        if rng.random() < 0.8:
            body.append(wrap(some("", "<p>") + block(some("&copy; ", "Copyright ", "") + some(sentence(2, 8), sentence(2, 8), paragraph()), 0), "footer", ("footer", "site-footer", "copyright")))
        pages.append(("<!DOCTYPE html><html><head><title>" + word() + '</title><script>var t="</p>";</script></head><body>' + "".join(body) + some("</body></html>", ""), labels))
    return pages


@functools.lru_cache(1)
def trained_field() -> Field:
    return train(labelled_pages())


def main_text(page: str | None, field: Field) -> str:
    if not page:
        return ""
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, y in zip(blocks, field.decode(blocks), strict=True) if y)


def extract_main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text."""
    model = field or trained_field()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "html"):
                texts = [main_text(p, model) for p in s.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([s.column("page_id"), s.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(extracted, "page_id long, url string, text string")


def main_text_query(pages: DataFrame) -> DataFrame:
    return extract_main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
