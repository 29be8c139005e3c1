"""The main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of blocks, cut at block-level tags. Features of a block are its words and link density, those of its
neighbours, its kind of tag, and what the enclosing tags call themselves. The tree is trained on a small labelled table:
the blocks of made-up pages (labelled_pages), in which every text says whether it belongs to the article.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.trees import Tree, decide, decision_tree

#: Elements whose content is no text of the page, elements that end a block, and elements without content.
SKIPPED = "script style noscript template svg math iframe object canvas title textarea select button option datalist audio video".split()
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table"
    " tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Skipped elements that end at their first closing tag or with the page, and those that "/>" closes.
PLAIN = set("script style textarea title".split())
CLOSABLE = {"svg", "math"}
#: Names by which tags, classes, ids and roles tell what they hold.
CONTEXTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar pagination pager tabs toc sitemap".split(),
    "head": "header head masthead banner topbar branding logo".split(),
    "foot": "footer foot bottombar copyright colophon contentinfo legal imprint".split(),
    "side": "aside sidebar side sidecol rail related recommended recommendations widget widgets complementary teaser more trending popular tags share sharing social author bio".split(),
    "advert": "ad ads adv advert adverts advertisement advertising adbox adslot banner-ad sponsor sponsored promo promotion promoted dfp".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall disclaimer warning".split(),
    "form": "form fieldset input login signin signup register search searchbox contact".split(),
    "talk": "comment comments commentlist reply replies respond discussion disqus responses feedback reviews".split(),
    "main": "article main content post entry story body-text articlebody post-content entry-content article-body maincontent text".split(),
}
KINDS = {"p": 1, "blockquote": 1, "pre": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "dd": 3, "dt": 3, "td": 4, "th": 4}
FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "kind", "sentence", *CONTEXTS]

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(SKIPPED) + r")(?=[\s/>])[^>]*>|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.I | re.S,
)
SKIPPED_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)(" + "|".join(SKIPPED) + r")(?=[\s/>])[^>]*>", re.I | re.S)
NAMES = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
BY_NAME = {name: i for i, names in enumerate(CONTEXTS.values()) for name in names}
HTML_TAGS = {"nav", "menu", "header", "head", "footer", "aside", "form", "fieldset", "article", "main", "search"}


def context_of(tag: str, attrs: str) -> int:
    """The contexts that an element opens, one bit each."""
    found = 1 << BY_NAME[tag] if tag in HTML_TAGS else 0
    for match in NAMES.finditer(attrs) if attrs else ():
        for name in (match[1] or match[2] or match[3] or "").lower().split():
            for part in {name, *re.split(r"[-_]+", name)}:
                if part in BY_NAME and tag not in ("html", "body"):
                    found |= 1 << BY_NAME[part]
    return found


def skipped_ends(page: str) -> dict[int, int]:
    """Where the skipped elements end, by where they start. Each closing tag closes the last open element of its name; an
    element that none closes has no end, but those of PLAIN take the first closing tag, or the page's end."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    at = 0
    while match := SKIPPED_TAG.search(page, at):
        name, start, at = (match[2] or "").lower(), match.start(), match.end()
        if match[1]:
            if opened.get(name):
                ends[opened[name].pop()] = at
        elif name in PLAIN:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            ends[start] = at = close.end() if close else len(page)
        elif name and not (name in CLOSABLE and match[0].endswith("/>")):
            opened.setdefault(name, []).append(start)
    return ends


def tokens(page: str) -> Iterator[re.Match]:
    """The tags and texts of a page, without the content of skipped elements. Of one without an end, the tag alone goes."""
    ends, at = None, 0
    while at < len(page):
        token = TOKEN.match(page, at)
        at = token.end()
        if token["raw"]:
            ends = skipped_ends(page) if ends is None else ends
            at = max(at, ends.get(token.start(), at))
        yield token


def blocks(page: str) -> Iterator[tuple[str, int, int, int]]:
    """text, words within links, kind and contexts of each block with text, in page order."""
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}  # where in the stack each tag is open, and where block-level ones are
    levels: list[int] = []
    parts: list[str] = []
    linked, in_link, kind, in_cdata = 0, 0, 0, False

    def pop():
        tag, _ = stack.pop()
        places[tag].pop()
        if tag in BLOCKS:
            levels.pop()

    def flush():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        out = (text, linked, kind, stack[-1][1] if stack else 0)
        parts, linked = [], 0
        return [out] if text else []

    for token in tokens(page):
        if (text := token["text"]) is not None:
            if in_cdata and "]]>" in text:
                text, in_cdata = text.replace("]]>", "", 1), False
            text = html.unescape(text)
            parts.append(text)
            linked += len(text.split()) if in_link else 0
            continue
        tag = (token["tag"] or "").lower()
        if tag in BLOCKS:
            yield from flush()
        elif tag == "br" or token["raw"]:
            parts.append(" ")
        in_cdata = in_cdata or token[0] == "<![CDATA["
        if not tag or tag in VOID:
            continue
        if token["close"]:
            depth = places[tag][-1] if places.get(tag) else len(stack)
            if tag in BLOCKS or not levels or levels[-1] < depth:
                while len(stack) > depth:
                    pop()
            in_link = 0 if tag == "a" else in_link
        else:
            if tag in ("p", "li", "tr", "td", "th", "dd", "dt") or tag in BLOCKS:
                while stack and stack[-1][0] not in BLOCKS or (stack and stack[-1][0] == "p"):
                    pop()  # inline elements and paragraphs that nobody closed
                if tag == "li" and stack and stack[-1][0] == "li":
                    pop()
                in_link = 0
            in_link = 1 if tag == "a" else in_link
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS:
                levels.append(len(stack))
            stack.append((tag, (stack[-1][1] if stack else 0) | context_of(tag, token["attrs"])))
        if tag in BLOCKS:
            kind = KINDS.get(stack[levels[-1]][0], 0) if levels else 0
    yield from flush()


ENDS = (".", "!", "?", "…", ":", '"', "”", "»", "。", "！", "？", ".)", "'")


def features_of(found: list[tuple[str, int, int, int]]) -> list[list[float]]:
    """FEATURES of each block of a page."""
    shape = [(len(t.split()), linked) for t, linked, _, _ in found]
    shape = [(0, 0.0), *((n, min(1.0, linked / n)) for n, linked in shape), (0, 0.0)]
    rows = []
    for i, (text, _, kind, contexts) in enumerate(found):
        near = [*shape[i + 1], *shape[i], *shape[i + 2]]
        rows.append([*near, kind, float(text.endswith(ENDS)), *(contexts >> k & 1 for k in range(len(CONTEXTS)))])
    return rows


def labelled_pages(count: int = 400, seed: int = 7) -> Iterator[str]:
    """Made-up pages of which each text starts with "+" if it belongs to the article and with "-" if not.

    Lengths, names and places are drawn at random, so that the tree learns what tells an article from its
    surroundings and not how long a footer is. Parts without a telling name are links or short lines.
    """
    draw = random.Random(seed)
    stop = lambda: draw.choice(("", ".", ".", "!"))
    size = lambda most: int(most ** draw.random())  # noqa: E731  short texts as often as long ones
    text = lambda mark, n: f"{mark} {' '.join(['word'] * max(1, n))}{stop()}"
    links = lambda: "<ul>" + "".join(f'<li><a href="#">{text("-", size(8))}</a></li>' for _ in range(draw.randint(2, 9))) + "</ul>"

    def linked() -> str:
        return draw.choice((
            f'<p><a href="#">{text("+", size(30))}</a></p>', f'<p>{text("+", size(4))} <a href="#">{" ".join(["word"] * size(30))}</a></p>',
            f'<ul><li><a href="#">{text("+", size(12))}</a></li><li>{text("+", size(12))}</li></ul>',
        ))

    def inner() -> str:
        return "".join(draw.choice((
            f"<p>{text('-', size(120))}</p>", f"<h3>{text('-', size(8))}</h3>", links(), f"{text('-', size(40))}", f"<ul><li>{text('-', size(40))}</li></ul>",
            f'<p>{text("-", size(20))} <a href="#">{" ".join(["word"] * size(9))}</a></p>', f"<table><tr><td>{text('-', size(9))}</td></tr></table>",
        )) for _ in range(draw.randint(1, 3)))

    def named(kind: str) -> str:
        name = draw.choice(CONTEXTS[kind])
        tag = name if name in HTML_TAGS and name != "head" and draw.random() < 0.6 else ""
        return f"<{tag}>{inner()}</{tag}>" if tag else f'<div {draw.choice(("class", "id"))}="{name}">{inner()}</div>'

    def plain() -> str:
        return draw.choice((f"<div>{links()}</div>", links(), f"<div>{text('-', size(6)).rstrip('.!')}</div>", f'<div><a href="#">{text("-", size(6))}</a></div>'))

    def article(in_main: bool) -> str:
        parts = [f"<h1>{text('+', size(14))}</h1>"] if draw.random() < 0.8 else []
        if in_main and draw.random() < 0.2:
            parts = [f"<header>{''.join(parts)}</header>"]
        for _ in range(draw.randint(1, 7)):
            n = size(200) if in_main else draw.randint(12, 150)
            parts.append(draw.choice((
                f"<p>{text('+', n)}</p>", f"<p>{text('+', n)}</p>", f"<p>{text('+', n)}</p>", f"<p>{text('+', n + 9)} <a href='#'>{' '.join(['word'] * size(6))}</a></p>",
                f"<h2>{text('+', size(9))}</h2><p>{text('+', n)}</p>", f"<blockquote>{text('+', n)}</blockquote>", f"<ul><li>{text('+', n)}</li><li>{text('+', n)}</li></ul>",
                f"<p><b>{text('+', size(9))}<br><p>{text('+', n)}</p>", *([f"<table><tr><td>{text('+', size(5))}</td><td>{text('+', size(5))}</td></tr></table>", f"<div>{text('+', n)}</div>", linked()] if in_main else []),
            )))
        if in_main and draw.random() < 0.5:
            parts.insert(draw.randint(1, len(parts)), named(draw.choice([k for k in CONTEXTS if k not in ("main", "head")])))
        return "".join(parts)

    around = [k for k in CONTEXTS if k != "main"]
    some = lambda: "".join(named(draw.choice(around)) if draw.random() < 0.75 else plain() for _ in range(draw.randint(0, 4)))
    for _ in range(count):
        in_main = draw.random() < 0.7
        name = draw.choice(CONTEXTS["main"])
        tag, attr = (name, "") if name in HTML_TAGS and draw.random() < 0.7 else ("div", f' class="{name}"' if in_main else "")
        yield f"<body>{some()}<{tag if in_main else 'div'}{attr}>{article(in_main)}</{tag if in_main else 'div'}>{some()}</body>"


def labelled_blocks() -> list[list[float]]:
    """The small labelled table: FEATURES and label."""
    rows = []
    for page in labelled_pages():
        found = list(blocks(page))
        plain = [(text[2:], *others) for text, *others in found]
        rows += [[*map(float, x), float(text.startswith("+"))] for (text, *_), x in zip(found, features_of(plain))]
    return rows


def train(spark: SparkSession, depth: int = 12) -> Tree:
    return decision_tree(spark.createDataFrame(labelled_blocks(), [*FEATURES, "label"]), FEATURES, depth)


def main_text(page: str | None, tree: Tree) -> str:
    found = list(blocks(page or ""))
    return "\n\n".join(text for (text, *_), x in zip(found, features_of(found)) if decide(tree, x) > 0.5)


def extract_text(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """The columns of pages, with text (empty if there is none, or html is null) and n_chars; such columns of pages are replaced."""
    tree = train(pages.sparkSession) if tree is None else tree

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page, tree) for page in batch], dtype=object)

    text = F.pandas_udf(run, "string")
    rest = [c for c in pages.columns if c not in ("text", "n_chars")]
    return pages.select(*rest, text("html").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
