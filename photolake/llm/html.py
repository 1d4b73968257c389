"""Main text of web pages: paragraphs score their ancestors, the best container wins."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.llm.common import slices
from photolake.session import table

#: Comments, declarations, tags (a quote that never ends is taken as a character) and stray end tags.
_MARKUP = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>|\Z)|[^>]*+)(?:>|\Z)|</[^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr svg g text tspan math mi mn mo ms mtext mrow msup msub mfrac msqrt mroot mstyle semantics".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
#: Elements that never belong to an article: scripts, styles, menus, headers, footers, sidebars, forms and their controls.
APART = RAW | frozenset("head nav header footer aside form button select menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class and id for menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer "
    "gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion "
    "replies respond share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Words that only say what kind of box, or where, one of ``BESIDE`` is.
BOX = frozenset("area bar block body bottom box container content group holder inner item items left link links list main outer page panel primary right row secondary section side site slot text title top unit wrap wrapper".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
PARAGRAPHS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li td dd dt".split())
WHOLE = frozenset(("html", "body", "article", "main"))


def _beside(tag: str, attributes: str) -> int:
    """Whether an element and all in it stand beside the article: 3 surely, 2 by a name of its class or id, 1 by a part of a name, 0 not.

    A name counts if all its words are in ``BESIDE`` or ``BOX`` and one is in ``BESIDE``
    (``ad-box``, not ``has-sidebar``, ``no-comments`` or ``notice-board``).
    """
    if tag in APART:
        return 3
    if "=" not in attributes:
        return 0
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if tag in WHOLE:
        return 0
    if found.get("role", "").lower() in ROLES:
        return 3
    marked = 0
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [p.lower() for p in _PART.findall(name)]
        if not BESIDE.isdisjoint(parts) and all(p in BESIDE or p in BOX for p in parts):
            marked = max(marked, 2 if len(parts) == 1 else 1)
    return marked


def _upwards(parents: list[int], values: list, share: float = 1) -> None:
    """Adds to each element a share of its children's sums; children come after their parents."""
    for e in range(len(parents) - 1, 0, -1):
        values[parents[e]] += values[e] * share


def _without_marked(parents: list[int], found: list[tuple[int, str, int]], marked: dict[int, int]) -> list[tuple[int, str, int]]:
    """The blocks outside ``marked`` elements, but for those that hold most of the page's text that is not linked; where the whole name marks one, all of it."""
    plain = [0] * len(parents)
    for element, text, linked in found:
        plain[element] += len(text) - linked
    _upwards(parents, plain)
    dropped = [False] * len(parents)
    for e in range(1, len(parents)):
        dropped[e] = dropped[parents[e]] or e in marked and (2 * plain[e] <= plain[0] if marked[e] == 1 else plain[e] < plain[0])
    return [x for x in found if not dropped[x[0]]]


def blocks(page: str) -> tuple[list[int], list[str], list[tuple[int, str, int]]]:
    """The page's block elements as parents and tags, and its blocks of text.

    A block is ``(element, text, characters inside links)``. Elements beside the article
    are left out with all they hold; one that only a part of its name marks is kept if
    it holds most of the page's text that is not linked, and one that a whole name marks
    if it holds all of it. Missing end tags are filled in where HTML does so.
    """
    parents, tags, found = [-1], ["#"], []
    marked: dict[int, int] = {}
    stack: list[tuple[str, int, bool]] = [("#", 0, False)]  # tag, block element, beside
    places: dict[str, list[int]] = {}  # of each tag's open elements in the stack
    text: list[str] = []
    linked = links = beside = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            if block:
                found.append((stack[-1][1], block, min(linked, len(block))))
            text.clear()
        linked = 0

    def pop() -> None:
        nonlocal links, beside
        if stack[-1][0] not in INLINE:
            flush()
        tag, _, apart = stack.pop()
        places[tag].pop()
        links -= tag == "a"
        beside -= apart

    def last(tag: str) -> int:
        found_at = places.get(tag)
        return found_at[-1] if found_at else 0

    def close(wanted: tuple[str, ...], limit: tuple[str, ...]) -> None:
        """Ends the last open element of ``wanted``, unless one of ``limit`` is open inside it."""
        i = max(map(last, wanted))
        if i and i > max(map(last, limit), default=0):
            while len(stack) > i:
                pop()

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not beside:
            text.append(piece)
            if links:
                linked += len(piece)

    while m := _MARKUP.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                add(" ")
            else:
                close((tag,), ())
            continue
        if tag in VOID:
            if tag in ("br", "img", "wbr"):
                add("" if tag == "wbr" else " ")
            elif tag == "hr":
                flush()
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?:[\\s/>]|\\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
            if end and (gt := page.find(">", at)) >= 0:
                at = gt + 1
            add(" ")
            continue
        if tag in CLOSES:
            close(CLOSES[tag], SCOPES[tag])
        if tag == "body":
            close(("head",), ())
        if tag not in INLINE:
            close(("p",), ("table", "td", "th", "button", "object"))
            flush()
            parents.append(stack[-1][1])
            tags.append(tag)
        kind = _beside(tag, m[3])
        # a line's parts are no element of their own, so there a name decides
        apart = kind == 3 or (kind > 0 and tag in INLINE)
        if kind and not apart and not beside:
            marked[len(tags) - 1] = kind
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, len(tags) - 1 if tag not in INLINE else stack[-1][1], apart))
        links += tag == "a"
        beside += apart
    add(page[at:])
    while len(stack) > 1:
        pop()
    flush()
    return parents, tags, _without_marked(parents, found, marked) if marked else found


def main_text(page: str | None) -> str:
    """The article of an HTML page, its blocks joined by line breaks; empty if there is none.

    Each block gives points for its length and commas, less for text in links, to its
    element and, halved at each step, to those around it. The element with most points,
    the first of equals, is kept with its siblings that read like text. Nothing kept is
    cut or dropped. The work grows with the page's length, however deep it is nested.
    """
    if not page:
        return ""
    parents, tags, found = blocks(page)
    if not found:
        return ""
    points, chars, linked = [0.0] * len(tags), [0] * len(tags), [0] * len(tags)
    for element, text, in_links in found:
        own = (1 + text.count(",") + min(len(text) / 100, 10)) * (1 - in_links / len(text))
        # a paragraph's points go to what contains it
        points[parents[element] if tags[element] in PARAGRAPHS else element] += own
        chars[element] += len(text)
        linked[element] += in_links
    _upwards(parents, points, 0.5)
    _upwards(parents, chars)
    _upwards(parents, linked)
    density = [b / a if a else 0.0 for a, b in zip(chars, linked)]
    scores = [p * (1 - d) for p, d in zip(points, density)]
    semantic = {i for i, t in enumerate(tags) if t in ("article", "main") and chars[i]}
    best = max(range(len(tags)), key=lambda i: (scores[i], -i))
    around = best
    while around >= 0:
        if around in semantic:
            best = around
        around = parents[around]
    keep = {best}
    for i, t in enumerate(tags):
        if i != best and i and parents[i] == parents[best] and chars[i] and tags[best] not in WHOLE:
            if density[i] < 0.33 and (scores[i] >= 0.2 * scores[best] or t in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "ul", "ol", "table")):
                keep.add(i)
        elif i in semantic and t == tags[best] and parents[i] == parents[best] and scores[i] >= 0.2 * scores[best]:
            keep.add(i)
    inside = [i in keep for i in range(len(tags))]
    for i in range(1, len(tags)):
        inside[i] = inside[i] or inside[parents[i]]
    return "\n".join(text for element, text, _ in found if inside[element])


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages``; null or empty html has an empty text.

    Whole pages of any length are read; repeated rows are extracted each, and an empty
    table gives an empty result. Other columns are left out, whatever their names.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 1 << 21):
            out = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(apply, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
