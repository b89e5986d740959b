"""Main text of web pages by tag-path ratios.

A page is read as a sequence of blocks (text between block-level tags), each with
its root-to-leaf tag path. Only scripts, styles and other raw text are left out
for their kind. Elements that are seldom an article by their tag (menus, headers,
footers, sidebars, forms), by a whole word of their class, id or role (adverts,
notices, reader comments; of a compound all parts must say so) are doubted: their
paths are apart from others, both their ratios count a tenth and they are kept
only if they reach the threshold all the same. Hidden elements are left out. No
element is doubted or taken as hidden that holds an ``article`` or ``main`` (of
half the longest one's length at least), or half of the text without links while
any ``article`` or ``main`` outside doubted elements has less than a tenth of it.

For every path the text lengths and punctuation marks of its blocks are added up
and divided by its number of blocks. Both ratios are smoothed over neighbouring
blocks in page order and fused into one score; blocks of paths that reach the
threshold are content. The deepest element that holds nearly all content leads to
the article: the ``article`` or ``main`` around it, or else its nearest container
with the headings beside it. All blocks of the article are kept, also short lines and
cells whose paths are below the threshold, except doubted ones and lists of links
outside a marked article.

Edge cases: a null or empty page and one without text have an empty text; a page
without tags is one block; markup that is cut off is dropped, text of elements
that are never closed is kept; a page cut inside a character reference keeps its
letters as they are; repeated rows are read one by one; a null id or url stays
null; an empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import arrow_map, query, table
from .columns import slices, texts

HOLDS = 0.9  # share of the content that the article holds
SIGMA = 1.0  # of the smoothing, in blocks
SMOOTH = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(3)]
FLOOR = 0.5  # share of the mean score that content reaches

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PARTS = re.compile(r"[-_]+")
MARKS = re.compile(r"[.,;:!?…。，！？]")

RAW = frozenset("script style noscript template iframe textarea title noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
DOUBT = 0.1  # of the score of a doubted path
DOUBTED = frozenset("nav header footer aside form button select fieldset dialog menu head svg math canvas object audio video map".split())
#: Words of a class, id or role that tell what is seldom an article; a compound tells it if all its parts do.
NO_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices notification banner popup modal overlay "
    "sidebar side widget widgets related recommended recommendations comment comments commentlist disqus discussion reply replies respond nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer contentinfo complementary share sharing social newsletter subscribe subscription signup login search pagination pager toolbar skip alert dialog form".split()
)
MARKED = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TEXTUAL = HEADINGS | frozenset("p pre blockquote li ul ol dl dt dd td th tr table tbody figure figcaption address details summary".split())
NEVER = frozenset("html body main article".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body html article section div main td th".split())


def _doubt(tag: str, attributes: str) -> int:
    """2: hidden; 1: seldom an article; 0: neither."""
    if tag in NEVER:
        return 0
    found = int(tag in DOUBTED)
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return 2
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return 2
        if name in ("class", "id", "role") and any(NO_ARTICLE.issuperset(PARTS.split(word)) for word in value.split()):
            found = 1
    return found


def _cleared(pieces: list, doubts: dict[int, int]) -> set[int]:
    """Elements that their tag, words or hiding speak against, but that hold the article."""
    inside: dict[int, int] = {}  # text without links in every doubted element
    marked: dict[int, int] = {}  # and in every article or main, each text in the innermost one
    around: dict[int, set[int]] = {}
    closing: set[int] = set()
    total = 0
    for own, held, _ in pieces:
        size = sum(len(" ".join(text.split())) for text, linked, _ in held if not linked)
        total += size
        doubted = {x[1] for x in own if x[1] in doubts} | {x for _, _, inline in held for x in inline}
        for element in doubted:
            inside[element] = inside.get(element, 0) + size
        closing.update(x[1] for x in own if x[0] in ("nav", "footer"))
        mark = next((i for i in range(len(own) - 1, -1, -1) if own[i][0] in MARKED), None)
        if mark is not None:
            marked[own[mark][1]] = marked.get(own[mark][1], 0) + size
            around[own[mark][1]] = {x for x in doubted if x < own[mark][1]}  # outer elements have smaller numbers
    most = max(marked.values(), default=0)
    outside = sum(n for m, n in marked.items() if not around[m])
    cleared = {e for m, n in marked.items() if n and 2 * n >= most for e in around[m]}
    # A menu or footer may be longer than a short article beside it.
    return cleared | {e for e, n in inside.items() if n and 2 * n >= total and (0 if e in closing else n) >= 10 * outside}


def blocks(page: str) -> list[tuple[tuple[int, ...], str, str, int, bool]]:
    """Open elements (numbered, outermost first), tag path, text, linked characters and doubt of every block."""
    pieces: list = []  # open block elements; text, whether linked and doubted inline elements of every piece; doubted
    doubts: dict[int, int] = {}
    stack: list[tuple[str, int]] = []  # tag, number
    held: list[tuple[str, bool, tuple[int, ...]]] = []
    number = 0

    def close_block() -> None:
        if any(not text.isspace() for text, _, _ in held):
            own = [x for x in stack if x[0] not in INLINE]
            pieces.append((own, tuple(held), any(x[1] in doubts for x in own)))
        held.clear()

    def pop_to(at: int) -> None:
        if any(x[0] not in INLINE for x in stack[at:]):
            close_block()
        del stack[at:]

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        raw = page[at : m.start()] if m else page[at:]
        if raw:
            inline = tuple(x[1] for x in stack if x[1] in doubts and x[0] in INLINE) if doubts else ()
            held.append((references.unescape(raw), any(x[0] == "a" for x in stack), inline))
        if not m:
            break
        at = m.end()
        if not m.group(1):
            continue
        tag, attributes = m.group(1).lower(), m.group(2) or ""
        if page[m.start() + 1] == "/":
            where = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if where is not None:
                pop_to(where)
            elif tag not in INLINE:
                close_block()
            continue
        if tag in VOID:
            if tag == "br":
                held.append((" ", False, ()))
            elif tag not in INLINE:
                close_block()
            continue
        if tag in CLOSES_P or tag in CLOSES:
            # An open paragraph, item or cell ends where the next begins; formatting left open ends with it.
            ended = {"p"} if tag in CLOSES_P else CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ended:
                    pop_to(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        if tag not in INLINE:
            close_block()
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if attributes.rstrip().endswith("/") and tag not in INLINE and tag not in CLOSES_P:
            continue
        number += 1
        stack.append((tag, number))
        if doubt := _doubt(tag, attributes):
            doubts[number] = doubt
    close_block()
    for element in _cleared(pieces, doubts) if doubts else ():
        del doubts[element]
    out = []
    for own, held_pieces, doubted in pieces:
        if doubted and any(doubts.get(x[1]) == 2 for x in own):
            continue
        shown = [x for x in held_pieces if not any(doubts.get(e) == 2 for e in x[2])]
        text = " ".join("".join(x[0] for x in shown).split())
        if text:
            # A doubted inline element counts if the block has no text beside it.
            doubted = doubted and any(x[1] in doubts for x in own) or all(any(e in doubts for e in x[2]) for x in shown if not x[0].isspace())
            linked = sum(len(" ".join(x[0].split())) for x in shown if x[1])
            out.append((tuple(x[1] for x in own), "/".join(x[0] for x in own), text, min(linked, len(text)), doubted))
    return out


def _article(root: int, found: list[tuple[tuple[int, ...], str, str, int, bool]]) -> int:
    """The element that makes the article around the deepest one: marked as such, or a container with its headings."""
    elements, path = next((e, p.split("/")) for e, p, *_ in found if root in e)
    depth = elements.index(root)
    for at in range(depth, -1, -1):
        if path[at] in MARKED:
            return elements[at]
    while depth and path[depth] in TEXTUAL:
        depth -= 1
    while depth:
        beside = [b for b in found if elements[depth - 1] in b[0] and elements[depth] not in b[0]]
        if not beside or not all(b[1].rpartition("/")[2] in HEADINGS for b in beside):
            break
        depth -= 1
    return elements[depth]


def main_text(page: str | None) -> str:
    """The article's blocks, one per line."""
    found = blocks(page) if page else []
    if not found:
        return ""
    sums: dict[tuple[str, bool], list[float]] = {}
    for _, path, text, linked, doubted in found:
        own = sums.setdefault((path, doubted), [0, 0, 0])
        own[0] += len(text) - linked
        own[1] += len(MARKS.findall(text)) if linked < len(text) else 0
        own[2] += 1
    fused: dict[tuple[str, bool], float] = {}
    floor = 0.0
    for doubt in (False, True):
        # Doubted blocks are no neighbours of others.
        keys = [(b[1], doubt) for b in found if b[4] == doubt]
        ratio = [(sums[k][0] / sums[k][2], sums[k][1] / sums[k][2]) for k in keys]
        scores = []
        for i in range(len(ratio)):
            near = [(SMOOTH[abs(j - i)], ratio[j]) for j in range(max(0, i - 2), min(len(ratio), i + 3))]
            weight = sum(w for w, _ in near) / (DOUBT if doubt else 1)
            scores.append(sum(w * r[0] for w, r in near) / weight * (1 + sum(w * r[1] for w, r in near) / weight))
        by_path: dict[tuple[str, bool], list[float]] = {}
        for key, score in zip(keys, scores, strict=True):
            by_path.setdefault(key, []).append(score)
        fused |= {key: sum(x) / len(x) for key, x in by_path.items()}
        if scores and not floor:
            floor = FLOOR * sum(scores) / len(scores)
    content = [fused[path, doubted] >= floor for _, path, _, _, doubted in found]
    # The deepest element that holds nearly all of the content's text, doubted text only where there is no other.
    sure = any(good and not b[4] for b, good in zip(found, content, strict=True))
    counted = [good and not (sure and b[4]) for b, good in zip(found, content, strict=True)]
    total = sum(len(b[2]) for b, good in zip(found, counted, strict=True) if good)
    held: dict[int, int] = {}
    for (elements, _, text, _, _), good in zip(found, counted, strict=True):
        for element in elements if good else ():
            held[element] = held.get(element, 0) + len(text)
    root = max((e for e, n in held.items() if n >= HOLDS * total), default=0)  # inner elements have greater numbers
    root = _article(root, found) if root else 0
    kept = []
    for (elements, path, text, linked, doubted), good in zip(found, content, strict=True):
        if (not root or root in elements) and (good or not doubted and ("article" in path or 2 * linked <= len(text))):
            kept.append(text)
    return "\n".join(kept)


def extract_main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: the article's text and its code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_column):
            found = [main_text(p) for p in texts(batch, html_column).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    texts(batch, id_column).cast(pa.int64()),
                    texts(batch, url_column).cast(pa.string()),
                    pa.array(found, pa.string()),
                    pa.array([len(t) for t in found], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    return arrow_map(pages.select(id_column, url_column, html_column), run, "page_id long, url string, text string, n_chars long")


@query("op4_html_extraction")
def op4_html_extraction(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))
