"""HTML extraction by line-block distribution.

The markup of a page is stripped into text blocks in page order. A block's weight is its length; blocks in menus, headers,
footers, sidebars, notices, adverts, forms and reader comments weigh nothing, and where the page marks its article or main
part, blocks outside weigh nothing either. Weights are summed over a window sliding along the blocks: the text surges where
the sum first leaves zero and dives where it falls to zero again. Inside a marked part everything from the first surge to
the last dive belongs to the article, so there the roles of the elements decide alone.

Outside a marked part the blocks known as apart are left out before the sums are taken, so that a box in mid-article breaks
nothing, and a block that is mostly link text weighs nothing. The stretch with most text is the article, together with the
stretches that share its container (the innermost element that is not text-level). Its link-heavy blocks are kept where a
container of theirs has text of the article before and after them, or beside that text in a container below the body.

A class name or id sets an element apart as a whole or by its last word but for words of boxes, lists and places
("share-buttons", not "related-work"), and not where it describes a state or a part of the article ("no-sidebar",
"article-header"). An article or main part inside such an element is read all the same.

Null and empty pages give an empty text. A page is read in one pass with a bounded stack; repeated rows count for themselves.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workgraph.llm.registry import query

#: Blocks in a window.
WINDOW = 3

# Element names of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike "
             "strong sub sup time tt u var wbr".split())
RAW = set("script style noscript template iframe textarea svg math canvas object title xmp noembed noframes".split())
APART = set("nav header footer aside form button select dialog menu head audio video fieldset".split())
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
             "menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"ul", "ol", "menu"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead", "tfoot"}, "option": {"select"},
            "dt": {"dl"}, "dd": {"dl"}}
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Elements within a text; any other is a container of blocks.
TEXT_LEVEL = INLINE | set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre address figure figcaption section hgroup details summary "
                          "table caption colgroup thead tbody tfoot tr td th".split())
#: Words in class names and ids of parts that are not the article.
APART_WORDS = set("ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments consent "
                  "cookie cookies copyright disclaimer discussion disqus footer header login masthead menu modal nav navbar navigation newsletter "
                  "notice notices notification pager pagination popup promo promotion recommended related replies respond reviews share sharing "
                  "sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Words after the one that says what a part is for: its box, its place, or what it lists.
BOX_WORDS = set("area bar block body bottom box button card col column container content desktop dialog fixed form group holder icon inner "
                "item label left link list main mobile module now outer overlay panel post article story primary right row secondary "
                "section slot sticky text this thread title tool top trail unit wrap wrapper zone".split())
#: Words before it by which a name describes a state or a layout ("no-sidebar"), or a part of the article ("article-header").
STATE_WORDS = set("has have no not with without show hide is are".split())
PART_WORDS = {"header": set("article chapter content entry post section story".split()), "sidebar": {"content"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _names_apart(name: str) -> bool:
    """Whether a class name or id names a part that is not the article: the name as a whole, or its last word by role."""
    if name.lower() in APART_WORDS:
        return True
    words = [w.lower() for w in _WORD.findall(name) if len(w) > 1]
    if not STATE_WORDS.isdisjoint(words[:-1]):
        return False
    while len(words) > 1 and (words[-1] in BOX_WORDS or words[-1].endswith("s") and words[-1][:-1] in BOX_WORDS or words[-1] == "stories"):
        words.pop()
    return bool(words) and words[-1] in APART_WORDS and PART_WORDS.get(words[-1], set()).isdisjoint(words[:-1])


def _apart(name: str, attributes: str) -> int:
    """2 where the element, its role or its being hidden sets it apart, 1 where only a class name or id does, else 0."""
    if name in APART:
        return 2
    if not attributes or name in ("html", "body"):
        return 0
    found = 0
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id") and any(_names_apart(w) for w in value.split()):
            found = 1
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return 2
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
    return found


class Block(NamedTuple):
    text: str
    apart: bool
    #: Number of the outermost article (positive) or main part (negative), 0 outside.
    part: int
    #: Over half of the text is inside links.
    linked: bool
    #: The part lies in an element that a class name or id sets apart.
    weak: bool
    #: Number of the container, 0 for the body.
    box: int


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """Every block with text, and for every container the number of the one around it (0 for the body itself).

    A main or article part inside an element that only a class name or id sets apart is read all the same, unless it is
    nested in another part.
    """
    out: list[Block] = []
    text: list[str] = []
    link = [0]
    stack: list[tuple[str, int, int, bool, int]] = [("", 0, 0, False, 0)]
    parts, around = 0, [0]

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                _, apart, part, weak, box = stack[-1]
                out.append(Block(joined, apart > 0, part, 2 * link[0] > len(joined), weak, box))
            link[0] = 0

    def add(piece: str) -> None:
        piece = html.unescape(piece)
        text.append(piece)
        if any(s[0] == "a" for s in stack):
            link[0] += len(piece.strip())

    def close_to(depth: int) -> None:
        flush()
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if not page.startswith(">", at - 1):  # a tag cut off at the end of the page
            break
        if m[1] or m[4]:
            if name in INLINE:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] not in INLINE:
                        break
                    if stack[depth][0] == name:
                        if (stack[depth][1] > 0) != (stack[depth - 1][1] > 0):
                            flush()
                        del stack[depth]
                        break
                continue
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == name), 0)
            close_to(depth) if depth else flush()
            continue
        if name in RAW:
            if not (m[3] or m[6] or "").endswith("/") or name not in ("svg", "math"):
                stop = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
                at = end if stop is None else stop.start()
            continue
        if name in VOID:
            if name not in ("wbr", "img", "input"):
                flush()
            continue
        if name not in INLINE:
            flush()
            if name in ENDS_P:
                depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == "p"), 0)
                if depth and all(s[0] in INLINE for s in stack[depth + 1:]):
                    close_to(depth)
            elif name in SIBLINGS:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in SIBLINGS[name]:
                        break
                    if stack[depth][0] == name:
                        close_to(depth)
                        break
        _, apart, part, weak, box = stack[-1]
        own = _apart(name, m[3] or m[6] or "")
        here = max(apart, own)
        if (here > 0) != (apart > 0) and name in INLINE:
            flush()
        if not part and not own and here < 2 and name in ("article", "main"):
            parts += 1
            part, weak, here = parts if name == "article" else -parts, here > 0, 0
        if name not in TEXT_LEVEL and name not in ("html", "body"):
            around.append(box)
            box = len(around) - 1
        stack.append((name, here, part, weak, box))
    flush()
    return out, around


def _stretches(weights: list[int], window: int) -> list[tuple[int, int]]:
    """Ranges from a surge of the windows' sums to the next dive."""
    sums = [sum(weights[i:i + window]) for i in range(len(weights))]
    stretches, begin = [], None
    for i, total in enumerate([*sums, 0]):
        if total and begin is None:
            begin = i
        elif not total and begin is not None:
            stretches.append((begin, i))
            begin = None
    return stretches


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The text of the blocks between surge and dive, one per line."""
    found, around = blocks(page) if page else ([], [0])
    size: dict[tuple[bool, int], int] = {}
    for b in found:
        if b.part and not b.apart:
            size[b.weak, b.part] = size.get((b.weak, b.part), 0) + len(b.text)
    if size:
        _, chosen = max(size, key=lambda p: (not p[0], p[1] < 0, size[p], -abs(p[1])))
        weights = [0 if b.apart or b.part != chosen else len(b.text) for b in found]
        stretches = _stretches(weights, window)
        return "\n".join(found[i].text for i in range(stretches[0][0], stretches[-1][1]) if weights[i])
    return "\n".join(b.text for b in _unmarked([b for b in found if not b.apart], around, window))


def _unmarked(found: list[Block], around: list[int], window: int) -> list[Block]:
    """The article's blocks of a page without a marked part."""
    weights = [0 if b.linked else len(b.text) for b in found]
    stretches = _stretches(weights, window)
    if not stretches:
        return []
    heavy = [[i for i in range(*r) if weights[i]] for r in stretches]
    most = max(range(len(heavy)), key=lambda k: (sum(weights[i] for i in heavy[k]), -k))
    boxes = [b.box for b in found]
    shared = {boxes[i] for i in heavy[most]}
    if len(heavy[most]) == len(shared) > 1 and len({around[x] for x in shared}) == 1 and around[min(shared)]:
        # Paragraphs that each have a container of their own share the one around it.
        boxes = [around[x] if around[x] == around[min(shared)] else x for x in boxes]
        shared = {around[min(shared)]}
    own = [r for r in heavy if any(boxes[i] in shared for i in r)]
    first, last = own[0][0], own[-1][-1]
    span: dict[int, list[int]] = {}
    for i in range(first, last + 1):
        if weights[i]:
            span.setdefault(boxes[i], [i, i])[1] = i

    def inside(i: int) -> bool:
        """Whether a container of the block has text of the article before and after it."""
        x = boxes[i]
        while True:
            if x in span and span[x][0] < i < span[x][1]:
                return True
            if not x:
                return False
            x = around[x]

    below = shared - {0}
    while first and found[first - 1].linked and boxes[first - 1] in below:
        first -= 1
    while last + 1 < len(found) and found[last + 1].linked and boxes[last + 1] in below:
        last += 1
    return [found[i] for i in range(first, last + 1) if weights[i] or boxes[i] in below or inside(i)]


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html", window: int = WINDOW) -> DataFrame:
    """Per page row: id, url, text and its number of code points."""
    plain = pages.select(F.col(f"`{id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{page}`").cast("string").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py(), window) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = plain.schema["page_id"].dataType.simpleString()
    return plain.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")


@query("op7_html_text")
def op7(spark, read):
    return extract(read("pages").select("page_id", "url", "html"))
