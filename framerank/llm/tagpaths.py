"""Main text of web pages by tag-path ratios.

A page is read into blocks: the text of a block-level element up to the next one. Each block has the path of block-level
tags from the root to it. Over all blocks of a path, text length, punctuation and linked text are summed up and
divided by the number of blocks; in page order these ratios are smoothed with a Gaussian window, so a short block among
long ones keeps its place, and fused into one value: length times punctuation, less what is linked. Paths that pass
a share of the values' spread are content. The content region is what the page marks as its article or main
part if content lies there, else the smallest element that holds most of the content's text and isn't one of several
content blocks by itself. The article is all content blocks, and in the region also those of other paths, such as short list
items, unless all that their path holds is links. Nothing below elements that mark themselves as something else (menus, headers, footers,
asides, forms, adverts, notices, comments) belongs to it. Inside an article such a mark on a container counts in the same way, but one on a
paragraph, list item or the like is only a weight (``MARKED``) on the ratios of a path of its own, not smoothed, and they decide.

Each page is read by itself in one pass of a tokenizer, in time linear in its length.

Nulls: a null page is empty and has the empty text. Repeated rows are read each. An empty table gives an empty table.
Pages without any content path have the empty text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the Gaussian window, in blocks, and the share of the spread that a path must pass.
SIGMA, SHARE = 1.0, 0.25
#: What a mark inside an article leaves of a path's value.
MARKED = 0.25

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[a-z]+|[0-9]+")
STOPS = re.compile(r"[.,;:!?…。，、；：！？]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents aren't read. Those of TEXT hold no tags: without an end tag they go on to the page's end.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas video audio select datalist".split())
TEXT = frozenset("script style textarea title iframe".split())
END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table caption colgroup tbody td tfoot th thead tr ul head".split()
)
#: What an opening tag ends: an open element of these, up to the nearest of the others.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: Elements that are never the article's text.
APART = frozenset("nav footer aside form button dialog menu head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a mark sets apart inside an article too.
CONTAINERS = frozenset("div section ul ol dl table figure details fieldset center hgroup header dir address".split())
#: Words in classes, ids and roles that say the same.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations comment comments disqus reply replies respond widget pagination pager toolbar search complementary contentinfo dialog".split()
)


@dataclass
class Element:
    tag: str
    path: int
    apart: bool
    parent: Element | None
    depth: int
    article: Element | None = None
    weight: float = 1.0


@dataclass
class Block:
    element: Element
    text: str
    linked: int
    stops: int
    value: float = 0.0


@dataclass
class Reader:
    """Blocks of one page, in page order."""

    blocks: list[Block] = field(default_factory=list)

    def read(self, page: str) -> list[Block]:
        root = Element("", 0, False, None, 0)
        stack, parts, linked, in_link, at = [root], [], 0, 0, 0
        endless: set[str] = set()  # elements that no end tag follows from here on
        open_count: dict[str, int] = {}
        paths: dict[tuple[int, str], int] = {}  # a path is known by its parent's number and its tag

        def block_of() -> Element:
            return next(e for e in reversed(stack) if e.tag in BLOCKS or not e.tag)

        def last_open(tag: str) -> int:
            return next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag)

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                if text:
                    self.blocks.append(Block(block_of(), text, linked, len(STOPS.findall(text))))
                parts.clear()
            linked = 0

        def close(upto: int) -> None:
            nonlocal in_link
            if any(e.tag in BLOCKS for e in stack[upto:]):
                flush()
            while len(stack) > upto:
                e = stack.pop()
                open_count[e.tag] -= 1
                in_link -= e.tag == "a"

        while at < len(page):
            m = TOKEN.match(page, at)
            at, end, tag, rest = m.end(), m[1], m[2], m[3]
            if tag is None:
                if m[0][:2] not in ("<!", "<?"):
                    parts.append(m[0])
                    linked += len(m[0]) if in_link else 0
                continue
            tag = tag.lower()
            if end:
                if open_count.get(tag):
                    close(last_open(tag))
                continue
            if tag in RAW:
                if not rest.rstrip().endswith("/") and tag not in endless:
                    if after := END[tag].search(page, at):
                        at = after.start()
                    elif tag in TEXT:
                        at = len(page)
                    else:
                        endless.add(tag)
                parts.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                else:
                    parts.append(" " if tag == "br" else "")
                continue
            if tag in BLOCKS and open_count.get("p"):
                close(last_open("p"))
            if tag in ENDS:
                which, within = ENDS[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in within:
                        break
                    if stack[i].tag in which:
                        close(i)
                        break
            if tag in BLOCKS:
                flush()
            top = stack[-1]
            hidden, marked = _marks(tag, rest)
            weighs = marked and top.article is not None and tag not in CONTAINERS
            apart = top.apart or tag in APART or (tag == "header" and top.article is None) or hidden or (marked and not weighs)
            path = paths.setdefault((top.path, tag + "!" * weighs), len(paths) + 1) if tag in BLOCKS else top.path
            element = Element(tag, path, apart, top, top.depth + 1, weight=top.weight * (MARKED if weighs and tag in BLOCKS else 1.0))
            element.article = top.article or (element if tag in ("article", "main") and not apart else None)
            stack.append(element)
            open_count[tag] = open_count.get(tag, 0) + 1
            in_link += tag == "a"
        flush()
        return self.blocks


def _marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element hides itself, and whether it names itself as one of ``MARKS``."""
    hidden = marked = False
    if tag not in ("html", "body", "article", "main") and attributes.strip():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value, name = (a or b or c).lower(), name.lower()
            hidden |= name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None)
            marked |= name in ("class", "id", "role") and not MARKS.isdisjoint(WORD.findall(value))
    return hidden, marked


def fused(blocks: list[Block]) -> None:
    """Sets each block's value: its path's ratios, smoothed in page order and fused."""
    sums: dict[tuple[bool, int], list[float]] = {}
    for b in blocks:
        s = sums.setdefault(_key(b), [0.0, 0.0, 0.0, 0.0])
        for i, x in enumerate((1, len(b.text), b.stops, min(b.linked, len(b.text)))):
            s[i] += x
    ratios = []
    for b in blocks:
        n, chars, stops, linked = sums[_key(b)]
        ratios.append((chars / n, 1 + stops / n, 0.0 if b.element.apart else 1 - linked / chars))
    reach = max(1, math.ceil(3 * SIGMA))
    window = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-reach, reach + 1)]
    for i, b in enumerate(blocks):
        if b.element.weight < 1.0:  # its long neighbours don't speak for a marked paragraph
            b.value = ratios[i][0] * math.sqrt(ratios[i][1]) * ratios[i][2] * b.element.weight
            continue
        near = [(window[k + reach], ratios[i + k]) for k in range(-reach, reach + 1) if 0 <= i + k < len(blocks)]
        weight = sum(w for w, _ in near)
        length, stops = (sum(w * r[j] for w, r in near) / weight for j in (0, 1))
        b.value = length * math.sqrt(stops) * ratios[i][2]


def _key(block: Block) -> tuple[bool, int]:
    return block.element.apart, block.element.path


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line ends."""
    blocks = Reader().read(page or "")
    if not blocks:
        return ""
    fused(blocks)
    values: dict[tuple[bool, int], list[float]] = {}
    for b in blocks:
        values.setdefault(_key(b), []).append(b.value)
    means = {k: sum(v) / len(v) for k, v in values.items()}
    mean = sum(means.values()) / len(means)
    spread = math.sqrt(sum((v - mean) ** 2 for v in means.values()) / len(means))
    limit = SHARE * spread if len(means) > 1 else 0.0
    content = {k for k, v in means.items() if v > 0 and v >= limit}
    chosen = [b for b in blocks if _key(b) in content and not b.element.apart]
    if not chosen:
        return ""
    regions = _articles(chosen) or [_holder(chosen)]
    ids = {id(r) for r in regions}

    def belongs(b: Block) -> bool:
        return b.element.weight == 1.0 and (means[_key(b)] > 0 or b.element.tag in HEADINGS) and _within(b.element, ids)

    return "\n".join(b.text for b in blocks if not b.element.apart and (_key(b) in content or belongs(b)))


def _articles(chosen: list[Block]) -> list[Element]:
    """The marked regions, if at least a third of the content's text lies there; nested ones count as the outermost."""
    found = {id(b.element.article): b.element.article for b in chosen if b.element.article}
    inside = sum(len(b.text) for b in chosen if b.element.article)
    return list(found.values()) if found and 3 * inside >= sum(len(b.text) for b in chosen) else []


def _holder(chosen: list[Block]) -> Element:
    """The deepest element that holds at least 85 of 100 code points of the content, and more than one of its blocks if there are more."""
    mass: dict[int, tuple[Element, int, int]] = {}
    for b in chosen:
        e = b.element
        while e is not None:
            _, chars, n = mass.get(id(e), (e, 0, 0))
            mass[id(e)] = (e, chars + len(b.text), n + 1)
            e = e.parent
    total, least = sum(len(b.text) for b in chosen), min(2, len(chosen))
    return max((e for e, m, n in mass.values() if 100 * m >= 85 * total and n >= least), key=lambda e: e.depth)


def _within(element: Element | None, ids: set[int]) -> bool:
    while element is not None:
        if id(element) in ids:
            return True
        element = element.parent
    return False


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page of ``page_id, url, html``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
