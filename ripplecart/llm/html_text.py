"""Main text of a page by tag-path ratios.

Every text belongs to the path of tags from the root to the node that holds it. Per path the page gives the number of
nodes, the length of their text, its punctuation marks and the share of it that stands in links. Two ratios per path, text
length and punctuation per node, are smoothed along the page order of the paths, fused by their product,
and the paths above the threshold (a share of the standard deviation) are content paths.

Content paths point at the content's container: the deepest element that holds most of the text that they select.
Every block of the container that is no boilerplate belongs to the article, short headings and list items too.
Elements that are boilerplate by their meaning (menus, headers, footers, asides, scripts ...) or because they are hidden
take no part in either step. Forms and elements marked by a name in their class, id or role take part only where they hold
the page's text: see `_settle`.

Pages are independent: one Arrow task works page by page, nothing is shuffled.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecart.llm.common import passes

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements that are never main text.
DROPPED = frozenset(
    "nav header footer aside button select option optgroup datalist label fieldset legend menu dialog template head script style "
    "textarea title iframe noembed noframes noscript xmp svg math canvas object embed audio video map".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark meter nobr output q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr img".split()
)
#: Names in class, id and role that mark boilerplate: a whole name, or one made up of these words (`_marks`).
#: NOUNS mark a name that ends in them whatever stands before (post-comments), the others only beside FORMS (share-buttons).
NOUNS = frozenset(
    "ads advert adverts advertisement advertisements advertising adbox adsense sponsor sponsors promo promos banner nav navbar navigation menu menus "
    "breadcrumb breadcrumbs pagination pager sidebar sidebars widget widgets header masthead footer comments commentlist disqus "
    "cookie cookies gdpr popup modal overlay newsletter toolbar tooltip contentinfo".split()
)
MARKS = NOUNS | frozenset(
    "ad adv sponsored promoted promotion side rail foot comment discussion respond reply replies reviews consent notice notices "
    "alert subscribe subscription signup login share sharing social related recommended recommendations "
    "skip hidden complementary search copyright legal disclaimer".split()
)
#: Words that leave a name's meaning as it is beside a mark.
FORMS = frozenset(
    "area article articles bar block body bottom box btn button buttons card cards center col column container content desktop entry form group "
    "head heading home icon icons inner item items js left line link links list lists logo main meta mobile more outer page panel policy post posts "
    "primary region right row secondary section site slot stories sub tertiary text title to top unit visually wrap wrapper".split()
)
#: Words of names that tell of a layout or state, not of what an element is.
STATES = frozenset("by disable disabled enable enabled has have hide hides is no non not off on open overflow show shows un with without".split())
#: Least characters outside links of a marked element that can be the page's text.
LEAST = 100
#: Parents that a new block of the same kind closes; a paragraph ends where any block begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
FLOW = frozenset("p li td th tr tbody thead table ul ol dl dd dt blockquote pre figure figcaption h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("ul ol dl table div article section main body html blockquote figure td th".split())

#: Comment, CDATA, declaration, or tag with its attributes; what is not closed goes on to the end of the page. Nothing backtracks.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|"
    r"</?+([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)",
    re.S,
)
#: Each attribute from its start, values and all, so that no name is found inside another name or a value.
_ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"?|'[^']*+'?|[^\s>]++))?+")
_MARK = re.compile(r"[.,;:!?…。，]")


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None
    path: int  # number of the tag path
    depth: int
    dropped: bool = False
    marked: bool = False  # boilerplate unless it holds the page's text
    chars: int = 0  # of content paths, its own and those below
    inside: bool = False  # in the container
    off: bool = False  # in a marked element that is boilerplate


@dataclass
class Block:
    node: Node
    texts: list[tuple[Node, str]] = field(default_factory=list)


def _marks(name: str) -> bool:
    """Whether a name of a class, id or role marks boilerplate."""
    if name in MARKS:
        return True
    words = [w for w in re.split(r"[-_]+", name) if w]
    if STATES.intersection(words) or not MARKS.intersection(words):
        return False
    return words[-1] in NOUNS or all(w in MARKS or w in FORMS or w.isdigit() for w in words)


def _boilerplate(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is never main text, and whether it is marked as boilerplate."""
    if tag in DROPPED:
        return True, False
    if tag in ("body", "html", "main", "article"):
        return False, False
    marked = tag == "form"
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name = name.lower()
        if name in ("class", "id", "role"):
            marked = marked or any(map(_marks, html.unescape(value.strip("\"'")).lower().split()))
        elif name in ("hidden", "aria-hidden", "style"):
            value = html.unescape(value.strip("\"'")).lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                return True, False
    return False, marked


def blocks_of(page: str) -> tuple[list[Block], list[Node]]:
    """Blocks of text in page order, and all elements, parents first.

    Unclosed elements end with their parent; stray end tags are passed over. The time is in proportion to the page.
    """
    node = Node("", None, 0, 0)
    nodes, blocks, paths, open_ = [node], [Block(node)], {}, Counter()
    at = 0

    def close_to(up: Node) -> None:
        nonlocal node
        while node is not up:
            open_[node.tag] -= 1
            node = node.parent

    def text(value: str) -> None:
        if value and not node.dropped:
            blocks[-1].texts.append((node, html.unescape(value)))

    def cut() -> None:
        if blocks[-1].texts:
            blocks.append(Block(node))
        else:
            blocks[-1].node = node

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[1] is None:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[1].lower()
        if m[0][1] == "/":
            if open_[tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                close_to(up.parent)
                if tag not in INLINE:
                    cut()
            elif tag in ("p", "br"):
                cut()
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                cut()
            continue
        block = tag not in INLINE
        if block:
            closed = CLOSES.get(tag, frozenset()) | {"p"}
            up, outer = node, None
            if any(open_[t] > 0 for t in closed):
                while up.parent is not None and (up.tag in closed or up.tag not in SCOPE):
                    if up.tag in closed:
                        outer = up.parent
                        if up.tag == tag:
                            break
                    up = up.parent
            if outer is not None:
                close_to(outer)
        path = paths.setdefault((node.path, tag), len(paths) + 1)
        dropped, marked = _boilerplate(tag, m[2])
        nodes.append(node := Node(tag, node, path, node.depth + 1, node.dropped or dropped, marked))
        open_[tag] += 1
        if block:
            cut()
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            inner = page[at : end.start() if end else len(page)]
            at = end.end() if end else len(page)
            text(inner)
            close_to(node.parent)
            cut()
        elif m[2].endswith("/") and tag in ("svg", "math", "path"):
            close_to(node.parent)
    text(page[at:])
    return [b for b in blocks if b.texts], nodes


def path_scores(blocks: list[Block], spread: int = 1) -> dict[int, float]:
    """Fused ratio of each tag path, smoothed with a Gaussian of `spread` neighbours in page order."""
    chars: dict[int, int] = {}
    marks: dict[int, int] = {}
    nodes: dict[int, set[int]] = {}
    for b in blocks:
        for node, value in b.texts:
            chars[node.path] = chars.get(node.path, 0) + len("".join(value.split()))
            marks[node.path] = marks.get(node.path, 0) + len(_MARK.findall(value))
            nodes.setdefault(node.path, set()).add(id(node))
    paths = list(chars)
    kernel = [math.exp(-(d * d) / (2 * spread * spread)) for d in range(-2 * spread, 2 * spread + 1)]

    def smooth(values: list[float]) -> list[float]:
        out = []
        for i in range(len(values)):
            near = [(w, values[j]) for d, w in zip(range(-2 * spread, 2 * spread + 1), kernel, strict=True) if 0 <= (j := i + d) < len(values)]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    length = [chars[p] / len(nodes[p]) for p in paths]
    punctuation = [1 + marks[p] / len(nodes[p]) for p in paths]
    # smoothing may lift a short neighbour, it never pushes a path below its own ratio
    fused = [max(a, b) for a, b in zip(smooth([x * y for x, y in zip(length, punctuation, strict=True)]), [x * y for x, y in zip(length, punctuation, strict=True)], strict=True)]
    return dict(zip(paths, fused, strict=True))


def _settle(blocks: list[Block], nodes: list[Node]) -> None:
    """Say which nodes are off: those in a marked element, unless that element holds the page's text.

    It does when its running text (LEAST characters outside links) has at least half of the page's text-ratio mass, characters
    times fused ratio, and nothing outside of marked elements can be the text: there is no article or main element, and the element
    has one or the mass there is below a fiftieth of its own. Marked elements inside it are judged in turn.
    """
    if not any(n.marked for n in nodes):
        return
    scores = path_scores(blocks)
    linked, holder, mass, chars, clean, named, free = set(), {}, Counter(), Counter(), Counter(), set(), set()
    for n in nodes[1:]:
        if n.tag == "a" or id(n.parent) in linked:
            linked.add(id(n))
        holder[id(n)] = n if n.marked else holder.get(id(n.parent))
    for b in blocks:
        for n, value in b.texts:
            if id(n) not in linked:
                size = len("".join(value.split()))
                mass[id(n)] += size * scores[n.path]
                chars[id(n)] += size
                clean[id(holder.get(id(n)))] += size * scores[n.path]
    for n in reversed(nodes[1:]):
        mass[id(n.parent)] += mass[id(n)]
        chars[id(n.parent)] += chars[id(n)]
        if chars[id(n)] and (n.tag in ("article", "main") or id(n) in named):
            named.add(id(n.parent))
    for n in nodes[1:]:
        if n.tag in ("article", "main") and chars[id(n)]:
            free.add(id(holder[id(n)]))
    page, outside, found = mass[id(nodes[0])], clean[id(None)], id(None) in free
    for n in nodes[1:]:
        n.off = n.parent.off
        if n.marked and not n.off:
            whole = mass[id(n)]
            n.off = found or chars[id(n)] < LEAST or whole < page / 2 or (id(n) not in named and outside * 50 >= whole)
            if not n.off:
                outside += clean[id(n)]
                found = id(n) in free


def main_text(page: str | None, share: float = 0.8, threshold: float = 0.5) -> str:
    """The article's text: blocks joined by one space, white space inside them made one space; empty if there is none."""
    blocks, nodes = blocks_of(page or "")
    _settle(blocks, nodes)
    for b in blocks:
        b.texts = [(n, v) for n, v in b.texts if not n.off]
    blocks = [b for b in blocks if any(v.strip() for _, v in b.texts)]
    if not blocks:
        return ""
    scores = path_scores(blocks)
    mean = sum(scores.values()) / len(scores)
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores.values()) / len(scores))
    chosen = {p for p, s in scores.items() if s >= threshold * spread and s >= 0.1 * max(scores.values())}
    for b in blocks:
        for node, value in b.texts:
            if node.path in chosen:
                node.chars += len("".join(value.split()))
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
    container = _climb(max((n for n in nodes if n.chars and n.chars >= share * nodes[0].chars), key=lambda n: n.depth, default=nodes[0]))
    for node in nodes:
        node.inside = node is container or (node.parent is not None and node.parent.inside)
    out = []
    for b in blocks:
        if text := " ".join("".join(v for n, v in b.texts if n.inside).split()):
            out.append(text)
    return " ".join(out)


def _climb(node: Node) -> Node:
    """The article or main element around a node; else the element around its paragraph, list or table."""
    named = node
    while named is not None and named.tag not in ("article", "main"):
        named = named.parent
    while named is None and node.parent is not None and (node.tag in INLINE or node.tag in FLOW):
        node = node.parent
    return named or node


def main_texts(pages: DataFrame, html_column: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The `carry` columns of `pages` in struct page, and the main text.

    A null or empty page, and one whose text is all boilerplate, has an empty text. Markup need not be well formed.
    """
    carry = pages.columns if carry is None else carry
    out = pages.select(F.struct(*carry).alias("page"), F.col(html_column).alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(texts, pa.string())], names=["page", "text"])

    return out.mapInArrow(extract, out.select("page", F.lit("").alias("text")).schema)
