"""Main-text extraction from HTML by tag-path ratios.

Every root-to-leaf tag path of a page gathers the length and the punctuation
of its text nodes; both, per node, are smoothed along the paths in page order
and fused into one score. Paths above a threshold, relative to the spread of
the scores, are content; the article or main element around them, or else the
smallest container that holds them all and the headings before them, is the
article, of which every block is kept whatever its own length, so that short
paragraphs and headings survive. Paths through menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments, known
by element, role or class, never take part; a class that only names a part of
the layout, as of a wrapper with a sidebar, does not remove the article in it,
and inside an article its own head and paragraphs stay whatever such names say.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_right as bisect
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import small_batches

MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?=[\s=/]|\Z)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PUNCTUATION = re.compile(r"[.,;:!?、。，；：！？…]")

# Elements of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
OUT = frozenset("nav header footer aside form script style noscript template iframe button select option textarea svg canvas dialog menu title object".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body table ul ol dl td th article main section div blockquote".split())
# Words that name what is not the article, in classes, ids and roles.
OUT_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices
    alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer contentinfo complementary
    comment comments commentlist disqus respond reply replies related recommended share sharing social newsletter subscribe subscription
    signup login search toolbar widget pagination pager skip""".split()
)
#: Words among them that wrappers of the whole page bear too.
LAYOUT_WORDS = frozenset("sidebar header masthead footer banner menu nav navbar navigation toolbar widget overlay".split())
#: Words that inside an article name parts of it as well: its head, and paragraphs.
HEAD_WORDS, PART_WORDS = frozenset(("header", "masthead")), frozenset("header masthead related recommended social".split())
KEPT = frozenset(("html", "body", "main"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements that are never the container of an article.
PARTS = frozenset(("p", *HEADINGS, "li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption"))
PARAGRAPHS = frozenset(("p", *HEADINGS, "blockquote", "pre"))
SENTENCE = re.compile(r"[.!?。！？…]")
#: A path is content above this part of the scores' standard deviation.
SPREAD = 0.5
#: In a page without an article element, a path of which more is link text is none.
LINK_SHARE = 0.6


def names_of(attrs: str) -> frozenset[str] | None:
    """The words by which class, id or role name something that is not the
    article; None where it is hidden."""
    found: set[str] = set()
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return None
        for part in value.split():
            words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", part).lower())
            if words and words[0] not in ("has", "with", "no"):
                found |= OUT_WORDS.intersection(words)
    return frozenset(found)


class _Paths:
    """The tree of a page's tag paths; equal paths are one node. A node's
    number is above its parent's, and it knows what it lies under, so that no
    question about it climbs the tree."""

    def __init__(self) -> None:
        self.ids: dict[tuple[int, str, bool], int] = {}
        self.parent, self.tag, self.out, self.depth = [-1], [""], [False], [0]
        #: Under an article or main element, under a link; the nearest heading (0: none) and element that is not inline.
        self.marked, self.linked, self.heading, self.block = [False], [False], [0], [0]

    def child(self, parent: int, tag: str, out: bool) -> int:
        key = (parent, tag, out)
        if (i := self.ids.get(key)) is None:
            i = self.ids[key] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.out.append(out or self.out[parent])
            self.depth.append(self.depth[parent] + 1)
            self.marked.append(self.marked[parent] or tag in ("article", "main"))
            self.linked.append(self.linked[parent] or tag == "a")
            self.heading.append(i if tag in HEADINGS else self.heading[parent])
            self.block.append(self.block[parent] if tag in INLINE else i)
        return i

    def common(self, some: Iterable[int]) -> int:
        """The deepest node that holds all of some nodes."""
        held = [0] * len(self.parent)
        every = set(some)
        for p in every:
            held[p] = 1
        for p in range(len(held) - 1, 0, -1):
            if held[p] == len(every):
                return p
            held[self.parent[p]] += held[p]
        return 0

    def inside(self, root: int) -> list[bool]:
        """Of every node whether ``root`` holds it."""
        out = [i == root for i in range(len(self.parent))]
        for i in range(root + 1, len(out)):
            out[i] = out[self.parent[i]]
        return out


class _Open:
    """The open elements, with the places of each tag, so that what an element
    closes is found without a walk over all that are open."""

    def __init__(self) -> None:
        #: Tag, path, innermost cut, whether out whatever its name, whether in an article that stays.
        self.items: list[tuple[str, int, int | None, bool, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, *rest) -> None:
        self.places.setdefault(tag, []).append(len(self.items))
        if tag not in INLINE:
            self.blocks.append(len(self.items))
        self.items.append((tag, *rest))

    def cut(self, k: int) -> None:
        while len(self.items) > k:
            tag = self.items.pop()[0]
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def close(self, tag: str) -> None:
        at = self.places.get(tag)
        if at and not (tag in INLINE and self.blocks and self.blocks[-1] > at[-1]):
            self.cut(at[-1])

    def make_room(self, closed: frozenset[str] | set[str]) -> None:
        """Close all of ``closed`` up to the nearest other element that bounds them."""
        if not any(self.places.get(t) for t in closed):
            return
        bound = max((at[-1] for t in SCOPES.difference(closed) if (at := self.places.get(t))), default=-1)
        first = min((at[i] for t in closed if (at := self.places.get(t)) and (i := bisect(at, bound)) < len(at)), default=None)
        if first is not None:
            self.cut(first)


@dataclass
class _Cut:
    """An element that its class, id or role removes, and what is lost by it."""

    place: int
    parent: int | None
    layout: bool
    article: bool = False
    #: The head of an article that stays: kept once a heading is found in it.
    head: bool = False
    headed: bool = False
    texts: list[tuple[int, str]] = field(default_factory=list)


def parse(page: str, spared: frozenset[int] = frozenset()) -> tuple[_Paths, list[tuple[int, int, str]], list[_Cut], bool]:
    """The paths of a page, its text nodes (path, block, text), the elements
    removed by name, outer ones first, and whether an article or main element
    stays. Names of elements that end at a place in ``spared`` do not count."""
    paths, nodes, cuts, stays = _Paths(), [], [], False
    opened = _Open()
    stack = opened.items
    here = block = at = 0
    while at < len(page):
        m = MARK.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            if not paths.out[here]:
                nodes.append((here, block, page[at:end]))
            elif not stack[-1][3]:
                cuts[stack[-1][2]].texts.append((here, page[at:end]))
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, close, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag == "br" or tag == "wbr":
            if tag == "br":
                nodes.append((here, block, " "))
            continue
        inline = tag in INLINE
        if not inline:
            block += 1
        if close:
            opened.close(tag)
        else:
            if not inline:
                opened.make_room(CLOSED_BY.get(tag, set()) | {"p"})
            if tag in VOID or attrs.endswith("/") and tag not in INLINE and tag in ("path", "rect", "circle"):
                here = stack[-1][1] if stack else 0
                continue
            parent = stack[-1][1] if stack else 0
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(page, at)
                at = stop.end()
                here = parent
                continue
            names = names_of(attrs) if attrs and tag not in KEPT else frozenset()
            cut, hard, mine = stack[-1][2:] if stack else (None, False, False)
            hard = hard or tag in OUT or names is None
            names = names or frozenset()
            if at in spared or mine and tag in PARAGRAPHS and names <= PART_WORDS:
                names = frozenset()
            if names and not hard:
                cuts.append(_Cut(at, cut, names <= LAYOUT_WORDS, head=mine and cut is None and names <= HEAD_WORDS))
                cut = len(cuts) - 1
            if tag in HEADINGS and cut is not None and not hard:
                cuts[cut].headed = True
            if tag in ("article", "main") and not hard:
                if cut is None:
                    stays = mine = True
                else:
                    cuts[cut].article = True
            opened.push(tag, paths.child(parent, tag, hard or bool(names)), cut, hard, mine)
        here = stack[-1][1] if stack else 0
    return paths, nodes, cuts, stays


def wrappers(paths: _Paths, nodes: list[tuple[int, int, str]], cuts: list[_Cut], stays: bool) -> set[int]:
    """Places of the removed elements that hold the article.

    Where no other article or main element stays: those around one, if they
    are named by the layout or nothing else on the page is a sentence; without
    any such element, and without a sentence, the layout that holds most text."""
    if stays or not any(c.article or c.layout for c in cuts):
        return set()
    plain = lambda found: any(SENTENCE.search(t) and not (paths.heading[p] or paths.linked[p]) for p, t in found)
    rest = plain((p, t) for p, _, t in nodes)
    out: set[int] = set()
    if any(c.article for c in cuts):
        fine: list[bool] = []  # whether all names from here outwards may be ignored
        for c in cuts:
            fine.append((c.layout or not rest) and (c.parent is None or fine[c.parent]))
        for k, c in enumerate(cuts):
            at = k if c.article and fine[k] else None
            while at is not None and cuts[at].place not in out:
                out.add(cuts[at].place)
                at = cuts[at].parent
        return out
    sizes = [sum(len(t.strip()) for _, t in c.texts) for c in cuts]
    inner: dict[int | None, list[int]] = {}
    for k in range(len(cuts) - 1, -1, -1):
        if cuts[k].parent is not None:
            sizes[cuts[k].parent] += sizes[k]
        if cuts[k].layout:
            inner.setdefault(cuts[k].parent, []).append(k)
    at = None
    while not rest and at in inner:
        at = max(inner[at], key=lambda k: (sizes[k], -k))
        out.add(cuts[at].place)
        rest = plain(cuts[at].texts)
    return out if rest else set()


def smooth(x: np.ndarray) -> np.ndarray:
    """A path counts twice, the ones before and behind it in page order once."""
    padded = np.pad(x, 1, mode="edge")
    return (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4


def element_root(paths: _Paths, nodes: list[tuple[int, int, str]], root: int) -> int:
    """The outermost article element around ``root``, or the main element where
    there is none or only that one holds a heading before it; else the page."""
    article = main = 0
    p = root
    while p > 0:
        if paths.tag[p] == "article":
            article = p
        elif paths.tag[p] == "main":
            main = p
        p = paths.parent[p]
    if not article or not main or paths.depth[article] < paths.depth[main]:
        return article or main
    in_main, in_article = paths.inside(main), paths.inside(article)
    for p, _, text in nodes:
        if in_main[p] and paths.heading[p] and text.strip():
            return article if in_article[p] else main
    return article


def headed_root(paths: _Paths, nodes: list[tuple[int, int, str]], root: int) -> int:
    """The nearest container of ``root`` that holds the headings before it too:
    the last heading, and every earlier one of a higher level. Linked headings,
    as of a site's name, do not count."""
    level = len(HEADINGS) + 1
    before: list[tuple[int, int]] = []
    held = paths.inside(root)
    for p, _, text in nodes:
        if not text.strip():
            continue
        q = paths.heading[p]
        if held[p]:
            if q > root:
                level = HEADINGS.index(paths.tag[q]) + 1
            break
        if q > 0 and not paths.linked[p]:
            before.append((HEADINGS.index(paths.tag[q]) + 1, q))
    for rank, q in reversed(before):
        if rank < level:
            root, level = paths.common((root, q)), rank
    while root > 0 and (paths.tag[root] in INLINE or paths.tag[root] in PARTS):
        root = paths.parent[root]
    return root


def article_root(paths: _Paths, nodes: list[tuple[int, int, str]]) -> tuple[int, set[int]]:
    """The container of the content paths, and the paths in it to leave out."""
    stats: dict[int, list[int]] = {}
    for path, _, text in nodes:
        size = len(text) - text.count(" ") - text.count("\n") if text.isascii() else sum(not c.isspace() for c in text)
        if size:
            s = stats.setdefault(path, [0, 0, 0])
            s[0] += size
            s[1] += len(PUNCTUATION.findall(text))
            s[2] += 1
    if not stats:
        return 0, set()

    marked = {p for p in stats if paths.marked[p]}
    keys = [p for p in stats if not marked or p in marked]
    values = np.array([stats[p] for p in keys], float)
    length, marks = smooth(values[:, 0] / values[:, 2]), smooth(values[:, 1] / values[:, 2])
    fused = length * (1 + marks)
    limit = min(SPREAD * fused.std(), fused.max()) if len(keys) > 1 else 0.0
    root = paths.common(p for p, f in zip(keys, fused, strict=True) if f >= limit)
    while root > 0 and (paths.tag[root] in INLINE or paths.tag[root] in PARTS):
        root = paths.parent[root]
    if marked:
        return element_root(paths, nodes, root), set(stats) - marked
    root = headed_root(paths, nodes, root)
    links: dict[int, int] = {}
    total: dict[int, int] = {}
    for p, s in stats.items():
        q = paths.block[p]
        total[q] = total.get(q, 0) + s[0]
        links[q] = links.get(q, 0) + s[0] * paths.linked[p]
    bad = {q for q in total if links[q] > LINK_SHARE * total[q]}
    return root, {p for p in stats if paths.block[p] in bad}


def main_text(page: str | None) -> str:
    """The article of a page: its blocks, white space within each squeezed,
    joined by blank lines. Null, empty and textless pages give ''. The time is
    in proportion to the page, however long it is or deep its elements lie."""
    if not page:
        return ""
    paths, nodes, cuts, stays = parse(page)
    held = wrappers(paths, nodes, cuts, stays).union(c.place for c in cuts if c.head and c.headed)
    if held:
        paths, nodes, _, _ = parse(page, frozenset(held))
    root, leave = article_root(paths, nodes)
    inside = paths.inside(root)
    blocks: list[list[str]] = []
    last = None
    for path, block, text in nodes:
        if path in leave or not inside[path]:
            continue
        if block != last:
            blocks.append([])
            last = block
        blocks[-1].append(text)
    whole = (" ".join(html_lib.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(b for b in whole if b)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each; rows and other columns stay as
    they are, whatever their names, and a column named ``out`` is replaced.
    Repeated rows are extracted each; an empty table gives no rows."""
    small_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        return pa.array([main_text(p) for p in column.to_pylist()], pa.string())

    return pages.withColumn(out, text_of(F.col(f"`{html_col}`")))
