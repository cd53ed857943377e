"""Main-text extraction by wrapper induction over the pages of a host.

Each page is parsed to the tree of its block elements. A host's pages are aligned to one of them,
the pivot of their layout, by simple tree matching: the mapping of nodes, in order and level by
level, that keeps most. Layouts are counted over all pages of the host; pages of a rare one are
aligned to the pivot that fits them best. Over all pages of the host, it is counted for every pivot
node how often the aligned node said the same, and how much text that varies from page to page stands
there, within links and without. Nodes that hardly ever change are the template. What varies is the
content, but not all of it is article: menus, adverts and footers vary as well. So the wrapper is
followed from its root to the node that holds the content, as long as all that varies beside a node is
small or linked and has no heading; the page's blocks outside of that node are left out.

Names decide where the wrapper can't: elements whose tag, role, class or id says that they are
furniture (forms, notices, reader comments, which vary like the article and may stand in it) are left
out, and where a page marks its article (``article``, ``main``) only blocks in it are kept; that is all
there is on hosts of few pages. Within a marked article a weak word (alert, share, related) that is only a part
of a name leaves out blocks of links, and no others. A block counts as template only on strong evidence, as copied articles
look constant as well: equal pages count as one, many pages have to agree, and what is left has to be a
share of the page's text. All other blocks are kept, however short or linked.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fits, scratch, small_join, spread_join, table
from .textarrays import trimmed
from .urls import host_of

# Elements and names.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search"
    " section summary table tbody tfoot thead tr ul head noscript template object iframe svg math button select"
    " canvas video audio".split()
)
SPACES = frozenset("br td th wbr img input".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
ENDS_P = BLOCKS - frozenset("button noscript object svg math canvas video audio option optgroup iframe select template".split())
VOID = frozenset("hr".split())
FURNITURE = frozenset(
    "nav footer aside form head noscript template iframe object svg math button select menu dialog search canvas video"
    " audio".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
STRONG = frozenset(
    "comment comments commentlist respond disqus discussion replies ad ads advert adverts advertisement advertising"
    " sponsor sponsored promo promotion".split()
)
WEAK = frozenset(
    "nav navbar navigation menu sidebar footer masthead banner breadcrumb breadcrumbs notice notices cookie"
    " cookies consent gdpr alert announcement newsletter subscribe signup login share sharing social related"
    " recommended popup modal overlay pagination pager toolbar widget skip".split()
)
#: Parts of a name that say nothing about what an element holds.
PLAIN = frozenset(
    "area bar block box button buttons container form global group icons inline inner item items link links list outer panel"
    " section site sticky widget wrap wrapper".split()
)
TITLED = frozenset("article content entry post story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | frozenset("p li blockquote pre dd dt figcaption tr caption summary".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tr", "tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tr", "tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}

#: A node is template if it says the same on this share of the pages aligned to it, of which there are
#: so many, and if half of the pages differ in another block that is kept.
CONSTANT, LEAST_PAGES = 0.95, 20
#: Nothing is template on a page of which less than this share of characters would be left: copies of a
#: page but for a date or a counter look like that.
LEAST_SHARE = 0.2
#: Blocks of which links hold this share are left out where a name alone is in doubt.
LINKED = 0.5
#: The wrapper leads to a node if it was aligned on so many pages and if at most this share of the text that
#: varies stands beside it, links apart.
REGION_PAGES, BESIDE = 10, 0.1
#: Most pivots of a host, and levels of blocks by which layouts are told apart.
PIVOTS, LEVELS = 8, 3
#: Pairs of children of which a table is held; that of wider levels is made row by row, and again in parts.
WIDEST = 20_000
#: Children up to which rows of a table are lists, which are faster than arrays if they are short.
NARROW = 64
#: Weights of pairs of subtrees that are remembered at once.
MOST_WEIGHTS = 1_000_000

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_NAMED = re.compile(r"\b(?:class|id|role|hidden|style|aria-hidden)\b", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


#: Whether an element is furniture: NO and YES, or DOUBT where it depends on the links of each block.
NO, YES, DOUBT = 0, 1, 2


def _said(value: str) -> set[str]:
    """The words of a class or id, without those that another takes its meaning from (``has-sidebar``)."""
    parts = [p.lower() for p in _PARTS.findall(value)]
    return {p for b, p in zip(["", *parts], parts) if b not in ("has", "with", "no", "without", "page")}


def _named(said: set[str], inside: bool) -> int:
    """Whether a name's words are those of furniture. Within a marked article (``inside``) a weak word has to be the
    whole of it, plain ones apart: an ``alert-text`` or ``related-work`` there may be the article's own."""
    if STRONG & said:
        return YES
    if not WEAK & said:
        return NO
    return YES if not inside or all(p in WEAK or p in PLAIN or len(p) < 3 or p.isdigit() for p in said) else DOUBT


def _furniture(tag: str, attributes: str, inside: bool = False) -> tuple[int, str, str]:
    """(whether the element is furniture, its class, "header" or "title" if it heads a page or an article)."""
    head = "header" if tag == "header" else ""
    if not attributes or not _NAMED.search(attributes):
        return int(tag in FURNITURE), "", head
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    name = found.get("class", "")
    if tag in FURNITURE or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        return int(tag not in ("html", "body")), name, head
    if "display:none" in found.get("style", "").replace(" ", "").lower():
        return YES, name, head
    if tag in ("html", "body", "main"):
        return NO, name, head
    doubt = NO
    for value in re.split(r"\s+", f"{name} {found.get('id', '')}"):
        said = _said(value)
        if "header" in said:
            head = "title" if TITLED & {p.lower() for p in _PARTS.findall(value)} else head or "header"
        own = _named(said, inside)
        if own == YES and (tag != "article" or STRONG & said):
            return YES, name, head
        doubt = max(doubt, own if tag != "article" else NO)
    return doubt, name, head


class Page:
    """Block elements in document order, and the text blocks that stand in them."""

    __slots__ = ("labels", "sizes", "said", "blocks", "marked")

    def __init__(self, html: str):
        self.labels: list[str] = ["#"]
        self.sizes: list[int] = [1]
        self.said: list[int] = [0]
        #: (node, text, furniture, in a marked article, share of its characters in links)
        self.blocks: list[tuple[int, str, bool, bool, float]] = []
        self.marked = False
        self._parse(html)

    def _parse(self, html: str) -> None:
        labels, sizes, said, blocks = self.labels, self.sizes, self.said, self.blocks
        # open elements: (tag, node, furniture, in an article, in a header of an article)
        stack = [("#", 0, NO, False, False)]
        text: list[str] = []
        opened: dict[str, int] = {}
        link, linked = False, 0
        at, end = 0, len(html)

        def flush() -> None:
            nonlocal text, linked
            if text:
                joined = "".join(text)
                if "&" in joined:
                    joined = unescape(joined)
                joined = " ".join(joined.split())
                if joined:
                    share = min(1.0, linked / len(joined))
                    tag, node, out, inside, header = stack[-1]
                    out = out == YES or out == DOUBT and share >= LINKED or header and tag not in HEADINGS
                    said[node] = zlib.crc32(joined.encode("utf-8", "surrogatepass"), said[node])
                    blocks.append((node, joined, out, inside, share))
                text, linked = [], 0

        def pop() -> None:
            flush()
            tag, node = stack.pop()[:2]
            opened[tag] = opened.get(tag, 0) - 1
            sizes[node] = len(labels) - node

        token = _TOKEN.search(html, at)
        while token:
            if token.start() > at:
                text.append(html[at : token.start()])
                if link:
                    linked += token.start() - at
            at = token.end()
            tag = token[2]
            if tag is not None:
                tag = tag.lower()
                if token[1]:
                    if tag in BLOCKS:
                        flush()
                        if opened.get(tag, 0) > 0:
                            while stack[-1][0] != tag:
                                pop()
                            pop()
                    elif tag == "a":
                        link = False
                    elif tag in SPACES:
                        text.append(" ")
                elif tag in BLOCKS:
                    flush()
                    if tag in ENDS_P and opened.get("p", 0) > 0:
                        while True:
                            last = stack[-1][0]
                            pop()
                            if last == "p":
                                break
                    if tag in CLOSES:
                        ended, scope = CLOSES[tag]
                        for i in range(len(stack) - 1, 0, -1) if any(opened.get(t, 0) > 0 for t in ended) else ():
                            if stack[i][0] in ended:
                                while len(stack) > i:
                                    pop()
                                break
                            if stack[i][0] in scope:
                                break
                    _, _, out, inside, header = stack[-1]
                    own, name, head = _furniture(tag, token[3], inside)
                    if tag in ("article", "main") and not own and not (out == YES and stack[-1][0] != "form"):
                        out, inside = NO, True
                        self.marked = True
                    if head:
                        own, header = YES if head == "header" and not inside else own, True
                    if tag not in VOID:
                        labels.append(f"{tag}.{name}" if name else tag)
                        sizes.append(1)
                        said.append(0)
                        stack.append((tag, len(labels) - 1, YES if YES in (out, own) else max(out, own), inside, header))
                        opened[tag] = opened.get(tag, 0) + 1
                    if tag in RAW:
                        close = re.compile(rf"</{tag}\b", re.I).search(html, at)
                        at = close.start() if close else end
                elif tag in SPACES:
                    text.append(" ")
                elif tag == "a":
                    link = True
                elif tag in RAW:
                    close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                    at = close.end() if close else end
            token = _TOKEN.search(html, at)
        if at < end:
            text.append(html[at:])
        while stack:
            pop()


def _shapes(labels: list[str], sizes: list[int]) -> tuple[list[list[int]], list[int]]:
    """(children, hash of the subtree's labels) of every node."""
    n = len(labels)
    children: list[list[int]] = [[] for _ in range(n)]
    shape = [0] * n
    for i in range(n - 1, -1, -1):
        j, last = i + 1, i + sizes[i]
        own = []
        while j < last:
            own.append(j)
            j += sizes[j]
        children[i] = own
        shape[i] = hash((labels[i], *(shape[c] for c in own)))
    return children, shape


class Tree:
    def __init__(self, labels: list[str], sizes: list[int], said: list[int]):
        self.labels, self.sizes, self.said = labels, sizes, said
        self.children, self.shape = _shapes(labels, sizes)


def align(page: Tree, pivot: Tree) -> list[int]:
    """The pivot's node for each node of the page by simple tree matching, -1 where there is none. Levels of
    any width are matched exactly, in memory of the square root of their pairs times the pivot's children,
    and trees of any depth: weights that a weight needs are worked off on a stack of their own."""
    mapped = [-1] * len(page.labels)
    todo = [(0, 0)]
    weights: dict[tuple[int, int], int] = {}

    def ends(a: list[int], b: list[int]) -> tuple[int, int]:
        """Length of the equal beginning and end; matching equal subtrees there is always best."""
        head, most = 0, min(len(a), len(b))
        while head < most and page.shape[a[head]] == pivot.shape[b[head]]:
            head += 1
        tail = 0
        while tail < most - head and page.shape[a[-1 - tail]] == pivot.shape[b[-1 - tail]]:
            tail += 1
        return head, tail

    def known(i: int, j: int) -> int | None:
        if page.labels[i] != pivot.labels[j]:
            return 0
        if page.shape[i] == pivot.shape[j]:
            return page.sizes[i]
        if page.sizes[i] == 1 or pivot.sizes[j] == 1:
            return 1
        return weights.get((page.shape[i], pivot.shape[j]))

    # the following generators yield pairs whose weight they need, and rows of a table

    def weigh(i: int, j: int) -> Iterator:
        a, b = page.children[i], pivot.children[j]
        head, tail = ends(a, b)
        found = 1 + sum(page.sizes[x] for x in a[:head]) + sum(page.sizes[x] for x in a[len(a) - tail :])
        a, b = a[head : len(a) - tail], b[head : len(b) - tail]
        if a and b:
            last: list = [None]
            yield from passing(rows_of(a, b, first_row(b)), lambda row: last.__setitem__(0, row))
            found += int(last[0][-1])
        if len(weights) >= MOST_WEIGHTS:
            weights.clear()
        weights[page.shape[i], pivot.shape[j]] = found
        return found

    def first_row(b: list[int]) -> np.ndarray:
        return np.zeros(len(b) + 1, np.int64)

    def rows_of(a: list[int], b: list[int], row: np.ndarray) -> Iterator:
        """The rows of the table after ``row``, one for each of ``a``."""
        by_label: dict[str, list[int]] = {}
        for k, y in enumerate(b):
            by_label.setdefault(pivot.labels[y], []).append(k)
        if len(b) <= NARROW:
            row = row.tolist()
        for x in a:
            found = by_label.get(page.labels[x], ())
            each = [1] * len(found)
            if page.sizes[x] > 1:
                for n, k in enumerate(found):
                    w = known(x, b[k])
                    each[n] = (yield x, b[k]) if w is None else w
            if len(b) <= NARROW:
                new, at = row[:], 0
                for k, w in zip(found, each):
                    new[k + 1] = max(new[k + 1], row[k] + w)
                for at in range(1, len(new)):
                    if new[at] < new[at - 1]:
                        new[at] = new[at - 1]
                row = new
            else:
                best = row[1:].copy()
                if len(found):
                    at = np.array(found)
                    best[at] = np.maximum(best[at], row[at] + np.array(each, np.int64))
                row = np.concatenate([row[:1], np.maximum.accumulate(best)])
            yield row

    def passing(rows: Iterator, take: Callable) -> Iterator:
        """Pass on the pairs that ``rows`` needs, and give its rows to ``take``."""
        value = None
        while True:
            try:
                found = rows.send(value)
            except StopIteration:
                return
            value = None
            if type(found) is tuple:
                value = yield found
            else:
                take(found)

    def run(work: Iterator) -> None:
        stack, value = [work], None
        while stack:
            try:
                pair = stack[-1].send(value)
                stack.append(weigh(*pair))
                value = None
            except StopIteration as end:
                stack.pop()
                value = end.value

    def parts(a: list[int], b: list[int]) -> Iterator[tuple[int, list]]:
        """(number of the first row, rows) of the table in parts from its end, each but for its last row the
        beginning of the one before: of a wide table only the parts' first rows are held."""
        rows = [first_row(b)]
        if len(a) * len(b) <= WIDEST:
            run(passing(rows_of(a, b, rows[0]), rows.append))
            yield 0, rows
            return
        step = int(len(a) ** 0.5) + 1
        firsts, seen = rows, [0]

        def take(row) -> None:
            seen[0] += 1
            if seen[0] % step == 0:
                firsts.append(np.asarray(row))

        run(passing(rows_of(a, b, firsts[0]), take))
        for part in range(len(firsts) - 1, -1, -1):
            rows = [firsts[part]]
            run(passing(rows_of(a[part * step : (part + 1) * step], b, firsts[part]), rows.append))
            yield part * step, rows

    def same(i: int, j: int) -> None:
        for k in range(page.sizes[i]):
            mapped[i + k] = j + k

    while todo:
        i, j = todo.pop()
        mapped[i] = j
        a, b = page.children[i], pivot.children[j]
        head, tail = ends(a, b)
        for x, y in [*zip(a[:head], b[:head]), *zip(a[len(a) - tail :], b[len(b) - tail :])]:
            same(x, y)
        a, b = a[head : len(a) - tail], b[head : len(b) - tail]
        if not a or not b:
            continue
        x, y = len(a), len(b)
        for first, rows in parts(a, b):
            while x > first and y:
                if rows[x - first][y] == rows[x - 1 - first][y]:
                    x -= 1
                elif rows[x - first][y] == rows[x - first][y - 1]:
                    y -= 1
                else:
                    x, y = x - 1, y - 1
                    if page.shape[a[x]] == pivot.shape[b[y]]:
                        same(a[x], b[y])
                    else:
                        todo.append((a[x], b[y]))
    return mapped


_trees: dict[str, Tree] = {}


def _tree(text: str) -> Tree:
    """A pivot's tree from its written form; a worker keeps some thousand of them."""
    found = _trees.get(text)
    if found is None:
        if len(_trees) >= 2000:
            _trees.clear()
        found = _trees[text] = Tree(*json.loads(text))
    return found


def layout(page: Page) -> int:
    """A hash of the different labels, without digits, of the containers in the page's upper levels: alike
    for pages of one layout, whatever the number and kind of blocks of text in them."""
    seen = set()
    todo = [(0, 0)]
    while todo:
        node, level = todo.pop()
        i, last = node + 1, node + page.sizes[node]
        while i < last:
            tag = page.labels[i].partition(".")[0]
            if tag not in TEXTUAL and tag not in VOID:
                seen.add((level, re.sub(r"\d+", "", page.labels[i])))
                if level + 1 < LEVELS and tag not in ("article", "main"):
                    todo.append((i, level + 1))
            i += page.sizes[i]
    return zlib.crc32(repr(sorted(seen)).encode("utf-8", "surrogatepass"))


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [layout(Page(html.as_py() or "")) for html in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_host"), batch.column("page_id"), pa.array(found, pa.int64())], ["_host", "page_id", "layout"]
        )


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = []
        for html in batch.column("html"):
            page = Page(html.as_py() or "")
            trees.append(json.dumps([page.labels, page.sizes, page.said], separators=(",", ":")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_host"), batch.column("layout"), pa.array(trees, pa.string())], ["_host", "layout", "tree"]
        )


def fitted(page: Page, layouts: list[int], trees: list[str]) -> tuple[int, list[int]]:
    """(number of the page's pivot, alignment to it): the pivot of its layout, or else the one that most aligns."""
    tree = Tree(page.labels, page.sizes, page.said)
    if len(trees) > 1:
        own = layout(page)
        if own not in layouts:
            found = [align(tree, _tree(t)) for t in trees]
            best = max(range(len(trees)), key=lambda k: (sum(j >= 0 for j in found[k]), -k))
            return best, found[best]
        k = layouts.index(own)
    else:
        k = 0
    return k, align(tree, _tree(trees[k]))


_COUNTED = ("aligned", "equal", "chars", "linked", "heads", "every")
_STATS = pa.schema([("_host", pa.string()), ("pivot", pa.int32()), ("node", pa.int32()), *((c, pa.float64()) for c in _COUNTED)])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, int], list[list[float]]] = {}
    held = 0

    def rows() -> pa.RecordBatch:
        found = [(*h, n, *x) for h, nodes in counts.items() for n, x in enumerate(nodes) if any(x)]
        columns = zip(*found, strict=True) if found else [[]] * len(_STATS)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _STATS.types)], schema=_STATS)

    for batch in batches:
        for host, html, layouts, trees, copies in zip(
            *(batch.column(c) for c in ("_host", "html", "layouts", "trees", "copies")), strict=True
        ):
            weight = 1 / copies.as_py()
            page, trees = Page(html.as_py() or ""), trees.as_py()
            k, mapped = fitted(page, layouts.as_py(), trees)
            pivot = _tree(trees[k])
            key = host.as_py(), k
            nodes = counts.get(key)
            if nodes is None:
                nodes = counts[key] = [[0.0] * len(_COUNTED) for _ in pivot.labels]
                held += len(nodes)
            for i, j in enumerate(mapped):
                if j >= 0:
                    nodes[j][0] += weight
                    nodes[j][1] += weight * (page.said[i] == pivot.said[j])
            above = _aligned_above(page, mapped)
            for node, text, out, _, share in page.blocks:
                own, j = mapped[node], above[node]
                if not out:
                    nodes[j][5] += weight * len(text) * (1 - share)
                if not out and (own < 0 or page.said[node] != pivot.said[own]):  # it varies
                    nodes[j][2] += weight * len(text)
                    nodes[j][3] += weight * len(text) * share
                    nodes[j][4] += weight * (page.labels[node].partition(".")[0] in HEADINGS)
        if held > 200_000:
            yield rows()
            counts, held = {}, 0
    yield rows()


def _aligned_above(page: Page, mapped: list[int]) -> list[int]:
    """The pivot's node for each node of the page or, where there is none, for the nearest one that it is in."""
    above = mapped[:]
    inside: list[tuple[int, int]] = []
    for i, j in enumerate(mapped):
        while inside and inside[-1][0] <= i:
            inside.pop()
        if j < 0:
            above[i] = inside[-1][1]
        inside.append((i + page.sizes[i], above[i]))
    return above


def region(tree: Tree, counts: dict[int, dict[str, float]]) -> int:
    """The pivot's node that holds the content: from the root on, the child with most of the text that
    varies, links apart, if next to nothing of it stands beside the child, and no heading. 0: all of it, as
    well if most of the pages' text, that which doesn't vary included, would stand outside."""
    zero = dict.fromkeys(_COUNTED, 0.0)
    n = len(tree.labels)
    text, heads, every = [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        own = counts.get(i, zero)
        text[i] = own["chars"] - own["linked"] + sum(text[c] for c in tree.children[i])
        heads[i] = own["heads"] + sum(heads[c] for c in tree.children[i])
        every[i] = own["every"] + sum(every[c] for c in tree.children[i])
    at = 0
    while tree.children[at] and tree.labels[at].partition(".")[0] not in ("article", "main"):
        best = max(tree.children[at], key=lambda c: text[c])
        tag = tree.labels[best].partition(".")[0]
        enough = counts.get(best, zero)["aligned"] >= REGION_PAGES
        if not enough or tag in TEXTUAL or text[best] <= 0 or text[at] - text[best] > BESIDE * text[at] or heads[at] > heads[best]:
            break
        at = best
    return at if 2 * every[at] > every[0] else 0


def host_join(pages: DataFrame, hosts: DataFrame, total: int, how: str, size) -> DataFrame:
    """Join of pages, of which ``total`` have a host, with one row a host, with its number of pages as ``n``.
    Beyond what may be broadcast, only hosts with few of the pages are joined by a shuffle."""
    if fits(hosts, size):
        return pages.join(F.broadcast(hosts.drop("n")), "_host", how)
    return spread_join(pages, hosts, "_host", total, how, size)


def wrappers(pages: DataFrame) -> DataFrame:
    """(``_host``, ``n``, ``layouts``, ``trees``, ``s``): each host's pages and pivots and, by pivot and its node, on
    how many of the host's other pages a node was aligned to it, how many of those said the same, and the
    characters there that vary, those of them in links, the headings that do, and all characters outside of
    links. Pages of equal html count as one together.

    ``pages`` has ``_host``, ``page_id`` and ``html``. A pivot is the page of least id of a layout that
    gives enough pages for evidence, for the PIVOTS most frequent ones; a host without such a layout has its
    page of least id for all. Hosts of one page have no wrapper.
    """
    laid = pages.select("_host", "page_id", "html").mapInArrow(trimmed(_layouts), "_host string, page_id long, layout long")
    laid = scratch(laid.groupBy("_host", "layout").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n")), "layouts")
    several = laid.groupBy("_host").agg(F.sum("n").alias("n")).filter("n > 1")
    total = laid.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") > LEAST_PAGES
    order = Window.partitionBy("_host").orderBy(F.when(frequent, F.col("n")).otherwise(0).desc(), "page_id", "layout")
    hosts = laid.join(several.select("_host"), "_host", "left_semi").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PIVOTS)
    hosts = scratch(hosts.filter((F.col("rank") == 1) | frequent).select("_host", "page_id", "layout"), "hosts")
    chosen = small_join(pages, hosts, ["_host", "page_id"], "inner", F.octet_length("_host") + 48)
    pivots = chosen.select("_host", "layout", "html").mapInArrow(_pivots, "_host string, layout long, tree string")
    pivots = pivots.groupBy("_host", "layout").agg(F.min("tree").alias("tree"))
    pivots = pivots.groupBy("_host").agg(F.sort_array(F.collect_list(F.struct("layout", "tree"))).alias("p"))  # at most PIVOTS
    pivots = pivots.join(several, "_host").select("_host", "n", F.col("p.layout").alias("layouts"), F.col("p.tree").alias("trees"))
    pivots = scratch(pivots, "pivots")
    size = F.aggregate("trees", F.lit(0), lambda n, t: n + F.octet_length(t)) + F.octet_length("_host") + 128
    body = pages.withColumn("_body", F.md5("html"))
    copied = scratch(body.groupBy("_host", "_body").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "copied")
    others = small_join(body, copied, ["_host", "_body"], "left", F.octet_length("_host") + 64)
    others = host_join(others.withColumn("copies", F.coalesce("copies", F.lit(1))), pivots, total, "inner", size)
    counted = (
        others.select("_host", "html", "layouts", "trees", "copies")
        .mapInArrow(trimmed(_compare), ", ".join(["_host string, pivot int, node int", *(f"{c} double" for c in _COUNTED)]))
        .groupBy("_host", "pivot", "node")
        .agg(*(F.sum(c).alias(c) for c in _COUNTED))
        # a pivot itself was compared as well and equals itself
        .withColumns({c: F.greatest(F.round(F.col(c) - 1, 6), F.lit(0.0)) for c in ("aligned", "equal")})
        .groupBy("_host")
        .agg(F.sort_array(F.collect_list(F.struct("pivot", "node", *_COUNTED))).alias("s"))  # the pivots' nodes
    )
    return scratch(pivots.join(counted, "_host"), "wrappers")


def main_text(page: Page, mapped: list[int] | None, counts: dict[int, dict[str, float]], content: int = 0) -> str:
    """The text of the blocks that are content. content: the pivot's node that holds it."""
    kept = [b for b in page.blocks if not b[2] and (b[3] or not page.marked)]
    if mapped is not None and counts:
        if content and content in mapped:
            i = mapped.index(content)
            kept = [b for b in kept if i <= b[0] < i + page.sizes[i]] or kept
        # a node that the pivot lacks, or that no other page has, is no evidence
        none = {"aligned": 0, "equal": 0}
        found = [counts.get(mapped[b[0]], none) if mapped[b[0]] >= 0 else none for b in kept]
        seen = [(x["aligned"], x["equal"]) for x in found]
        if any(aligned and equal <= 0.5 * aligned for aligned, equal in seen):
            left = [b for b, (aligned, equal) in zip(kept, seen) if aligned < LEAST_PAGES or equal < CONSTANT * aligned]
            if sum(len(b[1]) for b in left) >= LEAST_SHARE * sum(len(b[1]) for b in kept):
                kept = left
    return "\n\n".join(b[1] for b in kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[list[int], list[str], list[dict], list[int]]] = {}
    for batch in batches:
        texts = []
        for host, html, layouts, trees, s in zip(*(batch.column(c) for c in ("_host", "html", "layouts", "trees", "s")), strict=True):
            page = Page(html.as_py() or "")
            mapped, counts, content = None, {}, 0
            if trees.is_valid:
                host = host.as_py()
                if host not in known:
                    if len(known) >= 500:
                        known.clear()
                    by_pivot: list[dict] = [{} for _ in trees]
                    for x in s.as_py():
                        by_pivot[x["pivot"]][x["node"]] = x
                    written = trees.as_py()
                    known[host] = layouts.as_py(), written, by_pivot, [region(_tree(t), c) for t, c in zip(written, by_pivot)]
                own, written, by_pivot, regions = known[host]
                k, mapped = fitted(page, own, written)
                counts, content = by_pivot[k], regions[k]
            texts.append(main_text(page, mapped, counts, content))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every row of ``pages``.

    Null or empty html has an empty text. Pages without a host (a null url, or none in it) or without an id
    are extracted without a wrapper, as are those of hosts with one page. Repeated rows are extracted
    each, null ids stay null, an empty table gives no rows, other columns are not used.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("_host"))
    wrapped = (F.col("_host") != "") & F.col("page_id").isNotNull()
    found = wrappers(rows.filter(wrapped).select("_host", "page_id", "html"))
    total = found.agg(F.sum("n")).first()[0] or 0
    trees = F.aggregate("trees", F.lit(0), lambda n, t: n + F.octet_length(t))
    size = trees + 64 * F.size("s") + F.octet_length("_host") + 128
    # a page without an id, or without a host, has a host that no wrapper is of
    joined = host_join(rows.withColumn("_host", F.when(wrapped, F.col("_host"))), found, total, "left", size)
    return joined.select("page_id", "url", "_host", "html", "layouts", "trees", "s").mapInArrow(
        trimmed(_extract), "page_id long, url string, text string, n_chars long"
    )


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages", even=True))
