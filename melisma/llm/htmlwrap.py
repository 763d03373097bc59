"""Main text of web pages by wrapper induction.

The DOM tree of every page of a host is aligned with that of one typical page by simple tree matching: of a few pages the one most like the others. What the aligned nodes hold
over all of the host's pages makes its wrapper: an element whose text is the same on nearly all of them is template; a slot that is mostly
links is a menu; and the content is what is left of the place where the varying prose is: from the root down, the element that holds
most of it, with the headings and paragraphs beside the way. An element that says itself that it is the article (or else the main
region) is taken at its word, and of its text the wrapper only removes whole constant boxes. Regions that tags, roles or the
class names of adverts, menus and reader comments mark as something else are no part of the trees.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import kernels as K
from .store import Scratch, tables

#: A text is template if at least CONSTANT of the pages that have its element have it too, and these are at least COMMON of the host's; an element is gone into if it holds MOST of the varying prose.
CONSTANT, COMMON, MOST = 0.9, 0.1, 0.6
#: Pages of a host of which the one most like the others is aligned with, and counts that a task holds.
SEEDS, HELD = 5, 200_000

# HTML's elements without an end tag, raw-text elements, and elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp", "noembed", "noframes")
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
BLOCK = CLOSES_P | frozenset("html body li dt dd tr td th thead tbody tfoot caption option summary".split())
DROPPED = frozenset("head nav aside footer form button select input textarea label fieldset option datalist script style noscript template iframe svg math canvas object embed audio video map dialog menu title xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tooltip".split())
# Whole class names (and ids) of what is no part of an article wherever it stands. Names that articles use for their own parts (social, top, header, hidden) are left to the wrapper.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense ad-banner ad-container ad-slot sponsor sponsored promo promoted nav navbar navigation menu menus main-menu main-nav site-nav breadcrumb breadcrumbs sidebar side-bar footer site-footer masthead "
    "comment comments comment-list commentlist comments-area disqus replies respond cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr notice notices newsletter popup modal share sharing sharebar share-buttons "
    "related related-posts pagination pager widget widgets toolbar".split()
)
IDS = frozenset("comments respond disqus_thread sidebar navigation navbar footer cookie-banner cookie-notice newsletter".split())
# Elements that may hold the content as a whole, those that stand in its flow, and those of which a run of siblings is one node of the tree.
SHELLS = frozenset("html body div section main article center table tbody tr td form".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
RUNS = frozenset("p li dt dd tr a b i em strong span small sub sup code u s font abbr cite q time".split())
LISTS = SHELLS | frozenset("ul ol dl menu p header".split())
BOXES = frozenset("div section ul ol dl table center figure blockquote header".split())

# Quotes count only where a value begins; elsewhere, and inside a value without them, they are characters like others. The loop never gives back what it took.
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=\s*[^\s>"'][^\s>]*|=)*+)>""", re.S)
#: A slash that ends a tag, and not a value.
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
# Every attribute is read, values included, so that a name is never found inside another one's value.
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
# Trees may be as deep as pages are; calls between Python functions take no room on the C stack.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 1 << 24))


class Node:
    """An element. parts: texts and child elements in order. named: it is dropped for its class or id only. form: it is dropped for being a form only. code: it stands in preformatted text or code, where names colour words."""

    __slots__ = ("article", "code", "drop", "form", "named", "parts", "tag")

    def __init__(self, tag: str, drop: bool = False, article: str = "", named: bool = False, form: bool = False) -> None:
        self.tag, self.drop, self.article, self.named, self.form, self.code, self.parts = tag, drop, article, named, form, tag in ("pre", "code", "samp", "kbd"), []


_seen_attrs: dict[tuple[str, str], tuple[bool, str, bool, bool]] = {}


def judged(tag: str, attrs: str) -> tuple[bool, str, bool, bool]:
    """Whether an element is dropped by what it says of itself, whether it says that it holds the article, whether only its class or id has it dropped, and whether only its being a form has."""
    if (got := _seen_attrs.get((tag, attrs))) is not None:
        return got
    a: dict[str, str] = {}
    for k, v in _ATTR.findall(attrs):
        a.setdefault(k.lower(), v.strip("\"'").lower())
    hidden = a.get("role") in ROLES or a.get("aria-hidden") == "true" or "hidden" in a or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")))
    form, drop = tag == "form" and not hidden, hidden or tag in DROPPED
    named = not drop and tag not in ("html", "body") and (not NAMES.isdisjoint(a.get("class", "").split()) or (tag not in FLOW and a.get("id", "").strip() in IDS))
    article = "article" if tag == "article" or a.get("itemprop") == "articlebody" else "main" if tag == "main" or a.get("role") == "main" else ""
    if len(_seen_attrs) < 50_000:
        _seen_attrs[tag, attrs] = drop or named, article, named, form
    return drop or named, article, named, form


def parse(page: str) -> Node:
    """A DOM tree. End tags that are missing are implied; end tags without a start are ignored."""
    root = Node("#root")
    stack, at, n = [root], 0, len(page)
    open_: dict[str, int] = {}  # elements of each tag in the stack

    def close(i: int) -> None:
        for x in stack[i:]:
            open_[x.tag] -= 1
        del stack[i:]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at, name = m.end(), m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            if not open_.get(tag):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("td", "th", "article", "main", "body") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "article", "main", "body", "html"):
                    break
            continue
        if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th"):
            ends, until = ("p",), ("td", "th", "article", "main", "body", "div", "section", "blockquote", "button")
            if tag in ("li", "dt", "dd"):
                ends, until = ("p", "li") if tag == "li" else ("p", "dt", "dd"), ("ul", "ol", "dl", "menu", "td", "th")
            elif tag in ("td", "th", "tr"):
                ends, until = ("p", "td", "th") + (("tr",) if tag == "tr" else ()), ("table",)
            for i in range(len(stack) - 1, 0, -1) if any(map(open_.get, ends)) else ():
                if stack[i].tag in ends:
                    if tag not in ("tr", "li", "dt", "dd") or stack[i].tag == tag or i == 1 or stack[i - 1].tag not in ends:
                        close(i)
                        break
                if stack[i].tag in until:
                    break
        node = Node(tag, *judged(tag, m[3] or ""))
        if stack[-1].code:
            node.code = True
            if node.named:
                node.drop = node.named = False
        stack[-1].parts.append(node)
        if tag in VOID or _CLOSED.search(m[3] or ""):
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        stack.append(node)
        open_[tag] = open_.get(tag, 0) + 1
    keep_forms(root)
    return root


def keep_forms(root: Node) -> None:
    """A form around an article, or around most of the page's text, is the page's frame and not something to fill in: it is no longer dropped."""
    order, stack, forms = [], [root], False
    while stack:
        x = stack.pop()
        forms = forms or x.form
        order.append(x)
        stack += [p for p in x.parts if not isinstance(p, str) and (not p.drop or p.form or p.named)]
    if not forms:
        return
    prose: dict[int, int] = {}
    holds: set[int] = set()
    for x in reversed(order):
        kids = [p for p in x.parts if not isinstance(p, str)]
        prose[id(x)] = sum(len(p.split()) for p in x.parts if isinstance(p, str)) + sum(prose.get(id(p), 0) for p in kids if not p.named)
        if any(p.article or id(p) in holds for p in kids if not p.drop or p.form or p.named):
            holds.add(id(x))
    for x in order:
        if x.form and (id(x) in holds or 2 * prose[id(x)] > prose[id(root)]):
            x.drop = False


def squash(text: str) -> str:
    return " ".join(html_lib.unescape(text).split())


class Outline:
    """A node of a page's tree: an element, or a run of siblings of one tag of RUNS. deep: the fixity (crc32) of each one's whole text, 0 for none; own: characters directly in it."""

    __slots__ = ("deep", "kids", "nodes", "number", "own", "shape", "size", "tag")

    def __init__(self, tag: str) -> None:
        self.tag, self.kids, self.nodes, self.deep, self.own, self.number, self.shape, self.size = tag, [], [], [], 0, -1, b"", 1


def outline(root: Node) -> list[Outline]:
    """The tree of a page without dropped elements, in pre-order; each node's number is its place."""
    top = Outline(root.tag)
    top.nodes = [root]
    _fill(top)
    out, stack = [], [top]
    while stack:
        x = stack.pop()
        x.number = len(out)
        out.append(x)
        stack.extend(reversed(x.kids))
    return out


def _fill(run: Outline) -> None:
    kids: list[Outline] = []
    parts: list[list] = []
    for node in run.nodes:
        inside: list = []
        for p in node.parts:
            if isinstance(p, str):
                if text := squash(p):
                    run.own += len(text)
                    inside.append(text)
            elif not p.drop and p.tag not in VOID:
                if not kids or kids[-1].tag != p.tag or p.tag not in RUNS:
                    kids.append(Outline(p.tag))
                kids[-1].nodes.append(p)
                inside.append((kids[-1], len(kids[-1].nodes) - 1))
        parts.append(inside)
    for k in kids:
        _fill(k)
        run.size += k.size
    for inside in parts:
        text = 0
        for p in inside:
            raw = p.encode("utf-8", "surrogatepass") if isinstance(p, str) else p[0].deep[p[1]].to_bytes(4, "little") if p[0].deep[p[1]] else b""
            text = zlib.crc32(raw, text) if raw else text
        run.deep.append(text)
    run.kids = kids
    # A digest, since a deep tree's shapes written out would hold each other.
    run.shape = hashlib.blake2b(run.tag.encode("utf-8", "surrogatepass") + b"(" + b"".join([k.shape for k in kids]) + b")", digest_size=16).digest()


def written(tree: list[Outline]) -> str:
    """A tree without its text, as JSON of flat lists."""
    return json.dumps([[x.tag for x in tree], [len(x.kids) for x in tree], [x.deep for x in tree]])


def built(tags: list[str], kids: list[int], deep: list[list[int]]) -> list[Outline]:
    tree = []
    for i, (tag, d) in enumerate(zip(tags, deep, strict=True)):
        x = Outline(tag)
        x.number, x.deep = i, d
        tree.append(x)
    for x, n in zip(reversed(tree), reversed(kids), strict=True):
        at = x.number + 1
        for _ in range(n):
            x.kids.append(tree[at])
            at += tree[at].size
        x.size = at - x.number
        x.shape = hashlib.blake2b(x.tag.encode("utf-8", "surrogatepass") + b"(" + b"".join([k.shape for k in x.kids]) + b")", digest_size=16).digest()
    return tree


class Matching:
    """Simple tree matching: the most nodes that two trees share in order, roots alike. Pairs of shapes that were met before need no new work; the table of two lists of children is filled a row at a time, so long lists cost numpy steps."""

    def __init__(self) -> None:
        self.known: dict[tuple[bytes, bytes], int] = {}

    def weight(self, a: Outline, b: Outline) -> int:
        if a.shape == b.shape:
            return a.size
        if a.tag != b.tag:
            return 0
        if not a.kids or not b.kids:
            return 1
        key = (a.shape, b.shape)
        if (got := self.known.get(key)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[key] = 1 + self.of_lists(a.kids, b.kids)[0]
        return got

    def of_lists(self, x: list[Outline], y: list[Outline], way: bool = False) -> tuple[int, list[tuple[Outline, Outline]]]:
        """The most nodes that two lists of trees share, and, if asked for, which trees go together. Trees of one shape at both beginnings, or at both ends, go together in some best matching."""
        total, pairs = 0, []
        a, b, m, n = 0, 0, len(x), len(y)
        while a < m and b < n and x[a].shape == y[b].shape:
            total += x[a].size
            pairs.append((x[a], y[b]))
            a, b = a + 1, b + 1
        while m > a and n > b and x[m - 1].shape == y[n - 1].shape:
            m, n = m - 1, n - 1
            total += x[m].size
            pairs.append((x[m], y[n]))
        x, y = x[a:m], y[b:n]
        if not x or not y:
            return total, pairs
        shapes: dict[bytes, int] = {}
        kind = np.array([shapes.setdefault(t.shape, len(shapes)) for t in y])
        some = [y[i] for i in np.unique(kind, return_index=True)[1].tolist()]
        rows: dict[bytes, np.ndarray] = {}
        best, up, left = np.zeros(len(y) + 1, np.int64), [], []
        for t in x:
            if t.shape not in rows:
                rows[t.shape] = np.array([self.weight(t, u) for u in some], np.int64)[kind]
            now = best.copy()
            np.maximum(now[1:], best[:-1] + rows[t.shape], out=now[1:])
            now = np.maximum.accumulate(now)
            if way:
                up.append(np.packbits(now == best))
                left.append(np.packbits(now[1:] == now[:-1]))
            best = now
        i, j = len(x), len(y)
        while way and i and j:
            if up[i - 1][j >> 3] >> (7 - (j & 7)) & 1:
                i -= 1
            elif left[i - 1][(j - 1) >> 3] >> (7 - ((j - 1) & 7)) & 1:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((x[i], y[j]))
        return total + int(best[-1]), pairs

    def pairs(self, a: Outline, b: Outline) -> list[tuple[int, int]]:
        """Numbers of nodes that go together."""
        out, stack = [], [(a, b)] if a.tag == b.tag else []
        while stack:
            a, b = stack.pop()
            if a.shape == b.shape:
                out += zip(range(a.number, a.number + a.size), range(b.number, b.number + b.size), strict=True)
            else:
                out.append((a.number, b.number))
                stack += self.of_lists(a.kids, b.kids, way=True)[1]
        return out


class Aligner:
    """Alignments with hosts' typical pages; pages of a shape seen before need no new matching."""

    def __init__(self) -> None:
        self.trees: dict[str, list[Outline]] = {}
        self.known: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
        self.matching = Matching()

    def seed(self, text: str) -> list[Outline]:
        if text not in self.trees:
            if len(self.trees) > 1000:
                self.trees.clear()
            self.trees[text] = built(*json.loads(text))
        return self.trees[text]

    def align(self, seed: list[Outline], page: list[Outline]) -> list[tuple[int, int]]:
        key = (seed[0].shape, page[0].shape)
        if (got := self.known.get(key)) is None:
            got = self.matching.pairs(seed[0], page[0])
            if len(self.known) < 5000:
                self.known[key] = got
        return got


def most_typical(trees: list[list[Outline]]) -> list[Outline]:
    """The tree that shares most of its nodes with the others; the first of equals. A page of another make, an error page say, is like none of them."""
    if len(trees) < 3:
        return trees[0]
    matching = Matching()
    like = [sum(2 * matching.weight(a[0], b[0]) / (a[0].size + b[0].size) for b in trees) for a in trees]
    return trees[max(range(len(trees)), key=lambda i: (round(like[i], 9), -i))]


@K.tidy
def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (host, some of its pages): the tree of the most typical one, without its text."""
    for batch in batches:
        chosen = []
        for pages in batch.column(1).to_pylist():
            trees = []
            for page in dict.fromkeys(p or "" for p in pages):
                root = parse(page)
                article_of(root)
                trees.append(outline(root))
            chosen.append(written(most_typical(trees)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen, pa.string())], names=["_host", "_seed"])


STAT = "node int, part int, n long, chars long, links long"


@K.tidy
def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (host, html, seed): for each node of the seed how many pages have it, with how many characters and links (part -1), and for each of its texts how many of these have that one too. Node -1 counts the pages. A copy of the seed says nothing of what is constant."""
    aligner, totals, held = Aligner(), {}, 0

    def told() -> Iterator[pa.RecordBatch]:
        rows = [(h, *k, *v) for h, found in totals.items() for k, v in found.items()]
        for a in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 10_000], strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["host", "node", "part", "n", "chars", "links"])

    for batch in batches:
        for host, page, first in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            seed = aligner.seed(first)
            root = parse(page.as_py() or "")
            article_of(root)
            tree = outline(root)
            if tree[0].deep == seed[0].deep:
                continue
            found = totals.setdefault(host, {})
            before = len(found)
            found[-1, -1] = (found.get((-1, -1), (0, 0, 0))[0] + 1, 0, 0)
            for i, j in aligner.align(seed, tree):
                x, y = seed[i], tree[j]
                n, chars, links = found.get((i, -1), (0, 0, 0))
                found[i, -1] = (n + 1, chars + y.own, links + (len(y.deep) if y.tag == "a" else 0))
                there = set(y.deep)
                for k, d in enumerate(x.deep):
                    if d and d in there:
                        found[i, k] = (found.get((i, k), (0, 0, 0))[0] + 1, 0, 0)
            held += len(found) - before
            if held >= HELD:  # sums are added up afterwards
                yield from told()
                totals.clear()
                held = 0
    yield from told()


class Wrapper:
    """What is learnt of a host (or, without stats, of a page by itself): the texts of each node that are template, the nodes that are menus, and those that hold the content."""

    def __init__(self, tree: list[Outline], stats: list[tuple[int, int, int, int, int]] | None = None) -> None:
        here = {(i, k): (n, c, a) for i, k, n, c, a in stats} if stats else {(x.number, -1): (1, x.own, len(x.deep) if x.tag == "a" else 0) for x in tree}
        pages = here.get((-1, -1), (1, 0, 0))[0]
        self.tree, self.template, self.menus = tree, {}, set()
        for (i, k), (n, _, _) in here.items():
            if i >= 0 <= k and n >= CONSTANT * here[i, -1][0] and here[i, -1][0] >= COMMON * pages:
                self.template.setdefault(i, set()).add(tree[i].deep[k])
        size = len(tree)
        chars, linked, links, prose = [0.0] * size, [0.0] * size, [0.0] * size, [0.0] * size
        for x in reversed(tree):
            i = x.number
            n, own, a = here.get((i, -1), (0, 0, 0))
            texts = {d for d in x.deep if d}
            constant = len(texts & self.template.get(i, set())) / max(len(texts), 1)
            chars[i] = own + sum(chars[k.number] for k in x.kids)
            linked[i] = chars[i] if x.tag == "a" else sum(linked[k.number] for k in x.kids)
            links[i] = a + sum(links[k.number] for k in x.kids)
            prose[i] = 0.0 if x.tag == "a" or (texts and constant == 1) else own * (1 - constant) + sum(prose[k.number] for k in x.kids)
            if x.tag in LISTS and 2 * linked[i] > chars[i] and links[i] >= 2 * max(n, 1):
                self.menus.add(i)
                prose[i] = 0.0
        self.varied = {i for i, p in enumerate(prose) if p}
        x, self.content = tree[0], []
        while x.kids and prose[x.number]:
            k = max(x.kids, key=lambda k: prose[k.number])
            if k.tag not in SHELLS or prose[k.number] < MOST * prose[x.number]:
                break
            self.content += [s.number for s in x.kids if s is not k and s.tag in FLOW and prose[s.number]]
            x = k
        self.content = sorted([*self.content, x.number])
        self.core = x.number
        self.boxes = {i: d for i, d in self.template.items() if tree[i].tag in BOXES}

    def written(self) -> str:
        """As JSON, with no more of the seed than its shape."""
        tree = [[x.tag for x in self.tree], [len(x.kids) for x in self.tree], [[]] * len(self.tree)]
        return json.dumps([tree, [[i, sorted(d)] for i, d in sorted(self.template.items())], sorted(self.menus), sorted(self.varied), self.content, self.core])

    @classmethod
    def read(cls, text: str) -> Wrapper:
        out = cls.__new__(cls)
        tree, template, menus, varied, out.content, out.core = json.loads(text)
        out.tree, out.menus, out.varied = built(*tree), set(menus), set(varied)
        out.template = {i: set(d) for i, d in template}
        out.boxes = {i: d for i, d in out.template.items() if out.tree[i].tag in BOXES}
        return out


@K.tidy
def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (host, seed, stats): the host's wrapper."""
    for batch in batches:
        made = [Wrapper(built(*json.loads(seed)), [tuple(r.values()) for r in stats.as_py()]).written() for seed, stats in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["host", "_wrapper"])


def regions_of(root: Node, kind: str, named: bool = False) -> list[list[Node]]:
    """The outermost elements of a kind outside dropped regions, or also in those that only a class or id has dropped; each as its way from the root."""
    out, stack = [], [(root, None)]
    while stack:
        x, way = stack.pop()
        if x.drop and not (named and x.named):
            continue
        way = (x, way)
        if x.article == kind:
            nodes = []
            while way:
                nodes.append(way[0])
                way = way[1]
            out.append(nodes[::-1])
        else:
            stack.extend((p, way) for p in reversed(x.parts) if not isinstance(p, str))
    return out


def article_of(root: Node) -> list[Node]:
    """The outermost article elements outside dropped regions, else the main region, else the root.

    A class or id has no region dropped that holds the page's only article or main region. Of several articles that are all dropped so (comments,
    teasers or a list of posts) a main region outside goes first; without one the root is taken with them in it.
    """
    if found := regions_of(root, "article"):
        return [w[-1] for w in found]
    dropped = regions_of(root, "article", named=True)
    if len(dropped) == 1:
        return [dropped[0][-1]]
    if found := regions_of(root, "main") or regions_of(root, "main", named=True):
        return [w[-1] for w in found]
    for way in dropped:
        for x in way:
            x.drop = False
    return [root]


def text_of(page: str, wrapper: Wrapper | None = None, aligner: Aligner | None = None) -> str:
    root = parse(page)
    regions = article_of(root)
    marked, found = regions != [root], False
    silent: set[int] = set()
    if wrapper is not None and aligner is not None and (wrapper.boxes or not marked):
        tree = outline(root)
        there = dict(aligner.align(wrapper.tree, tree))
        # A marked article keeps its flow; only whole boxes that are constant go, and none if the host's articles do not vary.
        whole = {id(r) for r in regions}
        if not marked or any(i in wrapper.varied and any(id(x) in whole for x in tree[j].nodes) for i, j in there.items()):
            for i, texts in (wrapper.boxes if marked else wrapper.template).items():
                if i and i in there:
                    y = tree[there[i]]
                    silent.update(id(x) for x, d in zip(y.nodes, y.deep, strict=True) if d in texts)
        if not marked:
            silent.update(id(x) for i in wrapper.menus if i in there for x in tree[there[i]].nodes)
            if found := wrapper.core in there:
                regions = [x for i in wrapper.content if i in there for x in tree[there[i]].nodes]
    if not marked and not found:
        alone = Wrapper(outline(root))
        silent.update(id(x) for i in alone.menus for x in alone.tree[i].nodes)
        regions = [x for i in alone.content for x in alone.tree[i].nodes]
    blocks: list[str] = []
    own: list[str] = []

    def flush() -> None:
        if text := squash("".join(own)):
            blocks.append(text)
        own.clear()

    def walk(node: Node, in_article: bool) -> None:
        for p in node.parts:
            if isinstance(p, str):
                own.append(p)
            elif p.tag in ("br", "hr", "wbr"):
                own.append(" " if p.tag != "wbr" else "")
                if p.tag == "hr":
                    flush()
            elif p.drop or id(p) in silent or (p.tag == "header" and not in_article):
                if p.tag in BLOCK:
                    flush()
            elif p.tag in BLOCK:
                flush()
                walk(p, in_article)
                flush()
            else:
                walk(p, in_article)

    for r in regions:
        if id(r) not in silent:
            walk(r, r.article != "")
            flush()
    return "\n".join(blocks)


@K.tidy
def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (row, html, wrapper): the row, its text and its code points."""
    aligner, wrappers = Aligner(), {}
    for batch in batches:
        texts = []
        for page, written_ in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            if written_ is not None and written_ not in wrappers:
                if len(wrappers) > 1000:
                    wrappers.clear()
                wrappers[written_] = Wrapper.read(written_)
            texts.append(text_of(page.as_py() or "", wrappers.get(written_), aligner))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])


def main_text(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, text and n_chars (code points) of every row.

    A null or empty page has an empty text; a null url is a host of its own. A page whose host has no other page, or only copies of it, has nothing to be
    aligned with and is judged by its own tree. Repeated pages count as pages. Empty tables give no rows. Other columns play no part, whatever their names. A host's
    wrapper is as large as its typical page's tree; it goes to pages by a join on the host, which Spark broadcasts while it is small and splits where a host is hot.
    """
    scratch = Scratch(df.sparkSession, "wrapper")
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit(""))
    pages = df.select(F.struct(F.col(id_col), F.col(url_col)).alias("row"), host.alias("_host"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    first = lambda k: F.struct((F.length("_html") == 0).alias("e"), F.xxhash64(F.lit(k), F.col(f"row.`{id_col}`")).alias("h"), F.crc32(F.col("_html").cast("binary")).alias("c"))
    # A few pages a host, however many it has: min_by is combined before the shuffle.
    seeds = scratch.write(pages.groupBy("_host").agg(F.array(*(F.min_by("_html", first(k)) for k in range(SEEDS))).alias("_some")).mapInArrow(outlines, "_host string, _seed string"), "seeds")
    found = pages.select("_host", "_html").join(seeds, "_host").select("_host", "_html", "_seed").mapInArrow(tally, f"host string, {STAT}")
    found = found.groupBy("host", "node", "part").agg(*(F.sum(c).alias(c) for c in ("n", "chars", "links")))
    stats = found.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "part", "n", "chars", "links"))).alias("_stats"))
    learnt = seeds.join(stats, seeds["_host"] == stats["host"]).select("_host", "_seed", "_stats").mapInArrow(learn, "host string, _wrapper string")
    wrappers = scratch.write(learnt, "wrappers")
    joined = pages.join(wrappers, pages["_host"] == wrappers["host"], "left").select("row", "_html", "_wrapper")
    done = joined.mapInArrow(extract, StructType([pages.schema["row"], StructField("text", StringType()), StructField("n_chars", LongType())]))
    return done.select(f"row.`{id_col}`", f"row.`{url_col}`", "text", "n_chars")


def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(tables(spark, sf_dir, "pages"), "page_id", "url", "html")
