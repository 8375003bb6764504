"""Main text of web pages by wrapper induction.

Pages of a host are aligned with one reference page of that host by simple tree matching over their container
nodes. Aligned nodes vote: for each node of the reference the text it holds, its share of links and how often its
text repeats are summed over all pages of the host. Nodes with constant text, and those that hold mostly links, are
the template; the varying node with the most running text is the host's content slot. Each page gives the text of the
node that is aligned with the slot, without the template. Names of elements and classes are a prior that the votes
outweigh, but for adverts and reader comments, which vary as articles do. A page that has no node at the slot, or a
host of one page, is judged by its own votes, in which names weigh more.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import map_rows
from pagewright.session import stored

#: Fixed sets of HTML element names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe xmp svg math select".split())
#: Raw elements whose content is markup, so that one may hold another of its name.
NESTED = {"svg", "math", "select", "template", "noscript"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = set("html body main article section div header footer nav aside form center table td dialog details fieldset menu".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "summary", "html", "body"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements and roles that never hold an article's text.
CLUTTER = set("nav footer aside form button dialog menu fieldset".split())
CLUTTER_ROLES = set("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
#: Words of class and id values that name such parts.
CLUTTER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer cookie cookies consent notice gdpr popup modal overlay comment comments disqus respond reply replies share sharing "
    "social related recommended newsletter subscribe signup login search pagination pager widget toolbar masthead skip".split()
)
#: Of these, the names of parts that vary from page to page as articles do: votes cannot tell them from content.
VARYING_CLUTTER = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo comment comments disqus respond reply replies newsletter subscribe".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
HEADER_WORDS = {"header", "topbar", "masthead"}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|</?[a-zA-Z][^\s/>]*+(?:"[^"]*+"|'[^']*+'|[^'">])*+>|[^<]++|<""", re.S)
ATTR = re.compile(r"""\b(class|id|role|hidden|href)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
#: How much a node counts as content if it is judged alone.
ARTICLE_WEIGHT, CLUTTER_WEIGHT = 50.0, 0.001
#: How much names and constant text count in the votes of a host.
ARTICLE_PRIOR, CLUTTER_PRIOR, CONSTANT_WEIGHT = 2.0, 0.5, 0.02
#: A form with more plain text than this, and most of the page's, stands around the page and is no clutter.
PAGE_FORM = 200


class Node:
    __slots__ = ("tag", "words", "clutter", "sure", "kids", "link")

    def __init__(self, tag: str, words: tuple[str, ...] = (), clutter: bool = False, sure: bool = False):
        self.tag, self.words, self.clutter, self.sure, self.kids, self.link = tag, words, clutter, sure, [], tag == "a"


def _node(tag: str, raw: str) -> Node:
    if raw.find("=") < 0 and "hidden" not in raw:
        return Node(tag, (), tag in CLUTTER)
    words, clutter, sure = [], tag in CLUTTER, False
    for m in ATTR.finditer(raw):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            words += re.findall(r"[a-z]+", value)
        elif name == "role":
            clutter = clutter or value in CLUTTER_ROLES
        elif name == "hidden":
            clutter = sure = True
    if tag in BLOCK and tag not in HEADINGS and tag not in ("html", "body", "article", "main"):
        clutter = clutter or not CLUTTER_WORDS.isdisjoint(words)
        sure = sure or not VARYING_CLUTTER.isdisjoint(words)
    return Node(tag, tuple(words), clutter, sure)


class TagEnds:
    """Where a tag ends, for any place inside it and outside quotes: after the next > that no quoted value holds.

    One pass from the page's end over its quotes and > finds all ends, so that markup without an end is read once.
    """

    def __init__(self, page: str):
        self.places = [m.start() for m in re.finditer("""['">]""", page)]
        self.ends = [-1] * (len(self.places) + 1)
        later = {'"': -1, "'": -1}
        for k in range(len(self.places) - 1, -1, -1):
            char = page[self.places[k]]
            if char == ">":
                self.ends[k] = self.places[k] + 1
            else:
                self.ends[k] = self.ends[later[char] + 1] if later[char] >= 0 else -1
                later[char] = k
        self.delimiters = [m.start() for m in re.finditer(r"[\s/>]", page)]

    def after(self, at: int) -> int:
        """The end of the tag that `at` is in, -1 without one."""
        return self.ends[bisect_left(self.places, at)]

    def of_tag(self, name_at: int) -> int:
        """The end of the tag whose name starts at name_at; the name goes to the next white space, slash or >."""
        k = bisect_left(self.delimiters, name_at)
        return self.after(self.delimiters[k]) if k < len(self.delimiters) else -1


def _raw_ends(page: str, name: str, tags: TagEnds) -> dict[int, int]:
    """Where each raw element of a name ends, by the place of its start; those without an end are missing."""
    out: dict[int, int] = {}
    starts: list[int] = []
    done = 0
    for m in re.finditer(rf"<(/?){name}(?=[\s/>])", page, re.I):
        end = tags.after(m.end())
        if m.start() < done or end < 0:
            continue
        done = end
        if not m[1]:
            if name not in ("svg", "math") or page[end - 2] != "/":
                starts.append(m.start())
        elif name in NESTED:
            if starts:
                out[starts.pop()] = end
        else:
            out |= dict.fromkeys(starts, end)
            starts.clear()
    return out


#: Elements that are asked for as one kind: those that an open p does not reach out of, and raw ones without blocks.
KINDS = dict.fromkeys(CONTAINER | {"li", "td", "th"}, "P-SCOPE") | dict.fromkeys(RAW - {"template", "noscript"}, "RAW")


class OpenNodes:
    """The path of open elements, with the depths at which each name is open; closing costs what was opened."""

    def __init__(self, root: Node):
        self.stack, self.depths = [root], {}

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in KINDS:
            self.depths.setdefault(KINDS[node.tag], []).append(len(self.stack))
        self.stack.append(node)

    def close_from(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.depths[tag].pop()
            if tag in KINDS:
                self.depths[KINDS[tag]].pop()

    def last(self, *kinds: str) -> int:
        """The greatest depth of an open element of these names or kinds, 0 without one."""
        return max(d[-1] if (d := self.depths.get(k)) else 0 for k in kinds)

    def first(self, kind: str) -> int:
        return self.depths[kind][0] if self.depths.get(kind) else 0

    def close(self, kinds: set[str], scope: set[str]) -> None:
        """Close the last open element of these names, unless one of the scope is open inside it."""
        depth = self.last(*kinds)
        if depth and depth >= self.last(*scope):
            self.close_from(depth)


def parse(page: str) -> Node:
    """A forgiving tree: implied ends of p, li, td and the like; stray ends are ignored; raw elements are dropped.

    A raw element without an end (other than script and style) ends with its parent or before the next block; template
    and noscript, which hold blocks, end with their parent or, at the top of the page, at once. Tags that never end are
    text; time is linear in the page, whatever is left open.
    """
    root = Node("html")
    path = OpenNodes(root)
    at, n = 0, len(page)
    tags: TagEnds | None = None
    broken = False
    ends: dict[str, dict[int, int]] = {}
    last_end = page.rfind(">")

    def ends_somewhere(at: int) -> bool:
        """Asked once a tag had no end: whether a search for this token's end can be spared."""
        if page[at] != "<" or page.startswith(("<!--", "<![CDATA["), at):
            return True
        name_at = at + 2 if page.startswith("</", at) else at + 1
        return at < last_end and (page[at + 1] in "!?" or tags.of_tag(name_at) >= 0)

    while at < n:
        m = TOKEN.match(page, at) if not broken or ends_somewhere(at) else None
        token = m[0] if m else "<"
        at += len(token)
        if token[0] != "<":
            path.stack[-1].kids.append(token)
            continue
        if token == "<":
            broken, tags = True, tags or TagEnds(page)
            path.stack[-1].kids.append(token)
            continue
        if token[1] in "!?":
            continue
        end = token[1] == "/"
        name = re.match(r"</?([a-zA-Z][^\s/>]*)", token)[1].lower()
        if end:
            depth = path.last(name)
            if depth:
                path.close_from(depth)
            continue
        if name in RAW:
            if name not in ends:
                tags = tags or TagEnds(page)
                ends[name] = _raw_ends(page, name, tags)
            if name in ("svg", "math") and token.endswith("/>"):
                continue
            close = ends[name].get(m.start())
            if close is not None or name in ("script", "style"):
                at = n if close is None else close
            elif not (name in ("template", "noscript") and len(path.stack) == 1):
                path.push(Node(name))
            continue
        if name in ("html", "body", "head"):
            continue
        if name in BLOCK and name not in ("option", "legend") and path.first("RAW"):
            path.close_from(path.first("RAW"))
        if name in CLOSES_P:
            path.close({"p"}, {"P-SCOPE"})
        if name in SIBLINGS:
            path.close(SIBLINGS[name], SCOPES[name])
        node = _node(name, token[len(name) + 1 : -1])
        path.stack[-1].kids.append(node)
        if name not in VOID and not token.endswith("/>"):
            path.push(node)
    return root


def _below(node: Node) -> list[Node]:
    """The containers below a node that no other container below it holds, in page order."""
    out, todo = [], node.kids[::-1]
    while todo:
        k = todo.pop()
        if isinstance(k, Node):
            if k.tag in CONTAINER:
                out.append(k)
            else:
                todo += k.kids[::-1]
    return out


def _label(node: Node) -> str:
    return " ".join((node.tag, *node.words))


def outline(node: Node) -> list:
    """The containers below a node, nested: [label, children]. Labels hold the tag and the class and id words."""
    tree: list = [_label(node), []]
    todo = [(node, tree)]
    while todo:
        n, t = todo.pop()
        if n.tag not in ("nav", "menu"):
            for k in _below(n):
                t[1].append([_label(k), []])
                todo.append((k, t[1][-1]))
    return tree


def containers(root: Node) -> list[Node]:
    """The nodes of outline(), in its order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        if n.tag not in ("nav", "menu"):
            todo += _below(n)[::-1]
    return out


def _in_order(tree: list) -> list[list]:
    out, todo = [], [tree]
    while todo:
        out.append(todo.pop())
        todo += out[-1][1][::-1]
    return out


def written(tree: list) -> str:
    """An outline of any depth as flat JSON: label and number of children of each node, in order."""
    return json.dumps([[label, len(kids)] for label, kids in _in_order(tree)])


def read(text: str) -> list:
    """The outline that written() wrote."""
    top: list = ["", []]
    todo = [(top, 1)]
    for label, n in json.loads(text):
        while not todo[-1][1]:
            todo.pop()
        parent, left = todo[-1]
        todo[-1] = parent, left - 1
        parent[1].append([label, []])
        todo.append((parent[1][-1], n))
    return top[1][0]


class Shapes:
    """Outlines as numbers: subtrees of equal labels in equal places share one, whichever tree they are in."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.label: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        #: Whether no child has children.
        self.flat: list[bool] = []
        #: A shape's place among those of its label.
        self.place: list[int] = []
        self.of_label: Counter = Counter()

    def add(self, tree: list) -> dict[int, int]:
        """The shape of each node, by id."""
        out: dict[int, int] = {}
        for n in reversed(_in_order(tree)):
            kids = tuple([out[id(k)] for k in n[1]])
            shape = self.number.setdefault((n[0], kids), len(self.label))
            if shape == len(self.label):
                self.label.append(n[0])
                self.kids.append(kids)
                self.size.append(1 + sum([self.size[k] for k in kids]))
                self.flat.append(not any(self.kids[k] for k in kids))
                self.place.append(self.of_label[n[0]])
                self.of_label[n[0]] += 1
            out[id(n)] = shape
        return out


class Matcher:
    """Numbers of node pairs that simple tree matching finds for two shapes, each two compared once.

    Equal shapes match whole, and so do equal children at both ends of two lists; only what differs in between is
    compared, in time in proportion to the product of the sizes at most.
    """

    def __init__(self, shapes: Shapes):
        self.shapes = shapes
        self.found: dict[int, array] = {}

    def known(self, p: int, q: int) -> int:
        """The number for two shapes, -1 if it is not found yet."""
        s = self.shapes
        if p == q:
            return s.size[p]
        if s.label[p] != s.label[q]:
            return 0
        if not s.kids[p] or not s.kids[q]:
            return 1
        row = self.found.get(p)
        return row[s.place[q]] if row else -1

    def weight(self, p: int, q: int) -> int:
        todo = [(p, q, self._open(p, q))] if self.known(p, q) < 0 else []
        while todo:
            below = next(todo[-1][2], None)
            if below:
                todo.append((*below, self._open(*below)))
            else:
                self._find(*todo.pop()[:2])
        return self.known(p, q)

    def _open(self, p: int, q: int) -> Iterator[tuple[int, int]]:
        """Pairs of shapes that have to be found before p and q; flat ones are found on the way."""
        s = self.shapes
        x, y, *_ = self._between(p, q)
        of_label: dict[str, list[int]] = {}
        for j in dict.fromkeys(y):
            if s.kids[j]:
                of_label.setdefault(s.label[j], []).append(j)
        for i in dict.fromkeys(x):
            alike = of_label.get(s.label[i]) if s.kids[i] else None
            row = self._row(i) if alike else ()
            for j in alike or ():
                if row[s.place[j]] < 0 and i != j:
                    if s.flat[i] or s.flat[j]:
                        self._find(i, j)
                    else:
                        yield i, j

    def _row(self, p: int) -> array:
        """What is found for p, by the place of the other shape."""
        row = self.found.get(p)
        if row is None:
            row = self.found[p] = array("i", [-1]) * self.shapes.of_label[self.shapes.label[p]]
        return row

    def _between(self, p: int, q: int) -> tuple[tuple, tuple, int, int]:
        """The children of both without the equal ones at both ends, and how many those are at the start and the end."""
        x, y = self.shapes.kids[p], self.shapes.kids[q]
        start, most = 0, min(len(x), len(y))
        while start < most and x[start] == y[start]:
            start += 1
        end, most = 0, most - start
        while end < most and x[-1 - end] == y[-1 - end]:
            end += 1
        return x[start : len(x) - end], y[start : len(y) - end], start, end

    def _find(self, p: int, q: int) -> None:
        s = self.shapes
        x, y, start, end = self._between(p, q)
        if min(len(x), len(y)) < 2:
            most = 0
            for i in x:
                for j in y:
                    most = max(most, self.known(i, j)) if s.label[i] == s.label[j] else most
        else:
            best, rows = np.zeros(len(y) + 1, np.int64), self._rows(x, y)
            for i in x:
                best = _next_best(best, rows[i])
            most = int(best[-1])
        kids = s.kids[p]
        for k in kids[:start] + kids[len(kids) - end :]:
            most += s.size[k]
        self._row(p)[s.place[q]] = 1 + most

    def _rows(self, x: tuple, y: tuple) -> dict[int, np.ndarray | None]:
        """For each shape of x its numbers with all of y; none if it matches nothing."""
        label = self.shapes.label
        of_label: dict[str, dict[int, list[int]]] = {}
        for j, k in enumerate(y):
            of_label.setdefault(label[k], {}).setdefault(k, []).append(j)
        out: dict[int, np.ndarray | None] = {}
        for i in dict.fromkeys(x):
            alike = of_label.get(label[i])
            out[i] = np.zeros(len(y), np.int32) if alike else None
            for k, places in alike.items() if alike else ():
                out[i][places] = self.known(i, k)
        return out

    def children(self, p: int, q: int) -> list[tuple[int, int]]:
        """Places of the children that are paired: equal ones at both ends with each other; in between, of the best
        choices, the one with the first children of p, then of q.

        Every so many rows of best sums are kept and the others made again, so that memory stays below the product.
        """
        x, y, start, end = self._between(p, q)
        n, m = len(x), len(y)
        rows = self._rows(x, y)
        step = isqrt(n) + 1
        best = np.zeros(m + 1, np.int64)
        kept = [best]
        for i, k in enumerate(x, 1):
            best = _next_best(best, rows[k])
            if i % step == 0:
                kept.append(best)
        pairs, j = [], m
        for first in range(n // step * step, -1, -step):
            part = [kept[first // step]]
            for k in x[first : first + step]:
                part.append(_next_best(part[-1], rows[k]))
            for i in range(len(part) - 1, 0, -1):
                if part[i][j] > part[i - 1][j]:
                    j = int(np.searchsorted(part[i], part[i][j])) - 1
                    pairs.append((start + first + i - 1, start + j))
        return [(i, i) for i in range(start)] + pairs[::-1] + [(start + n + i, start + m + i) for i in range(end)]


def _next_best(best: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
    """Best sums over the first children of the other tree, once one more child may be paired with one of them."""
    if weights is None:
        return best
    out = best.copy()
    np.maximum(best[1:], best[:-1] + weights, out=out[1:])
    return np.maximum.accumulate(out, out=out)


def match(a: list, b: list) -> tuple[int, list[tuple[list, list]]]:
    """Simple tree matching: the largest number of node pairs that keep parents and order, and such pairs. Roots with
    different labels don't match. One rule holds for trees of all sizes."""
    shapes = Shapes()
    of = shapes.add(a) | shapes.add(b)
    matcher = Matcher(shapes)
    n = matcher.weight(of[id(a)], of[id(b)])
    pairs, todo = [], [(a, b)] if n else []
    while todo:
        p, q = todo.pop()
        pairs.append((p, q))
        below = matcher.children(of[id(p)], of[id(q)]) if p[1] and q[1] else ()
        todo += [(p[1][i], q[1][j]) for i, j in reversed(below)]
    return n, pairs


def align(page: list, reference: list) -> dict[int, int]:
    """Numbers of the page's nodes (in order) to those of the reference that they match."""
    number = {id(t): i for tree in (page, reference) for i, t in enumerate(_in_order(tree))}
    return {number[id(p)]: number[id(q)] for p, q in match(page, reference)[1]}


def own_text(node: Node) -> tuple[int, int, int]:
    """Characters outside and inside links, and a hash, of the text that is in no container below."""
    plain = linked = 0
    digest = xxhash.xxh64()

    todo = [(k, False) for k in reversed(node.kids)]
    while todo:
        k, link = todo.pop()
        if isinstance(k, str):
            size = len(k.strip())
            digest.update(k.encode("utf-8", "surrogatepass"))
            if link:
                linked += size
            else:
                plain += size
        elif k.tag not in CONTAINER:
            todo += [(below, link or k.link) for below in reversed(k.kids)]
    return plain, linked, digest.intdigest() - 2**63


def weights(nodes: list[Node], root: Node, article: float = ARTICLE_WEIGHT, clutter: float = CLUTTER_WEIGHT) -> list[float]:
    """How much each container counts by its place: inside an article more, inside clutter less."""
    page_forms = _page_forms(nodes)
    out: dict[int, float] = {}
    todo = [(root, 1.0, False)]
    while todo:
        n, w, inside = todo.pop()
        inside = inside or n.tag in ("article", "main")
        if _is_clutter(n, inside) and id(n) not in page_forms:
            w *= clutter
        if n.tag in ("article", "main"):
            w *= article
        out[id(n)] = w
        todo += [(k, w, inside) for k in n.kids if isinstance(k, Node)]
    return [out[id(n)] for n in nodes]


def _page_forms(nodes: list[Node]) -> set[int]:
    """Forms that hold most of the page's plain text."""
    if not any(n.tag == "form" for n in nodes):
        return set()
    plain = {id(n): own_text(n)[0] for n in nodes}
    most = max(PAGE_FORM, sum(plain.values()) / 2)
    below = dict(plain)  # in order of containers(): each node's children come after it
    for n in reversed(nodes):
        if n.tag not in ("nav", "menu"):
            below[id(n)] += sum(below[id(k)] for k in _below(n))
    return {id(n) for n in nodes if n.tag == "form" and below[id(n)] > most}


def _is_clutter(n: Node, in_article: bool) -> bool:
    return n.clutter or not in_article and (n.tag == "header" or n.tag in BLOCK and n.tag not in HEADINGS and not HEADER_WORDS.isdisjoint(n.words))


def _article_of(nodes: list[Node], root: Node, at: int, template: set[int]) -> Node:
    """The outermost article or else main element around a container; without one, the container or the least one
    around it whose other parts read like it: they are neither clutter nor template and have running text."""
    above: dict[int, Node] = {}
    todo = [root]
    while todo:
        n = todo.pop()
        below = [k for k in n.kids if isinstance(k, Node)]
        above |= dict.fromkeys(map(id, below), n)
        todo += below
    path = [nodes[at]]
    while path[-1] is not root:
        path.append(above[id(path[-1])])
    path.reverse()
    articles = [n for n in path if n.tag == "article"] or [n for n in path if n.tag == "main"]
    if articles:
        return articles[0]
    path = [n for n in path if n.tag in CONTAINER]
    most = own_text(nodes[at])[0]

    def alike(node: Node, around: Node) -> bool:
        todo = _below(around)[::-1]
        while todo:
            n = todo.pop()
            if n is node or id(n) in template or _is_clutter(n, False):
                continue
            if around is not root or (n.tag, n.words) == (node.tag, node.words):
                plain, linked, _ = own_text(n)
                if plain >= 0.2 * most and plain > 2 * linked:
                    return True
            todo += _below(n)[::-1]
        return False

    while len(path) > 1 and alike(path[-1], path[-2]):
        path.pop()
    return path[-1]


def render(node: Node, template: set[int] = frozenset(), content: set[int] = frozenset()) -> str:
    """Blocks of the subtree in page order, without clutter and without the nodes (by id) of the template. Nodes of
    `content` stay though their names are those of clutter."""
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join(html_lib.unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append(text)

    in_article = node.tag in ("article", "main")

    todo: list = node.kids[::-1]
    while todo:
        k = todo.pop()
        if k is None:
            close()
        elif isinstance(k, str):
            run.append(k)
        elif id(k) in template or k.sure or _is_clutter(k, in_article) and id(k) not in content:
            close()
        elif k.tag in BLOCK:
            close()
            todo += [None, *k.kids[::-1]]
        elif k.tag == "br":
            run.append(" ")
        else:
            todo += k.kids[::-1]
    close()
    return "\n".join(blocks)


def main_text(page: str | None, reference: str | None, slot: int | None, constant: list[int] = (), varying: list[int] = ()) -> str:
    """The text around the node that the host's content slot is aligned with, or else the page's own best node.

    Nodes aligned with the host's template (`constant`) are left out, unless the slot itself is constant: then the
    whole article repeats. Nodes aligned with running text that varies (`varying`) are kept whatever their names.
    """
    root = parse(page or "")
    nodes = containers(root)
    at, template, content = None, set(), _page_forms(nodes)
    if reference is not None and slot is not None:
        aligned = align(outline(root), read(reference))
        at = next((i for i, j in aligned.items() if j == slot), None)
        if at is not None and own_text(nodes[at])[0]:
            fixed, free = set(constant) if slot not in constant else set(), set(varying)
            template = {id(nodes[i]) for i, j in aligned.items() if j in fixed and i and i != at}
            content |= {id(nodes[i]) for i, j in aligned.items() if j in free}
            return render(_article_of(nodes, root, at, template), template, content)
    place = weights(nodes, root)
    scores = [own_text(n)[0] * w for n, w in zip(nodes, place)]
    if at is None or max(scores) >= 1:
        at = max(range(len(nodes)), key=lambda i: (scores[i], place[i], -i))
    if place[at] < 1:
        return ""
    return render(_article_of(nodes, root, at, template), template, content)


def host_of(url):
    return F.nullif(F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def references(pages: DataFrame) -> DataFrame:
    """host, reference: the outline of one page of each host with two pages or more. pages: page_id, host, html."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shapes = [written(outline(parse(h or ""))) for h in b["html"]]
            yield pd.DataFrame({"host": b["host"], "reference": shapes})

    first = pages.filter(F.col("host").isNotNull()).groupBy("host").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))
    first = stored(first.filter((F.col("n") > 1) & F.col("page_id").isNotNull()).select("host", "page_id"))
    chosen = pages.join(first, ["host", "page_id"]).select("host", "html")
    return stored(chosen.mapInPandas(run, "host string, reference string").groupBy("host").agg(F.min("reference").alias("reference")))


def content_slots(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """host, reference, slot, constant, varying: the reference's node with the most varying text over all pages of the
    host; its nodes that are template (the same text on most pages, or mostly links on three pages or more); and its
    nodes with running text that varies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: dict[tuple, list[float]] = {}
            for host, page, ref in zip(b["host"], b["html"], b["reference"]):
                root = parse(page or "")
                nodes = containers(root)
                prior = weights(nodes, root, ARTICLE_PRIOR, CLUTTER_PRIOR)
                for i, j in align(outline(root), read(ref)).items():
                    plain, linked, digest = own_text(nodes[i])
                    if plain + linked:
                        votes = out.setdefault((host, j, digest), [0, 0.0, 0, 0])
                        votes[0] += 1
                        votes[1] += prior[i] * plain * plain / (plain + linked)
                        votes[2] += plain
                        votes[3] += linked
            if out:
                yield pd.DataFrame([(*k, *v) for k, v in out.items()], columns=["host", "node", "digest", "n", "score", "plain", "linked"])

    votes = pages.join(refs, "host").select("host", "html", "reference")
    votes = votes.mapInPandas(run, "host string, node int, digest long, n long, score double, plain long, linked long")
    total = [F.sum(c).alias(c) for c in ("n", "score", "plain", "linked")]
    votes = votes.groupBy("host", "node", "digest").agg(*total)
    nodes = votes.groupBy("host", "node").agg(F.max("n").alias("most"), *total)
    repeats = (F.col("most") >= 3) & (F.col("most") * 5 >= F.col("n") * 4)
    links = (F.col("n") >= 3) & (F.col("linked") > F.col("plain"))
    worth = F.when(repeats, F.col("score") * CONSTANT_WEIGHT).otherwise(F.col("score"))
    best = nodes.groupBy("host").agg(  # lists as long as the reference has nodes at most
        F.max(F.struct(worth.alias("worth"), (-F.col("node")).alias("node"))).alias("best"),
        F.collect_list(F.when(repeats | links, F.col("node"))).alias("constant"),
        F.collect_list(F.when(~repeats & ~links & (F.col("n") >= 3) & (F.col("plain") >= 40 * F.col("n")), F.col("node"))).alias("varying"),
    )
    return stored(refs.join(best.select("host", (-F.col("best.node")).alias("slot"), "constant", "varying"), "host", "left"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null and empty pages have an empty text. A null url has no host; such a page is judged alone. A null id stays
    null; repeated rows have a row each and vote each; of equal ids the reference is the least outline; of equal worth
    the slot is the first node. An empty table gives an empty result; other columns are ignored. References are joined
    by host: Spark broadcasts them if their file is under its threshold, else it splits hot hosts.
    """

    def start():
        def work(pages: list, references: list, slots: list, constants: list, varying: list) -> dict:
            texts = [main_text(h, r, s, c or (), v or ()) for h, r, s, c, v in zip(pages, references, slots, constants, varying)]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return work

    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col).cast("string")).alias("host"),
    )
    slots = content_slots(rows, references(rows))
    joined = rows.join(slots, "host", "left").select("page_id", "url", "html", "reference", "slot", "constant", "varying")
    return map_rows(joined, ["html", "reference", "slot", "constant", "varying"], {"text": "string", "n_chars": "long"}, start)
