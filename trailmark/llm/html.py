"""Main text of HTML pages by wrapper induction.

Pages of one host are dealt into blocks of bounded size.  In a block the pages' DOM trees are aligned one after the other with the
wrapper, the tree that the pages before have made: equal subtrees first, the children between them by simple tree matching (the
largest order-preserving mapping of equally labelled nodes), to full depth; what meets nothing becomes a new place of the wrapper.
Each place counts the texts that stand there.  A run of text between block edges that is the same in ``AGREE`` of the other pages
that have its node's parent is template and dropped; what varies is a slot.  The region is the lowest node that
covers all article or main elements and the titles beside them, or else the whole page; a page's main text is what varies
in its region, less parts that are no article by tag, role, class or id.  Such a name does not discard a node that holds most of the
page's varying text, or its only article.

Pages with (nearly) equal text would make everything template, so pages of which one has all but ``COPY`` of its text in common with the
other count as one; a page with no other to align with counts as all slots.  Sizes of mappings are kept by the shapes of subtrees,
which pages of a host share.

Defined results: null or empty html gives an empty text; broken markup (unclosed elements, stray end tags, html cut short) is repaired
as browsers do for blocks and inline elements; a null url is a host of its own; repeated rows repeat; extra columns are
ignored; nothing is capped: no step recurses, and all but the matching of two lists of children is linear in the page.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, hot_join, written
from .url_filter import host_and_path

#: Pages of a block, and characters of its pages, on average.
BLOCK, BLOCK_SIZE = 24, 4_000_000
#: A node is template if so large a share of the aligned pages has an equal one.
AGREE = 0.9
#: ... and so many of them have: what two pages alone share can be a quotation.
SUPPORT = 2
#: Pages that differ in a smaller share of the text are copies of each other.
COPY = 0.25
#: Cells of a table of two lists of children that are kept at once; larger ones are halved.
CELLS = 4_000_000

# Names of HTML elements and of usual page parts.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav noframes ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul br".split()
)
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
HIDDEN = set("head script style noscript template title svg math iframe object textarea select option button canvas audio video datalist".split())
CHROME_TAGS = set("nav footer header aside form menu dialog search".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
CHROME_WORDS = set(
    "ad ads adv advert advertisement advertising adbox adsense banner sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar "
    "aside cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond reply replies disqus share sharing social "
    "related recommended recommendations pagination pager toolbar skip widget".split()
)
#: Parts of an article can have these in their names too; they are no chrome next to one of the second set ("entry-header").
SHARED_WORDS = set("header footer notice promo".split())
ARTICLE_WORDS = set("article post entry content story section title".split())
MAIN_TAGS = ("article", "main")
WHOLE = {"html", "body", *MAIN_TAGS}
NO_ARTICLE = HIDDEN | CHROME_TAGS
#: Elements that an open p is not closed across.
P_STAYS_IN = ("article", "body", "td", "div", "section", "li", "main")
#: Start tags that close an element like them, and what they do not reach across.
CLOSES_LIKE = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}

_not_letters = re.compile(r"[^a-z]+").split


def names_chrome(attribute: str) -> bool:
    """Whether a class or id names a page part that is no article."""
    for name in attribute.lower().split():
        words = {w for w in _not_letters(name) if w}
        found = words & CHROME_WORDS
        if found - SHARED_WORDS or found and not words & ARTICLE_WORDS:
            return True
    return False


class Node:
    __slots__ = ("tag", "words", "role", "hidden", "named", "kids", "up", "depth", "solid", "parts", "units", "items", "mark", "shape", "chars", "clear", "slot", "opened", "fixed", "mass", "shut", "hard")

    def __init__(self, tag: str, words=frozenset(), role: str = "", hidden: bool = False, named: bool = False, up=None):
        self.tag, self.words, self.role, self.hidden, self.named, self.up = tag, words, role, hidden, named, up
        self.depth = 0 if up is None else up.depth + 1
        self.kids: list[Node | str] = []
        self.opened, self.fixed, self.solid = False, (), False

    def chrome(self) -> bool:
        """No article by tag, class, id or role."""
        if self.opened:
            return False
        if self.tag in NO_ARTICLE or self.hidden or self.role in CHROME_ROLES:
            return True
        return self.named and self.tag not in WHOLE

    def unseen(self) -> bool:
        return self.tag in HIDDEN or self.hidden

    def label(self) -> tuple:
        # The classes of the outermost elements tell pages apart, not templates.
        return self.tag, frozenset() if self.tag in WHOLE else self.words


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")
        self.open: Counter[str] = Counter()  # tags from the root to ``at``

    def _up_to(self, n: Node) -> None:
        """Closes the elements down from ``n``."""
        while self.at is not n.up:
            self.open[self.at.tag] -= 1
            self.at = self.at.up

    def _close(self, same: tuple[str, ...], stop: tuple[str, ...]) -> None:
        """Closes the nearest element of ``same``, unless one of ``stop`` is nearer."""
        if any(self.open[t] for t in same):
            n = self.at
            while n.tag not in same:
                if n.tag in stop:
                    return
                n = n.up
            self._up_to(n)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close(("p",), P_STAYS_IN)
        if tag in CLOSES_LIKE:
            self._close(*CLOSES_LIKE[tag])
        words, role, hidden, named = frozenset(), "", False, False
        if attrs:
            a = {k: v or "" for k, v in attrs}
            marks = f"{a.get('class', '')} {a.get('id', '')}"
            if marks != " ":
                words = frozenset(w for w in _not_letters(marks.lower()) if w)  # numbers differ from page to page
                named = bool(words) and names_chrome(marks)
            role = a.get("role", "").lower()
            hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        n = Node(tag, words, role, hidden, named, self.at)
        self.at.kids.append(n)
        if tag not in VOID:
            self.at = n
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.handle_starttag("br", [])
            return
        if not self.open[tag]:
            return
        n, inline = self.at, tag not in BLOCKS
        while n.tag != tag:
            # An inline end tag does not close the blocks around it.
            if inline and n.tag in BLOCKS:
                return
            n = n.up
        self._up_to(n)

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def text_of(n: Node) -> str:
    """The text outside chrome, less lines of nothing but template."""
    parts, lines, now, keep = [], [], [], False
    todo: list = [(n, True, False)]
    while todo:
        x, top, fixed = todo.pop()
        if isinstance(x, str):
            now.append(x)
            keep = keep or not fixed and bool(x.strip())
        elif x is None or not top and x.chrome() or x.tag == "br":
            lines.append("".join(now))
            now = []
            if x is None or x.tag != "br":
                if keep:
                    parts.extend(lines)
                lines, keep = [], False
        else:
            edge = [(None, False, False)] if x.tag in BLOCKS else []
            own = [(k, False, fixed or i in x.fixed) for i, k in enumerate(x.kids)]
            todo += [*edge, *reversed(own), *edge]
    if keep:
        parts.extend([*lines, "".join(now)])
    return "\n".join(line for x in parts if (line := " ".join(x.split())))


class Shapes:
    """Numbers for the shapes of subtrees (labels alone) and the sizes of the largest mappings between them."""

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.labels, self.kids, self.counts = [], [], []
        self.best: dict[tuple[int, int], int] = {}
        self.met: dict[tuple, list[tuple[int, int]]] = {}

    def number(self, label: tuple, kids: tuple[int, ...]) -> int:
        k = self.ids.setdefault((label, kids), len(self.labels))
        if k == len(self.labels):
            self.labels.append(label)
            self.kids.append(kids)
            self.counts.append(1 + sum(self.counts[x] for x in kids))
        return k

    def size(self, a: int, b: int) -> int:
        """Size of the largest mapping of two shapes."""
        if a == b:
            return self.counts[a]
        if self.labels[a] != self.labels[b]:
            return 0
        todo = [(a, b)]
        while todo:
            at = todo[-1]
            if at not in self.best:
                x, y = self.kids[at[0]], self.kids[at[1]]
                k, z = self._ends(x, y)
                left, right = set(x[k : len(x) - z]), set(y[k : len(y) - z])
                missing = [(p, q) for p in left for q in right if p != q and self.labels[p] == self.labels[q] and (p, q) not in self.best]
                if missing:
                    todo.extend(missing)
                    continue
                self.best[at] = 1 + self.aligned(x, y)[0]
            todo.pop()
        return self.best[a, b]

    def _ends(self, x, y) -> tuple[int, int]:
        """How many equal shapes stand at both ends; they can always meet, as no other partner gives more."""
        a, n = 0, min(len(x), len(y))
        while a < n and x[a] == y[a]:
            a += 1
        z = 0
        while z < n - a and x[-1 - z] == y[-1 - z]:
            z += 1
        return a, z

    def aligned(self, x, y) -> tuple[int, list[tuple[int, int]]]:
        """Simple tree matching of two lists of children: the size and the places that meet."""
        a, z = self._ends(x, y)
        size, pairs = 0, []
        if a + z < min(len(x), len(y)):
            size, pairs = self._tabled(x[a : len(x) - z], y[a : len(y) - z])
        ends = [(i, i) for i in range(a)], [(len(x) - i, len(y) - i) for i in range(z, 0, -1)]
        return size + sum(self.counts[x[i]] for side in ends for i, _ in side), [*ends[0], *((i + a, j + a) for i, j in pairs), *ends[1]]

    def pairs(self, x: tuple[int, ...], y: tuple[int, ...]) -> list[tuple[int, int]]:
        """The places that meet, remembered."""
        if (x, y) not in self.met:
            self.met[x, y] = self.aligned(x, y)[1]
        return self.met[x, y]

    def _tabled(self, x, y) -> tuple[int, list[tuple[int, int]]]:
        """The largest mapping by a table of all beginnings of both lists; ties go to the earliest members."""
        m, n = len(x), len(y)
        if m * n > CELLS and m > 1:
            # Halved where the best mapping of the first half ends and that of the second begins.
            h = m // 2
            first, last = self._scores(x[:h], y), self._scores(x[h:][::-1], y[::-1])[::-1]
            k = int(np.argmax(first + last))
            (s, p), (t, q) = self._tabled(x[:h], y[:k]) if k else (0, []), self._tabled(x[h:], y[k:]) if k < n else (0, [])
            return s + t, p + [(i + h, j + k) for i, j in q]
        if m * n <= 1024:
            best = [[0] * (n + 1)]
            for p in x:
                above, row, left = best[-1], [0], 0
                for j, q in enumerate(y):
                    left = max(above[j + 1], left, above[j] + self.size(p, q))
                    row.append(left)
                best.append(row)
        else:
            best = np.stack(list(self._rows(x, y)))
        i, j, chosen = m, n, []
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                chosen.append((i, j))
        return int(best[m][n]), chosen[::-1]

    def _rows(self, x, y):
        """The table's rows."""
        kinds, which = np.unique(np.array(y), return_inverse=True)
        known = {p: np.array([self.size(p, int(q)) for q in kinds], np.int64)[which] for p in set(x)}
        row = np.zeros(len(y) + 1, np.int64)
        yield row
        for p in x:
            now = np.zeros_like(row)
            now[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + known[p]))
            row = now
            yield row

    def _scores(self, x, y) -> np.ndarray:
        row = None
        for row in self._rows(x, y):
            pass
        return row


def prepare(root: Node, shapes: Shapes) -> list[Node]:
    """Sets the parts (child nodes that stand for themselves), the texts between them, marks and shapes; returns all nodes, parents first."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        if not n.unseen():
            todo.extend([k for k in reversed(n.kids) if not isinstance(k, str)])
    for n in reversed(order):
        if not n.unseen():
            n.solid = n.solid or n.up is None or n.tag in BLOCKS and n.tag != "br" or n.chrome()
            if n.solid and n.up is not None:
                n.up.solid = True
    for n in reversed(order):
        n.parts, n.units, n.items, n.mass, n.slot, n.chars, n.clear = [], [], [], 0, None, 0, 0
        if not n.solid:
            continue
        said, now, held = [n.tag], [], []
        for i, k in enumerate([*n.kids, None]):
            if k is None or not isinstance(k, str) and k.solid:
                if held:
                    if text := " ".join("".join(now).split()):
                        n.units.append(text)
                        n.items.append(held)
                        said.append(text)
                    now, held = [], []
                if k is not None:
                    n.parts.append(k)
                    if k.chars:
                        said.append(k.mark)
            else:
                now.append(k) if isinstance(k, str) else _inline(k, now)
                held.append(i)
        own = sum(map(len, n.units))
        n.chars = own + sum(k.chars for k in n.parts)
        n.clear = 0 if n.chrome() else own + sum(k.clear for k in n.parts)
        n.mark = hash(tuple(said)) if n.chars else 0
        n.shape = shapes.number(n.label(), tuple([k.shape for k in n.parts]))
    return order


def _inline(n: Node, out: list[str]) -> None:
    """The texts of an inline element, in order."""
    todo: list[Node | str] = [n]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append(" ")
        elif not x.unseen():
            todo.extend(reversed(x.kids))


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: size of the largest mapping of the trees and its pairs of nodes, parents first."""
    shapes = Shapes()
    prepare(a, shapes)
    prepare(b, shapes)
    pairs, todo = [], [(a, b)] if a.label() == b.label() else []
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        got = shapes.aligned([k.shape for k in x.parts], [k.shape for k in y.parts])[1]
        todo.extend((x.parts[i], y.parts[j]) for i, j in reversed(got))
    return shapes.size(a.shape, b.shape), pairs


class Slot:
    """A place of the wrapper: the nodes of pages that met, how many pages have it and how many have each text there."""

    __slots__ = ("up", "label", "shape", "kids", "marks", "pages", "last", "texts")

    def __init__(self, node: Node, up: Slot | None):
        self.up, self.label, self.shape = up, node.label(), node.shape
        self.kids: list[Slot] = []
        self.marks: set[int] = set()
        self.pages, self.last = 0, -1
        self.texts: dict[str, list[int]] = {}  # text -> pages that have it, the last of them

    def take(self, node: Node, page: int, common: set[int]) -> None:
        """Counts a node; ``page`` numbers pages that are no copies of each other, and comes in order."""
        node.slot = self
        if node.mark in common:
            self.marks.add(node.mark)
        if self.last != page:
            self.last = page
            self.pages += 1
        for text in node.units:
            seen = self.texts.get(text)
            if seen is None:
                self.texts[text] = [1, page]
            elif seen[1] != page:
                seen[0] += 1
                seen[1] = page


def _equal(parts: list[Node], slots: list[Slot], common: set[int]) -> list[tuple[int, int]]:
    """The longest chain, in order, of children that are equal to one that stood in a slot before; of repeated ones the first meets the first."""
    wanted = [(i, k) for i, k in enumerate(parts) if k.mark in common]
    if not wanted:
        return []
    where: dict[tuple, list[int]] = {}
    for j in range(len(slots) - 1, -1, -1):
        for mark in slots[j].marks:
            where.setdefault((mark, slots[j].label), []).append(j)
    ends: list[int] = []
    chain: list[tuple[int, int, object]] = []
    for i, k in wanted:
        if free := where.get((k.mark, k.label())):
            j = free.pop()
            at = bisect_left(ends, j)
            ends[at : at + 1], chain[at : at + 1] = [j], [(i, j, chain[at - 1] if at else None)]
    out, link = [], chain[-1] if chain else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def align(root: Node, wrapper: Slot, page: int, shapes: Shapes, common: set[int]) -> None:
    """Aligns a page with the wrapper and counts its nodes there; what meets nothing becomes a place behind the one before it."""
    todo = [(root, wrapper)]
    while todo:
        node, slot = todo.pop()
        slot.take(node, page, common)
        parts, slots = node.parts, slot.kids
        if not parts:
            continue
        partner: list[int | None] = [None] * len(parts)
        if slots:
            i = j = 0
            for p, q in [*_equal(parts, slots, common), (len(parts), len(slots))]:
                if i < p and j < q:
                    for s, t in shapes.pairs(tuple([k.shape for k in parts[i:p]]), tuple([k.shape for k in slots[j:q]])):
                        if parts[i + s].label() == slots[j + t].label:
                            partner[i + s] = j + t
                if p < len(parts):
                    partner[p] = q
                i, j = p + 1, q + 1
        grown, done = [], 0
        for k, j in zip(parts, partner, strict=True):
            if j is None:
                grown.append(Slot(k, slot))
            else:
                grown.extend(slots[done : j + 1])
                done = j + 1
            todo.append((k, grown[-1]))
        if len(grown) + len(slots) - done > len(slots):
            slot.kids = grown + slots[done:]


def _settle(order: list[Node]) -> None:
    """From the wrapper's counts: which children are template (``fixed``) and how many characters vary in each node (``mass``)."""
    for n in order:
        if n.solid and n.units:
            slot = n.slot
            others, fixed = (slot.up or slot).pages - 1, []
            for text, held in zip(n.units, n.items, strict=True):
                equal = slot.texts[text][0] - 1
                if equal >= SUPPORT and equal >= AGREE * others:
                    fixed.extend(held)
                else:
                    n.mass += len(text)
            n.fixed = frozenset(fixed)
    for n in reversed(order):
        if n.solid and n.up is not None:
            n.up.mass += n.mass


def _numbered(orders: list[list[Node]]) -> list[int]:
    """A number for each page, the same for pages that are copies of each other, from 0 in order of first pages."""
    texts = []
    for order in orders:
        seen: dict[str, int] = {}
        clear: dict[str, int] = {}
        for n in order:
            n.shut = (n.up is not None and n.up.shut) or n.chrome()
            if n.solid:
                for u in n.units:
                    seen[u] = seen.get(u, 0) + len(u)
                    if not n.shut:
                        clear[u] = clear.get(u, 0) + len(u)
        texts.append((seen, clear, order[0].chars, order[0].clear))
    up = list(range(len(orders)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a in range(len(orders)):
        for b in range(a):
            shared = texts[a][0].keys() & texts[b][0].keys()
            for seen, clear, chars, clear_chars in (texts[a], texts[b]):
                if chars - sum([seen[u] for u in shared]) < COPY * chars and clear_chars - sum([clear.get(u, 0) for u in shared]) <= COPY * clear_chars:
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
                    break
    tops = list(dict.fromkeys(map(top, range(len(orders)))))
    return [tops.index(top(k)) for k in range(len(orders))]


def _is_main(n: Node) -> bool:
    return n.tag in MAIN_TAGS or n.role in ("main", "article")


def _open(order: list[Node]) -> None:
    """Names are only a help: they do not discard most of what varies, nor the only article."""
    may = lambda n: not n.unseen() and (n.named or n.role in CHROME_ROLES or n.tag == "form") and n.tag not in CHROME_TAGS - {"form"}
    mains = []
    for n in order:
        if n.solid and n.chrome() and 2 * n.mass > order[0].mass and may(n):
            n.opened = True
        n.shut = n.chrome() or n.up is not None and n.up.shut
        n.hard = n.chrome() and not may(n) or n.up is not None and n.up.hard
        if n.solid and n.mass and _is_main(n):
            mains.append(n)
    if mains and all(n.shut for n in mains):
        for n in mains:
            if not n.hard:
                while n is not None and n.shut:
                    n.opened, n.shut = n.opened or n.chrome(), False
                    n = n.up


def _meeting(a: Node, b: Node) -> Node:
    """The lowest node above both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
    return a


def _region(order: list[Node]) -> Node:
    """The lowest node that covers all articles and the titles beside them; without an article the whole page."""
    found, titles, todo = [], [], [order[0]]
    while todo:
        k = todo.pop()
        if not k.solid or k.chrome() or not k.mass:
            continue
        if _is_main(k):
            found.append(k)
        elif k.tag == "h1":
            titles.append(k)
        else:
            todo.extend(reversed(k.parts))
    if not found:
        return order[0]
    region = found[0]
    for n in found[1:] + titles:
        region = _meeting(region, n)
    return region


def extract(pages: list[str]) -> list[str]:
    """The main text of each page of one block."""
    shapes = Shapes()
    different = list(dict.fromkeys(pages))
    orders = [prepare(parse(p), shapes) for p in different]
    held = Counter(m for order in orders for m in {n.mark for n in order if n.chars})
    common = {m for m, k in held.items() if k > 1}
    numbers = _numbered(orders)
    wrapper = None
    for k in sorted(range(len(orders)), key=numbers.__getitem__):
        wrapper = wrapper or Slot(orders[k][0], None)
        align(orders[k][0], wrapper, numbers[k], shapes, common)
    done: dict[str, str] = {}
    for page, order in zip(different, orders, strict=True):
        _settle(order)
        _open(order)
        done[page] = text_of(_region(order))
    return [done[p] for p in pages]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block: int = BLOCK) -> DataFrame:
    """Rows (id, url, text string, n_chars long) for every row of ``pages``."""
    host = F.coalesce(host_and_path(F.col(url_col))[0], F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    # A host with many or large pages has many blocks; which one a page is in follows from the page alone.
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(F.length("html")) / BLOCK_SIZE))
    hosts = rows.groupBy("host").agg(blocks.cast("long").alias("n_blocks"), F.count(F.lit(1)).alias("n")).where("n_blocks > 1")
    dealt = hot_join(rows, written(hosts, "hosts"), "host", "n").withColumn("block", F.pmod(F.xxhash64("id", "url", "html"), F.coalesce("n_blocks", F.lit(1))))
    near = dealt.select("host", "block", "id", "url", "html").repartition("host", "block").sortWithinPartitions("host", "block", "id", "url", "html")
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        now, held, id_type = None, [], None  # held: id, url, html, how many equal rows

        def close():
            texts, rows, size = extract([h for _, _, h, _ in held]), [], 0
            for (i, url, _, n), text in zip(held, texts, strict=True):
                for _ in range(n):
                    rows.append((i, url, text, len(text)))
                    size += 100 + len(text)
                    if size > BLOCK_SIZE:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)

        def batch(rows):
            kinds = (id_type, pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[id_col, url_col, "text", "n_chars"])

        for b in batches:
            id_type = b.schema.field("id").type
            for part in range(0, b.num_rows, 256):
                cut = b.slice(part, 256)
                for host, k, i, url, html in zip(*(cut.column(c).to_pylist() for c in ("host", "block", "id", "url", "html")), strict=True):
                    if (host, k) != now:
                        if held:
                            yield from close()
                        now, held = (host, k), []
                    # Rows are in order, so equal ones are neighbours and need to be held once.
                    if held and held[-1][:3] == (i, url, html):
                        held[-1] = (i, url, html, held[-1][3] + 1)
                    else:
                        held.append((i, url, html, 1))
        if held:
            yield from close()
        held = []
        give_back()

    return near.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
