"""Main text of web pages by composite text density (Sun et al., 2011).

A page becomes a tree by the usual rules for implied and missing end tags.
What is never article text goes first: scripts, styles, forms, menus, headers,
footers, asides, hidden parts, and elements whose class, id or role says
advert, notice, sidebar or comments.  A form, a class or an id does not make
noise of the page's own wrapper: of an element that holds `main`, nor, on a
page that would be left without text, of one that holds most of it and
paragraphs, an article or a main heading.  Names of states (`has-sidebar`,
`no-sidebar`, `comments-open`) say nothing about the element itself.

Each remaining node gets

    density = C / T * log_b(C / LC * T / LT),  b = ln(C / (C - LC) * LC + LCb / Cb * C + e)

of its characters C, tags T, linked characters LC and linked tags LT (b: of
the body), and the sum of its children's densities.  The node of the largest
sum is content; so are the largest-sum nodes of other branches whose density
reaches the lowest on the path from the body to it.  Where `article` or `main`
holds that node, all of it is content.  In content, a list of links goes as a
menu, unless a heading or a paragraph that ends in a colon introduces it.

A page is read in time linear in its length (but for logarithms).

Defined results: null, empty and textless pages give an empty text; pages
without tags give their text; page ids and urls are passed on, repeated or
null; an empty table gives an empty table; other columns are ignored.  White
space is what Unicode calls so.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, mapped

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p pre section summary"
    " table tbody td tfoot th thead tr ul".split()
)
#: Block elements that end an open paragraph.
ENDS_P = BLOCK - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split())
#: What an opening tag ends, and where the search for it stops.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
}
P_SCOPE = frozenset("table td th caption button object html body".split())
NOISE_TAG = frozenset(
    "nav header footer aside script style noscript iframe template title head textarea button select datalist menu dialog svg"
    " canvas object embed audio video map input label fieldset".split()
)
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status".split())
NOISE_WORD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted"
    " nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar toolbar"
    " comment comments commentlist disqus replies respond discussion cookie cookies consent gdpr notice notices notification"
    " newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended"
    " recommendations widget widgets pagination pager banner skip hidden".split()
)
#: Before or after a word above, they name a state of the page.
STATE_BEFORE = frozenset("has no with without".split())
STATE_AFTER = frozenset("open opened closed enabled disabled collapsed expanded".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset(["p", "article", "h1"])
#: Words of headings over lists of links that are menus, beside those above.
MENU_WORD = frozenset("more popular latest also contents toc tags categories archive archives trending".split())
NOISE_NAME = frozenset("header site-header page-header main-header top-header global-header".split())

#: A quote that is never closed ends with its tag.  Linear: only the last quote of each kind on a page can be such.
_TAG = re.compile(r"""<(?:!--(?:.*?-->|.*)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*+"|'[^']*+'|["'][^>]*+)*+)>?|[!?/][^>]*>?)""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SOFT, HARD = 1, 2


def _names_noise(name: str) -> bool:
    """Whether a class or an id says that its element is no article text."""
    if name.lower() in NOISE_NAME:
        return True
    words = [w.lower() for w in _WORD.findall(name)]
    if NOISE_WORD.isdisjoint(words):
        return False
    first = next(k for k, w in enumerate(words) if w in NOISE_WORD)
    return words[-1] not in STATE_AFTER and STATE_BEFORE.isdisjoint(words[:first])


def _mark(tag: str, attrs: str) -> int:
    """0 for what may be article text, SOFT for forms and names, HARD for the rest."""
    if tag in NOISE_TAG:
        return HARD
    mark = SOFT if tag == "form" else 0
    if not attrs or tag in ("html", "body"):
        return mark
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "").strip()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return HARD
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HARD
        if name == "role" and value.lower() in NOISE_ROLE:
            return HARD
        if name in ("class", "id") and any(map(_names_noise, value.split())):
            mark = SOFT
    return mark


class Tree:
    """The nodes of a page in page order.  Node 0 is the root; texts hang on
    nodes as (order, text) in `text`."""

    def __init__(self, html: str):
        self.tag, self.parent, self.mark, self.main = ["html"], [-1], [0], [False]
        self.items: list[tuple[int, str | None, int]] = []  # (node, text or None, child) in page order
        self.body = 0
        self.open: dict[str, list[int]] = {}  # depths of the open elements of each tag
        self.blocks: list[int] = []  # depths of the open blocks
        stack, pos, n = [0], 0, len(html)
        while pos < n:
            m = _TAG.search(html, pos)
            stop = m.start() if m else n
            if stop > pos:
                self.items.append((stack[-1], html[pos:stop], -1))
            if not m:
                break
            pos = max(m.end(), stop + 1)
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(stack, tag)
                continue
            attrs = m[3]
            if tag == "html":
                continue
            if tag == "body" and self.body:
                continue
            self._imply(stack, tag)
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.mark.append(_mark(tag, attrs))
            self.main.append(tag == "main" or "role" in attrs and any(m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").strip().lower() == "main" for m in _ATTR.finditer(attrs)))
            self.items.append((stack[-1], None, node))
            if tag == "body":
                self.body = node
            if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, pos)
                self.items.append((node, html[pos : end.start() if end else n], -1))
                pos = end.end() if end else n
                continue
            self.open.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                self.blocks.append(len(stack))
            stack.append(node)
        self.noise = self._noise()

    def _noise(self) -> list[bool]:
        """Which nodes are no article text, wrappers told from noise."""
        n, parent = len(self.tag), self.parent
        own = [0] * n
        for node, text, _ in self.items:
            if text is not None:
                own[node] += len("".join(text.split()))
        self.own = own
        holds, prose = self.main[:], [t in PROSE for t in self.tag]
        for k in range(n - 1, 0, -1):
            holds[parent[k]] |= holds[k]
            prose[parent[k]] |= prose[k]
        mark = [0 if m == SOFT and h else m for m, h in zip(self.mark, holds, strict=True)]
        # Characters below each node outside hard marks, and outside all marks.
        some, clean = own[:], own[:]
        for k in range(n - 1, 0, -1):
            if mark[k] != HARD:
                some[parent[k]] += some[k]
            if not mark[k]:
                clean[parent[k]] += clean[k]
        noise, look = [False] * n, [False] * n
        look[0] = not clean[0]
        for k in range(1, n):
            p = parent[k]
            noise[k], look[k] = noise[p], look[p]
            if mark[k] and not noise[k]:
                noise[k] = not (look[k] and mark[k] == SOFT and prose[k] and some[k] * 2 > some[0])
                look[k] = look[k] and not noise[k] and not clean[k]
        return noise

    def _cut(self, stack: list[int], depth: int) -> None:
        """End all open elements from a depth on."""
        for k in range(len(stack) - 1, depth - 1, -1):
            tag = self.tag[stack[k]]
            self.open[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
        del stack[depth:]

    def _depth(self, tags) -> int:
        """The greatest depth at which one of the tags is open, or 0."""
        return max([self.open[t][-1] for t in self.open.keys() & tags if self.open[t]], default=0)

    def _close(self, stack: list[int], tag: str) -> None:
        depths = self.open.get(tag)
        at = depths[-1] if depths else 0
        # An inline end tag doesn't reach out of its block.
        if at and (tag in BLOCK or not self.blocks or at > self.blocks[-1]):
            self._cut(stack, at)

    def _imply(self, stack: list[int], tag: str) -> None:
        if tag in ENDS_P and self.open.get("p"):
            at = self.open["p"][-1]
            if at > self._depth(P_SCOPE):
                self._cut(stack, at)
        if tag == "body" and len(stack) > 1:
            self._cut(stack, 1)
        if tag in IMPLIED:
            ends, scope = IMPLIED[tag]
            floor = self._depth(scope)
            if tag == "tr":  # a row ends the cells and the row above it, down to its table
                lists = [self.open.get(t, ()) for t in ends]
                at = min((x[bisect_right(x, floor)] for x in lists if x and x[-1] > floor), default=0)
            else:
                at = self._depth(ends)
            if at > floor:
                self._cut(stack, at)


def _density(c: int, t: int, lc: int, lt: int, share: float) -> float:
    if not c:
        return 0.0
    base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
    return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / math.log(max(base, 2.0))


def main_text(html: str | None) -> str:
    """The article of a page: its blocks, joined by two line feeds."""
    if not html:
        return ""
    tree = Tree(html)
    n = len(tree.tag)
    chars, tags, lchars, ltags = [0] * n, [0] * n, [0] * n, [0] * n
    kids: list[list[int]] = [[] for _ in range(n)]
    linked = [False] * n
    for k in range(1, n):
        linked[k] = linked[tree.parent[k]] or tree.tag[k] == "a"
        if not tree.noise[k]:
            kids[tree.parent[k]].append(k)
            tags[k] += 1
            ltags[k] += linked[k]
    for k in range(n):
        if not tree.noise[k]:
            chars[k] = tree.own[k]
            lchars[k] = tree.own[k] if linked[k] else 0
    own = chars[:]
    for k in range(n - 1, 0, -1):
        if not tree.noise[k]:
            p = tree.parent[k]
            chars[p] += chars[k]
            tags[p] += tags[k]
            lchars[p] += lchars[k]
            ltags[p] += ltags[k]
    body = tree.body
    if not chars[body]:
        body = 0
    if not chars[body]:
        return ""
    share = lchars[body] / chars[body]
    density = [0.0 if tree.noise[k] else _density(chars[k], tags[k] - 1, lchars[k], ltags[k], share) for k in range(n)]
    total = [0.0] * n
    for k in range(n - 1, 0, -1):
        total[tree.parent[k]] += density[k]
    # The largest sum in each subtree; a node's own text counts as a child of density like its own.
    best, best_at = total[:], list(range(n))
    for k in range(n):
        if not kids[k] or own[k] * 2 > chars[k]:
            best[k] = max(best[k], density[k])
    for k in range(n - 1, 0, -1):
        p = tree.parent[k]
        if not tree.noise[k] and best[k] > best[p]:
            best[p], best_at[p] = best[k], best_at[k]
    top = best_at[body]
    path = [top]
    while path[-1] != body and tree.parent[path[-1]] >= 0:
        path.append(tree.parent[path[-1]])
    floor = min(density[k] for k in path)
    for k in path:  # the element that says it is the article holds all of it
        if tree.tag[k] in ("article", "main"):
            top = k
    chosen, todo = set(), [(body, top)]
    while todo:
        node, pick = todo.pop()
        chosen.add(pick)
        k = pick
        while k != node:
            above = tree.parent[k]
            for c in kids[above]:
                if c != k and density[c] >= floor and c not in chosen and not (top != body and tree.tag[top] in ("article", "main")):
                    todo.append((c, best_at[c]))
            k = above
    return _blocks(tree, chosen, lchars, chars)


def _introduced(tree: Tree) -> set[int]:
    """Lists that follow a heading, or a paragraph that ends in a colon."""
    n = len(tree.tag)
    before: list[int] = [-1] * n
    last: dict[int, int] = {}
    asked: set[int] = set()
    for k in range(1, n):
        p = tree.parent[k]
        if tree.tag[k] in ("ul", "ol") and (tree.tag[last.get(p, 0)] in HEADING or tree.tag[last.get(p, 0)] == "p"):
            before[k] = last[p]
            asked.add(before[k])
        last[p] = k
    if not asked:
        return set()
    at, said = list(range(n)), {k: [] for k in asked}
    for k in range(1, n):
        at[k] = k if k in asked else at[tree.parent[k]]
    for node, text, _ in tree.items:
        if text is not None and at[node] in said:
            said[at[node]].append(text)
    out = set()
    for k in range(1, n):
        if before[k] > 0:
            words = unescape("".join(said[before[k]])).lower().split()
            bare = {w.strip(".,:;!?") for w in words}
            colon = bool(words) and words[-1].endswith((":", "："))
            if words and bare.isdisjoint(NOISE_WORD | MENU_WORD) and (colon or tree.tag[before[k]] in HEADING):
                out.add(k)
    return out


def _blocks(tree: Tree, chosen: set[int], lchars: list[int], chars: list[int]) -> str:
    n = len(tree.tag)
    keep, block = [False] * n, [0] * n
    told = _introduced(tree)
    for k in range(n):
        p = tree.parent[k]
        inside = k in chosen or p >= 0 and keep[p]
        links = tree.tag[k] in ("ul", "ol") and lchars[k] > 0.8 * chars[k] and k not in told
        keep[k] = inside and not tree.noise[k] and not links
        block[k] = k if k == 0 or tree.tag[k] in BLOCK else block[p]
    out: list[str] = []
    held: list[str] = []
    at = -1

    def end() -> None:
        text = " ".join(unescape("".join(held)).split())
        if text:
            out.append(text)
        held.clear()

    for node, text, child in tree.items:
        if text is None:
            if tree.tag[child] in BLOCK:
                end()
            elif tree.tag[child] == "br":
                held.append(" ")
            continue
        if not keep[node]:
            continue
        if block[node] != at:
            end()
            at = block[node]
        held.append(text)
    end()
    return "\n\n".join(out)


def _extract(batches, html: str, schema: pa.Schema):
    for batch in batches:
        texts = [main_text(h) for h in batch.column(html).to_pylist()]
        kept = [batch.column(c) for c in schema.names[:-2]]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep`, text and n_chars (code points) of every page."""
    out = pages.select(*keep).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    schema = arrow_schema(out)
    return pages.select(*keep, html).transform(mapped, lambda it: _extract(it, html, schema), out)
