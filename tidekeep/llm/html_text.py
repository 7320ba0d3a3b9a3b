"""Main text of web pages by composite text density.

A page becomes a tree in one linear scan.  Every node gets its characters per tag, weighed
down by its share of link text; a node's density sum adds that of its children.  The node of the greatest sum (own text counts with the node's own density) is the
core of the article.  The least
density on the way from it up to the body is the threshold: from the body downwards, each
node that reaches it gives the subtree of its greatest sum.  Headings beside these, below the
body, are kept with them.

Elements that are never part of an article (scripts, menus, forms, footers, and those whose
class, id or role says so: adverts, sidebars, notices, comments) are left out before
densities are computed; if nothing is left, only the element names count.

Text: character references are decoded, white space within a block becomes one space, and
blocks are joined by one space in page order.  A page that is null, empty or without text
gives "".  Unclosed tags, comments and quotes end with the page.  Equal pages give equal rows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .textbatch import quoted

#: Least logarithm of the base that link text raises; without links it would be 0.
LEAST_BASE = 0.05

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul br".split()
)
CLOSES_P = BLOCKS - frozenset("body br caption dd dt html legend li optgroup option tbody td tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends the nearest open element of these names, unless one of the second set is open nearer.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
P_LIMIT = frozenset(["table", "td", "th", "button", "caption", "object", "html"])
NEVER = frozenset("head script style noscript template title nav footer aside form button select textarea input iframe object svg canvas dialog menu noembed noframes".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond replies share sharing social related recommended pagination pager toolbar masthead login".split()
)
#: Names with one of these words describe a layout, not what is in it.
LAYOUT = frozenset("with has no without layout page".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>|$)")
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+")


def _hinted(attributes: str) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if not ROLES.isdisjoint(value.split()):
                return True
            continue
        for name in value.split():
            words = set(_WORD.findall(name))
            if not HINTS.isdisjoint(words) and LAYOUT.isdisjoint(words):
                return True
    return False


class Tree:
    """Nodes in page order, a parent before its children; text runs are nodes named ''."""

    def __init__(self, page: str, hints: bool) -> None:
        self.names, self.parents, self.texts = ["#root"], [-1], [""]
        self.body = 0
        self._hints = hints
        self._stack: list[int] = [0]
        self._open: dict[str, list[int]] = {}  # places in the stack by name
        self._open_blocks: list[int] = []
        self._skip = 0  # depth of the element that is left out, if any
        self._scan(page)

    def _add(self, name: str, text: str) -> int:
        self.names.append(name)
        self.parents.append(self._stack[-1])
        self.texts.append(text)
        return len(self.names) - 1

    def _scan(self, page: str) -> None:
        at, size, find = 0, len(page), page.find
        begun = 0  # of text not yet added
        while at < size:
            at = find("<", at)
            if at < 0:
                break
            after = page[at + 1 : at + 2]
            if after == "!" or after == "?":
                self._text(page, begun, at)
                if page.startswith("<!--", at):
                    to = find("-->", at + 4) if not page.startswith(("<!-->", "<!--->"), at) else find(">", at)
                    at = begun = size if to < 0 else page.index(">", to) + 1
                else:
                    to = find(">", at)
                    at = begun = size if to < 0 else to + 1
                continue
            m = (_TAG.match(page, at) or _LOOSE.match(page, at)) if after.isalpha() or after == "/" else None
            if m is None:
                if after == "/" and page[at + 2 : at + 3]:  # </ and no letter: up to > is a comment
                    self._text(page, begun, at)
                    to = find(">", at)
                    at = begun = size if to < 0 else to + 1
                else:
                    at += 1
                continue
            self._text(page, begun, at)
            name = m[2].lower()
            at = begun = m.end()
            if m[1]:
                self._end(name)
                continue
            self._start(name, m[3])
            if name in RAW:
                to = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
                stop = to.start() if to else size
                self._text(page, at, stop)
                at = begun = stop
        self._text(page, begun, size)

    def _text(self, page: str, begun: int, at: int) -> None:
        if begun < at and not self._skip:
            raw = page[begun:at]
            self._add("", html.unescape(raw) if "&" in raw else raw)

    def _start(self, name: str, attributes: str) -> None:
        stack = self._stack
        if name in ("html", "body") and self._open.get(name):
            return
        if name == "body" or (name in BLOCKS and name not in ("html", "br")):
            if self._open.get("head"):  # a head ends where the body or a block begins
                self._pop(self._top("head"))
        if name in CLOSES_P:
            self._close(frozenset(["p"]), P_LIMIT)
        if name in IMPLIED:
            self._close(*IMPLIED[name])
        node = self._add(name, "")
        if name in VOID or attributes.endswith("/") and name not in BLOCKS and name not in RAW and name not in ("a", "b", "i", "em", "strong", "span"):
            return
        self._open.setdefault(name, []).append(len(stack))
        if name in BLOCKS:
            self._open_blocks.append(len(stack))
        stack.append(node)
        if name == "body":
            self.body = node
        if not self._skip and self._left_out(name, attributes):
            self._skip = len(stack)

    def _left_out(self, name: str, attributes: str) -> bool:
        if name in NEVER:
            return True
        if name == "header":
            return not (self._open.get("article") or self._open.get("main"))
        return self._hints and name not in ("html", "body", "article", "main") and bool(attributes) and _hinted(attributes)

    def _top(self, *names: str) -> int:
        """The last place in the stack of an element of one of these names; 0 (the root's) if there is none."""
        return max((at[-1] for name in names if (at := self._open.get(name))), default=0)

    def _pop(self, k: int) -> None:
        for i in self._stack[k:]:
            name = self.names[i]
            self._open[name].pop()
            if name in BLOCKS:
                self._open_blocks.pop()
        del self._stack[k:]
        if self._skip > len(self._stack):
            self._skip = 0

    def _close(self, targets: frozenset[str], limit: frozenset[str]) -> None:
        k = self._top(*targets)
        if k > self._top(*limit):
            self._pop(k)

    def _end(self, name: str) -> None:
        if name in ("html", "body"):
            return  # what follows still belongs to the body
        k = self._top(name)
        if not k or k < self._top("html", "body") or (name == "p" and k < self._top(*P_LIMIT)):
            return
        if name not in BLOCKS and self._open_blocks and k < self._open_blocks[-1]:
            return  # an inline end tag does not end a block
        self._pop(k)

    # densities

    def select(self) -> list[int]:
        """Nodes whose subtrees are the article, in page order."""
        n, names, parents = len(self.names), self.names, self.parents
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[parents[i]] or names[i] == "a"
            if not names[i]:
                chars[i] = sum(map(len, self.texts[i].split()))
                links[i] = chars[i] if in_link[i] else 0
        for i in range(n - 1, 0, -1):
            p = parents[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + (names[i] != "")
            link_tags[p] += link_tags[i] + (names[i] == "a")
        body = self.body
        if not chars[body]:
            return []
        share = links[body] / chars[body]
        density = [0.0] * n
        for i in range(n):
            c = chars[i]
            if c:
                t, lc, lt = tags[i] or 1, links[i], link_tags[i]
                base = math.log(c / ((c - lc) or 1) * lc + share * c + math.e)
                density[i] = c / t * math.log(c / (lc or 1) * t / (lt or 1) + 1) / max(math.log(base), LEAST_BASE)
        # inline elements are part of the block that they stand in
        block = list(range(n))
        for i in range(1, n):
            if names[i] not in BLOCKS:
                block[i] = block[parents[i]]
        sums = [0.0] * n
        for i in range(1, n):
            p = block[parents[i]]
            if block[i] == i:
                sums[p] += density[i]
            elif not names[i]:
                sums[p] += density[p] * chars[i] / (chars[p] or 1)
        best = list(range(n))  # of equal sums the outermost, then the first in the page
        for i in range(n - 1, 0, -1):
            p = parents[i]
            if names[i] and (sums[best[i]] > sums[best[p]] or sums[best[i]] == sums[best[p]] and best[p] != p):
                best[p] = best[i]
        core = best[body]
        threshold, i = density[core], core
        while i != body:
            i = parents[i]
            threshold = min(threshold, density[i])
        children: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            if names[i]:
                children[parents[i]].append(i)
        marked, queue = set(), [body]
        while queue:
            i = queue.pop()
            if not chars[i] or density[i] < threshold or i in marked:
                continue
            marked.add(best[i] if sums[best[i]] > 0 else i)
            if i not in marked:
                queue += children[i]
        # a heading beside the article, inside the same part of the page, belongs to it
        around = set()
        for i in marked:
            p = parents[i]
            while p > body and p not in around:
                around.add(p)
                p = parents[p]
        marked.update(i for i in range(1, n) if names[i] in HEADINGS and parents[i] in around)
        return sorted(marked)

    def text(self, chosen: list[int]) -> str:
        """Text of these subtrees: white space is one space, and blocks stand apart."""
        inside, pieces = set(chosen), []
        gap = [False] * len(self.names)
        block = [0] * len(self.names)  # the nearest block above, or the node itself
        last = None
        for i in range(1, len(self.names)):
            p = self.parents[i]
            block[i] = i if self.names[i] in BLOCKS else block[p]
            if p in inside:
                inside.add(i)
            if i not in inside:
                continue
            name = self.names[i]
            # a space where the nearest block changes, or a block or line break begins
            gap[i] = name in BLOCKS
            if gap[i]:
                pieces.append(" ")
            if not name:
                if block[p] != last:
                    pieces.append(" ")
                    last = block[p]
                pieces.append(self.texts[i])
        return " ".join("".join(pieces).split())


def extract(page: str | None) -> str:
    """Main text of one page."""
    if not page:
        return ""
    for hints in (True, False):
        tree = Tree(page, hints)
        chosen = tree.select()
        if chosen:
            return tree.text(chosen)
    return ""


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns `keep` with text and n_chars of every whole page; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keep, "text", "n_chars"]
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [extract(p) for p in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names)

    picked = pages.select(*map(quoted, keep), quoted(html))
    schema = ", ".join(f"{quoted(name)} {kind}" for name, kind in picked.dtypes[: len(keep)])
    return picked.mapInArrow(run, f"{schema}, text string, n_chars long")
