"""Main text of web pages by composite text density.

Every node of a page gets a density: characters per tag in its subtree, lowered where many of them are in links. A
node's density sum adds up the densities of its children; the article is the subtree with the largest sum. The lowest
density on the path from there up to the body is the threshold for what else on that path belongs to it.

Elements that never hold article text (menus, forms, scripts, hidden ones) are out of the tree before densities are
computed. Elements whose class or id says that they are reader comments go whatever their tag and size, unless nothing but
links would be left; those named as adverts, menus and the like go unless the dense subtree lies in them. Where the page
marks an ``article`` or ``main`` part and the dense subtree agrees, the whole part is the text.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .shared import lean_batches, table
from .textnp import column

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>", re.S
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z-]+)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "xmp", "iframe")}
#: Elements that never hold article text, and those that don't unless they stand in an article.
DROP = frozenset("head script style noscript template iframe nav aside form button select option textarea input label dialog menu svg canvas object audio video map".split())
DROP_OUTSIDE = frozenset(["footer", "header"])
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that are a part of an article, never all of it: where one of them is the densest subtree, those beside it belong to it.
PARAGRAPH = frozenset("p blockquote pre ul ol dl table figure".split())
#: An open element that ends where one of these begins, without looking past the elements after it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class and id names that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs toolbar masthead "
    "comment comments commentlist disqus replies respond share sharing social related recommended recommendations widget widgets login pagination pager "
    "skip hidden paywall".split()
)
#: Those of them that mark what readers say.
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Words that leave a name of marks what it is.
PLAIN = frozenset("list box block section container wrapper wrap inner outer area item items link links button buttons icon icons left right top main form bar post posts article articles unit slot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKS_OUTSIDE = frozenset("footer header topbar bottom copyright legal search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_WORDS = re.compile(r"[A-Za-z]+")


def _dropped(tag: str, attrs: str, inside: bool) -> bool | None:
    """Whether an element leaves the tree; None if its name has marks, so its text decides."""
    if tag in DROP or (tag in DROP_OUTSIDE and not inside):
        return True
    if not attrs or tag in ("html", "body", "main", "article"):
        return False
    found: bool | None = False
    for name, a, b, c, bare in _ATTR.findall(attrs):
        name, value = (name or bare).lower(), a or b or c
        if name in ("class", "id"):
            if name == "id" and tag in HEADINGS:  # made from the title
                continue
            for token in value.split():
                own = {w.lower() for w in _WORDS.findall(token)}
                if own & (MARKS if inside else MARKS | MARKS_OUTSIDE):
                    found = None
        elif name == "role" and value.lower() in ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return found


def _made_of(marks: frozenset, tag: str, attrs: str, inside: bool) -> bool:
    """Whether a class or id consists of marks, some of them of ``marks``, and of words that leave them what they are."""
    every = PLAIN | (MARKS if inside else MARKS | MARKS_OUTSIDE)
    for name, a, b, c, _ in _ATTR.findall(attrs):
        if name.lower() not in ("class", "id") or (name.lower() == "id" and tag in HEADINGS):
            continue
        for token in (a or b or c).split():
            own = {w.lower() for w in _WORDS.findall(token)}
            if own & marks and own <= every and not (tag == "p" and own - PLAIN <= {"notice", "notices", "alert"}):
                return True
    return False


class Page:
    """The tree of a page as parallel lists, in document order; node 0 is the root."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.end, self.gone, self.inside = ["#root"], [-1], [0], [False], [False]
        self.parts: list[tuple[int, str]] = []  # (node, text), and (node, None) where a block begins or ends
        self.marked: list[tuple[int, bool]] = []  # nodes whose names have marks, and whether these are all there is
        self.said: list[int] = []  # nodes that are named as comments
        self._build(source)
        if self.marked or self.said:
            self._judge()

    def _take_out(self, node: int) -> None:
        self.gone[node : self.end[node]] = [True] * (self.end[node] - node)

    def _judge(self) -> None:
        """Take out nodes by their names.

        Those with marks among other words go if most of their text is in links. Comments go, unless only links and named
        parts would be left and the densest subtree lies in the comments. Other marks alone go unless the densest subtree of
        what is left lies in them and no article or main part stands outside of them.
        """
        chars, links = self._sizes()
        for i, alone in self.marked:
            if not alone and not self.gone[i] and 2 * links[i] > chars[i]:
                self._take_out(i)
        alone = [i for i, only in self.marked if only and not self.gone[i]]
        said = [i for i in self.said if not self.gone[i]]
        if said:
            chars, links = self._sizes()
            left, upto = chars[0] - links[0], 0
            for i in sorted([*said, *alone]):
                if i >= upto:  # not within another one
                    left -= chars[i] - links[i]
                    upto = self.end[i]
            if left or not any(i <= best < self.end[i] for best in [self._dense()] for i in said):
                for i in said:
                    self._take_out(i)
        if alone:
            chars, best = self._sizes()[0], self._dense()
            parts = [i for i, t in enumerate(self.tag) if t in ("article", "main") and chars[i] and not self.gone[i]]
            for i in alone:
                outside = any(j >= self.end[i] or self.end[j] <= i for j in parts)
                if not self.gone[i] and (outside or not i <= best < self.end[i]):
                    self._take_out(i)

    def _sizes(self) -> tuple[list[int], list[int]]:
        """Characters of each subtree, and those in links."""
        n = len(self.tag)
        chars, links, in_link = [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
        for node, text in self.parts:
            if text and not self.gone[node]:
                size = len(" ".join(text.split()))
                chars[node] += size
                links[node] += size * in_link[node]
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            links[self.parent[i]] += links[i]
        return chars, links

    def _open(self, tag: str, attrs: str, stack: list[int]) -> int:
        up, node = stack[-1], len(self.tag)
        inside = self.inside[up] or tag == "article"
        self.tag.append(tag)
        self.parent.append(up)
        self.end.append(node + 1)
        self.inside.append(inside)
        dropped = _dropped(tag, attrs, inside)
        if (dropped is None or (tag == "article" and attrs)) and _made_of(COMMENTS, tag, attrs, inside):
            self.said.append(node)
        elif dropped is None:
            self.marked.append((node, _made_of(MARKS | MARKS_OUTSIDE, tag, attrs, inside)))
        self.gone.append(self.gone[up] or bool(dropped))
        return node

    def _build(self, source: str) -> None:
        stack, tag_of, at, parts = [0], self.tag, 0, self.parts
        opened: dict[str, int] = {}  # how many elements of a name are open
        blocks: list[int] = []  # depths of the open blocks
        where: dict[str, list[int]] = {t: [] for t in BLOCK}  # and by name

        def deepest(kinds: set[str]) -> int:
            return max((where[k][-1] for k in kinds if where.get(k)), default=0)

        def close(depth: int) -> None:
            while len(stack) > depth:
                self.end[node := stack.pop()] = len(tag_of)
                if tag_of[node] in BLOCK:
                    parts.append((node, None))
                    if node:
                        where[tag_of[node]].pop()
                opened[tag_of[node]] = opened.get(tag_of[node], 1) - 1
            while blocks and blocks[-1] >= depth:
                blocks.pop()

        while (m := _TAG.search(source, at)) is not None:
            if m.start() > at and not self.gone[stack[-1]]:
                parts.append((stack[-1], source[at : m.start()]))
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, ending = name.lower(), m[1] or m[4]
            if ending:
                if opened.get(tag):
                    depth = len(stack) - 1
                    while tag_of[stack[depth]] != tag:
                        depth -= 1
                    close(depth)
                continue
            if tag in BLOCK and blocks and tag_of[stack[blocks[-1]]] == "p":  # a block ends an open paragraph
                close(blocks[-1])
            if tag in CLOSES:
                same, stop = CLOSES[tag]
                while (depth := deepest(same)) > deepest(stop):
                    close(depth)
            attrs = m[3] or m[6] or ""
            node = self._open(tag, attrs, stack)
            if tag in BLOCK or tag == "br":
                parts.append((node, None if tag in BLOCK else " "))
            if tag in VOID or attrs.endswith("/"):
                continue
            if tag in RAW:
                stop = RAW[tag].search(source, at)
                at = stop.end() if stop else len(source)
                continue
            if tag in BLOCK:
                blocks.append(len(stack))
                where[tag].append(len(stack))
            opened[tag] = opened.get(tag, 0) + 1
            stack.append(node)
        if at < len(source) and not self.gone[stack[-1]]:
            parts.append((stack[-1], source[at:]))
        close(0)

    def densities(self) -> tuple[list[float], list[float]]:
        """Density and density sum of every node; 0 for nodes taken out."""
        n = len(self.tag)
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
        for node, text in self.parts:
            if text and not self.gone[node]:
                size = len(" ".join(text.split()))
                chars[node] += size
                links[node] += size * in_link[node]
        for i in range(n - 1, 0, -1):
            if not self.gone[i]:
                up = self.parent[i]
                chars[up] += chars[i]
                links[up] += links[i]
                tags[up] += tags[i] + 1
                link_tags[up] += link_tags[i] + (self.tag[i] == "a")
        body = self.tag.index("body") if "body" in self.tag else 0
        share = links[body] / max(chars[body], 1)
        density, total = [0.0] * n, [0.0] * n
        for i in range(n):
            if self.gone[i] or not chars[i]:
                continue
            c, t, lc, lt = chars[i], max(tags[i], 1), max(links[i], 1), max(link_tags[i], 1)
            plain = max(c - links[i], 1)
            base = math.log(c / plain * links[i] + share * c + math.e)
            value = max(c / lc * t / lt, 1.0)
            density[i] = c / t * (math.log(value) / math.log(base) if base > 1 + 1e-9 else math.log(value + 1))
            if i:
                total[self.parent[i]] += density[i]
        return density, total

    def _dense(self, found: tuple[list[float], list[float]] | None = None) -> int:
        """The node with the largest density sum; -1 if there is no text."""
        density, total = found or self.densities()
        alive = (i for i in range(len(self.tag)) if not self.gone[i] and density[i] > 0)
        return max(alive, key=lambda i: (total[i], density[i], -i), default=-1)

    def main(self) -> list[tuple[int, int]]:
        """Node ranges [first, end) that make up the article."""
        density, total = self.densities()
        best = self._dense((density, total))
        if best < 0:
            return []
        alive = [i for i in range(len(self.tag)) if not self.gone[i] and density[i] > 0]
        path = [best, *self._path(self.parent[best])] if best else [0]
        chars, links = self._sizes()
        for kind in ("article", "main"):
            around = [i for i in path if self.tag[i] == kind]
            if around:  # the dense subtree stands in a marked part: that is the article's extent
                return [(around[-1], self.end[around[-1]])]
            within = [i for i in alive if self.tag[i] == kind and best < i < self.end[best]]
            outer = []
            for i in within:
                if not outer or i >= self.end[outer[-1]]:
                    outer.append(i)
            if 2 * sum(chars[i] for i in outer) > chars[best]:  # it holds marked parts, and most of its text is in them
                return [(i, self.end[i]) for i in outer]
        body = next((i for i in path if self.tag[i] == "body"), path[-1])
        path = path[: path.index(body) + 1]
        threshold = min(density[i] for i in path)
        on_path, out = set(path), [(best, self.end[best])]
        beside: dict[int, list[int]] = {up: [] for up in path[1:]}
        for child in range(1, len(self.tag)):
            if self.parent[child] in beside and not self.gone[child]:
                beside[self.parent[child]].append(child)
        for up, children in beside.items():
            also = PARAGRAPH if self.tag[best] in PARAGRAPH and up == self.parent[best] else ()

            def belongs(c: int) -> bool:
                if self.tag[c] in also or self.tag[c] not in BLOCK:  # noqa: B023
                    return 2 * links[c] <= chars[c]
                return self.tag[c] in HEADINGS or density[c] >= threshold

            own = [c in on_path or belongs(c) for c in children]
            first, last = own.index(True), len(own) - 1 - own[::-1].index(True)
            for k, child in enumerate(children):  # what stands between kept siblings stays unless it is mostly links
                if child not in on_path and (own[k] or (first < k < last and 2 * links[child] <= chars[child])):
                    out.append((child, self.end[child]))
        return sorted([*out, *((up, up + 1) for up in path[1:])])  # and text that stands directly on the path

    def _path(self, node: int) -> list[int]:
        out = []
        while node > 0:
            out.append(node)
            node = self.parent[node]
        return out

    def text(self) -> str:
        keep = [False] * len(self.tag)
        for a, b in self.main():
            keep[a:b] = [True] * (b - a)
        blocks: list[list[str]] = [[]]
        for node, text in self.parts:
            if not keep[node] or self.gone[node]:
                if text is None:
                    blocks.append([])
                continue
            if text is None:
                blocks.append([])
            else:
                blocks[-1].append(text)
        lines = (" ".join(htmllib.unescape("".join(b)).split()) for b in blocks if b)
        return "\n".join(x for x in lines if x)


def main_text(source: str | None) -> str:
    """The article's text: one line a block, white space inside a block as one space; empty if there is none."""
    return Page(source).text() if source else ""


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Returns page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    A null or empty html, and a page of menus only, give an empty text. Broken markup never fails: unclosed elements end
    with their parent, and a stray end tag is ignored. Pages are handled one by one without a shuffle, whole however long,
    in time and memory proportional to their length. Rows that repeat a page_id give a row each; further columns go.
    """
    lean_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    schema = StructType([pages.schema["page_id"], pages.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in column(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.mapInArrow(run, schema)


def op9_html_text(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))
