"""Main text of web pages by composite text density."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noframes iframe noembed xmp".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - set("body caption html legend option optgroup tbody td tfoot th thead tr".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = set("ul ol dl table div section article main body html select td th".split())
DROPPED = set(
    "script style head title noscript template nav menu footer aside form button select input textarea label iframe object embed svg canvas audio video map noembed noframes dialog search".split()
)
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# What names of classes and ids say of an element; a sign only, see `Page._judge_names`.
DROPPED_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " footer masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription"
    " share sharing social related recommended widget toolbar pager pagination login signup".split()
)
COMMENT_NAMES = set("comment comments disqus reply replies respond".split())
NEGATING = set("no not non has have with without hide is".split())
#: An element is not left out for its name if less than this part of the page's unlinked text stands elsewhere.
REST, REST_OF_COMMENTS = 0.2, 0.05
#: A list or division in the main text is a menu if so large a part of its characters are links, two or more.
LINKED = 0.6
CONTAINERS = set("ul ol dl div section table details menu dir".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
LANDMARKS = {"article", "main"}


def _names(attributes: str) -> tuple[set[str], set[str], bool]:
    """Class and id names, roles; if the element is hidden."""
    names, roles, hidden = set(), set(), False
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "hidden" or kind == "aria-hidden" and value == "true":
            hidden = True
        elif kind != "aria-hidden":
            (roles if kind == "role" else names).update(value.split())
    return names, roles, hidden


def _tells(names: set[str], of: set[str]) -> bool:
    """If a name is one of ``of``, or starts or ends with one as in ``main-nav``; ``has-sidebar`` and ``no-ads`` tell nothing."""
    for name in names:
        parts = re.split(r"[_-]+", name)
        if (parts[0] in of or parts[-1] in of) and parts[0] not in NEGATING:
            return True
    return False


class Page:
    """The nodes of a page in document order (a subtree is a range of them), what it says, and which nodes are never main text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.off, self.said = ["#root"], [-1], [False], []
        self.names: dict[int, tuple[set[str], set[str]]] = {}
        self._parse(source)
        last = list(range(1, len(self.tag) + 1))
        for i in range(len(self.tag) - 1, 0, -1):
            last[self.parent[i]] = max(last[self.parent[i]], last[i])
        self.end = last
        self._judge_names()

    def _parse(self, source: str) -> None:
        stack, at, n = [0], 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            self._text(stack[-1], source[at : m.start() if m else n])
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self._close(stack, name)
                continue
            attributes = m[3] if m[2] else m[6]
            node = self._open(stack, name, attributes)
            if name in RAW:
                shut = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                self._text(node, source[at : shut.start() if shut else n])
                at = shut.end() if shut else n
                self._pop(stack, node)
            elif name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK:
                self._pop(stack, node)

    def _text(self, node: int, text: str) -> None:
        if text and not self.off[node]:
            self.said.append((node, entities.unescape(text) if "&" in text else text))

    def _open(self, stack: list[int], name: str, attributes: str) -> int:
        if name in CLOSES_P:
            self._pop_to(stack, {"p"}, WALLS)
        if name in SAME:
            self._pop_to(stack, SAME[name], WALLS - SAME[name])
        up, node = stack[-1], len(self.tag)
        names, roles, hidden = _names(attributes) if "=" in attributes or "hidden" in attributes else (set(), set(), False)
        off = self.off[up] or hidden or name in DROPPED and name != "form"
        if name == "header" and not off:
            off = not any(self.tag[k] in LANDMARKS for k in stack)
        if not off and (name == "form" or (names or roles) and name not in ("html", "body", *LANDMARKS, *HEADINGS)):
            self.names[node] = names, roles | {"form"} if name == "form" else roles
        self.tag.append(name)
        self.parent.append(up)
        self.off.append(off)
        if name in BLOCK:
            self.said.append((node, None))
        elif name == "br":
            self.said.append((up, " "))
        stack.append(node)
        return node

    def _pop(self, stack: list[int], node: int) -> None:
        while stack[-1] >= node and len(stack) > 1:
            gone = stack.pop()
            if self.tag[gone] in BLOCK:
                self.said.append((gone, None))

    def _pop_to(self, stack: list[int], names: set[str], walls: set[str]) -> None:
        for k in reversed(stack):
            if self.tag[k] in names:
                return self._pop(stack, k)
            if self.tag[k] in walls:
                return None

    def _close(self, stack: list[int], name: str) -> None:
        for k in reversed(stack[1:]):
            if self.tag[k] == name:
                return self._pop(stack, k)
            if name not in BLOCK and self.tag[k] in WALLS:
                return None

    def counts(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """Characters, linked characters, tags and link tags of each subtree, without what is left out."""
        n = len(self.tag)
        chars, links, tags, link_tags = [0] * n, [0] * n, [0 if x else 1 for x in self.off], [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
            link_tags[i] = int(in_link[i] and not self.off[i])
        for i, text in self.said:
            if text and not self.off[i]:
                size = len(text.strip())
                chars[i] += size
                links[i] += size if in_link[i] else 0
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            for of in (chars, links, tags, link_tags):
                of[p] += of[i]
        return chars, links, tags, link_tags

    def _judge_names(self) -> None:
        """Leaves out subtrees whose name, role or being a form says that they are no main text, unless they hold a landmark, a first
        heading (names only) or nearly all of the unlinked text; one that is left out counts as text nowhere."""
        told = {k: x for k, x in self.names.items() if x[1] & DROPPED_ROLES or _tells(x[0], DROPPED_NAMES | COMMENT_NAMES)}
        if not told:
            return
        chars, links, _, _ = self.counts()
        spoken = [c - x for c, x in zip(chars, links)]
        holding, titled = ({i for i, t in enumerate(self.tag) if t in of} for of in (LANDMARKS, {"h1"}))
        holding, titled = self._above(holding), self._above(titled)
        left, skip = spoken[0], 0
        for k, (names, roles) in sorted(told.items(), key=lambda x: x[0]):
            if k < skip or k in holding or k in titled and not roles & DROPPED_ROLES:
                continue
            least = REST_OF_COMMENTS if _tells(names, COMMENT_NAMES) else REST
            if left - spoken[k] < least * left:
                continue
            left, skip = left - spoken[k], self.end[k]
            self.off[k : skip] = [True] * (skip - k)

    def _above(self, nodes: set[int]) -> set[int]:
        """``nodes`` and all nodes that hold one of them."""
        out = set()
        for k in nodes:
            while k >= 0 and k not in out:
                out.add(k)
                k = self.parent[k]
        return out

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite text density of each node and the sum of its children's: characters per tag, times the logarithm of how few of
        characters and tags are links, to a base that grows where links do."""
        n = len(self.tag)
        chars, links, tags, link_tags = self.counts()
        share = links[0] / chars[0] if chars[0] else 0.0
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            c, lc, t, lt = chars[i], links[i], max(tags[i], 1), link_tags[i]
            if c and not self.off[i]:
                base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
                much = c / max(lc, 1) * (t / max(lt, 1))
                density[i] = max(0.0, c / t * math.log(much) / math.log(base)) if base > 1 and much > 0 else c / t * max(0.0, math.log(max(much, 1.0)))
            if i:
                sums[self.parent[i]] += density[i]
        return density, sums

    def main(self) -> int:
        """The node whose subtree is the main text: of those as dense as the thinnest node between the largest sum and the body,
        take each one's largest-sum node, and then what holds them all, up to the article or main element around it. Where the
        largest sum lies in an article with most of the page's unlinked text, other parts of the page have no say."""
        density, sums = self.densities()
        chars, links, _, _ = self.counts()
        best = max(range(len(sums)), key=lambda i: (sums[i], -i))
        if not sums[best]:
            best = max(range(len(density)), key=lambda i: (density[i], -i))
        path, k = [], best
        while k > 0:
            path.append(k)
            k = self.parent[k]
        for k in path:
            if self.tag[k] == "article" and 2 * (chars[k] - links[k]) > chars[0] - links[0]:
                return k
        inner = [k for k in path if self.tag[k] not in ("html", "body")]
        least = min((density[k] for k in inner), default=0.0)
        top = list(range(len(sums)))
        for i in range(len(sums) - 1, 0, -1):
            p = self.parent[i]
            if sums[top[i]] > sums[top[p]]:
                top[p] = top[i]
        marked = {best} | {top[i] if sums[top[i]] else i for i in range(1, len(sums)) if density[i] and density[i] >= least and links[i] < LINKED * chars[i]}
        holder = best
        while holder > 0 and not all(holder <= m < self.end[holder] for m in marked):
            holder = self.parent[holder]
        for k in path:
            if self.tag[k] in LANDMARKS and (k <= holder or holder == 0):
                return k
        return max(holder, 0)

    def menus(self, node: int) -> list[bool]:
        """Which nodes lie in a list or division below ``node`` that is mostly links."""
        chars, links, _, link_tags = self.counts()
        out = [False] * len(self.tag)
        for i in range(node + 1, self.end[node]):
            out[i] = out[self.parent[i]] or self.tag[i] in CONTAINERS and link_tags[i] > 1 and links[i] >= LINKED * chars[i] > 0
        return out

    def text(self) -> str:
        node = self.main()
        menu = self.menus(node)
        blocks, piece = [], []
        for i, said in self.said:
            if not node <= i < self.end[node]:
                continue
            if said is None:
                if piece and (line := " ".join("".join(piece).split())):
                    blocks.append(line)
                piece = []
            elif not self.off[i] and not menu[i]:
                piece.append(said)
        if piece and (line := " ".join("".join(piece).split())):
            blocks.append(line)
        return "\n".join(blocks)


def main_text(source: str | None) -> str:
    """Main text of a page; empty for null, empty and text-free pages. Memory is a few times the page's own size."""
    return Page(source).text() if source else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row for each input row, whole pages, no shuffle.

    A null page counts as empty; null ids and urls and repeated rows stay as they are; other columns are ignored, whatever their
    names. Empty input: no rows. Long pages are read whole; a task holds one batch of pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return narrow.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op2_html(spark, sf_dir: str) -> DataFrame:
    """Contract: page_id, url, text, n_chars."""
    return extract_pages(table(spark, sf_dir, "pages"))
