"""HTML extraction by tag-path ratios (operator 2).

A page is read once, tolerantly: comments, raw-text elements and markup go, optional end tags are implied, character references are decoded. Text between two
block boundaries is a block; its tag path is the chain of block elements from the root. For every path of a page the text length, the punctuation and the linked text
of its blocks are summed up and divided by their number. These ratios are smoothed over neighbouring paths in page order, weighted by a Gaussian of
the distance between the paths, and fused into one score, which names of classes, ids and roles that speak of menus, notices, adverts or comments lower a lot; paths at or above a threshold, a share of the scores' standard deviation,
hold content. The elements that contain such paths are the article: all their blocks are returned, short ones as well, except what elements such as nav, footer, aside and form hold, and paths with such
names that the threshold leaves out. Nothing is left out for its score alone within the article.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from graphflow.llm.common import small_batches

#: Elements by their part in a page.
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption header footer nav aside "
    "form fieldset legend address hr details summary center menu dir hgroup search dialog title head".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not text of the page.
MUTE = frozenset("script style template svg iframe canvas audio video head title button select datalist textarea input option".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
ASIDE = frozenset("nav footer aside form menu dialog search".split())
CLOSES_P = BLOCK - {"html", "body", "head", "title", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "li", "dt", "dd", "legend", "summary", "figcaption"}
#: An element ends an open one of the same set, up to the container named.
SIBLINGS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
}
P_SCOPE = frozenset({"table", "td", "th", "caption", "button", "html"})
#: Words of a class, id or role that mark what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertising advertisement adsense banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer masthead "
    "comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations widget toolbar pagination pager copyright skip contentinfo complementary search".split()
)
#: Whole names that mark the head of a site, but not that of an article.
TOP_NAMES = frozenset({"header", "banner", "site-header", "page-header", "main-header", "top-header", "global-header", "site-banner"})

#: What is not closed ends its search at the next bracket.
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_MARKS = re.compile(r"[.,;:!?。，、；：！？…]")


#: Factor of a score for names that mark what is not the article, and steps between paths beyond which they don't touch each other.
DOUBT, FAR = 0.02, 8
HEADINGS = frozenset({"h1", "h2", "h3"})
PARTS = frozenset("section ul ol dl table thead tbody tfoot tr li dt dd td th".split())


class Page:
    """Blocks of one page: text, linked characters, path number and whether an element above sets them aside; for each path its parent, tag, doubt and the outermost article above."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, int, bool]] = []
        self.parent, self.depth, self.tag, self.doubt, self.top = [-1], [0], [""], [False], [-1]
        self._known: dict[tuple[int, str, bool], int] = {}
        self._open: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, path, aside, mute
        self._count: Counter = Counter()
        self._text: list[str] = []
        self._linked, self._links = 0, 0
        self._read(html)
        self._flush()

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            _, path, aside, mute = self._open[-1]
            if text and not mute:
                self.blocks.append((text, min(self._linked, len(text)), path, aside))
            self._text = []
        self._linked = 0

    def _push(self, tag: str, attributes: str) -> None:
        _, above, aside, mute = self._open[-1]
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower().split() if attributes else []
        within = self.top[above] >= 0
        # inside an article only whole names count, and never those of headings
        words = set(names) if within else {w for n in names for w in _WORD.findall(n)}
        doubt = bool(words & ASIDE_WORDS) and tag not in ("html", "body", "article", "main") and not (within and tag in HEADINGS)
        doubt = doubt or not within and bool(TOP_NAMES & set(names)) and tag not in ("html", "body")
        label = f"{tag}.{names[0]}" if names else tag
        path = self._known.get((above, label, doubt))
        if path is None:
            path = self._known[above, label, doubt] = len(self.parent)
            self.parent.append(above)
            self.depth.append(self.depth[above] + 1)
            self.tag.append(tag)
            self.doubt.append(doubt or self.doubt[above])
            self.top.append(self.top[above] if within else path if tag in ("article", "main") else -1)
        off = tag in ASIDE or tag == "header" and not within
        self._open.append((tag, path, aside or off, mute or tag in MUTE or bool(attributes) and _HIDDEN.search(attributes) is not None))
        self._count[tag] += 1

    def _pop(self, to: int) -> None:
        for tag, *_ in self._open[to:]:
            self._count[tag] -= 1
        del self._open[to:]

    def _close(self, wanted, stop) -> None:
        """End the innermost open element among ``wanted`` unless one of ``stop`` is nearer."""
        if not any(self._count[t] for t in wanted):
            return
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] in wanted:
                self._pop(k)
                return
            if self._open[k][0] in stop:
                return

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            m = _TOKEN.search(html, at)
            self._say(html[at : m.start()] if m else html[at:])
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self._say(m[0][9:].removesuffix("]]>"))
                continue
            closing, attributes = m[1] or m[4], (m[3] if m[2] else m[6]) or ""
            if tag in RAW and not closing:
                stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
                at = stop.end() if stop else end
                continue
            if tag == "br":
                self._text.append(" ")
            elif tag == "a":
                self._links = 0 if closing else 1
            elif tag in BLOCK or tag in MUTE and tag not in VOID:
                self._flush()
                self._links = 0
                if closing:
                    self._close({tag}, ())
                    continue
                if self._open[-1][0] == "head" and tag not in MUTE:  # its end tag is optional
                    self._pop(len(self._open) - 1)
                if tag in CLOSES_P:
                    self._close({"p"}, P_SCOPE)
                if tag in SIBLINGS:
                    self._close(*SIBLINGS[tag])
                if tag not in VOID:
                    self._push(tag, attributes)

    def _say(self, raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            self._text.append(text)
            if self._links:
                self._linked += len(text.strip())

    def distance(self, a: int, b: int) -> int:
        """Steps between two paths in the tree of paths, or FAR if they are more."""
        steps = 0
        while a != b and steps < FAR:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            steps += 1
        return steps


def path_scores(page: Page, reach: int = 2) -> dict[int, float]:
    """Fused score of every path that has a block which is not set aside."""
    sums: dict[int, list[float]] = {}
    for text, linked, path, aside in page.blocks:
        if not aside:
            s = sums.setdefault(path, [0, 0, 0, 0])
            for k, v in enumerate((1, len(text), len(_MARKS.findall(text)), linked)):
                s[k] += v
    order = list(sums)
    raw = [(c / n * (1 - l / c), (p + 1) / n) for n, c, p, l in sums.values()]
    out = {}
    for i, path in enumerate(order):
        near = [(math.exp(-(page.distance(path, order[j]) ** 2) / 2), raw[j]) for j in range(max(0, i - reach), min(len(order), i + reach + 1))]
        total = sum(w for w, _ in near)
        length, marks = (sum(w * r[k] for w, r in near) / total for k in (0, 1))
        out[path] = length * math.log1p(marks) * (DOUBT if page.doubt[path] else 1) if raw[i][0] > 0 else 0.0
    return out


def content_paths(scores: dict[int, float], share: float) -> set[int]:
    """Paths at or above ``share`` standard deviations, and the best one."""
    mean = sum(scores.values()) / len(scores)
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores.values()) / len(scores))
    best = max(scores.values())
    return {p for p, s in scores.items() if s >= min(share * spread, best) and s > 0 or s == best}


def main_text(html: str | None, share: float = 0.8) -> str:
    """The article's blocks in page order, one a line; empty if there are none."""
    page = Page(html or "")
    scores = path_scores(page)
    if not scores:
        return ""
    chosen = content_paths(scores, share)
    base = [0] * len(page.parent)  # the element around lists, tables and sections
    for p in range(1, len(base)):
        base[p] = base[page.parent[p]] if page.tag[p] in PARTS else p
    roots = set()
    for p in chosen:
        root = page.top[p]
        if root < 0:
            root = base[page.parent[p]]
        roots.add(root)
    inside = [False] * len(page.parent)
    for p in range(len(inside)):  # parents come first
        inside[p] = p in roots or p > 0 and inside[page.parent[p]]
    keep = [not aside and (path in chosen or inside[path] and not page.doubt[path]) for _, _, path, aside in page.blocks]
    if True in keep:  # a title may stand above the element that holds the text
        first = keep.index(True)
        for i in range(first - 1, max(-1, first - 4), -1):
            _, _, path, aside = page.blocks[i]
            if aside or page.doubt[path]:
                break
            keep[i] = page.tag[path] in HEADINGS
    return "\n".join(text for (text, *_), k in zip(page.blocks, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (main text) and n_chars (its code points) of every row of ``pages`` (page_id, url, html).

    A null or empty html, or one without content, gives an empty text. Repeated rows are extracted each, and so do repeated ids; paths with equal scores are chosen alike. Tags that are not
closed, nesting of any depth and very long pages cost time in proportion to the page. Other columns are ignored.
    """
    small_batches(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def rows(batches):
        for b in batches:
            texts = [main_text(h) for h in pc.fill_null(b.column("html"), "").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(rows, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
