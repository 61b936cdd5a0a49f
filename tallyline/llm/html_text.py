"""Main text of web pages by tag-path ratios.

A page is cut into blocks, each with the path of elements from the root down to it. Text length, link text and
punctuation are added up per path and put in proportion to the path's blocks; the ratios are smoothed along the page, fused
with those of the enclosing container, and the paths above a threshold are the content. Pages are independent of each
other, so the work is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.words import slices

#: A path is content with this share of the best path's score.
THRESHOLD = 0.06
#: What a block under a container (not the body itself) has of the container's ratio.
CONTAINER_SHARE = 0.5

# Fixed values of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p"
    " pre search section summary table tbody td tfoot th thead tr ul".split()
)
IN_HEAD = set("base link meta noscript script style template title".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "option": {"option"},
}
ITEM_SCOPE = {"ul", "ol", "menu", "dl", "table", "select", "td", "th", "div", "article", "section", "main", "body"}
CONTAINER = {"div", "section", "article", "main", "body", "center", "html"}

# Elements and names of what is never the article.
NEVER = set(
    "head script style noscript template nav aside footer form button select textarea datalist fieldset legend label"
    " dialog menu search iframe object applet svg canvas audio video map noframes noembed xmp title".split()
)
ROLES = set(
    "navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert status".split()
)
HINTS = set(
    "ad ads adbox adsense adslot adunit advert adverts advertisement advertising advertorial sponsor sponsored"
    " promo promos promotion banner sidebar sidenav rail menu menus nav navbar navigation navi breadcrumb breadcrumbs"
    " footer masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox"
    " newsletter subscribe subscription signup login register paywall share sharing sharebar social comment comments"
    " commentlist disqus reply replies respond discussion related recommended recommendations pagination pager"
    " toolbar skip hidden".split()
)
ARTICLE_HINTS = set("comment reply ad ads advert advertisement sponsored promo related recommended teaser".split())

ATTRIBUTES = r"""[^>=]*+(?:=(?:\s*"[^"]*"|\s*'[^']*')?+[^>=]*+)*+"""
TOKEN = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))
    |<(?P<raw>script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>]){ATTRIBUTES}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)
    |<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attributes>{ATTRIBUTES})>
    |<[!?/][^>]*(?:>|\Z)
    |<[a-z][^>]*\Z""",
    re.VERBOSE | re.DOTALL | re.IGNORECASE,
)
TELLING = re.compile(
    r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.IGNORECASE
)
NAME_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
PUNCTUATION = re.compile(r"[,.;:!?…،。，、；：！？]")


@lru_cache(1 << 14)
def _names(attributes: str) -> dict[str, str]:
    """The telling attributes of a tag."""
    return {k.lower(): v.strip("\"'") for k, v in TELLING.findall(attributes)}


def _unwanted(tag: str, names: dict[str, str], in_article: bool) -> bool:
    """Whether an element by its kind, role or name holds no part of an article."""
    if tag in NEVER or (tag == "header" and not in_article):
        return True
    if not names or tag in ("html", "body", "main"):
        return False
    hidden = "hidden" in names or names.get("aria-hidden", "").lower() == "true"
    hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", names.get("style", ""), re.IGNORECASE) is not None
    said = {w.lower() for k in ("class", "id") for w in NAME_WORD.findall(names.get(k, ""))}
    roles = set(names.get("role", "").lower().split())
    return hidden or bool(roles & ROLES) or bool(said & (ARTICLE_HINTS if tag == "article" else HINTS))


class _Page:
    """Blocks of one page in order: text, path, container and region, and how much of the text is a link."""

    def __init__(self) -> None:
        self.paths: dict[tuple, int] = {}
        self.blocks: list[tuple[str, int, int, str, int]] = []
        # Open elements: tag, path, container, region, unwanted.
        self.open: list[tuple[str, int, int, str, bool]] = [("", 0, 0, "", False)]
        self.count: dict[str, int] = defaultdict(int)
        self.buffer: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if not self.buffer:
            return
        text = " ".join("".join(self.buffer).split())
        if text:
            _, path, container, region, _ = next(e for e in reversed(self.open) if e[0] in BLOCK or not e[0])
            self.blocks.append((text, path, container, region, min(self.linked, len(text))))
        self.buffer, self.linked = [], 0

    def text(self, piece: str) -> None:
        if self.open[-1][4]:
            return
        piece = unescape(piece) if "&" in piece else piece
        self.buffer.append(piece)
        if self.count["a"]:
            self.linked += len(" ".join(piece.split()))

    def pop(self, to: str) -> None:
        while True:
            tag = self.open.pop()[0]
            self.count[tag] -= 1
            if tag == to:
                return

    def start(self, tag: str, attributes: str) -> None:
        if self.count["head"] and (tag == "body" or tag not in IN_HEAD):
            self.pop("head")
        if tag == "br":
            self.text(" ")
        if tag in BLOCK:
            self.flush()
            if self.count["p"]:
                self.pop("p")
            ends = CLOSED_BY.get(tag, ())
            for k in range(len(self.open) - 1, 0, -1):
                if not ends or self.open[k][0] in ITEM_SCOPE - ends:
                    break
                if self.open[k][0] in ends:
                    self.pop(self.open[k][0])
        if tag in VOID:
            return
        names = {}
        if attributes:
            names = (_names if len(attributes) < 1000 else _names.__wrapped__)(attributes)
        _, path, container, region, unwanted = self.open[-1]
        unwanted = unwanted or _unwanted(tag, names, bool(self.count["article"] or self.count["main"]))
        if tag in BLOCK:
            name = names and (names.get("class") or re.sub(r"\d+", "", names.get("id", "")))
            label = (path, tag, name or "")
            path = self.paths.setdefault(label, len(self.paths) + 1)
            # The body itself is no container to speak of.
            container = (0 if tag in ("body", "html") else path) if tag in CONTAINER else container
            region = tag if tag == "article" or (tag == "main" and region != "article") else region
        self.open.append((tag, path, container, region, unwanted))
        self.count[tag] += 1

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if not self.count[tag]:
            return
        if tag not in BLOCK and tag not in NEVER:
            # An inline element ends within its block only.
            for entry in reversed(self.open):
                if entry[0] == tag:
                    break
                if entry[0] in BLOCK:
                    return
        self.pop(tag)


def blocks(html: str) -> list[tuple[str, int, int, str, int]]:
    """``text, path, container, region, link characters`` of the blocks that may be part of the article."""
    page, at = _Page(), 0
    for token in TOKEN.finditer(html):
        if token.start() > at:
            page.text(html[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag:
            (page.end(tag.lower()) if token["end"] else page.start(tag.lower(), token["attributes"]))
    if at < len(html):
        page.text(html[at:])
    page.flush()
    return page.blocks


def content(found: list[tuple[str, int, int, str, int]]) -> list[str]:
    """The texts of the blocks whose path is content."""
    sums: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
    for text, path, container, _, linked in found:
        marks = len(PUNCTUATION.findall(text))
        for key in (("path", path), ("container", container)):
            total = sums[key]
            total[0] += 1
            total[1] += len(text)
            total[2] += linked
            total[3] += marks
    # Characters outside links, and punctuation marks, for each block of the path; a mark a block is as good as more.
    ratio = {k: ((n_chars - n_linked) / n, min(1.0, marks / n)) for k, (n, n_chars, n_linked, marks) in sums.items()}
    along = [ratio["path", b[1]] for b in found]
    smooth: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for k, b in enumerate(found):
        near = [(2, along[k])] + [(1, along[j]) for j in (k - 1, k + 1) if 0 <= j < len(along)]
        weight, total = sum(w for w, _ in near), smooth[b[1]]
        total[0] += 1
        total[1] += sum(w * r[0] for w, r in near) / weight
        total[2] += sum(w * r[1] for w, r in near) / weight
    score, region = {}, {}
    for _, path, container, place, _ in found:
        if path in score:
            continue
        n, n_chars, marks = smooth[path]
        n_chars, marks = n_chars / n, marks / n
        _, whole, linked, _ = sums["path", path]
        plain = 1 - linked / whole
        if container:
            around = ratio["container", container]
            n_chars, marks = max(n_chars, CONTAINER_SHARE * around[0]), max(marks, around[1])
            plain = max(plain, CONTAINER_SHARE * (1 - sums["container", container][2] / sums["container", container][1]))
        score[path], region[path] = n_chars * (1 + marks) / 2 * plain, place
    if not score:
        return []
    best = max(score, key=lambda p: (score[p], -p))
    # Where the best path lies in an article (or else the main part), the rest of the page does not compete.
    least = THRESHOLD * score[best]
    kept = {p for p in score if score[p] >= least and score[p] > 0 and (not region[best] or region[p] == region[best])}
    return [b[0] for b in found if b[1] in kept]


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    ``text`` holds the article's blocks in page order, joined by a line feed: character references decoded, white space
    inside a block (a line break too) as one space, nothing cut. Menus, page headers, footers, sidebars, notices,
    adverts, forms, comments, scripts and styles are told by their element, role or name; what else is left out has a
    path of short, linked or unpunctuated blocks. Null or empty html, and a page without content, give an empty text; null
    ids and urls stay null; rows that repeat are judged each; an empty table gives an empty result; further columns are
    left out. Broken markup is read as far as it goes. One page is held at a time beyond a slice of pages; its time grows in
    proportion to its length.
    """

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "html"):
            texts = pa.array(["\n".join(content(blocks(x or ""))) for x in piece.column("html").to_pylist()], pa.string())
            n_chars = pc.utf8_length(texts).cast(pa.int64())
            columns = [piece.column("page_id"), piece.column("url"), texts, n_chars]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
