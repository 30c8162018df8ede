"""The main text of web pages by tag-path ratios.

A page is read as a stream of tags with the implied ends of HTML, which gives each run of text
between block tags its root-to-leaf path of block tags; inline tags belong to their block.
Text length, link text and punctuation are summed per path of the page. A path's ratio is its
text and punctuation per node; it is smoothed with the mean of the paths under the same parent
(weighted by text), fused with how the path lies in the page (inside an article or main part,
or outside while such a part exists) and compared with a share of the page's mean. Paths that
the markup itself calls menus, headers, forms, comments and so on score nothing, unless an
element so named holds the main element, or an article and most of the page's text.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmetrics.llm.common import slices, table, text_arg

# Names that HTML gives its elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"},
    "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tbody": {"tbody", "tfoot", "thead"},
    "thead": {"tbody", "tfoot", "thead"}, "tfoot": {"tbody", "tfoot", "thead"}, "p": CLOSES_P,
}
#: The open elements that a start tag ends.
ENDS = {tag: {was for was, by in CLOSED_BY.items() if tag in by} for tag in set().union(*CLOSED_BY.values())}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}}
WALLS = set("table td th caption button object template html".split())

#: Elements and words of class, id and role whose text is no main text.
ASIDE_TAGS = set(
    "head nav header footer aside form script style noscript template button select option textarea label fieldset svg canvas "
    "iframe video audio object dialog menu title math datalist".split())
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner sidebar aside "
    "complementary menu nav navbar navigation breadcrumb breadcrumbs footer masthead contentinfo cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus "
    "reply replies respond related recommended share sharing social widget toolbar pager pagination search form "
    "copyright disclaimer skip".split())
TOP_WORDS = {"header", "top"}
BODY_WORDS = set("article entry post content story body main".split())
#: A class with one of these words says how the page looks, not what the element is: has-sidebar, comments-open.
STATE_WORDS = set("has no not without is are open opened closed enabled disabled".split())
#: Words of what readers write; an element with one is never taken for the article.
READER_WORDS = set("comment comments disqus reply replies respond".split())
#: Tags that may stand in a head; any other ends it.
HEAD_TAGS = set("head base link meta script style title template noscript".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PIECES = re.compile(r"[a-z]+", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PUNCT = re.compile(r"[.,;:!?…。、，！？；：]")

SHARE = 0.7  # of the page's mean score, which a path must reach
OUTSIDE = 0.5  # of its score is left to a path outside an article while the page has one


HARD, SOFT = 2, 1
MOST = 0.5  # of the page's unlinked text, which an element named like an aside must exceed to be the article after all


def set_apart(tag: str, attrs: str) -> tuple[int, set[str]]:
    """How the element says that it is no main text (0: not at all, SOFT: by a name, HARD), and its names' words."""
    kind = SOFT if tag == "form" else HARD if tag in ASIDE_TAGS else 0
    words: set[str] = set()
    if kind == HARD or not attrs or tag in ("html", "body"):
        return kind, words
    for m in NAMES.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return HARD, words
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return HARD, words
        elif name != "aria-hidden":
            for one in value.split():
                parts = {w.lower() for w in PIECES.findall(CAMEL.sub(" ", one))}
                if not parts & STATE_WORDS:
                    words |= parts
    if tag == "main":
        return 0, words
    if words & ASIDE_WORDS or words & TOP_WORDS and not words & BODY_WORDS:
        kind = SOFT
    return kind, words


class Page:
    """The text runs of a page, its tag paths as linked nodes and the elements named like asides.

    A path is the number of its node: `parent`, `tag`, `part` (the first article or main element on
    the path, 0 if none) and `deep` (whether an element other than html and body is on it) are lists
    over nodes, of which 0 is the page. An element named like an aside is the number of its row in
    `named`: its parent there, whether it holds a main element, whether it holds or is an article
    or is named like one, whether readers write it, the body mark around it, its unlinked text.
    """

    def __init__(self) -> None:
        self.parent, self.tag, self.part, self.deep = [0], [""], [0], [False]
        self.node: dict[tuple[int, str], int] = {}
        self.named: list[list] = [[0, False, False, False, 0, 0]]
        self.marked: list[int] = [0]  # unlinked text in each outermost element that is an article by tag or name
        self.runs: list[tuple[int, int, str, int]] = []  # path, aside (-1: set apart for certain), text, linked characters

    def below(self, path: int, tag: str) -> int:
        """The path one element longer."""
        key = (path, tag)
        if key not in self.node:
            self.node[key] = n = len(self.parent)
            self.parent.append(path)
            self.tag.append(tag)
            self.part.append(self.part[path] or (n if tag in ("article", "main") else 0))
            self.deep.append(self.deep[path] or tag not in ("html", "body"))
        return self.node[key]

    def main_runs(self) -> list[tuple[int, str, int]]:
        """Runs that aren't set apart, after names are overruled: path, text, linked characters.

        An element named like an aside is the article after all if it holds the main element, or if it
        holds an article (or is one, or has a name like one), has most of the page's unlinked text, isn't
        written by readers and no other article stands beside it.
        """
        named = self.named
        for at in range(len(named) - 1, 0, -1):  # an element comes after those around it
            up, holds_main, holds_article, readers, _, size = named[at]
            if up:
                named[up][1] |= holds_main and not readers
                named[up][2] |= holds_article and not readers
                named[up][5] += size
        total = sum(max(0, len(t) - k) for _, aside, t, k in self.runs if aside >= 0)
        marked = sum(self.marked)
        apart = [False] * len(named)
        for at, (up, holds_main, holds_article, readers, mark, size) in enumerate(named):
            if at:
                beside = marked - (self.marked[mark] if mark else 0)
                over = not readers and (holds_main or holds_article and size > MOST * total and not beside)
                apart[at] = apart[up] or not over
        return [(path, t, k) for path, aside, t, k in self.runs if aside >= 0 and not apart[aside]]


def read_page(html: str) -> Page:
    """The page's runs; work is linear in its length, however deep elements are nested."""
    page = Page()
    # Of each open element: tag, inline, kind, path, aside around the text in it, mark around it.
    stack: list[tuple[str, bool, int, int, int, int]] = []
    places: dict[str, list[int]] = {}  # where a tag stands in the stack
    walls: list[int] = []
    run: list[str] = []
    hard = links = linked = at = 0

    def close_run() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                _, _, _, path, aside, mark = stack[-1] if stack else ("", False, 0, 0, 0, 0)
                page.runs.append((path, -1 if hard else aside, text, linked))
                if not hard:
                    size = max(0, len(text) - linked)
                    if aside:
                        page.named[aside][5] += size
                    elif mark:
                        page.marked[mark] += size
            run.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = references.unescape(raw) if "&" in raw else raw
            if stack and stack[-1][0] == "head" and text.strip():
                pop_to(len(stack) - 1)
            run.append(text)
            if links:
                linked += len(text)

    def pop_to(i: int) -> None:
        nonlocal hard, links
        if any(not inline or kind for _, inline, kind, _, _, _ in stack[i:]):
            close_run()
        while len(stack) > i:
            tag, _, kind, _, _, _ = stack.pop()
            places[tag].pop()
            hard -= kind == HARD
            links -= tag == "a"
            if tag in WALLS:
                walls.pop()

    def push(tag: str, inline: bool, kind: int, words: set[str]) -> None:
        nonlocal hard, links
        _, _, _, path, aside, mark = stack[-1] if stack else ("", False, 0, 0, 0, 0)
        if not hard and kind != HARD:
            like = tag == "article" or bool(words & BODY_WORDS)
            if kind == SOFT:
                page.named.append([aside, False, like, bool(words & READER_WORDS), mark, 0])
                aside = len(page.named) - 1
            elif tag in ("main", "article") and aside:
                page.named[aside][1 if tag == "main" else 2] = True
            elif (like or tag == "main") and not aside and not mark and tag not in ("html", "body"):
                page.marked.append(0)
                mark = len(page.marked) - 1
        places.setdefault(tag, []).append(len(stack))
        if tag in WALLS:
            walls.append(len(stack))
        stack.append((tag, inline, kind, path if inline else page.below(path, tag), aside, mark))
        hard += kind == HARD
        links += tag == "a"

    def last(tags) -> int:
        """Where the innermost open element of these tags stands, -1 if none is open."""
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    while at < len(html):
        m = TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at: m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag, ending, attrs = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if ending:
            if tag == "br":
                run.append(" ")
                continue
            i = last((tag,))
            through = tag in WALLS or tag in ("body", "tr", "tbody")
            if i >= 0 and (through or not walls or i > walls[-1]):
                pop_to(i)
            continue
        if tag not in HEAD_TAGS and tag not in VOID and places.get("head"):
            i = places["head"][-1]
            if not walls or i > walls[-1]:
                pop_to(i)
        if tag in VOID:
            if tag not in INLINE:
                close_run()
            elif tag == "br":
                run.append(" ")
            continue
        while (i := last(ENDS.get(tag, ()))) >= 0 and i >= last(SCOPE.get(tag, ())) and (not walls or i >= walls[-1]):
            was = stack[i][0]
            pop_to(i)
            if was not in ("th", "td"):
                break
        kind, words = set_apart(tag, attrs)
        inline = tag in INLINE
        if not inline or kind:
            close_run()
        if tag in RAW:
            # Raw text ends only at its own end tag.
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if not kind:
                push(tag, inline, kind, words)
                add(html[at: end.start() if end else len(html)])
                pop_to(len(stack) - 1)
            at = end.end() if end else len(html)
            continue
        if not attrs.rstrip().endswith("/") or tag not in ("svg", "path", "use"):
            push(tag, inline, kind, words)
    close_run()
    return page


def path_scores(page: Page, runs: list[tuple[int, str, int]]) -> dict[int, float]:
    """The fused and smoothed ratio of each path of the runs."""
    sums: dict[int, list[float]] = {}
    for path, text, linked in runs:
        s = sums.setdefault(path, [0.0, 0.0, 0.0, 0.0])
        s[0] += 1
        s[1] += max(0, len(text) - linked)
        s[2] += min(linked, len(text))
        s[3] += len(PUNCT.findall(text))
    raw = {p: (math.log1p(t / n) + math.log1p(marks / n)) * (t / (t + l) if t + l else 0)
           for p, (n, t, l, marks) in sums.items()}
    near: dict[int, list[float]] = {}
    for p, (_, t, _, _) in sums.items():
        x = near.setdefault(page.parent[p], [0.0, 0.0])
        x[0] += t * raw[p]
        x[1] += t
    inside = any(page.part[p] for p in sums)
    out = {}
    for p in sums:
        beside, all_t = near[page.parent[p]]
        smooth = 0.5 * raw[p] + 0.5 * (beside / all_t if all_t else 0)
        out[p] = smooth * (OUTSIDE if inside and not page.part[p] else 1.0)
    return out


def main_text(html: str) -> str:
    page = read_page(html)
    runs = page.main_runs()
    scores = path_scores(page, runs)
    weight: dict[int, int] = {}
    for path, text, _ in runs:
        weight[path] = weight.get(path, 0) + len(text)
    total = sum(weight.values())
    if not total:
        return ""
    least = SHARE * sum(scores[p] * w for p, w in weight.items()) / total
    # What stands beside the text in one part of the page belongs to it: short lines, lists.
    good = {p for p in scores if scores[p] >= least}
    parts = {_part(page, p) for p in good} - {0}
    within = [False] * len(page.parent)
    for p in range(1, len(within)):  # a path comes after the one it extends
        within[p] = within[page.parent[p]] or page.parent[p] in parts
    good |= {p for p in scores if scores[p] > 0 and within[p]}
    inside = {c for c in parts if page.tag[c] in ("article", "main")}
    return " ".join(text for p, text, _ in runs if p in good or _part(page, p) in inside)


def _part(page: Page, path: int) -> int:
    """The path up to its first article or main element, else to its parent (0: the body)."""
    up = page.parent[path]
    return page.part[path] or (up if page.deep[up] else 0)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text (main text, blocks in page order), n_chars of every page.

    pages needs page_id, url and html; other columns are not read. Pages are independent:
    repeated pages and ids come back as they are, nulls in page_id and url too. Null or empty
    html, and pages without main text, give an empty text. Long pages are read whole. Empty
    table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                texts = [main_text(h.decode("utf-8", "replace")) for h in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", text_arg("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")


def op2_main_text(spark, sf_dir):
    """Main text of all pages."""
    return extract_main_text(table(spark, sf_dir, "pages"))
