"""Main text of web pages by the distribution of text over lines.

Mark-up is stripped so that every block keeps a line of its own and what is never article text
(navigation, scripts, forms, notices, reader comments, ...) leaves empty lines.  Text lengths are
summed over a sliding window of lines; text surges where a sum rises over a threshold, dives where
it falls to nothing, and the lines between are kept.  Lines inside an article or main element weigh
more: there any text surges, and text outside must be as dense as the densest inside.  Where text outside is
far denser, such elements are teasers and weigh nothing.  Short lines between kept ones of the
same container stay.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import quoted

WINDOW = 3
THRESHOLD = 60  # code points in a window where text surges
GAP = WINDOW  # empty lines left by a stripped element: enough for every window sum to reach zero

TEASER = 4  # times the densest text of marked elements, from where text outside is the main one

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<title\b[^>]*>[^<]*(?:</title\s*>)?|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S | re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav header footer aside form menu dialog button select option fieldset object svg noscript template head".split())
IN_HEAD = frozenset("meta link base script style title noscript template".split())  # whatever else begins ends the head
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure "
                    "figcaption center address details summary".split())
# Words of class names, ids and roles, parts of compound names among them, that tell what is not article text ...
HINT = re.compile(
    r"nav|navbar|navigation|menus?|menubar|breadcrumbs?|sidebar|header|footer|masthead|ads?|adverts?|advertisements?|advertising|"
    r"sponsor|sponsored|promos?|promoted|promotion|banner|cookies?|consent|gdpr|notice|newsletter|subscribe|subscription|popup|modal|"
    r"comments?|respond|replies|disqus|share|sharing|social|related|recommended|recommendations|pagination|pager|widgets?|toolbar|"
    r"login|signup|search|contentinfo|complementary")
# ... and words that may stand beside them in a compound name.
BESIDE = re.compile(
    r"\d+|site|page|top|bottom|left|right|main|primary|secondary|global|mobile|list|item|items|links?|box|bar|slot|container|wrapper|"
    r"wrap|section|block|area|inner|outer|unit|panel|text|message|form|buttons?|icons?|group|post|posts|user|reader|the|side|bread|crumbs")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PARTS = re.compile(r"[-_:]+")
SPACE = re.compile(r"\s+")
CLOSES = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"),
          "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
MAIN = frozenset(("article", "main"))


def hinted(rest: str) -> bool:
    """Whether a whole name among an element's classes, id and role says that it is not article text."""
    for m in NAMES.finditer(rest):
        for name in m[1].strip("\"'").lower().split():
            parts = [x for x in PARTS.split(name) if x]
            hints = [bool(HINT.fullmatch(x)) for x in parts]
            if any(hints) and all(hint or BESIDE.fullmatch(x) for hint, x in zip(hints, parts)):
                return True
            if name in ("side-bar", "bread-crumbs"):
                return True
    return False


def boilerplate(tag: str, rest: str, inside_main: bool) -> bool:
    """Whether an element never holds article text.

    A header inside the article holds its title; body, article and main are never set aside, nor are a
    main part's own paragraphs and lists, whatever their names.
    """
    if tag in MAIN or tag in ("html", "body") or tag in INLINE:
        return False
    if tag in ASIDE:
        return not (tag == "header" and inside_main)
    return not (inside_main and tag in TEXTUAL) and hinted(rest)


@dataclass
class Line:
    text: str = ""
    container: int = 0  # number of the innermost element around it that is not a paragraph, list or table
    main: bool = False


def to_lines(page: str) -> list[Line]:
    """Text of each block in page order, and runs of ``GAP`` empty lines for what is stripped and at the
    ends of marked elements."""
    lines: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = []
    skip, main, elements = 0, 0, 0

    def close_block() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            lines.append(Line(text, next((n for tag, _, n in reversed(stack) if tag not in TEXTUAL), 0), main > 0))

    def gap() -> None:
        close_block()
        lines.extend(Line() for _ in range(GAP))

    def pop() -> None:
        nonlocal skip, main
        if stack[-1][0] in MAIN and not skip:
            gap()
        name, aside, _ = stack.pop()
        if aside:
            skip -= 1
            gap()
        elif name in MAIN:
            main -= 1

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at and not skip:
            parts.append(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if m["raw"] and not skip:
            gap()
        if not tag:
            continue
        if m["end"]:
            if any(name == tag for name, _, _ in stack):
                if not skip and tag not in INLINE:
                    close_block()
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag not in INLINE and not skip:
                close_block()
            continue
        if stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            pop()
        if tag not in INLINE and not skip:
            close_block()
        if tag in VOID:
            continue
        for name in CLOSES.get(tag, ()):
            if stack and stack[-1][0] == name:
                pop()
        aside = boilerplate(tag, m["rest"], main > 0)
        if aside:
            if not skip:
                gap()
            skip += 1
        elif tag in MAIN:
            if not skip:
                gap()
            main += 1
        if aside or tag not in INLINE:
            elements += 1
            stack.append((tag, aside, elements))
    if not skip:
        parts.append(page[at:])
        close_block()
    return lines


def surges(lengths: list[int], window: int) -> list[tuple[int, int, int]]:
    """Runs of lines [surge, dive) whose window sums stay above nothing, each with its greatest sum.

    Window i sums lines i .. i + window - 1.  A run begins at the first line with text after
    sums of zero and ends where the sum falls to zero again.
    """
    out, start, best = [], None, 0
    total = sum(lengths[:window])
    for i in range(len(lengths)):
        if lengths[i] and start is None:
            start, best = i, 0
        if start is not None:
            if total == 0:
                out.append((start, i, best))
                start = None
            best = max(best, total)
        total += (lengths[i + window] if i + window < len(lengths) else 0) - lengths[i]
    if start is not None:
        out.append((start, len(lengths), best))
    return out


def kept_runs(lines: list[Line], window: int, threshold: int) -> list[tuple[int, int]]:
    """Runs that surge over their threshold, and what lies between such runs of one container."""
    lengths = [len(x.text) for x in lines]
    runs = surges(lengths, window)
    inside = [lines[a].main for a, _, _ in runs]
    top = {where: max((best for (_, _, best), x in zip(runs, inside) if x == where), default=0) for where in (True, False)}
    teasers = top[False] > TEASER * top[True]
    least = {True: max(threshold, top[False] // TEASER) if teasers else 1, False: threshold if teasers else max(threshold, top[True])}
    kept = [best >= least[x] for (_, _, best), x in zip(runs, inside)]
    if runs and not any(kept):
        most = max(range(len(runs)), key=lambda i: (sum(lengths[runs[i][0]:runs[i][1]]), -i))
        kept[most] = True
    ends: dict[int, tuple[int, int]] = {}
    for i, (a, b, _) in enumerate(runs):
        if kept[i]:
            for line in lines[a:b]:
                if line.text:
                    ends[line.container] = (ends.get(line.container, (i, i))[0], i)
    return [(a, b) for i, (a, b, _) in enumerate(runs) if kept[i] or any(
        line.text and line.container in ends and ends[line.container][0] < i < ends[line.container][1] for line in lines[a:b])]


def main_text(page: str, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    """The kept lines of a page, joined by line feeds.

    In an article or main element any text surges, elsewhere a run must reach the threshold, and the
    densest text of such elements; where nothing does, the run with most text is kept, the first of equal ones.
    """
    lines = to_lines(page)
    return "\n".join(x.text for a, b in kept_runs(lines, window, threshold) for x in lines[a:b] if x.text)


def extract_text(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html",
                 window: int = WINDOW, threshold: int = THRESHOLD) -> DataFrame:
    """``page_id, url, text, n_chars`` per page; no shuffle.

    Null, empty and text-free pages give an empty text; repeated rows are extracted each; an
    empty table gives an empty table; other columns are not read.  Pages are read whole, very long ones
    too; of equally long runs in a page where nothing surges the first is kept.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, window, threshold) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(quoted(id_column).cast("long").alias("page_id"), quoted(url).cast("string").alias("url"),
                        F.coalesce(quoted(html).cast("string"), F.lit("")).alias("page"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
