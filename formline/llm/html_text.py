"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import bisect
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import ship

ship(__name__)

#: Elements of raw text, which run to the page's end where the end tag is missing, and elements whose content is no text of the page.
_RAW = frozenset("script style textarea title".split())
_SILENT = frozenset("template noscript svg iframe object select button head".split())
#: Elements that stand inside a line; all others begin and end one.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold menus, headers, sidebars, forms. A main element inside a form or dialog is text all the same.
_AROUND = frozenset("nav header footer aside form menu dialog fieldset".split())
_MAIN = frozenset(("article", "main"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold others; what a paragraph or a heading is called says less, and its id is a target of links.
_HOLDERS = frozenset("div section ul ol dl table figure center details article main".split()) | _AROUND
#: Names of adverts, other pages' texts and readers' comments, whatever is inside.
_FOREIGN = re.compile(r"ads?|advert\w*|banner|sponsor\w*|promo\w*|related|recommend\w*|comments?|replies|disqus")
#: Names of what stands around the text; they also name wrappers of the whole page, if a main element is inside.
_LAYOUT = re.compile(
    r"cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|sidebar|side|widget|menu|nav\w*|breadcrumbs?|header|masthead|footer|foot|"
    r"share|sharing|social|login|search|complementary|contentinfo"
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"(/?)([a-zA-Z][\w:-]*)")
_STOP = re.compile("[\"'>]")
_CLOSES = re.compile(r"</(template|noscript|svg|iframe|object|select|button|head)\b|<(body)\b", re.I)
#: Elements that end where a like one, or for a paragraph any other block, begins.
_OPEN_ENDED = frozenset("p li dt dd tr td th option".split())
PLAIN, INSIDE, SUSPECT, AROUND = range(4)


def tokens(page: str):
    """(text before, closing, name, attributes) for each tag, in one pass: no place of a page is looked at more than a fixed few times.

    Comments, declarations, raw text and silent elements are left out; a silent element without an end tag, and a tag
    that isn't closed by ``>``, hide nothing but themselves. A head without one ends at the body.
    """
    ends: dict[str, list[int]] = {}
    for m in _CLOSES.finditer(page):
        ends.setdefault((m[1] or m[2]).lower(), []).append(m.start())
    missing: set[str] = set()  # quotes and ends that no longer occur

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        got = page.find(what, start)
        if got < 0:
            missing.add(what)
        return got

    at = begin = 0  # begin of the text not yet given
    held: list[str] = []
    while True:
        lt = page.find("<", at)
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = find("-->", lt + 4)
            held.append(page[begin:lt])
            at = begin = len(page) if end < 0 else end + 3
            continue
        m = _NAME.match(page, lt + 1)
        if not m:
            if page[lt + 1 : lt + 2] in ("!", "/", "?"):
                end = find(">", lt)
                held.append(page[begin:lt])
                at = begin = len(page) if end < 0 else end + 1
            else:
                at = lt + 1
            continue
        end = m.end()
        while True:
            stop = _STOP.search(page, end) if ">" not in missing else None
            if stop is None:
                missing.add(">")
                close = -1
                break
            if stop[0] == ">":
                close = stop.start()
                break
            other = find(stop[0], stop.end())
            end = stop.end() if other < 0 else other + 1
        held.append(page[begin:lt])
        stop_at = len(page) if close < 0 else close
        attributes, at = page[m.end() : stop_at], min(len(page), stop_at + 1)
        begin = at
        name = m[2].lower()
        if close < 0:  # cut off: what stands behind the name is no text
            break
        if not m[1] and name in _RAW:
            found = re.compile(f"</{name}\\b", re.I).search(page, at)
            at = begin = len(page) if not found else found.start()
            continue
        if not m[1] and name in _SILENT and not attributes.endswith("/"):
            known = ends.get(name, [])
            i = bisect.bisect_left(known, at)
            if i < len(known):
                at = begin = known[i]
                continue
            if name == "head" and "body" in ends:
                at = begin = max(at, ends["body"][0])
                continue
        yield "".join(held), bool(m[1]), name, attributes
        held.clear()
    yield "".join(held) + page[begin:], False, "", ""


def marks(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is named as foreign, or a holder as layout or by a compound that has such a word in it and may mean anything."""
    foreign = layout = maybe = False
    holder = name in _HOLDERS
    for kind, *found in _NAMES.findall(attributes) if attributes else ():
        for token in next(filter(None, found), "").lower().split():
            foreign |= bool(_FOREIGN.fullmatch(token)) and (holder or kind.lower() != "id")
            layout |= holder and bool(_LAYOUT.fullmatch(token))
            maybe |= holder and any(_FOREIGN.fullmatch(x) or _LAYOUT.fullmatch(x) for x in re.split("[-_]+", token))
    return foreign, layout, maybe and not (foreign or layout)


def page_lines(page: str) -> list[tuple[str, int, int]]:
    """The lines of a page, one a block: (text, characters inside links, where it stands).

    A line stands AROUND the main text inside menus, headers, footers, asides, forms and what is named as an advert or
    the like; html and body never are, and a main element inside a layout wrapper or a form ends that. It is SUSPECT
    inside a holder with a compound name, INSIDE in a main element, else PLAIN. Paragraphs, list items and cells
    without an end tag end where the next begins.
    """
    lines: list[tuple[str, int, int]] = []
    text: list[str] = []
    links = main = in_link = 0
    skip, depth, foreign, lists = "", 0, False, 0
    suspect, suspect_depth = "", 0
    pending: list[tuple[str, int]] = []  # wrappers that a main element broke up

    def flush():
        nonlocal text, links
        line = " ".join(html.unescape("".join(text)).split())
        if line:
            lines.append((line, links, AROUND if skip else SUSPECT if suspect else INSIDE if main else PLAIN))
        text, links = [], 0

    for piece, closing, name, attributes in tokens(page):
        text.append(piece)
        links += len(piece) if in_link else 0
        if name == "a":
            in_link = 0 if closing else 1
        if name in _INLINE:
            continue
        text.append(" ")
        flush()
        if skip in _OPEN_ENDED:
            lists += (name in ("ul", "ol", "dl", "table", "select")) * (-1 if closing else 1)
            if (not closing and not lists and (name == skip or skip == "p")) or lists < 0:
                skip = ""
        if suspect and name == suspect:
            suspect_depth += -1 if closing else 1
            suspect = suspect if suspect_depth > 0 else ""
        if skip:
            if name in _MAIN and not closing and not foreign:
                pending.append((skip, depth))
                skip, main = "", main + 1
            elif name == skip:
                depth += -1 if closing else 1
                if depth <= 0:
                    skip = ""
        elif closing:
            if name in _MAIN and main:
                main -= 1
                if pending and not main:
                    (skip, depth), foreign = pending.pop(), False
        elif name in _MAIN:
            main += 1
        if not skip and not closing and name and name not in _VOID and name not in ("html", "body"):
            other, layout, maybe = marks(name, attributes)
            layout = layout and name not in _MAIN
            if other or layout or (name in _AROUND and not (name == "header" and main)):
                skip, depth, lists = name, 1, 0
                foreign = other or name in ("nav", "header", "footer", "aside", "menu")
                main -= name in _MAIN
            elif maybe and not suspect and name not in _MAIN:
                suspect, suspect_depth = name, 1
    return lines


def block_sums(weights: np.ndarray, window: int) -> np.ndarray:
    """Sum of each line and the ``window`` - 1 lines before it, and on past the last line."""
    return np.convolve(weights, np.ones(window, np.int64))


def main_text(page: str | None, window: int = 3) -> str:
    """Text between the surges and the dives of a page's line lengths.

    Lines around the main text are no part of the distribution. Any other weighs its characters outside links, or all
    of them where the ``window`` lines about it have more text outside links than inside: so a line of one link counts
    within prose, and a menu nowhere. Sums run over ``window`` lines. A stretch begins with the first line of weight
    where the sums surge from zero and ends with the last before they dive to zero again. Suspect lines are text where
    their own sums reach half of what the page's other text has at its median; an advert's line under a compound name
    doesn't, a section of paragraphs does.

    If main elements have at least half of the weight, all their lines are kept and nothing else; else the stretches
    whose sums reach a quarter of the highest are, whole.
    """
    lines = [x for x in page_lines(page or "") if x[2] != AROUND]
    if not lines:
        return ""
    length = np.array([len(line) for line, _, _ in lines], np.int64)
    bare = np.maximum(length - np.array([links for _, links, _ in lines]), 0)
    place = np.array([x for _, _, x in lines])
    half = window // 2
    about = lambda x: np.convolve(x, np.ones(2 * half + 1, np.int64))[half : half + len(x)]
    weights = np.where(2 * about(bare) > about(length), length, bare)
    if (place == SUSPECT).any():
        others, mine = np.where(place == SUSPECT, 0, weights), np.where(place == SUSPECT, weights, 0)
        usual = block_sums(others, window)[: len(lines)]
        least = np.median(usual[others > 0]) / 2 if (others > 0).any() else 0
        edges = np.flatnonzero(np.diff(np.r_[0, (place == SUSPECT).astype(int), 0]))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if block_sums(mine[a:b], window).max() < least:
                weights[a:b] = length[a:b] = 0
            else:
                place[a:b] = INSIDE if a and place[a - 1] == INSIDE else PLAIN
    inside = place == INSIDE
    if inside.any() and 2 * weights[inside].sum() >= weights.sum():
        return " ".join(lines[i][0] for i in np.flatnonzero(inside & (length > 0)))
    some = np.flatnonzero(weights)
    if not len(some):
        return ""
    sums = block_sums(weights, window)
    dives = np.flatnonzero(np.diff(some) > window)
    kept: list[str] = []
    for a, b in zip(np.r_[some[0], some[dives + 1]].tolist(), np.r_[some[dives], some[-1]].tolist(), strict=True):
        if 4 * sums[a : b + window].max() >= sums.max() > 0:
            kept += [lines[i][0] for i in range(a, b + 1) if length[i]]
    return " ".join(kept)


def extract_pages(pages: DataFrame, step: int = 200) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars (code points).

    Works on whole pages, ``step`` at a time, without a shuffle. Character references are decoded, white space inside
    a block becomes one space, blocks are joined by one space in page order. A null or empty page, or one without main
    text, gives an empty text. Null ids and urls stay null; repeated rows are extracted each; an empty table gives an
    empty result; other columns are not read.
    """

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                texts = [main_text(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    made = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string")
    return made.withColumn("n_chars", F.length("text").cast("long"))
