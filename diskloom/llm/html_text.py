"""Main text of web pages by line-block distribution.

Markup is stripped to lines (one a block element).  A line counts by the length of its
text; lines of menus, notices, adverts and the like, and lines that are mostly links,
count nothing.  Lengths are summed over a sliding window of lines; where the sum surges
text begins, where it dives it ends, and what lies between is kept.  Article elements are
a hint: where the page's largest sum lies in one, short runs in articles are kept too.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops

WINDOW = 3
#: A surge must reach this many characters, or a part of the page's peak if that is less.
SURGE, SURGE_PART = 86, 0.2
# Fixed lists: elements without running text, elements that are no part of an article,
# elements that begin a line, and words of class or id that name page furniture.
_MUTE = "script|style|noscript|template|textarea|title|svg|math|iframe|select|button|object|canvas|video|audio"
_FURNITURE = frozenset(("nav", "footer", "aside", "form", "menu", "dialog"))
_HOLDERS = frozenset("div section nav header footer aside form article main ul ol dl table menu dialog figure blockquote details fieldset".split())
_LINES = _HOLDERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr pre hr address figcaption caption body head html summary center".split())
_NAMES = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars menu menus submenu nav navbar navigation breadcrumb "
    "breadcrumbs foot footer footers comment comments commentlist commentform disqus respond replies reply cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager search searchform copyright legal".split()
)
#: Words that only say that something is a part of the page: the word before them tells what.
_PARTS = frozenset(
    "box boxes list lists item items container containers wrapper wrap area areas block blocks section sections bar slot slots unit units panel panels pane inner outer top bottom left right main body content contents "
    "text links link posts post articles stories thread threads form forms group row col column columns holder zone region module title heading header buttons button icons icon message messages policy".split()
)
#: Names that are furniture unless they stand in an article, whose heading they may hold.
_HEADS = frozenset(("header", "masthead", "topbar"))
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<({_MUTE})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][\w:-]*+)([^>]*+)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def _says(value: str, names: frozenset[str]) -> bool:
    """Whether a class or id says one of ``names``: its last word does, words for parts of a page aside.

    So ``cookie-notice`` and ``comment-list`` do, but ``notice-period`` and ``related-work`` do not.
    """
    for name in value.split():
        words = [w for w in re.split(r"[-_\d]+", name) if len(w) > 1]
        while words:
            if words[-1] in names:
                return True
            if words[-1] not in _PARTS:
                break
            words.pop()
    return False


def _is_furniture(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no part of an article; ``inside``: it stands in one."""
    if name in _FURNITURE or (name == "header" and not inside):
        return True
    for kind, a, b, c in _ATTRIBUTE.findall(attributes) if attributes and not attributes.isspace() else ():
        value, kind = (a or b or c).lower(), kind.lower()
        if kind == "role":
            if value in _ROLES:
                return True
        elif kind == "hidden" or kind == "aria-hidden":
            if value != "false":
                return True
        elif name == "article":
            if any(x in _NAMES for x in value.split()):
                return True
        elif name not in ("main", "body", "html") and (_says(value, _NAMES) or (not inside and _says(value, _HEADS))):
            return True
    return False


def lines(page: str, window: int = WINDOW) -> list[tuple[str, int, bool, bool, int]]:
    """``(text, characters within links, in an article, furniture, holder)`` of every line, in page order.

    ``holder`` numbers the innermost open block that holds the line (0: none).

    Around furniture and articles stand empty lines, as many as the window is wide.
    """
    found: list[tuple[str, int, bool, bool, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # open holders: name, furniture, article, number
    linked = links = holders = 0
    muted = False  # the line began with an element that is furniture by itself

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            found.append((text, linked, any(x[2] for x in stack), muted or any(x[1] for x in stack), stack[-1][3] if stack else 0))
        parts.clear()
        linked = 0

    def gap() -> None:
        found.extend([("", 0, False, False, 0)] * window)

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            text = page[at : token.start()]
            parts.append(text)
            if links:
                linked += len(text)
        at = token.end()
        name = token[3] or token[6]
        if name is None:
            if token[1]:
                parts.append(" ")
            continue
        name, ending, attributes = name.lower(), bool(token[2] or token[5]), token[4] or token[7] or ""
        if name == "a":
            links = max(0, links + (-1 if ending else 1))
        elif name == "br" or name in ("td", "th"):
            parts.append(" ")
        elif name in _LINES:
            close()
            muted = not ending and name not in _HOLDERS and _is_furniture(name, attributes, True)
            if name in _HOLDERS:
                if ending:
                    if any(x[0] == name for x in stack):
                        while True:
                            gone = stack.pop()
                            if gone[1] or gone[2]:
                                gap()
                            if gone[0] == name:
                                break
                    links = 0
                elif not attributes.rstrip().endswith("/"):
                    inside = any(x[2] for x in stack)
                    holders += 1
                    entry = (name, _is_furniture(name, attributes, inside), name in ("article", "main"), holders)
                    if entry[1] or entry[2]:
                        gap()
                    stack.append(entry)
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<(?:[a-zA-Z/!?][^>]*)?\Z", rest)  # a tag that the page breaks off in
        parts.append(rest[: cut.start()] if cut else rest)
    close()
    return found


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE, part: float = SURGE_PART) -> str:
    """The article's blocks, one a line; empty if the page has none."""
    if not page:
        return ""
    every = lines(page, window)
    sizes = []
    for text, linked, inside, furniture, _ in every:
        counts = not furniture and (inside or linked * 2 <= len(text))
        sizes.append(len(text) if counts else 0)
    upto = [0, *accumulate(sizes)]
    sums = [upto[min(i + window, len(sizes))] - upto[i] for i in range(len(sizes))]
    peak = max(sums, default=0)
    least = min(surge, part * peak)
    runs: list[tuple[int, int]] = []
    i = 0
    while i < len(sums):
        dive = i
        while dive < len(sums) and sums[dive]:
            dive += 1
        if dive > i:
            runs.append((i, dive))
        i = dive + 1
    # A run beside a surge in the same block belongs to it: furniture stood between them.
    tops = [max(sums[a:b]) for a, b in runs]
    inside = [any(every[j][2] for j in range(a, b) if sizes[j]) for a, b in runs]
    hinted = any(x and top == peak for x, top in zip(inside, tops))
    surged = [top >= least or (x and hinted) for x, top in zip(inside, tops)]
    blocks = {every[j][4] for (a, b), yes in zip(runs, surged) if yes for j in range(a, b) if sizes[j]}
    kept = [every[j][0] for (a, b), yes in zip(runs, surged) for j in range(a, b) if sizes[j] and (yes or every[j][4] in blocks)]
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, from its whole markup.

    Null, empty and text-free pages give the empty text; repeated pages are extracted
    each; long and broken-off markup is read as far as it goes; null ids stay null; an empty
    table gives an empty table; further columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.pieces(batch, "html"):
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
