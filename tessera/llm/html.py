"""Main text of web pages by line-block distribution.

Markup is stripped: comments, scripts, styles and the like go with their content, tags of block elements end a
line, other tags vanish, character references are decoded, and white space in a line becomes single
spaces. Lines keep their order; empty lines don't count. The length of each window of `window` lines is
the sum of the lengths of its lines. A surge is the first window that reaches `surge`; the following dive is the
first window below `dive`. The lines between a surge and its dive are kept, without short lines (under surge / window)
and blocks under `dive` at either end that only share a window with the text. Short lines between two kept lines of one block (article,
section, div, cell and the like; lists, tables' rows and quotes belong to the block around them, but not to the
whole body) are kept, too. A page may have several parts, runs of lines that are kept.

Scale: one pass without a shuffle. Defined cases: a null page has a null text and no part; an empty
page, or one in which no window reaches `surge`, has an empty text; an unclosed comment, script, style or
textarea reaches to the end of the page; a head without its end tag, and other elements that close themselves or have
no end tag, are plain tags; each row is judged by its own page; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_arrow, text_slices

_HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|textarea)(?=[\s>/]).*?(?:</\1\s*>|\Z)|<title(?=[\s>/])(?:(?!<title[\s>/]).)*?</title\s*>|<!\[CDATA\[.*?(?:\]\]>|\Z)")
#: Elements that vanish with their content if they end; innermost first. A head has no text of its own once its title is gone.
_CLOSED = re.compile(r"(?is)<(noscript|template|svg|iframe|select)(?=[\s>/])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*(?<!/)>(?:(?!<\1[\s>/]).)*?</\1\s*>")
_BLOCK = "address|article|aside|blockquote|body|br|button|caption|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|legend|li|main|menu|nav|ol|option|p|pre|section|summary|table|tbody|td|tfoot|th|thead|tr|ul"
_BREAK = re.compile(rf"(?i)</?(?:{_BLOCK})(?=[\s>/])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>")
_OPEN = re.compile(r"</?([A-Za-z0-9]+)")
#: Elements that are a block of their own, and those that belong to the block around them unless that is the body.
_OWN = frozenset("address article aside center details dialog div fieldset figure footer form header main menu nav section table td th".split())
_PART = frozenset("blockquote dir dl ol ul".split())
_TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]*>|<[!?][^<>]*>")
_SPACE = re.compile(r"[^\S\n]+")


def lines_of(page: str) -> tuple[list[str], list[int]]:
    """The lines of a page without its markup and without empty lines, and the number of the block of each."""
    text, n = _HIDDEN.sub("\n", page), 1
    while n:
        text, n = _CLOSED.subn("\n", text)
    lines: list[str] = []
    blocks: list[int] = []
    held: list[tuple[str, int]] = []  # open elements and their blocks; the body is block 0
    begin, n = 0, 0
    for m in [*_BREAK.finditer(text), None]:
        piece = _TAG.sub("", text[begin : m.start() if m else len(text)])
        if "&" in piece:
            piece = entities.unescape(piece)
        for x in piece.split("\n"):
            if x := _SPACE.sub(" ", x).strip():
                lines.append(x)
                blocks.append(held[-1][1] if held else 0)
        if m:
            begin, name = m.end(), _OPEN.match(m[0])[1].lower()
            if name not in _OWN and name not in _PART:
                continue
            if m[0][1] != "/":
                n += 1
                held.append((name, held[-1][1] if name in _PART and held and held[-1][1] else n))
            elif any(name == x for x, _ in held):
                while held.pop()[0] != name:
                    pass
    return lines, blocks


def parts(lengths: np.ndarray, window: int, surge: int, dive: int) -> list[tuple[int, int]]:
    """(first line, end) of each part between a surge and its dive."""
    if not len(lengths):
        return []
    # whole windows only: a line isn't short because the page ends after it
    sums = np.convolve(lengths, np.ones(window, np.int64))[window - 1 : max(window, len(lengths))]
    out, at = [], 0
    least = surge / window
    high, low = np.flatnonzero(sums >= surge), np.flatnonzero(sums < dive)
    while True:
        k = np.searchsorted(high, at)
        if k == len(high):
            return out
        begin = int(high[k])
        k = np.searchsorted(low, begin)
        end = at = int(low[k]) if k < len(low) else len(lengths)
        while begin < end and lengths[begin] < least:
            begin += 1
        stop = end
        while stop > begin and lengths[stop - 1] < least:
            stop -= 1
        if begin < stop:
            out.append((begin, stop))
        at = end + 1


def main_text(page: str | None, window: int = 3, surge: int = 80, dive: int = 50) -> tuple[str | None, int]:
    """The text that is kept, and the number of its parts."""
    if page is None:
        return None, 0
    lines, blocks = lines_of(page)
    lengths = np.fromiter((len(x) for x in lines), np.int64, len(lines))
    whole = np.bincount(blocks, lengths) if lines else np.zeros(0)
    found = []
    for a, b in parts(lengths, window, surge, dive):
        # lines of the block that are not short end it, though the dive begins there
        while b < len(lines) and blocks[b] == blocks[b - 1] and lengths[b] >= surge / window:
            b += 1
        # a block under `dive` at either end is no part of the text beside it
        while a < b and whole[blocks[a]] < dive:
            a += 1
        while a < b and whole[blocks[b - 1]] < dive:
            b -= 1
        found.append((a, b))
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for i in (i for a, b in found for i in range(a, b)):
        first.setdefault(blocks[i], i)
        last[blocks[i]] = i
    # what is kept itself lies between the first and the last kept line of its block
    kept = [i for i, block in enumerate(blocks) if first.get(block, i + 1) <= i <= last[block]]
    return "\n".join(lines[i] for i in kept), sum(i == 0 or kept[i] != kept[i - 1] + 1 for i in range(len(kept)))


def extract_pages(pages: DataFrame, window: int = 3, surge: int = 80, dive: int = 50) -> DataFrame:
    """(page_id, url, text, n_parts) for every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html"):
                done = [main_text(x, window, surge, dive) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], names=["page_id", "url", "text", "n_parts"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(rows, run, "page_id long, url string, text string, n_parts int")
