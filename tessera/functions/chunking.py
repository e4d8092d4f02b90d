"""Splitting of texts into chunks of words along headings, fences, paragraphs, lines and sentences."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Titles, companies, ranks, months and measures that a period may follow within a sentence.
ABBREVIATIONS = frozenset(
    """mr mrs ms dr prof sr jr st rev hon mgr supt pres gov gen sgt cpl pvt
    vs etc inc ltd corp co dept fig eq vol no op approx est min max
    jan feb mar apr jun jul aug sep sept oct nov dec""".split()
)
LABELS = ("[Page ", "[Slide ", "[Sheet ", "[Document]", "[Header ", "[Footer ")
CHUNKS = "array<struct<content: string, chunk_index: int, heading: string>>"
_CHUNKS = pa.list_(pa.struct([("content", pa.string()), ("chunk_index", pa.int32()), ("heading", pa.string())]))
#: Bytes of text that a task has as Python's objects at once.
SLICE = 4 << 20


def text_bounds(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Begin and end of slices of about `most` bytes of text; a longer text is in a slice of its own."""
    end = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    begin = 0
    while begin < len(texts):
        stop = max(begin + 1, int(np.searchsorted(end, (end[begin - 1] if begin else 0) + most, side="right")))
        yield begin, stop
        begin = stop


def in_slices(make: Callable[..., list], kind: pa.DataType, texts: pa.Array, *more: pa.Array) -> pa.Array:
    """What `make` gives for the texts (and values of more columns), slice by slice: only the Arrow batch is held whole."""
    parts = [pa.array(make(*(x.slice(a, b - a).to_pylist() for x in (texts, *more))), kind) for a, b in text_bounds(texts)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def chunk_rows(chunks: list[tuple[str, int, str]]) -> list[dict]:
    return [{"content": c, "chunk_index": i, "heading": h} for c, i, h in chunks]


def sentences(text: str) -> list[str]:
    """Sentences end at . ! or ? before white space or the end, but not at the period of an abbreviation or a single letter."""
    out, begin = [], 0
    for m in re.finditer(r"[.!?](?=\s|$)", text):
        at = m.start()
        if m[0] == ".":
            word = re.search(r"[^\W\d_]*$", text[max(0, at - 24) : at])[0]
            if len(word) == 1 or word.lower() in ABBREVIATIONS:
                continue
        if part := text[begin : at + 1].strip():
            out.append(part)
        begin = at + 1
    return out + [rest] if (rest := text[begin:].strip()) else out


def units(text: str) -> list[str]:
    """Headings, labels, whole fenced blocks and paragraphs, in order."""
    out: list[str] = []
    held: list[str] = []
    fence = False

    def flush() -> None:
        if part := "\n".join(held).strip():
            out.append(part)
        held.clear()

    for line in re.sub(r"\r\n?", "\n", text).split("\n"):
        bare = line.strip()
        if bare.startswith(("```", "~~~")):
            if not fence:
                flush()
            held.append(line)
            if fence:
                flush()
            fence = not fence
        elif fence:
            held.append(line)
        elif not bare:
            flush()
        elif (bare[0] == "#" and not bare.startswith("#!")) or bare.startswith(LABELS):
            flush()
            out.append(bare)
        else:
            held.append(line)
    flush()
    return out


def small_units(unit: str, size: int) -> list[str]:
    """The unit, or its lines, sentences or words packed to at most `size` words."""
    if len(unit.split()) <= size:
        return [unit]
    for parts, glue in ((unit.split("\n"), "\n"), (sentences(unit), " ")):
        if len(parts) > 1:
            out: list[str] = []
            held: list[str] = []
            n = 0
            for p in parts:
                k = len(p.split())
                if held and n + k > size:
                    out += small_units(glue.join(held), size) if len(held) == 1 else [glue.join(held)]
                    held, n = [], 0
                held.append(p)
                n += k
            last = glue.join(held)
            return out + (small_units(last, size) if len(held) == 1 else [last])
    words = unit.split()
    return [" ".join(words[i : i + size]) for i in range(0, len(words), size)]


@dataclass(frozen=True)
class Splitter:
    """Chunks of about `size` words; each repeats the last `overlap` share of the one before."""

    size: int = 512
    overlap: float = 0.15

    def split(self, text: str | None) -> list[tuple[str, int, str]]:
        """(content, index, heading) of each chunk; the heading is the path of titles above it."""
        if not text or not text.strip():
            return []
        keep = int(self.size * self.overlap)
        keep = keep if keep < self.size else self.size // 4
        out: list[tuple[str, int, str]] = []
        stack: list[tuple[int, str]] = []
        held: list[str] = []
        n = 0

        def crumbs() -> str:
            names = [t for _, t in stack]
            return f"## {names[0]}" if len(names) == 1 else " > ".join(names)

        def flush() -> None:
            body = "\n\n".join(held).strip()
            if body:
                top = crumbs()
                out.append((f"{top}\n\n{body}" if top and not body.startswith("#") else body, len(out), top))

        for unit in (s for u in units(text) for s in small_units(u, self.size)):
            k = len(unit.split())
            if m := re.match(r"(#{1,6})\s*(\S[^\n]*)$", unit):
                while stack and stack[-1][0] >= len(m[1]):
                    stack.pop()
                stack.append((len(m[1]), m[2].strip()))
            if held and n + k > self.size:
                flush()
                tail = " ".join("\n\n".join(held).split()[-keep:]) if keep else ""
                held = [tail] if tail else []
                n = len(tail.split())
            held.append(unit)
            n += k
        flush()
        return out

    def column(self, text: Column) -> Column:
        """The chunks of a text column."""
        split = self.split

        @F.arrow_udf(CHUNKS)
        def run(texts: pa.Array) -> pa.Array:
            return in_slices(lambda part: [chunk_rows(split(t)) for t in part], _CHUNKS, texts)

        return run(text)


@F.arrow_udf(T.ArrayType(T.StringType()))
def sentence_array(texts: pa.Array) -> pa.Array:
    """Sentences of a text column."""
    return in_slices(lambda part: [sentences(t) if t else [] for t in part], pa.list_(pa.string()), texts)
