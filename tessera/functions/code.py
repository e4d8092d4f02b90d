"""Chunking of source code by declarations, the registry of chunking strategies, and splitting to the embedder's budget."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunking import _CHUNKS, CHUNKS, Splitter, chunk_rows, in_slices

CHARS_A_WORD = 5
SIGNATURE = 120
MAX_INPUT = 4000
HEURISTIC = frozenset(".py .js .ts .tsx .jsx .rs .java .c .cpp .cc .h .hpp .rb .php .swift .kt .cs .scala .lua .ex .exs".split())
#: What begins a top-level block, at the start of a line.
_OPENERS = "|".join(["func", "class", "def", "export", "public", "private", "protected", "fn", "impl", "type", "const", "var", "let", "interface", "enum", "struct", *(f"pub {x}" for x in ("fn", "struct", "enum", "type", "const", "static")), "object", "module", "trait", "async fn", "async def", "async"])
_OPENER = re.compile(rf"(?:{_OPENERS}) ")
Chunk = tuple[str, int, str]


def first_line(block: str) -> str:
    """The first line that isn't blank, cut to SIGNATURE characters with an ellipsis."""
    line = next((x.strip() for x in block.split("\n") if x.strip()), "")
    return line if len(line) <= SIGNATURE else line[:SIGNATURE] + "..."


def pack_blocks(blocks: list[str], splitter: Splitter, preamble: str = "") -> list[Chunk]:
    """Blocks packed to the splitter's size, with the preamble before each chunk; a larger block is split as text, under its first line."""
    budget = splitter.size * CHARS_A_WORD
    out: list[str] = []
    held: list[str] = []
    size = 0
    front = f"{preamble}\n\n" if preamble else ""

    def flush() -> None:
        nonlocal held, size
        if held:
            out.append(front + "\n\n".join(held))
        held, size = [], 0

    for block in blocks:
        if len(block) > budget:
            flush()
            title = first_line(block)
            for body, _, _ in splitter.split(block):
                out.append((f"{title}\n\n" if title and not body.strip().startswith(title) else "") + front + body)
            continue
        room = budget - (0 if held or not preamble else len(preamble) + 2)
        if size and size + len(block) > room:
            flush()
        held.append(block)
        size += len(block)
    flush()
    return [(x, i, "") for i, x in enumerate(out)]


def heuristic_chunks(text: str, splitter: Splitter) -> list[Chunk] | None:
    """Blocks from one opening line at column 0 to the next; what comes before the first is dropped. None with fewer than two."""
    lines = text.split("\n")
    starts = [i for i, line in enumerate(lines) if line.strip() and line[0] not in " \t" and _OPENER.match(line)]
    if len(starts) < 2:
        return None
    blocks = ["\n".join(lines[a:b]).rstrip("\n\t ") for a, b in zip(starts, [*starts[1:], len(lines)])]
    return pack_blocks([b for b in blocks if b.strip()], splitter)


_GO_SKIP = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])+\'', re.S)
_GO_DECL = re.compile(r"(?m)^(func|type|var|const|import)\b")


def go_chunks(text: str, splitter: Splitter) -> list[Chunk] | None:
    """Top-level declarations of a Go file, with its package line and imports before each chunk; None for a file that doesn't parse."""
    # comments and strings can't open a bracket or begin a declaration
    bare = _GO_SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    package = re.match(r"\s*package[ \t]+\w+", bare)
    depth, spans, at = 0, [], package.end() if package else 0
    if not package:
        return None
    ends = [i for i, c in enumerate(bare) if c in "({[)}]\n"]
    k = 0
    while m := _GO_DECL.search(bare, at):
        while k < len(ends) and ends[k] < m.start():
            if bare[ends[k]] != "\n":
                return None  # a bracket outside of declarations
            k += 1
        depth, stop = 0, len(bare)
        while k < len(ends):
            c = bare[ends[k]]
            depth += (c in "({[") - (c in ")}]")
            if depth < 0:
                return None
            if c == "\n" and depth == 0:
                stop = ends[k]
                break
            k += 1
        if depth:
            return None
        spans.append((m[1], text[m.start() : stop].rstrip()))
        at = stop
    head = [bare[package.start() : package.end()].strip(), *(t for kind, t in spans if kind == "import")]
    blocks = [t for kind, t in spans if kind != "import"]
    return pack_blocks(blocks, splitter, "\n\n".join(head)) if blocks else None


def python_chunks(text: str, splitter: Splitter) -> list[Chunk] | None:
    """Top-level statements of a Python file, with its imports before each chunk; None for a file that doesn't parse."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = text.split("\n")
    source = lambda n: "\n".join(lines[min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]) - 1 : n.end_lineno])
    imports = [source(n) for n in body if isinstance(n, (ast.Import, ast.ImportFrom))]
    blocks = [source(n) for n in body if not isinstance(n, (ast.Import, ast.ImportFrom))]
    return pack_blocks(blocks, splitter, "\n".join(imports)) if blocks else None


@dataclass(frozen=True)
class Strategy:
    """A way to chunk files: `split` gives None where it can't, and the generic splitter takes over."""

    name: str
    priority: int
    supports: Callable[[str], bool]
    split: Callable[[str, Splitter], list[Chunk] | None]


def _extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


GO = Strategy("go", 100, lambda p: _extension(p) == ".go", go_chunks)
CODE = Strategy("code", 50, lambda p: _extension(p) in HEURISTIC, heuristic_chunks)
GENERIC = Strategy("generic", 0, lambda p: True, lambda t, s: s.split(t))
#: Python by its syntax tree; not registered unless it is added.
PYTHON = Strategy("python", 90, lambda p: _extension(p) == ".py", python_chunks)


@dataclass
class Registry:
    """Strategies; the one with the highest priority that supports a path splits it."""

    strategies: list[Strategy] = field(default_factory=lambda: [GO, CODE, GENERIC])

    def register(self, strategy: Strategy) -> None:
        self.strategies = sorted([*self.strategies, strategy], key=lambda s: -s.priority)

    def get(self, path: str) -> Strategy | None:
        return next((s for s in sorted(self.strategies, key=lambda s: -s.priority) if s.supports(path)), None)

    def split(self, text: str | None, path: str | None, splitter: Splitter = Splitter()) -> list[Chunk]:
        """Chunks of a text; null and blank texts have none, a null path is that of plain text."""
        if not text or not text.strip():
            return []
        strategy = self.get(path or "")
        chunks = strategy.split(re.sub(r"\r\n?", "\n", text), splitter) if strategy else None
        return splitter.split(text) if chunks is None else chunks

    def column(self, text: Column, path: Column, splitter: Splitter = Splitter(), budget: int = 0) -> Column:
        """The chunks of each row, divided to the embedder's budget where one is given."""
        split = self.split

        def chunked(texts: list, paths: list) -> list:
            found = (split(t, p, splitter) for t, p in zip(texts, paths))
            return [chunk_rows(to_budget(c, budget) if budget else c) for c in found]

        @F.arrow_udf(CHUNKS)
        def run(texts: pa.Array, paths: pa.Array) -> pa.Array:
            return in_slices(chunked, _CHUNKS, texts, paths)

        return run(text, path)


def cut_at_boundary(text: str, most: int) -> tuple[str, int]:
    """The longest start of a text of at most `most` characters that ends at a boundary, and how many characters it takes.

    Paragraphs, lines, sentences, clauses and words, in this order, are looked for in the last 256 characters; a start of less than
    half of `most` isn't taken.
    """
    if most <= 0 or len(text) <= most:
        return text, len(text)
    begin = max(0, most - 256)
    for mark in ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " "):
        at = text.rfind(mark, begin, most)
        if at >= 0 and len(part := text[: at + len(mark)].strip()) >= most // 2:
            return part, at + len(mark)
    return text[:most].strip(), most


def embed_input(heading: str, content: str) -> str:
    return f"{heading}\n\n{content}" if heading else content


def to_budget(chunks: list[Chunk], most: int = MAX_INPUT) -> list[Chunk]:
    """Chunks whose input for the embedder, heading included, has at most `most` characters; numbered anew."""
    out: list[tuple[str, str]] = []
    for content, _, heading in chunks:
        if len(embed_input(heading, content)) <= most:
            out.append((content, heading))
            continue
        room = max(1, most - (len(heading) + 2 if heading else 0))
        rest = content.strip()
        while rest:
            part, used = cut_at_boundary(rest, room)
            out.append((part or rest[:room], heading))
            rest = rest[max(1, used) :].strip()
    return [(c, i, h) for i, (c, h) in enumerate(out)]
