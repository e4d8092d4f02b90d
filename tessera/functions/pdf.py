"""Text of PDF files: objects, streams and the operators that show text; without layout.

Pages come in the order of the page tree. A page that can't be read is passed over. Fonts are decoded by their ToUnicode maps, or
as Latin text. Encrypted files are an error; a file without text may be given to an OCR function.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)(?:\bendobj\b|\Z)", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\(|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]{}/%]*|[+-]?\d*\.?\d+|[A-Za-z'\"*]+[0-9*]?|%[^\r\n]*")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
OCRError = type("OCRError", (Exception,), {"__doc__": "The OCR function failed."})


class _File:
    """Objects by number; those of object streams, too."""

    def __init__(self, data: bytes) -> None:
        self.objects = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body and (content := self.stream(body)):
                n, first = self._int(body, b"N"), self._int(body, b"First")
                head = [int(x) for x in content[:first].split()[: 2 * n]]
                for number, at, end in zip(head[::2], head[1::2], [*head[3::2], len(content) - first]):
                    self.objects.setdefault(number, content[first + at : first + end])

    def _int(self, body: bytes, key: bytes) -> int:
        m = re.search(rb"/" + key + rb"\s+(\d+)", body)
        return int(m[1]) if m else 0

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        if b"/FlateDecode" in body[: m.start()]:
            return zlib.decompressobj().decompress(m[1])
        return m[1]

    def refs(self, body: bytes, key: bytes) -> list[int]:
        """The objects that a key refers to, one or a list."""
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in _REF.findall(m[1])] if m else []

    def pages(self) -> list[bytes]:
        """Page objects in the order of the tree, or of the file where there is none."""
        out: list[bytes] = []
        seen: set[int] = set()

        def walk(number: int) -> None:
            body = self.objects.get(number, b"")
            if number in seen:
                return
            seen.add(number)
            if kids := self.refs(body, b"Kids"):
                for k in kids:
                    walk(k)
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append(body)

        for number, body in self.objects.items():
            if re.search(rb"/Type\s*/Catalog\b", body):
                for root in self.refs(body, b"Pages"):
                    walk(root)
        return out or [b for b in self.objects.values() if re.search(rb"/Type\s*/Page\b", b)]

    def fonts(self, page: bytes) -> dict[bytes, dict[int, str]]:
        """ToUnicode maps by font name."""
        body = page
        for r in self.refs(page, b"Resources"):
            body += self.objects.get(r, b"")
        for r in self.refs(body, b"Font"):
            body += self.objects.get(r, b"")
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", body):
            font = self.objects.get(int(number), b"")
            for u in self.refs(font, b"ToUnicode"):
                out[b"/" + name] = _unicode_map(self.stream(self.objects.get(u, b"")))
        return out


def _unicode_map(cmap: bytes) -> dict[int, str]:
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first = text(c)
            for i in range(min(65536, int(b, 16) - int(a, 16) + 1)):
                out[int(a, 16) + i] = first[:-1] + chr(ord(first[-1]) + i) if first else ""
    return out


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses from `at` (after the first), and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            n = data[at + 1 : at + 2]
            if m := re.match(rb"[0-7]{1,3}", data[at + 1 : at + 4]):
                out.append(int(m[0], 8) & 255)
                at += 1 + len(m[0])
                continue
            out += _ESCAPES.get(n, b"" if n in (b"\n", b"\r") else n)
            at += 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            break
        out += c
    return bytes(out), at


def content_text(content: bytes, fonts: dict[bytes, dict[int, str]]) -> str:
    """What a content stream shows: Tj, TJ, ' and " between BT and ET; a move to another line is a line break. A stream that ends within
    an operator gives what came before."""
    out: list[str] = []
    stack: list = []
    font: dict[int, str] = {}
    shown = False
    at = 0

    def show(raw: bytes) -> None:
        if font:
            size = 2 if max(font) > 255 else 1
            out.append("".join(font.get(int.from_bytes(raw[i : i + size], "big"), "") for i in range(0, len(raw), size)))
        else:
            out.append(raw.decode("utf-16-be", "replace")[1:] if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace"))

    while m := _TOKEN.search(content, at):
        token, at = m[0], m.end()
        if token == b"(":
            value, at = _literal(content, at)
            stack.append(value)
        elif token[:1] == b"<" and token != b"<<":
            digits = re.sub(rb"\s", b"", token[1:-1])
            stack.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif token[:1] in b"/[]" or token in (b"<<", b">>"):
            stack.append(token.decode("latin-1"))
        elif re.fullmatch(rb"[+-]?\d*\.?\d+", token):
            stack.append(float(token))
        elif token[:1] != b"%":
            if token in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
                if token != b"Tj" and shown:
                    out.append("\n")
                show(stack[-1])
                shown = True
            elif token == b"TJ":
                begin = max((i for i, x in enumerate(stack) if x == "["), default=0)
                for x in stack[begin:]:
                    if isinstance(x, bytes):
                        show(x)
                        shown = True
                    elif isinstance(x, float) and x < -200:
                        out.append(" ")  # a gap as wide as a space
            elif token == b"Tf" and len(stack) > 1:
                font = fonts.get(str(stack[-2]).encode("latin-1"), {})
            elif shown and (token in (b"T*", b"ET") or (token in (b"Td", b"TD") and stack and stack[-1] != 0.0)):
                out.append("\n")
                shown = False
            elif shown and token in (b"Td", b"TD", b"Tm"):
                out.append("\n" if token == b"Tm" else " ")
            stack = []
    return re.sub(r"\n{2,}", "\n", re.sub(r"[ \t]+", " ", "".join(out))).strip()


def pdf_text(data: bytes, ocr: Callable[[bytes], str] | None = None) -> str:
    """[Page N] and the text of each page that has some; where none has, what `ocr` reads, if it is there."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise ValueError("no PDF file")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise ValueError("encrypted")
    file = _File(data)
    out = []
    for i, page in enumerate(file.pages(), 1):
        try:
            content = b"\n".join(file.stream(file.objects.get(n, b"")) for n in file.refs(page, b"Contents"))
            text = content_text(content, file.fonts(page))
        except (zlib.error, ValueError, IndexError, OverflowError):
            continue
        if text:
            out.append(f"[Page {i}]\n{text}")
    if not out and ocr is not None:
        try:
            return ocr(data)
        except Exception as error:
            raise OCRError(str(error)) from error
    return "\n\n".join(out)
