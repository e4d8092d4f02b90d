"""Text of files by format: plain text, HTML, notebooks, PDF, OOXML, ODF and RTF, as one Arrow-batched function."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pdf import pdf_text

TEXT_LIMIT = 8 << 20
#: Files of other formats that are larger aren't read.
SIZE_LIMIT = 100 << 20
TEXT = frozenset("txt md rst py go rs js ts tsx jsx java kt c h cc cpp hpp cs rb php sh sql css json yaml yml toml ini cfg xml csv tsv log tex r swift scala lua pl".split())
_HIDDEN = {"script", "style", "noscript"}
_BLOCK = set("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer nav main aside pre blockquote title body hr form dl dt dd".split())


def looks_binary(data: bytes) -> bool:
    """A NUL byte, or more than a tenth of control bytes, among the first 8192."""
    head = data[:8192]
    return b"\0" in head or sum(b < 32 and b not in (9, 10, 12, 13) for b in head) > len(head) / 10


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in _HIDDEN
        if tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in _BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in _BLOCK:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden and data.strip():
            self.out.append(data.strip() + " ")


def html_text(page: str) -> str:
    parser = _Html()
    parser.feed(page)
    parser.close()
    lines = (re.sub(r"^\| ", "", re.sub(r"\s+", " ", x).strip()) for x in "".join(parser.out).split("\n"))
    return "\n".join(x for x in lines if x)


def notebook_text(data: bytes) -> str:
    """Cells with a label, their source and their distinct text outputs."""
    parts = []
    for i, cell in enumerate(json.loads(data).get("cells", []), 1):
        kind = {"markdown": "Markdown Cell", "code": "Code Cell", "raw": "Raw Cell"}.get(cell.get("cell_type"), "Cell")
        body = ["".join(cell.get("source", ""))]
        seen = []
        for output in cell.get("outputs", []):
            data_ = output.get("data", {})
            text = "".join(output.get("text", "") or data_.get("text/plain", "") or data_.get("text/markdown", "")).strip()
            if text and text not in seen:
                seen.append(text)
        parts.append("\n".join([f"[{kind} {i}]", *(x for x in body if x.strip()), *(f"[Output]\n{t}" for t in seen)]))
    return "\n\n".join(parts)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _paragraphs(root: ElementTree.Element, paragraph: str = "p") -> list[str]:
    out = []
    for node in root.iter():
        if _local(node.tag) == paragraph:
            text = "".join(("\t" if _local(x.tag) == "tab" else x.text or "") + (x.tail or "" if _local(x.tag) in ("span", "s", "a") else "") for x in node.iter() if _local(x.tag) in ("t", "tab", "p", "span", "h", "s", "a"))
            if text.strip():
                out.append(text.strip())
    return out


def _table_rows(root: ElementTree.Element) -> list[str]:
    """Paragraphs in order, a table's row as one line with its cells between bars."""
    out: list[str] = []
    for node in root:
        kind = _local(node.tag)
        if kind == "tr":
            cells = [" ".join(_table_rows(c)) for c in node if _local(c.tag) == "tc"]
            if any(cells):
                out.append(" | ".join(cells))
        elif kind == "p":
            out += _paragraphs(ElementTree.ElementTree(node).getroot())[:1]
        else:
            out += _table_rows(node)
    return out


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Paths in the archive by relationship, of a part."""
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    found = ElementTree.fromstring(z.read(rels))
    return {r.get("Id", ""): posixpath.normpath(t[1:] if (t := r.get("Target", "")).startswith("/") else f"{folder}/{t}") for r in found.iter() if _local(r.tag) == "Relationship"}


def _related(node: ElementTree.Element) -> str:
    return next((v for k, v in node.attrib.items() if k.endswith("}id")), "")


def _number(name: str) -> int:
    return int(m[1]) if (m := re.search(r"(\d+)\.xml$", name)) else 0


def docx_text(z: zipfile.ZipFile) -> str:
    out = []
    for name in sorted(z.namelist()):
        if m := re.fullmatch(r"word/(document|header(\d*)|footer(\d*))\.xml", name):
            label = "[Document]" if m[1] == "document" else f"[{m[1][:6].capitalize()} {_number(name) or 1}]"
            if body := _table_rows(ElementTree.fromstring(z.read(name))):
                out.append("\n".join([label, *body]))
    return "\n\n".join(out)


def _slide(z: zipfile.ZipFile, name: str, without: tuple[str, ...] = ()) -> list[str]:
    """Paragraphs of a slide or of notes, without placeholders of some kinds (numbers, dates)."""
    root = ElementTree.fromstring(z.read(name))
    for parent in list(root.iter()):
        for shape in [s for s in parent if _local(s.tag) == "sp"]:
            if any(_local(x.tag) == "ph" and x.get("type") in without for x in shape.iter()):
                parent.remove(shape)
    return _paragraphs(root)


def pptx_text(z: zipfile.ZipFile) -> str:
    """Slides in the order of the presentation (by file number where it doesn't say), each with its notes."""
    names = set(z.namelist())
    slides: list[str] = []
    if "ppt/presentation.xml" in names:
        targets = _targets(z, "ppt/presentation.xml")
        slides = [t for n in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter() if _local(n.tag) == "sldId" and (t := targets.get(_related(n), "")) in names]
    out = []
    for name in slides or sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number):
        body = _slide(z, name)
        notes = next((t for t in _targets(z, name).values() if "/notesSlides/" in t), name.replace("slides/slide", "notesSlides/notesSlide"))
        said = _slide(z, notes, ("sldNum", "dt")) if notes in names else []
        if body or said:
            out.append("\n".join([f"[Slide {_number(name)}]", *body, *(["[Notes]", *said] if said else [])]))
    return "\n\n".join(out)


def xlsx_text(z: zipfile.ZipFile) -> str:
    """Sheets in the order of the workbook; one that can't be read is passed over."""
    names = set(z.namelist())
    shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"] if "xl/sharedStrings.xml" in names else []
    sheets: list[tuple[str, str]] = []
    if "xl/workbook.xml" in names:
        targets = _targets(z, "xl/workbook.xml")
        sheets = [(n.get("name", ""), t) for n in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(n.tag) == "sheet" and (t := targets.get(_related(n), "")) in names]
    if not sheets:
        sheets = [(str(_number(n)), n) for n in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number)]
    out = []
    for title, name in sheets:
        try:
            cells = [x for x in ElementTree.fromstring(z.read(name)).iter() if _local(x.tag) == "c"]
        except (ElementTree.ParseError, zipfile.BadZipFile):
            continue
        rows = []
        for c in cells:
            parts = {_local(x.tag): "".join(x.itertext()) for x in c}
            value, formula, kind = parts.get("v", parts.get("is", "")), parts.get("f"), c.get("t")
            if kind == "s" and value.isdigit() and int(value) < len(shared):
                value = shared[int(value)]
            elif kind == "b":
                value = "TRUE" if value == "1" else "FALSE"
            if formula is not None:
                rows.append(f"{c.get('r')} = {formula}" + (f" -> {value}" if value else ""))
            elif value:
                rows.append(f"{c.get('r')}: {value}")
        if rows:
            out.append("\n".join([f"[Sheet {title}]", *rows]))
    return "\n\n".join(out)


def odf_text(z: zipfile.ZipFile) -> str:
    body = ElementTree.fromstring(z.read("content.xml"))
    out = []
    tables = [t for t in body.iter() if _local(t.tag) == "table" and "table" in t.tag]
    pages = [p for p in body.iter() if _local(p.tag) == "page"]

    def named(x: ElementTree.Element) -> str:
        return next((v for k, v in x.attrib.items() if _local(k) == "name"), "")

    if pages:
        out = ["\n".join([f"[Slide {i}: {named(p)}]", *_paragraphs(p)]) for i, p in enumerate(pages, 1)]
    elif tables:
        for t in tables:
            rows = []
            for row in (r for r in t.iter() if _local(r.tag) == "table-row"):
                cells = []
                for c in (c for c in row if _local(c.tag) == "table-cell"):
                    times = min(1000, int(next((v for k, v in c.attrib.items() if _local(k) == "number-columns-repeated"), "1")))
                    formula = next((v for k, v in c.attrib.items() if _local(k) == "formula"), "")
                    value = "".join(c.itertext()).strip()
                    cells += [f"{formula.partition(':')[2] or formula} -> {value}" if formula else value] * times
                if any(cells):
                    rows.append(" | ".join(cells).rstrip(" |"))
            out.append("\n".join([f"[Sheet {named(t)}]", *rows]))
    else:
        out = ["\n".join(["[Document]", *("".join(n.itertext()).strip() for n in body.iter() if _local(n.tag) in ("p", "h") and "".join(n.itertext()).strip())])]
    return "\n\n".join(out)


_RTF = re.compile(r"\\u(-?\d+)\s?\??|\\'([0-9a-fA-F]{2})|\\([a-z]+)(-?\d+)? ?|\\(\W)|([{}])|([^\\{}]+)")
_RTF_SKIP = {"fonttbl", "colortbl", "stylesheet", "pict", "info", "object", "header", "footer", "generator", "themedata", "listtable"}
_RTF_CHARS = {"par": "\n", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}


def rtf_text(data: bytes) -> str:
    out: list[str] = []
    stack, skip = [], False
    for m in _RTF.finditer(data.decode("latin-1")):
        code, hexa, word, _, symbol, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif word in _RTF_SKIP or symbol == "*":
            skip = True
        elif not skip:
            if code:
                out.append(chr(int(code) % 65536))
            elif hexa:
                out.append(bytes([int(hexa, 16)]).decode("cp1252", "replace"))
            elif word:
                out.append(_RTF_CHARS.get(word, ""))
            elif symbol:
                out.append("\u00a0" if symbol == "~" else symbol if symbol in "\\{}" else "")
            elif plain:
                out.append(plain.replace("\r", "").replace("\n", ""))
    return tidy("".join(out))


def tidy(text: str) -> str:
    """Without white space at the ends of lines and of the text."""
    return "\n".join(x.rstrip() for x in text.split("\n")).strip()


def extract(path: str, data: bytes) -> tuple[str, str | None]:
    """(text, error): the first reader that knows the extension; unknown and binary files have no text."""
    ext = path.rpartition("/")[2].rpartition(".")[2].lower()
    if ext not in TEXT and len(data) > SIZE_LIMIT:
        return "", "too_large"
    try:
        if ext in ("docx", "pptx", "xlsx", "odt", "ods", "odp"):
            if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
                return "", "encrypted"
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return tidy({"docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_text}.get(ext, odf_text)(z)), None
        if ext in ("html", "htm", "xhtml"):
            return html_text(data.decode("utf-8", "replace")), None
        if ext == "ipynb":
            return tidy(notebook_text(data)), None
        if ext == "pdf":
            return tidy(pdf_text(data)), None
        if ext == "rtf":
            return rtf_text(data), None
        if ext in TEXT or path.rpartition("/")[2].lower() in ("makefile", "dockerfile", "readme", "license"):
            return ("" if looks_binary(data) else data[:TEXT_LIMIT].decode("utf-8", "replace")), None
    except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as error:
        return "", "encrypted" if str(error) == "encrypted" else type(error).__name__
    return "", None


def extract_column(path: Column, content: Column) -> Column:
    """struct(text, error) of files."""

    @F.pandas_udf("text string, error string")
    def run(paths: pd.Series, data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(p, bytes(d)) for p, d in zip(paths, data)], columns=["text", "error"])

    return run(path, content)


@F.pandas_udf(T.StringType())
def html_column(pages: pd.Series) -> pd.Series:
    """Text of HTML pages."""
    return pd.Series([None if p is None else html_text(p) for p in pages])
