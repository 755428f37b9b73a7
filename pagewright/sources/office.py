"""Word and Excel files (the zipped XML kinds) as chunks, read with the standard library.

Files are decoded one at a time inside `mapInPandas`. Old binary kinds need a plugged converter (see `models`). A file
that can't be read gives one chunk of type `error` with the reason; one without bytes gives nothing (see `binary.files`)."""

from __future__ import annotations

import base64
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.document import chunk_id
from . import binary

# Namespaces of the formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
P = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: What damaged files raise: not a zip, a damaged part, a part that is missing, a password, XML that doesn't parse or lacks something.
DAMAGED = (zipfile.BadZipFile, zlib.error, struct.error, EOFError, NotImplementedError, RuntimeError, ET.ParseError, KeyError, IndexError, TypeError, AttributeError, ValueError, OverflowError)
_URL = re.compile(r'http://[^\s+"]+//|https://[^\s+"]+')


def _relations(z: zipfile.ZipFile, name: str) -> dict[str, tuple[str, bool, str]]:
    """Targets of a part's relations, whether they are outside of the file, and their kinds."""
    if name not in z.namelist():
        return {}
    return {r.get("Id"): (r.get("Target"), r.get("TargetMode") == "External", r.get("Type", "").split("/")[-1]) for r in ET.fromstring(z.read(name)).iter(f"{P}Relationship")}


# Sheets


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si")]


def _value(c: ET.Element, shared: list[str]):
    kind, v = c.get("t"), c.find(f"{S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{S}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return bool(int(v.text))
    if kind in ("str", "e"):
        return v.text
    number = float(v.text)
    return int(number) if number.is_integer() else number


def sheet_rows(data: bytes) -> Iterator[tuple[str, int, list[tuple[str, str]]]]:
    """Sheet, row (from 0 below the header) and the named values of each row that isn't empty; links as markdown."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared, book = _shared(z), _relations(z, "xl/_rels/workbook.xml.rels")
    for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"):
        target = book[sheet.get(f"{R}id")][0].lstrip("/")
        part = target if target.startswith("xl/") else f"xl/{target}"
        root = ET.fromstring(z.read(part))
        rels = _relations(z, part.replace("worksheets/", "worksheets/_rels/") + ".rels")
        links = {h.get("ref"): rels.get(h.get(f"{R}id"), (h.get("location"),))[0] for h in root.iter(f"{S}hyperlink")}
        header: list[str] | None = None
        first = 0
        for i, row in enumerate(root.iter(f"{S}row")):
            at = int(row.get("r", i + 1))
            cells = {}
            for j, c in enumerate(row.iter(f"{S}c")):
                ref = c.get("r", "")
                value = _value(c, shared)
                if value is not None:
                    cells[_column(ref) if ref else j] = f"[{value}]({links[ref]})" if header is not None and links.get(ref) else value
            if header is None:
                header = [str(cells.get(k)) for k in range(max(cells, default=-1) + 1)]
                first = at + 1
            elif cells:
                yield sheet.get("name"), at - first, [(header[k] if k < len(header) else "None", str(v)) for k, v in sorted(cells.items())]


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """A chunk per row of each sheet; numbering begins anew on every sheet, so that `sheet` tells rows apart."""
    return excel_chunks(binary.files(spark, path, "*.xlsx"))


def excel_chunks(files: DataFrame) -> DataFrame:
    """The same for files that are rows already: (path, content)."""

    def rows(batches):
        for pdf in batches:
            for doc, source, data in zip(pdf["doc_id"], pdf["path"], pdf["content"]):
                try:
                    got = [(doc, sheet, i, "text", ";".join(f'"{k}":"{v}"' for k, v in cells), source) for sheet, i, cells in sheet_rows(data)]
                except DAMAGED as e:
                    got = [(doc, None, 0, "error", _reason(e), source)]
                yield pd.DataFrame(got, columns=["doc_id", "sheet", "index", "chunk_type", "content", "source"])

    got = files.select(binary.doc_key(), "path", "content").mapInPandas(rows, "doc_id long, sheet string, index int, chunk_type string, content string, source string")
    own = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "sheet", F.col("index").cast("string")), 256)
    return got.select("doc_id", "sheet", "index", own.alias("chunk_id"), "chunk_type", "content", "source")


def _reason(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


# Word


class Word:
    """A document's body as chunks."""

    def __init__(self, data: bytes) -> None:
        z = zipfile.ZipFile(io.BytesIO(data))
        self.body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
        self.images: dict[str, tuple[str, str, str | None]] = {}  # relation to name, text and base64 of its picture
        names = z.namelist()
        for rid, (target, outside, kind) in _relations(z, "word/_rels/document.xml.rels").items():
            part = f"word/{target}"
            if "image" in target and not outside and part in names:
                name = f"image_{len(self.images) + 1}"
                self.images[rid] = (name, f"![{name}](images/{target.split('/')[-1]})", base64.b64encode(z.read(part)).decode())
            elif outside and kind == "image":  # its bytes aren't in the file
                name = f"image_{len(self.images) + 1}"
                self.images[rid] = (name, f"![{name}]({target})", None)
        self.texts = self._linked()

    @staticmethod
    def _text(run: ET.Element) -> str:
        marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
        return "".join((x.text or "") if x.tag == f"{W}t" else marks.get(x.tag, "") for x in run)

    def _linked(self) -> dict[int, str]:
        """Texts of runs by identity; the run after a link field's target is the link."""
        out, url = {}, None
        for p in self.body.findall(f"{W}p"):
            for run in p.findall(f"{W}r"):
                text = self._text(run)
                if text and url:
                    text, url = f"  [{text}]({url})  ", None
                out[id(run)] = text
                for field_ in run.iter(f"{W}instrText"):
                    if "HYPERLINK" in (field_.text or ""):
                        for found in _URL.findall(field_.text):
                            url = found
        return out

    def _pictures(self, run: ET.Element) -> list[tuple[str, str, str | None]]:
        named = [b.get(f"{R}embed") or b.get(f"{R}link") for b in run.iter(f"{A}blip")]
        return [self.images[x] for x in named if x in self.images]

    def _paragraph(self, p: ET.Element) -> Iterator[dict]:
        text = ""
        for run in p.findall(f"{W}r"):
            for name, mark, data in self._pictures(run):
                if text:
                    yield {"content": text}
                    text = ""
                yield {"content": mark, "chunk_type": "image", "image_name": name, "image_content": data}
            text += self.texts.get(id(run), self._text(run)).strip()
        if text:
            yield {"content": text}

    def _cell(self, tc: ET.Element) -> str:
        parts = []
        for p in tc.findall(f"{W}p"):
            got = "".join("".join(m for _, m, _ in pics) if (pics := self._pictures(r)) else self._text(r) for r in p.findall(f"{W}r")).strip().replace("\n", "<br>")
            if got:
                parts.append(got)
        return " ".join(dict.fromkeys(parts))

    def table(self, tbl: ET.Element) -> list[list[str]]:
        """Rows of equal width; a wide cell has its text in its first place."""
        rows = []
        for tr in tbl.findall(f"{W}tr"):
            cells = []
            for tc in tr.findall(f"{W}tc"):
                span = tc.find(f"{W}tcPr/{W}gridSpan")
                cells += [self._cell(tc).strip(), *[""] * (int(span.get(f"{W}val")) - 1 if span is not None else 0)]
            rows.append(cells)
        width = max((len(r) for r in rows), default=0)
        return [r + [""] * (width - len(r)) for r in rows]

    def chunks(self) -> Iterator[dict]:
        for element in self.body:
            if element.tag == f"{W}p":
                yield from self._paragraph(element)
            elif element.tag == f"{W}tbl":
                rows = self.table(element)
                if rows:
                    lines = ["| " + " | ".join(r) + " |" for r in rows]
                    lines.insert(1, "| " + " | ".join(["---"] * len(rows[0])) + " |")
                    yield {"content": "\n".join(lines), "chunk_type": "table_csv", "table_content": "\n".join(",".join(r) for r in rows)}


_WORD = ["doc_id", "index", "chunk_type", "content", "image_name", "image_content", "table_content", "source"]


def read_word(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of Word files: texts, pictures and tables, in order."""
    return word_chunks(binary.files(spark, path, "*.docx"))


def word_chunks(files: DataFrame) -> DataFrame:
    """The same for files that are rows already: (path, content)."""

    def rows(batches):
        for pdf in batches:
            for doc, source, data in zip(pdf["doc_id"], pdf["path"], pdf["content"]):
                try:
                    got = [{"doc_id": doc, "index": i, "chunk_type": "text", "source": source} | c for i, c in enumerate(Word(data).chunks())]
                except DAMAGED as e:
                    got = [{"doc_id": doc, "index": 0, "chunk_type": "error", "content": _reason(e), "source": source}]
                yield pd.DataFrame(got, columns=_WORD).astype(object).where(lambda d: d.notna(), None)

    kinds = {"doc_id": "long", "index": "int"}
    got = files.select(binary.doc_key(), "path", "content").mapInPandas(rows, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in _WORD))
    return got.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("index")))
