"""A Python data source for word-processing files: one partition per file, one row per non-blank paragraph.

Body paragraphs and tables (nested ones too) come in document order, then text boxes, then headers
and footers if asked for. Nothing but the standard library is needed.
"""

from __future__ import annotations

import hashlib
import re
import zipfile
from collections.abc import Iterator
from glob import glob
from xml.etree import ElementTree as ET

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "doc string, seq long, location string, segment_id string, source_plain string, part string, in_table boolean, in_textbox boolean, paragraph_style string, heading string, is_toc_entry boolean, in_frame boolean, table_index int, row_index int, col_index int, width_twips int, height_twips int"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
#: Lengths of drawings a twip.
EMU = 635
_TOC = re.compile(r"\t\d+\s*$|(?:\.\s*){6,}\d+\s*$")


def is_toc(text: str, style: str | None) -> bool:
    """An entry of the contents, by its style or by its form; also their title."""
    t = " ".join(text.split()).lower()
    return (style or "").lower().startswith("toc") or t.startswith("table of contents") or _TOC.search(text.strip()) is not None


def _number(value: str | None) -> int | None:
    """A length above 0, else None."""
    try:
        n = int(float(value))
    except (TypeError, ValueError):
        return None
    return n if n > 0 else None


def paragraph_text(p: ET.Element) -> str:
    """The runs' text with tabs and line breaks; text boxes inside are not part of it."""
    out = []

    def walk(e: ET.Element) -> None:
        for c in e:
            if c.tag == f"{W}txbxContent":
                continue
            if c.tag == f"{W}t":
                out.append(c.text or "")
            elif c.tag == f"{W}tab":
                out.append("\t")
            elif c.tag in (f"{W}br", f"{W}cr"):
                out.append("\n")
            else:
                walk(c)

    walk(p)
    return "".join(out)


def _style(p: ET.Element) -> str | None:
    s = p.find(f"{W}pPr/{W}pStyle")
    return s.get(f"{W}val") if s is not None else None


def _blocks(e: ET.Element, prefix: str, cell: tuple | None = None) -> Iterator[tuple[str, tuple | None, ET.Element]]:
    """Location, cell (table, row, column and width) and element of each paragraph; nested tables count within their cell."""
    np = nt = 0
    for c in e:
        if c.tag == f"{W}p":
            yield f"{prefix}/p{np}", cell, c
            np += 1
        elif c.tag == f"{W}tbl":
            for r, row in enumerate(c.findall(f"{W}tr")):
                for k, tc in enumerate(row.findall(f"{W}tc")):
                    w = tc.find(f"{W}tcPr/{W}tcW")
                    yield from _blocks(tc, f"{prefix}/t{nt}/r{r}/c{k}", (nt, r, k, _number(w.get(f"{W}w")) if w is not None else None))
            nt += 1


def _extents(root: ET.Element) -> dict[ET.Element, tuple[int | None, int | None]]:
    """Width and height in twips of each text box, from the drawing around it."""
    out = {}
    for drawing in root.iter(f"{W}drawing"):
        size = next((x for x in drawing.iter(f"{WP}extent")), None)
        if size is not None:
            twips = tuple(n // EMU if (n := _number(size.get(k))) else None for k in ("cx", "cy"))
            for box in drawing.iter(f"{W}txbxContent"):
                out.setdefault(box, twips)
    return out


def segments_of(path: str, headers: bool = False) -> Iterator[tuple]:
    seq, heading = 0, None
    with zipfile.ZipFile(path) as z:
        parts = [("body", "word/document.xml")] + ([(n.split("/")[-1][:-4], n) for n in sorted(z.namelist()) if headers and n.startswith(("word/header", "word/footer"))])
        for part, name in parts:
            root = ET.fromstring(z.read(name))
            top = root.find(f"{W}body") if part == "body" else root
            rows = [(loc, cell, None, p) for loc, cell, p in _blocks(top, part)] if top is not None else []
            size = _extents(root)
            for i, box in enumerate(root.iter(f"{W}txbxContent")):
                rows += [(loc, cell, size.get(box, (None, None)), p) for loc, cell, p in _blocks(box, f"{part}/textbox{i}")]
            for loc, cell, box, p in rows:
                text, style = paragraph_text(p), _style(p)
                if not text.strip():
                    continue
                if style and style.lower().startswith("heading"):
                    heading = text.strip()
                key = hashlib.sha1(f"{loc}\n{text}".encode()).hexdigest()[:16]
                frame = p.find(f"{W}pPr/{W}framePr")
                width, height = (cell[3], None) if cell else box if box else (None, None) if frame is None else (_number(frame.get(f"{W}w")), _number(frame.get(f"{W}h")))
                yield path, seq, loc, key, text, part, cell is not None, box is not None, style, heading, is_toc(text, style), frame is not None, *(cell[:3] if cell else (None, None, None)), width, height
                seq += 1


class DocxSource(DataSource):
    """``spark.dataSource.register(DocxSource)``, then ``spark.read.format("docx").load(glob)``; option ``headers``."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DocxReader(self.options)


class DocxReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.headers = options["path"], str(options.get("headers", "false")).lower() == "true"

    def partitions(self):
        return [InputPartition(p) for p in sorted(glob(self.path))]

    def read(self, partition):
        yield from segments_of(partition.value, self.headers)
