"""A Python data source for PDF files: one partition a file, one row per block of text with its spans and the page's drawings.

Reading needs the package ``fitz``, which is imported by the tasks alone; without it reading fails with a message, and tables
of pages and blocks take its place. What is made of a page's dictionary is plain Python and needs no package.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from glob import glob

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BOX = "x0: double, y0: double, x1: double, y1: double"
SPAN = "text: string, font_name: string, font_size_pt: double, flags: int, bold: boolean, italic: boolean, color: array<int>, rotation: double"
SCHEMA = f"doc string, page_number int, width_pt double, height_pt double, block_id int, x0 double, y0 double, x1 double, y1 double, text string, spans array<struct<{SPAN}>>, drawings array<struct<{BOX}>>"


def colour(value) -> list[int] | None:
    """Red, green and blue of a colour number; None for one below 0 or none at all."""
    try:
        c = int(value)
    except (TypeError, ValueError):
        return None
    return [c >> 16 & 255, c >> 8 & 255, c & 255] if c >= 0 else None


def rotation(direction) -> float:
    """Degrees of a line's direction; 0 without one."""
    try:
        dx, dy = float(direction[0]), float(direction[1])
    except (TypeError, ValueError, IndexError):
        return 0.0
    return math.degrees(math.atan2(dy, dx)) if dx or dy else 0.0


def _span(s: dict, line: dict) -> dict:
    font, flags = str(s.get("font") or ""), int(s.get("flags") or 0)
    name = font.lower()
    return {
        "text": s.get("text") or "", "font_name": font, "font_size_pt": float(s.get("size") or 0), "flags": flags, "bold": "bold" in name or "black" in name or bool(flags & 16),
        "italic": "italic" in name or "oblique" in name or bool(flags & 2), "color": colour(s.get("color")), "rotation": rotation(line.get("dir")),
    }


def blocks_of(page: dict) -> Iterator[tuple[int, list[float], str, list[dict]]]:
    """Number, box, text and spans of the text blocks of a page's dictionary; blank blocks are left out, the others numbered from 0."""
    number = 0
    for b in page.get("blocks") or ():
        if b.get("type", 0) != 0:
            continue
        lines = b.get("lines") or ()
        text = "\n".join("".join(s.get("text") or "" for s in line.get("spans") or ()) for line in lines).strip()
        if text:
            box = [float(x) for x in (b.get("bbox") or (0, 0, 0, 0))[:4]]
            yield number, box, text, [_span(s, line) for line in lines for s in line.get("spans") or ()]
            number += 1


class PdfSource(DataSource):
    """``spark.dataSource.register(PdfSource)``, then ``spark.read.format("pdf").load(glob)``; option ``pages`` reads the first pages only."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PdfReader(self.options)


class PdfReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pages = options["path"], int(options.get("pages", 0))

    def partitions(self):
        return [InputPartition(p) for p in sorted(glob(self.path))]

    def read(self, partition):
        try:
            import fitz
        except ImportError as e:
            raise RuntimeError("reading PDF files needs the package fitz") from e
        with fitz.open(partition.value) as doc:
            for no, page in enumerate(doc):
                if self.pages and no >= self.pages:
                    break
                drawings = [dict(zip(("x0", "y0", "x1", "y1"), map(float, d["rect"]))) for d in page.get_drawings() if d.get("rect") is not None]
                for number, box, text, spans in blocks_of(page.get_text("dict")):
                    yield partition.value, no, float(page.rect.width), float(page.rect.height), number, *box, text, spans, drawings
