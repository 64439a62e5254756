"""Readers: files of mixed formats to page and block rows.

``read_text`` reads text and Markdown with Spark's own reader. ``read_files`` takes all formats: each file is decoded in the
task that holds it (``binaryFile`` and ``mapInPandas``), a file at a time. A file that cannot be decoded gives one row with
``error`` set, not a failed job. PDF, HWP (OLE) and OCR need decoders that are not bundled: register a function
(bytes, name) -> list of pages in ``DECODERS``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Supported extensions and their types.
MIME = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "txt": "text/plain",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xlsm": "application/vnd.ms-excel.sheet.macroEnabled.12",
    "csv": "text/csv",
    "hwp": "application/x-hwp",
    "hwpx": "application/hwp+zip",
}
PAGE_CHARS = 3000
HEAD_ROWS, TAIL_ROWS = 150, 30
ROWS_AT_ONCE = 2000
WIDTH, HEIGHT = 612.0, 792.0  # of a page that has no size, in points
POINTS = 72.0 / 914400.0  # per unit of an office drawing
BLOCKS = (
    "path string, page int, seq int, block_type string, text string, x0 double, y0 double, x1 double, y1 double, confidence double, "
    "width double, height double, image_count int, drawing_count int, "
    "paths array<struct<x0:double,y0:double,x1:double,y1:double,items:array<struct<op:string,points:array<struct<x:double,y:double>>>>>>, error string"
)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def mime_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("application/octet-stream"))


def is_supported(path: Column) -> Column:
    return extension(path).isin(*MIME)


def detect_format(path: str) -> str:
    found = re.search(r"\.([^./\\]+)$", path)
    ext = found[1].lower() if found else ""
    if ext not in MIME:
        raise ValueError(f"unsupported format: {ext or '(none)'}")
    return ext


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def pack_paragraphs(text: Column, size: int = PAGE_CHARS) -> Column:
    """Greedy packs of blank-line paragraphs: a pack closes before a paragraph that takes it past the size; separators
    are not counted."""
    none = F.array().cast("array<string>")
    zero = F.struct(none.alias("done"), none.alias("buf"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        full = (acc["n"] + F.length(p) > size) & (F.size(acc["buf"]) > 0)
        closed = F.concat(acc["done"], F.array(_strip(F.array_join(acc["buf"], "\n\n"))))
        return F.struct(
            F.when(full, closed).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(p)).otherwise(F.concat(acc["buf"], F.array(p))).alias("buf"),
            F.when(full, F.length(p)).otherwise(acc["n"] + F.length(p)).alias("n"),
        )

    return F.aggregate(F.split(_strip(text), "\n\n"), zero, step, lambda acc: F.concat(acc["done"], F.array(_strip(F.array_join(acc["buf"], "\n\n")))))


def split_pages(text: Column, size: int = PAGE_CHARS) -> Column:
    """Pages of a text: form feeds where there are two parts or more, else packs of paragraphs."""
    fed = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\f", -1), _strip), lambda p: p != "")
    return F.when(F.size(fed) > 1, fed).otherwise(pack_paragraphs(F.coalesce(text, F.lit("")), size))


def read_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text and Markdown files as block rows."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = files.select("path", F.posexplode(split_pages(F.col("value"))).alias("page", "text"))
    return rows.select("path", (F.col("page") + 1).alias("page"), F.lit(0).alias("seq"), F.lit("TEXT").alias("block_type"), "text", F.lit(None).cast("string").alias("error"))


Box = tuple[float, float, float, float]


@dataclass
class Page:
    """Blocks (block_type, text, box, confidence) of a page; a box of None is the whole page. ``paths`` are its drawings as dicts
    in the form of the column of that name."""

    blocks: list[tuple[str, str, Box | None, float]] = field(default_factory=list)
    width: float = WIDTH
    height: float = HEIGHT
    images: int = 0
    drawings: int = 0
    paths: list[dict] | None = None

    def add(self, kind: str, text: str, box: Box | None = None, confidence: float = 1.0) -> None:
        self.blocks.append((kind, text, box, confidence))


def cap_rows(rows: list[str], most: int | None) -> list[str]:
    """All rows; with ``most``, head and tail of a sheet that has more, and a line that says how many rows are left out."""
    if most is None or len(rows) <= most:
        return rows
    return [*rows[:HEAD_ROWS], f"... ({len(rows) - HEAD_ROWS - TAIL_ROWS} rows omitted) ...", *rows[-TAIL_ROWS:]]


def _sheet(title: str, rows: list[list[str]], most: int | None = None) -> Page:
    page, lines = Page(), cap_rows([" | ".join(r) for r in rows], most)
    if title:
        page.add("TEXT", title, (36.0, 36.0, WIDTH - 36.0, 60.0))
    if lines:
        page.add("TABLE", "\n".join(lines), (36.0, 70.0, WIDTH - 36.0, HEIGHT - 36.0))
    return page


def _texts(texts: list[str]) -> list[Page]:
    return [Page([("TEXT", text, None, 1.0)]) for text in texts]


def decode_csv(data: bytes, name: str, most: int | None = None) -> list[Page]:
    import csv

    return [_sheet(name, list(csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline=""))), most)]


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _all(root: ElementTree.Element, tag: str) -> Iterator[ElementTree.Element]:
    return (e for e in root.iter() if _tag(e) == tag)


def _said(root: ElementTree.Element) -> str:
    return "".join(e.text or "" for e in _all(root, "t")).strip()


def decode_xlsx(data: bytes, name: str, most: int | None = None) -> list[Page]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        have = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in have:
            shared = ["".join(t.text or "" for t in _all(si, "t")) for si in _all(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {}
        if "xl/_rels/workbook.xml.rels" in have:
            links = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        pages = []
        for k, sheet in enumerate(_all(book, "sheet"), 1):
            rid = next((v for a, v in sheet.attrib.items() if a.endswith("}id")), None)
            target = links.get(rid, f"worksheets/sheet{k}.xml")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for row in _all(root, "row"):
                cells: list[str] = []
                for cell in _all(row, "c"):
                    letters = re.match(r"[A-Z]*", cell.get("r") or "")[0]
                    at = 0
                    for c in letters:
                        at = at * 26 + ord(c) - 64
                    value = next((v.text or "" for v in _all(cell, "v")), None)
                    if cell.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif cell.get("t") == "inlineStr":
                        value = _said(cell)
                    cells += [""] * (max(at, len(cells) + 1) - 1 - len(cells)) + [(value or "").strip()]
                if any(cells):
                    rows.append(cells)
            pages.append(_sheet(sheet.get("name") or "", rows, most))
        return pages or [_sheet("empty", [])]


def pack_text(paragraphs: list[str], size: int = PAGE_CHARS) -> list[str]:
    packs, buf, n = [], [], 0
    for p in paragraphs:
        if buf and n + len(p) > size:
            packs.append("\n\n".join(buf).strip())
            buf, n = [], 0
        buf.append(p)
        n += len(p)
    return [*packs, "\n\n".join(buf).strip()]


def decode_docx(data: bytes, name: str) -> list[Page]:
    """Paragraphs, then tables; packed into pages."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    inside = {id(p) for t in _all(root, "tbl") for p in _all(t, "p")}
    parts = [said for p in _all(root, "p") if id(p) not in inside and (said := _said(p))]
    for row in (r for t in _all(root, "tbl") for r in _all(t, "tr")):
        if cells := [said for c in _all(row, "tc") if (said := _said(c))]:
            parts.append(" | ".join(cells))
    return _texts(pack_text(parts))


def _box(shape: ElementTree.Element, width: float, height: float) -> Box:
    """Place of a shape in points; the whole page where the file does not say (a place may come from the layout)."""
    for frame in _all(shape, "xfrm"):
        off, ext = next(_all(frame, "off"), None), next(_all(frame, "ext"), None)
        if off is not None and ext is not None:
            x, y = float(off.get("x")) * POINTS, float(off.get("y")) * POINTS
            return x, y, min(x + float(ext.get("cx")) * POINTS, width), min(y + float(ext.get("cy")) * POINTS, height)
    return 0.0, 0.0, width, height


def _is_drawing(shape: ElementTree.Element) -> bool:
    """A line, group, free form or drawn form; text boxes and placeholders are none."""
    kind = _tag(shape)
    if kind in ("cxnSp", "grpSp"):
        return True
    inside = {_tag(e) for e in shape.iter()}
    box = any(e.get("txBox") in ("1", "true") for e in _all(shape, "cNvSpPr"))
    return kind == "sp" and not box and "ph" not in inside and bool(inside & {"prstGeom", "custGeom"})


def decode_pptx(data: bytes, name: str) -> list[Page]:
    """A page per slide: shapes and tables with their boxes, pictures and drawings of the top level counted, then the notes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        width, height = 720.0, 540.0
        if "ppt/presentation.xml" in names:
            for size in _all(ElementTree.fromstring(z.read("ppt/presentation.xml")), "sldSz"):
                width, height = float(size.get("cx")) * POINTS, float(size.get("cy")) * POINTS
        pages = []
        for k, path in sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))):
            root = ElementTree.fromstring(z.read(path))
            page = Page(width=width, height=height)
            for tree in _all(root, "spTree"):
                page.images += sum(_tag(shape) == "pic" for shape in tree)
                page.drawings += sum(_is_drawing(shape) for shape in tree)
            places = {id(t): _box(frame, width, height) for frame in _all(root, "graphicFrame") for t in _all(frame, "tbl")}
            for shape in root.iter():
                if _tag(shape) == "sp":
                    if lines := [said for p in _all(shape, "p") if (said := _said(p))]:
                        page.add("TEXT", "\n".join(lines), _box(shape, width, height))
                elif _tag(shape) == "tbl":
                    rows = [" | ".join(_said(c) for c in _all(r, "tc")) for r in _all(shape, "tr")]
                    page.add("TABLE", "\n".join(rows), places.get(id(shape)))
            notes = f"ppt/notesSlides/notesSlide{k}.xml"
            if notes in names and (said := _said(ElementTree.fromstring(z.read(notes)))):
                page.add("TEXT", said, (0.0, height - 40.0, width, height), 0.9)
            pages.append(page)
        return pages


def decode_hwpx(data: bytes, name: str) -> list[Page]:
    parts = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = sorted(n for n in z.namelist() if n.lower().endswith(".xml"))
        for n in [x for x in xml if "/section" in x.lower()] or xml:
            try:
                root = ElementTree.fromstring(z.read(n))
            except ElementTree.ParseError:
                continue
            parts += [s.strip() for e in root.iter() for s in (e.text, e.tail) if s and s.strip()]
    return _texts(pack_text(parts))


def decode_text(data: bytes, name: str) -> list[Page]:
    text = data.decode("utf-8", "replace")
    fed = [p.strip() for p in text.split("\f") if p.strip()]
    return _texts(fed if len(fed) > 1 else pack_text(text.strip().split("\n\n")))


DECODERS: dict[str, Callable[[bytes, str], list[Page]]] = {
    "txt": decode_text, "md": decode_text, "markdown": decode_text, "csv": decode_csv, "xlsx": decode_xlsx, "xlsm": decode_xlsx,
    "docx": decode_docx, "pptx": decode_pptx, "hwpx": decode_hwpx,
}


def _as_page(page: Page | list) -> Page:
    """Registered decoders may give bare lists of (block_type, text)."""
    return page if isinstance(page, Page) else Page([(kind, text, None, 1.0) for kind, text in page])


def decode(path: str, data: bytes, decoders: dict[str, Callable[[bytes, str], list[Page]]]) -> list[tuple]:
    """Rows of BLOCKS. A page without blocks has one row without a type, so that its number and counts are kept."""
    try:
        kind = detect_format(path)
        if kind not in decoders:
            raise ValueError(f"no decoder for {kind} is registered")
        name = re.sub(r"\.[^.]*$", "", path.rpartition("/")[2])
        rows = []
        for p, page in enumerate(map(_as_page, decoders[kind](bytes(data), name)), 1):
            for s, (block, text, box, confidence) in enumerate(page.blocks or [(None, None, None, None)]):
                place = box or (0.0, 0.0, page.width, page.height)
                rows.append((path, p, s, block, text, *place, confidence, page.width, page.height, page.images, page.drawings, page.paths if s == 0 else None, None))
        return rows
    except Exception as e:  # a broken file is a row, whatever is wrong with it
        return [(path, *[None] * 14, f"{type(e).__name__}: {e}")]


def decode_files(files: DataFrame, decoders: dict | None = None) -> DataFrame:
    """Block rows of files (path, content), by their extension; the rows of ``binaryFile``, streamed or not, are such."""
    used = {**DECODERS, **(decoders or {})}
    names = [f.name for f in StructType.fromDDL(BLOCKS)]
    whole = ("page", "seq", "image_count", "drawing_count")

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in whole})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows: list[tuple] = []
            for p, data in zip(part["path"], part["content"], strict=True):
                rows += decode(p, data, used)
                if len(rows) >= ROWS_AT_ONCE:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def read_files(spark: SparkSession, path: str, glob: str = "*", decoders: dict | None = None) -> DataFrame:
    """Block rows of all files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return decode_files(files, decoders)
