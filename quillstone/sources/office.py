"""DOCX and XLSX sources over the standard library's zip and XML readers, and the file dispatch.

Files are read by Spark's ``binaryFile`` source; a file is a row, parsed where it
lies, and becomes rows of the elements and cells tables.  PDF needs a parser
this library doesn't bring; pass one.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ENTRIES = 20_000  #: zip entries
MOST_BYTES = 256 * 2**20  #: bytes an archive may expand to
MOST_CELLS = 200_000  #: cells of a sheet

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

ELEMENTS = "document_id string, ordinal int, element_id string, kind string, text string, table_id string, level int, paragraph int, heading_path array<string>, sheet string, cell_range string, fmt string"
CELLS = "document_id string, table_id string, row_no int, col_no int, row_span int, col_span int, text string, value_type string, value_double double, formula string, cached_value string, cache_status string, number_format string, header boolean, fmt string"


def read_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("pdf", "docx", "xlsx")) -> DataFrame:
    """(path, fmt, document_id, content) of supported files; the id is the SHA-256 of the bytes."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fmt = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    return f.select("path", fmt.alias("fmt"), F.sha2("content", 256).alias("document_id"), "content").where(F.col("fmt").isin(*suffixes))


def guarded(content: bytes) -> zipfile.ZipFile:
    """The archive, unless it has too many entries or expands too far."""
    z = zipfile.ZipFile(io.BytesIO(content))
    infos = z.infolist()
    if len(infos) > MOST_ENTRIES or sum(i.file_size for i in infos) > MOST_BYTES:
        raise ValueError("the archive is too large")
    return z


def _text(node: ET.Element) -> str:
    out = []
    for n in node.iter():
        if n.tag == f"{W}t":
            out.append(n.text or "")
        elif n.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
        elif n.tag == f"{W}tab":
            out.append("\t")
    return "".join(out)


def parse_docx(content: bytes, document_id: str) -> tuple[list[tuple], list[tuple]]:
    """(element rows, cell rows) in body order; merged cells collapse into their anchor, header rows are those so marked, else the first."""
    z = guarded(content)
    levels = {}
    if "word/styles.xml" in z.namelist():
        for st in ET.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
            name = st.find(f"{W}name")
            if name is not None and (m := re.fullmatch(r"heading (\d)", name.get(f"{W}val", "").lower())):
                levels[st.get(f"{W}styleId")] = int(m[1])
    elements, cells, path = [], [], []
    n = paragraph = table = 0
    for node in ET.fromstring(z.read("word/document.xml")).find(f"{W}body"):
        if node.tag == f"{W}p":
            paragraph += 1
            text = _text(node).strip()
            if not text:
                continue
            style = node.find(f"{W}pPr/{W}pStyle")
            level = levels.get(style.get(f"{W}val")) if style is not None else None
            if level is None and style is not None and (m := re.fullmatch(r"(?i)heading\s?(\d)", style.get(f"{W}val", ""))):
                level = int(m[1])
            if level:
                path = [*path[: level - 1], text]
            n += 1
            elements.append((document_id, n, f"{document_id[:12]}-e{n:05d}", "heading" if level else "paragraph", text, None, level, paragraph, list(path), None, None, "docx"))
        elif node.tag == f"{W}tbl":
            table += 1
            n += 1
            tid = f"{document_id[:12]}-t{table:03d}"
            elements.append((document_id, n, f"{document_id[:12]}-e{n:05d}", "table", None, tid, None, None, list(path), None, None, "docx"))
            cells += _word_table(node, document_id, tid)
    return elements, cells


def _word_table(node: ET.Element, document_id: str, tid: str) -> list[tuple]:
    grid: dict[tuple[int, int], dict] = {}
    open_: dict[int, dict] = {}
    marked = []
    for r, row in enumerate(node.findall(f"{W}tr"), 1):
        if row.find(f"{W}trPr/{W}tblHeader") is not None:
            marked.append(r)
        c = 1
        for cell in row.findall(f"{W}tc"):
            span = cell.find(f"{W}tcPr/{W}gridSpan")
            wide = int(span.get(f"{W}val", "1")) if span is not None else 1
            merge = cell.find(f"{W}tcPr/{W}vMerge")
            if merge is not None and merge.get(f"{W}val") != "restart" and c in open_:
                open_[c]["rows"] += 1
            else:
                text = "\n".join(t for p in cell.findall(f"{W}p") if (t := _text(p).strip()))
                grid[r, c] = {"rows": 1, "cols": wide, "text": text}
                if merge is not None:
                    open_[c] = grid[r, c]
                else:
                    open_.pop(c, None)
            c += wide
    heads = set(marked or [1])
    return [(document_id, tid, r, c, g["rows"], g["cols"], g["text"], "text", None, None, None, "not_formula", None, r in heads, "docx") for (r, c), g in sorted(grid.items())]


def _column(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n


def is_date_format(fmt: str) -> bool:
    """Does a number format show dates or times?  Literals, colours and conditions don't count; elapsed hours do."""
    code = re.sub(r'"[^"]*"|\\.|_.|\*.', "", fmt)
    code = re.sub(r"\[(?!(?:h+|m+|s+)\])[^\]]*\]", "", code, flags=re.I)
    return fmt != "General" and bool(re.search(r"[dmyhs]", code.split(";")[0], re.I))


def iso_time(serial: float, epoch: datetime) -> str:
    """ISO form of a date serial; a part of a day alone is a time."""
    at = epoch + timedelta(seconds=round(serial * 86_400))
    return (at.time() if 0 <= serial < 1 else at).isoformat()


def parse_xlsx(content: bytes, document_id: str) -> tuple[list[tuple], list[tuple]]:
    """(element rows, cell rows): one table per sheet, its effective region, merges, formulas with cached values, number formats.

    Dates and times come out as ISO text, booleans as True or False.

    Leading rows that are one merged cell across the region, and the row after
    them, are header rows.
    """
    z = guarded(content)
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{S}si")]
    formats = _number_formats(z) if "xl/styles.xml" in names else []
    targets = {x.get("Id"): x.get("Target") for x in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    elements, cells = [], []
    book = ET.fromstring(z.read("xl/workbook.xml"))
    epoch = datetime(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in book.iter(f"{S}workbookPr")) else datetime(1899, 12, 30)
    for n, sheet in enumerate(book.iter(f"{S}sheet"), 1):
        target = targets[sheet.get(f"{R}id")].lstrip("/")
        root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
        found = {}
        for c in root.iter(f"{S}c"):
            v, f, inline = c.find(f"{S}v"), c.find(f"{S}f"), c.find(f"{S}is")
            if v is None and f is None and inline is None:
                continue
            m = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r"))
            raw = "".join(t.text or "" for t in inline.iter(f"{S}t")) if inline is not None else (v.text if v is not None else None)
            kind = c.get("t", "n")
            if kind == "s" and raw is not None:
                raw = shared[int(raw)]
            style = int(c.get("s", "0"))
            number = float(raw) if kind == "n" and raw is not None else None
            formula = "=" + (f.text or "") if f is not None else None
            fmt = formats[style] if style < len(formats) else "General"
            if number is not None and is_date_format(fmt):
                raw, number = iso_time(number, epoch), None
            elif kind == "b" and raw is not None:
                raw = str(raw == "1")
            found[int(m[2]), _column(m[1])] = (raw, number, formula, fmt, kind)
            if len(found) > MOST_CELLS:
                raise ValueError("the sheet has too many cells")
        if not found:
            continue
        merges = {}
        for mc in root.iter(f"{S}mergeCell"):
            m = re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", mc.get("ref"))
            merges[int(m[2]), _column(m[1])] = (int(m[4]) - int(m[2]) + 1, _column(m[3]) - _column(m[1]) + 1)
        r0, r1 = min(r for r, _ in found), max([r for r, _ in found] + [r + h - 1 for (r, _), (h, _) in merges.items()])
        c0, c1 = min(c for _, c in found), max([c for _, c in found] + [c + w - 1 for (_, c), (_, w) in merges.items()])
        heads, r = set(), r0
        while r < r1 and (r, c0) in found and merges.get((r, c0), (1, 1))[1] == c1 - c0 + 1 > 1:
            heads.add(r - r0 + 1)
            r += merges[r, c0][0]
        heads.add(r - r0 + 1)
        tid = f"{document_id[:12]}-t{n:03d}"
        from quillstone.operators.tables import column_letters

        ref = f"{column_letters(c0)}{r0}:{column_letters(c1)}{r1}"
        elements.append((document_id, n, f"{document_id[:12]}-e{n:05d}", "table", None, tid, None, None, [], sheet.get("name"), ref, "xlsx"))
        for (r, c), (raw, number, formula, fmt, kind) in sorted(found.items()):
            h, w = merges.get((r, c), (1, 1))
            status = "not_formula" if formula is None else "missing" if raw is None else "unverified"
            vt = "formula" if formula is not None and raw is None else "number" if number is not None else "text"
            cells.append((document_id, tid, r - r0 + 1, c - c0 + 1, h, w, raw if raw is not None else formula, vt, number, formula, raw if formula else None, status, fmt, (r - r0 + 1) in heads, "xlsx"))
    return elements, cells


# Built-in number formats.
_BUILT_IN = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "m/d/yyyy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yyyy h:mm", 37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 49: "@"}


def _number_formats(z: zipfile.ZipFile) -> list[str]:
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(n.get("numFmtId")): n.get("formatCode") for n in root.iter(f"{S}numFmt")}
    xfs = root.find(f"{S}cellXfs")
    return [own.get(i) or _BUILT_IN.get(i, "General") for i in (int(x.get("numFmtId", "0")) for x in xfs)] if xfs is not None else []


PARSERS: dict[str, Callable[[bytes, str], tuple[list[tuple], list[tuple]]]] = {"docx": parse_docx, "xlsx": parse_xlsx}


def _rows(files: DataFrame, schema: str, which: int, parsers: dict[str, Callable]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for fmt, doc, content in zip(pdf["fmt"], pdf["document_id"], pdf["content"]):
                rows += parsers[fmt](bytes(content), doc)[which]
            yield pd.DataFrame(rows, columns=names).astype({k: "Int32" for k in ("level", "paragraph") if k in names})

    return files.where(F.col("fmt").isin(*parsers)).select("fmt", "document_id", "content").dropDuplicates(["document_id"]).mapInPandas(work, schema)


def elements(files: DataFrame, parsers: dict[str, Callable] | None = None) -> DataFrame:
    """Elements of all files with a parser; equal files count once."""
    return _rows(files, ELEMENTS, 0, parsers or PARSERS)


def cells(files: DataFrame, parsers: dict[str, Callable] | None = None) -> DataFrame:
    """Cells of all files with a parser."""
    return _rows(files, CELLS, 1, parsers or PARSERS)


def ocr_needed(pages: DataFrame) -> DataFrame:
    """Pages without native text, or with images on more than 15 % of their area: (document_id, page, reason)."""
    empty = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
    scan = F.col("image_area") > 0.15 * F.col("page_area")
    return pages.where(empty | F.coalesce(scan, F.lit(False))).select("document_id", "page", F.when(empty, "no text").otherwise("image").alias("reason"))


RECOGNISED = "document_id string, page int, ordinal int, text string, bbox array<double>, confidence double"


def recognised(requests: DataFrame, backend: Callable[[bytes, dict], list[tuple[str, list[float], float]]]) -> DataFrame:
    """Text lines of page images (document_id, page, image) by an OCR ``backend(image, request)`` that gives (text, box, confidence) in reading order.

    The backend runs inside Arrow batches, once a page; a null image or one the
    backend finds nothing on gives no row.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, page, image in zip(pdf["document_id"], pdf["page"], pdf["image"]):
                lines = [] if image is None else backend(bytes(image), {"document_id": doc, "page": int(page)})
                rows += [(doc, int(page), n, text, [float(x) for x in box], float(sure)) for n, (text, box, sure) in enumerate(lines)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECOGNISED.split(", ")])

    return requests.select("document_id", "page", "image").mapInPandas(work, RECOGNISED)
