"""Table structure: span expansion, header paths, row rendering, previews, geometry."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def covered_positions(cells: DataFrame) -> DataFrame:
    """Every grid position a cell covers: (table_id, row_no, col_no, anchor_row, anchor_col, cell_id).  A span below 1 counts as 1.

    Interval containment becomes an equi-join key by writing out the interval.
    """
    rows = F.explode(F.sequence(F.col("row_no"), F.col("row_no") + F.greatest(F.coalesce("row_span", F.lit(1)), F.lit(1)) - 1))
    cols = F.explode(F.sequence(F.col("col_no"), F.col("col_no") + F.greatest(F.coalesce("col_span", F.lit(1)), F.lit(1)) - 1))
    c = cells.select("table_id", "cell_id", "row_no", "col_no", "col_span", rows.alias("r"))
    return c.select("table_id", "cell_id", "row_no", "col_no", "r", cols.alias("c")).select("table_id", F.col("r").alias("row_no"), F.col("c").alias("col_no"), F.col("row_no").alias("anchor_row"), F.col("col_no").alias("anchor_col"), "cell_id")


def column_headers(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_id, col_no, header): the header rows' texts above a column joined by " / ", merged headers included."""
    heads = tables.select("table_id", F.explode("header_rows").alias("row_no"))
    at = covered_positions(cells).join(heads, ["table_id", "row_no"], "left_semi")
    t = at.join(cells.select("cell_id", "text"), "cell_id").where("trim(coalesce(text, '')) <> ''")
    got = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "text"))), lambda x: x["text"]))
    return t.groupBy("table_id", "col_no").agg(F.array_join(got, " / ").alias("header"))


def header_cells(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_id, row_no, col_no) of the cells that cover a header row, by their own place."""
    heads = tables.select("table_id", F.explode("header_rows").alias("row_no"))
    at = covered_positions(cells).join(heads, ["table_id", "row_no"], "left_semi")
    return at.select("table_id", F.col("anchor_row").alias("row_no"), F.col("anchor_col").alias("col_no")).distinct()


def render_rows(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(document_id, table_id, row_no, row_text, cell_refs): body rows as ``C<n> [<year>]: <text> [format=<f>]`` joined by " | "; blank cells are left out, blank rows give nothing."""
    heads = tables.select("table_id", F.explode("header_rows").alias("row_no"))
    body = cells.where("trim(coalesce(text, '')) <> ''").join(heads, ["table_id", "row_no"], "left_anti")
    years = column_headers(cells, tables).select("table_id", "col_no", F.regexp_extract("header", r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)", 1).alias("year"))
    j = body.join(years, ["table_id", "col_no"], "left")
    year = F.when(F.coalesce("year", F.lit("")) != "", F.concat(F.lit(" ["), F.col("year"), F.lit("]"))).otherwise("")
    fmt = F.when(F.col("number_format").isNotNull() & (F.col("number_format") != "General"), F.concat(F.lit(" [format="), F.col("number_format"), F.lit("]"))).otherwise("")
    one = F.concat(F.lit("C"), F.col("col_no").cast("string"), year, F.lit(": "), F.col("text"), fmt)
    got = F.sort_array(F.collect_list(F.struct("col_no", one.alias("t"))))
    return j.groupBy("document_id", "table_id", "row_no").agg(
        F.array_join(F.transform(got, lambda x: x["t"]), " | ").alias("row_text"), F.transform(got, lambda x: F.struct(F.col("row_no").alias("row_no"), x["col_no"].alias("col_no"))).alias("cell_refs")
    )


def preview(cells: DataFrame, rows: int = 100, columns: int = 50) -> DataFrame:
    """(table_id, row_no, texts): a dense grid up to ``rows`` x ``columns``; covered positions are empty strings beside their anchor's text."""
    c = cells.where((F.col("row_no") <= rows) & (F.col("col_no") <= columns)).select("table_id", "row_no", "col_no", "text")
    got = F.map_from_entries(F.collect_list(F.struct("col_no", F.coalesce("text", F.lit("")).alias("text"))))
    g = c.groupBy("table_id", "row_no").agg(got.alias("m"), F.max("col_no").alias("last"))
    return g.select("table_id", "row_no", F.transform(F.sequence(F.lit(1), F.col("last")), lambda i: F.coalesce(F.element_at("m", i), F.lit(""))).alias("texts"))


def grid_spans(boxes: DataFrame, slack: float = 1e-6) -> DataFrame:
    """Spans of merged boxes: how many distinct column and row origins of its table a box covers, at least 1.

    boxes: (table_id, cell_id, x0, y0, x1, y1).
    """
    xs = boxes.select("table_id", F.col("x0").alias("x")).distinct()
    ys = boxes.select("table_id", F.col("y0").alias("y")).distinct()
    bx = boxes.join(xs, "table_id").where((F.col("x") >= F.col("x0") - slack) & (F.col("x") < F.col("x1") - slack)).groupBy("table_id", "cell_id").agg(F.count("*").alias("c"))
    by = boxes.join(ys, "table_id").where((F.col("y") >= F.col("y0") - slack) & (F.col("y") < F.col("y1") - slack)).groupBy("table_id", "cell_id").agg(F.count("*").alias("r"))
    j = boxes.select("table_id", "cell_id").join(bx, ["table_id", "cell_id"], "left").join(by, ["table_id", "cell_id"], "left")
    return j.select("table_id", "cell_id", F.greatest(F.coalesce("r", F.lit(1)), F.lit(1)).alias("row_span"), F.greatest(F.coalesce("c", F.lit(1)), F.lit(1)).alias("col_span"))


def bbox_union(boxes: DataFrame, by: list[str], bbox: str = "bbox") -> DataFrame:
    b = F.col(bbox)
    return boxes.groupBy(*by).agg(F.array(F.min(b[0]), F.min(b[1]), F.max(b[2]), F.max(b[3])).alias("bbox"))


_YEAR = re.compile(r"(?:19|20)\d{2}")
_VALUE = re.compile(r"\(?[-–]?[$€£]?\s*\d[\d,.]*\)?%?|[-–—]")  # a dash alone is nil


def _line_groups(items: list[tuple], tolerance: float = 2.5) -> list[list[tuple]]:
    """Items (centre, ...) grouped into lines: a new one starts beyond ``tolerance`` of the group's first centre."""
    out: list[list[tuple]] = []
    for it in sorted(items):
        if out and abs(it[0] - out[-1][0][0]) <= tolerance:
            out[-1].append(it)
        else:
            out.append([it])
    return out


def year_tables(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Borderless tables anchored on year headers: (keys, table_no, row_no, label, col_no, year, value).

    lines: (keys, x0, y0, x1, y1, text), one page per key.  A header is a line of
    2 to 5 different years more than 12 points apart; rows follow within 45
    points of each other; a value belongs to the year whose right edge is nearest,
    at most 18 points away; a row with a value too far or a year twice is left
    out, as is one whose label has no letter; a dash stands for nil, a currency sign up to 24 points left of one
    value joins it; fewer than 3 complete rows make no table.
    """
    schema = ", ".join(f"{k} {lines.schema[k].dataType.simpleString()}" for k in keys) + ", table_no int, row_no int, label string, col_no int, year string, value string"

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = _line_groups([((y0 + y1) / 2, x0, x1, str(t).strip()) for x0, y0, x1, y1, t in zip(pdf["x0"], pdf["y0"], pdf["x1"], pdf["y1"], pdf["text"]) if str(t).strip()])
        rows, table, at = [], 0, 0
        while at < len(groups):
            years = sorted((x0, x1, t) for _, x0, x1, t in groups[at] if _YEAR.fullmatch(t))
            at += 1
            if not 2 <= len(years) <= 5 or len({t for *_, t in years}) != len(years) or any(b[0] - a[1] <= 12 for a, b in zip(years, years[1:])):
                continue
            found, last = [], groups[at - 1][0][0]
            while at < len(groups) and groups[at][0][0] - last <= 45:
                items = sorted((x0, x1, t) for _, x0, x1, t in groups[at])
                if sum(bool(_YEAR.fullmatch(t)) for *_, t in items) >= 2:
                    break
                last = groups[at][0][0]
                at += 1
                label = [t for x0, x1, t in items if x1 < years[0][0] and not _VALUE.fullmatch(t) and t not in "$€£"]
                values = [(x0, x1, t) for x0, x1, t in items if _VALUE.fullmatch(t) and abs(x1 - min(years, key=lambda y: abs(y[1] - x1))[1]) <= 60]
                signs = [(x0, x1, t) for x0, x1, t in items if t in ("$", "€", "£")]
                cells: dict[int, str] = {}
                clear = True
                for x0, x1, t in values:
                    n = min(range(len(years)), key=lambda i: abs(years[i][1] - x1))
                    if abs(years[n][1] - x1) > 18 or n in cells:
                        clear = False
                        break
                    near = [s for s in signs if 0 <= x0 - s[1] <= 24]
                    cells[n] = (near[0][2] if len(near) == 1 else "") + t
                if clear and any(c.isalpha() for t in label for c in t) and len(cells) == len(years):
                    found.append((" ".join(label), cells))
            if len(found) >= 3:
                table += 1
                for r, (name, cells) in enumerate(found, 1):
                    rows += [(table, r, name, n + 2, years[n][2], v) for n, v in sorted(cells.items())]
        out = pd.DataFrame(rows, columns=["table_no", "row_no", "label", "col_no", "year", "value"])
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return lines.groupBy(*keys).applyInPandas(page, schema)


def outside_boxes(lines: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Lines whose midpoint lies in no box of their page."""
    mx, my = (F.col("l.x0") + F.col("l.x1")) / 2, (F.col("l.y0") + F.col("l.y1")) / 2
    same = [F.col(f"l.{k}") == F.col(f"b.{k}") for k in keys]
    cond = same[0]
    for c in [*same[1:], mx.between(F.col("b.x0"), F.col("b.x1")), my.between(F.col("b.y0"), F.col("b.y1"))]:
        cond = cond & c
    return lines.alias("l").join(boxes.alias("b"), cond, "left_anti")


def heading_paths(elements: DataFrame, levels: int = 9) -> DataFrame:
    """elements (document_id, ordinal, level or null, text) with heading_path: the headings above each row, outermost first.

    A heading of level l closes all of level l and deeper; per level the last
    heading counts unless a shallower one came after it.
    """
    w = Window.partitionBy("document_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("level") == n, F.struct("ordinal", "text"))).over(w).alias(f"h{n}") for n in range(1, levels + 1)]
    e = elements.select("*", *last)
    path = []
    for n in range(1, levels + 1):
        above = [F.coalesce(F.col(f"h{m}.ordinal"), F.lit(-1)) for m in range(1, n)]
        over = F.greatest(F.lit(-1), *above) if above else F.lit(-1)
        path.append(F.when(F.col(f"h{n}.ordinal") > over, F.col(f"h{n}.text")))
    return e.withColumn("heading_path", F.array_compact(F.array(*path))).drop(*(f"h{n}" for n in range(1, levels + 1)))


def a1_slice(cell_range: str, first: int, last: int) -> str:
    """Rows ``first`` to ``last`` (from 1) of an A1 range, as a range."""
    m = re.fullmatch(r"([A-Z]+)(\d+)(?::([A-Z]+)(\d+))?", cell_range)
    if not m or not 1 <= first <= last:
        raise ValueError("not a range")
    a, r, b = m[1], int(m[2]), m[3] or m[1]
    return f"{a}{r + first - 1}:{b}{r + last - 1}"


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out
