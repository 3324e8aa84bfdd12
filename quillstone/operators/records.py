"""Small operators over records: provenance, questions, positions, round trips, symmetric checks, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The fields a source may have, and the line that names a question's report.
SOURCE_FIELDS = ["fmt", "page", "bbox", "paragraph", "heading_path", "table_no", "sheet", "cell_range"]
TARGET = "\nTarget report: {}.pdf"


def provenance(source: Column, fields: list[str] = SOURCE_FIELDS) -> Column:
    """The fields of a source struct that are there, as a map from name to text; null gives an empty map.  An empty list is there."""
    given = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(source[f].cast("string") for f in fields)))
    return F.map_filter(given, lambda k, v: v.isNotNull())


def target_question(question: Column, document: Column) -> Column:
    """A question with its target report's name."""
    before, after = TARGET.split("{}")
    return F.concat(question, F.lit(before), document, F.lit(after))


def zip_by_position(left: DataFrame, right: DataFrame, position: str = "position_no", key: str = "chunk_id") -> DataFrame:
    """Two tables in the same order, joined by position; a missing partner or another id at a position is an error."""
    r = right.select(position, F.col(key).alias("other__"), *(c for c in right.columns if c not in (position, key)))
    j = left.join(r, position, "full_outer")
    same = F.col(key) == F.col("other__")
    return j.withColumn(key, F.when(F.coalesce(same, F.lit(False)), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("the tables differ at position "), F.col(position).cast("string"))))).drop("other__")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with ``side`` (left or right), repeated rows counted; empty if they hold the same."""
    cols = a.columns
    n = F.sum("n__").alias("n__")
    both = a.select(*cols, F.lit(1).alias("n__")).unionByName(b.select(*cols, F.lit(-1).alias("n__"))).groupBy(*cols).agg(n).where("n__ <> 0")
    return both.select(*cols, F.when(F.col("n__") > 0, "left").otherwise("right").alias("side"), F.abs("n__").alias("times"))


def reading_order(elements: DataFrame, document: str = "document_id", page: str = "page", bbox: str = "bbox", tie: str = "ordinal") -> DataFrame:
    """elements with ``reading_no`` from 1 per page: by upper, then left edge, boxes before elements without one, then by ``tie``."""
    w = Window.partitionBy(document, page).orderBy(F.asc_nulls_last(F.element_at(bbox, 2)), F.asc_nulls_last(F.element_at(bbox, 1)), F.asc(tie))
    return elements.withColumn("reading_no", F.row_number().over(w))


def page_elements(lines: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Lines and tables of pages as elements in reading order: (keys, reading_no, kind, text, table_no, bbox).

    ``lines``: (keys, x0, y0, x1, y1, text), ``tables``: (keys, table_no, x0, y0, x1, y1).  A line
    whose midpoint lies in a table is the table's, blank lines are none.
    """
    from quillstone.operators.tables import outside_boxes

    box = F.array("x0", "y0", "x1", "y1").alias("bbox")
    free = outside_boxes(lines, tables, keys).where("trim(coalesce(text, '')) <> ''").select(*keys, F.lit("paragraph").alias("kind"), "text", F.lit(None).cast("int").alias("table_no"), box)
    both = free.unionByName(tables.select(*keys, F.lit("table").alias("kind"), F.lit(None).cast("string").alias("text"), F.col("table_no").cast("int").alias("table_no"), box))
    w = Window.partitionBy(*keys).orderBy(F.element_at("bbox", 2), F.element_at("bbox", 1), "kind", F.coalesce("text", F.lit("")), "table_no")
    return both.withColumn("reading_no", F.row_number().over(w))
