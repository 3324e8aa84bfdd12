"""Validation: rules as queries that return violations as rows or arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def location_violations(source: Column) -> Column:
    """Names of the rules a source location breaks: pdf has a page from 1, others none; docx a paragraph or table; xlsx sheet and range; boxes ordered."""
    fmt, page, box = source["fmt"], source["page"], source["bbox"]
    rule = lambda name, bad: F.when(F.coalesce(bad, F.lit(False)), F.lit(name))
    return F.array_compact(
        F.array(
            rule("unknown format", ~F.coalesce(fmt.isin("pdf", "docx", "xlsx"), F.lit(False))),
            rule("pdf without page", (fmt == "pdf") & (page.isNull() | (page < 1))),
            rule("page outside pdf", (fmt != "pdf") & page.isNotNull()),
            rule("box outside pdf", (fmt != "pdf") & box.isNotNull()),
            rule("docx without paragraph or table", (fmt == "docx") & source["paragraph"].isNull() & source["table_no"].isNull()),
            rule("xlsx without sheet or range", (fmt == "xlsx") & (source["sheet"].isNull() | source["cell_range"].isNull())),
            rule("box not ordered", (F.size(box) != 4) | (box[0] > box[2]) | (box[1] > box[3])),
        )
    )


def grid_violations(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_id, row_no, col_no, rule): cells outside their table's grid, and anchors used twice."""
    c = cells.select("table_id", "row_no", "col_no", "row_span", "col_span").join(tables.select("table_id", "n_rows", "n_cols"), "table_id")
    outside = (F.col("row_no") < 1) | (F.col("col_no") < 1) | (F.col("row_no") + F.col("row_span") - 1 > F.col("n_rows")) | (F.col("col_no") + F.col("col_span") - 1 > F.col("n_cols"))
    out = c.where(outside).select("table_id", "row_no", "col_no", F.lit("outside the grid").alias("rule"))
    twice = cells.groupBy("table_id", "row_no", "col_no").agg(F.count("*").alias("n")).where("n > 1").select("table_id", "row_no", "col_no", F.lit("anchor used twice").alias("rule"))
    return out.unionByName(twice)


def reference_violations(elements: DataFrame, tables: DataFrame) -> DataFrame:
    """(document_id, element_id, rule): table elements whose table isn't there, and ids used twice."""
    lost = elements.where("kind = 'table'").join(tables.select("document_id", "table_id"), ["document_id", "table_id"], "left_anti").select("document_id", "element_id", F.lit("no such table").alias("rule"))
    twice = elements.groupBy("document_id", "element_id").agg(F.count("*").alias("n")).where("n > 1").select("document_id", "element_id", F.lit("id used twice").alias("rule"))
    return lost.unionByName(twice)


def latest(df: DataFrame, keys: list[str], loaded_at: str = "loaded_at") -> DataFrame:
    """The last delivery of every key.  Partial aggregation keeps one row per key and task before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(loaded_at)).alias("r__"))
    return one.select(*keys, *(F.col(f"r__.`{c}`").alias(c) for c in rest)).select(*df.columns)


def new_documents(incoming: DataFrame, library: DataFrame, key: str = "document_id") -> DataFrame:
    """Incoming rows whose document isn't in the library, each document once."""
    return incoming.join(library.select(key), key, "left_anti").dropDuplicates([key])


def without_documents(index: DataFrame, gone: DataFrame, key: str = "document_id") -> DataFrame:
    """The index without the deleted documents; nothing is encoded again."""
    return index.join(gone.select(key), key, "left_anti")
