"""Accepting uploaded files into a library: limits as rules over tables, equal files once, only new ones parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Formats and limits.
FORMATS = ["pdf", "docx", "xlsx"]
MOST_FILES, MOST_BYTES, MOST_TOTAL, MOST_DOCUMENTS = 10, 20 * 1024**2, 100 * 1024**2, 10


def described(files: DataFrame) -> DataFrame:
    """(name, fmt, size, document_id) of files (path, content)."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("fmt"), F.length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("document_id"))


def violations(uploads: DataFrame, library: DataFrame) -> DataFrame:
    """(name, rule): files of another format, empty or too large ones; and, with a null name, too many files, too much in total, too large a library.  Empty if all may come in."""
    bad = F.when(~F.col("fmt").isin(FORMATS), "unknown format").when(F.col("size") < 1, "empty").when(F.col("size") > MOST_BYTES, "too large")
    one = uploads.select("name", bad.alias("rule")).where("rule is not null")
    all_ = uploads.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    held = uploads.select("document_id").unionByName(library.select("document_id")).agg(F.count_distinct("document_id").alias("held"))
    rules = F.array_compact(F.array(F.when(F.col("n") < 1, F.lit("no file")), F.when(F.col("n") > MOST_FILES, F.lit("too many files")), F.when(F.col("total") > MOST_TOTAL, F.lit("too much in total")), F.when(F.col("held") > MOST_DOCUMENTS, F.lit("library too large"))))
    return one.unionByName(all_.join(held).select(F.lit(None).cast("string").alias("name"), F.explode(rules).alias("rule")))


def accepted(uploads: DataFrame, library: DataFrame) -> DataFrame:
    """The uploads that are new to the library, equal files once (under the smallest name); ValueError if a rule is broken."""
    broken = violations(uploads, library).limit(20).collect()
    if broken:
        raise ValueError("; ".join(f"{r['name'] or 'upload'}: {r['rule']}" for r in broken))
    new = uploads.join(library.select("document_id"), "document_id", "left_anti")
    return new.groupBy("document_id").agg(F.min(F.struct("name", "fmt", "size")).alias("f")).select("document_id", "f.*")
