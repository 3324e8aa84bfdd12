"""Problem 4's queries: figures in common units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.operators import quantities as Q


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("cells", "doc_tables", "quantity_register"))


def p4_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure's amount in its measure's common unit."""
    return Q.to_common_units(*_tables(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures held in another unit whose amount agrees with the register.

    A figure without a stated unit is in the common unit by definition here, so
    what the mixture assigns (p4_amounts) has no part in it.
    """
    cells, tables, register = _tables(spark, sf_dir)
    return Q.register_matches(Q.stated_amounts(cells, tables, register), register)


def queries() -> dict:
    return {"p4_found": p4_found, "p4_amounts": p4_amounts}


def oracle_sql() -> dict[str, str]:
    return {}
