"""Retrieval evaluation: gold pages, page metrics, budgets, roll-ups, paired comparisons, bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gold_pages(cases: DataFrame) -> DataFrame:
    """(case_id, document_id, page): evidence pages, from zero-based to one-based, each once; a negative page is an error."""
    e = cases.select("case_id", "doc_name", F.explode("evidence").alias("e"))
    doc = F.coalesce("e.doc_name", "e.evidence_doc_name", "doc_name")
    page = F.when(F.col("e.evidence_page_num") < 0, F.raise_error(F.lit("a negative page"))).otherwise(F.col("e.evidence_page_num") + 1)
    return e.select("case_id", doc.alias("document_id"), page.cast("int").alias("page")).distinct()


def page_metrics(results: DataFrame, gold: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case: hit, coverage, all_hit, mrr, unique_pages, repeat_fraction.

    results (case, rank, document_id, page), gold (case, document_id, page).
    Cases without results score 0; the reciprocal rank is over chunks.
    """
    keys = [case, "document_id", "page"]
    g = gold.select(*keys).distinct()
    marked = results.select(case, "rank", "document_id", "page").join(g.withColumn("gold", F.lit(True)), keys, "left")
    page = F.struct("document_id", "page")
    per = marked.groupBy(case).agg(
        F.count_distinct(F.when(F.col("gold"), page)).alias("found"),
        F.min(F.when(F.col("gold"), F.col("rank"))).alias("first"),
        F.count_distinct(page).alias("unique_pages"),
        F.count("*").alias("n"),
    )
    want = g.groupBy(case).agg(F.count("*").alias("want"))
    j = want.join(per, case, "left").na.fill(0, ["found", "unique_pages", "n"])
    return j.select(
        case,
        (F.col("found") > 0).cast("int").alias("hit"),
        F.round(F.col("found") / F.col("want"), 6).alias("coverage"),
        (F.col("found") == F.col("want")).cast("int").alias("all_hit"),
        F.coalesce(F.round(F.lit(1.0) / F.col("first"), 6), F.lit(0.0)).alias("mrr"),
        F.col("unique_pages").cast("bigint").alias("unique_pages"),
        F.when(F.col("n") > 0, F.round(1 - F.col("unique_pages") / F.col("n"), 6)).otherwise(0.0).alias("repeat_fraction"),
    )


def recall_at(results: DataFrame, relevant: DataFrame, ks: list[int], query: str = "query_id") -> DataFrame:
    """(query, k, hits, recall, hit, mrr) for several k from one ranking."""
    want = relevant.groupBy(query).agg(F.count("*").alias("want"))
    r = results.join(relevant.select(query, "chunk_id"), [query, "chunk_id"], "left_semi").select(query, "rank")
    grid = want.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    j = grid.join(r, query, "left").groupBy(query, "k", "want").agg(F.count(F.when(F.col("rank") <= F.col("k"), 1)).alias("hits"), F.min(F.when(F.col("rank") <= F.col("k"), F.col("rank"))).alias("first"))
    return j.select(query, "k", "hits", F.round(F.col("hits") / F.col("want"), 6).alias("recall"), (F.col("hits") > 0).cast("int").alias("hit"), F.coalesce(F.round(1.0 / F.col("first"), 6), F.lit(0.0)).alias("mrr"))


def budget_prefix(ranked: DataFrame, budget: int, key: str = "query_id", cost: str = "token_count", rank: str = "rank") -> DataFrame:
    """Whole chunks in rank order until the first that would exceed the budget; nothing is skipped over.  A null cost counts 0."""
    run = F.sum(F.coalesce(cost, F.lit(0))).over(Window.partitionBy(key).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", run).where(F.col("used") <= budget)


def mean_percentiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, median, p95) with exact, linearly interpolated percentiles; nulls don't count."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), p.alias("p")).select(*by, "n", "mean", F.round(F.col("p")[0], 6).alias("median"), F.round(F.col("p")[1], 6).alias("p95"))


def paired(df: DataFrame, case: str, config: str, value: str, base: str, other: str, eps: float = 1e-12) -> DataFrame:
    """(case, base, other, delta, change) of cases that both configurations completed."""
    p = df.where(F.col(config).isin(base, other)).groupBy(case).agg(F.max(F.when(F.col(config) == base, F.col(value))).alias("base"), F.max(F.when(F.col(config) == other, F.col(value))).alias("other")).where("base is not null and other is not null")
    d = F.col("other") - F.col("base")
    return p.withColumn("delta", d).withColumn("change", F.when(d > eps, "improved").when(d < -eps, "worse").otherwise("unchanged"))


def bootstrap(deltas: DataFrame, by: str, value: str = "delta", resamples: int = 10_000, seed: int = 7) -> DataFrame:
    """(by, n, mean, low, high): mean of paired differences with a 95 % percentile interval.

    Groups are cases of one comparison, bounded by the evaluation set; each has a generator of its own.
    """
    kind = deltas.schema[by].dataType.simpleString()

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["v"].dropna().to_numpy("f8"))
        if not len(x):
            return pd.DataFrame({"by": [pdf["by"].iloc[0]], "n": [0], "mean": [np.nan], "low": [np.nan], "high": [np.nan]})
        rng = np.random.default_rng(seed)
        means = np.concatenate([x[rng.integers(0, len(x), (m, len(x)))].mean(1) for m in _batches(resamples, len(x))])
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({"by": [pdf["by"].iloc[0]], "n": [len(x)], "mean": [x.mean()], "low": [low], "high": [high]})

    return deltas.select(F.col(by).alias("by"), F.col(value).cast("double").alias("v")).groupBy("by").applyInPandas(draw, f"by {kind}, n bigint, mean double, low double, high double").withColumnRenamed("by", by)


def _batches(total: int, width: int) -> list[int]:
    size = max(1, 2_000_000 // max(1, width))
    return [min(size, total - i) for i in range(0, total, size)]


def promote(summary: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The best configuration of each group by composite keys."""
    return summary.withColumn("n__", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("n__ = 1").drop("n__")


def grouped_sample(df: DataFrame, stratum: str, group: str, key: str, quota: int, seed: str = "") -> DataFrame:
    """As ``quota_sample``, but at most one row of a group: the group's first in the order of the seeded hash."""
    h = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    first = df.withColumn("g__", F.row_number().over(Window.partitionBy(group).orderBy(h, key))).where("g__ = 1").drop("g__")
    return quota_sample(first, stratum, key, quota, seed)


def quota_sample(df: DataFrame, stratum: str, key: str, quota: int, seed: str = "") -> DataFrame:
    """``quota`` rows of every stratum, in the order of a seeded hash of the key."""
    h = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    return df.withColumn("h__", h).withColumn("pick", F.row_number().over(Window.partitionBy(stratum).orderBy("h__", key))).where(F.col("pick") <= quota).drop("h__")
