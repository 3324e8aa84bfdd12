"""Evaluation grids: all configurations of an experiment in one plan, a configuration being a column.

A ranking is computed once; cut-offs, budgets and thresholds are conditions on its
rows, which are exploded into the configurations they belong to.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import chunking as K
from quillstone.operators import content as N
from quillstone.operators import evidence as E
from quillstone.operators import metrics as M
from quillstone.operators import retrieval as R
from quillstone.session import materialize

KS, BUDGET = (5, 10, 20), 2_000


def cut_modes(ranked: DataFrame, ks: tuple[int, ...] = KS, budget: int = BUDGET, query: str = "query_id", cost: str = "token_count") -> DataFrame:
    """``ranked`` once for every mode a row belongs to: top<k>, and budget<n> for whole chunks in rank order up to a cost.  A null cost counts 0."""
    used = F.sum(F.coalesce(cost, F.lit(0))).over(Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    modes = [F.when(F.col("rank") <= k, F.lit(f"top{k}")) for k in ks] + [F.when(F.col("used__") <= budget, F.lit(f"budget{budget}"))]
    return ranked.withColumn("used__", used).withColumn("mode", F.explode(F.array_compact(F.array(*modes)))).drop("used__")


def score_modes(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS, budget: int = BUDGET, query: str = "query_id") -> DataFrame:
    """(mode, query, page metrics): a ranking (query, rank, document_id, page, token_count) scored in all modes; queries without results score 0."""
    names = F.array(*(F.lit(f"top{k}") for k in ks), F.lit(f"budget{budget}"))
    case = F.struct("mode", F.col(query)).alias("case_id")
    r = cut_modes(ranked, ks, budget, query).select(case, "rank", "document_id", "page")
    g = gold.withColumn("mode", F.explode(names)).select(case, "document_id", "page")
    m = M.page_metrics(r, g)
    return m.select("case_id.mode", F.col(f"case_id.{query}").alias(query), *(c for c in m.columns if c != "case_id"))


def means(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by, n, mean of each value): nulls, as of cases that need a manual judgement, leave a mean's denominator but not n."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(F.avg(v), 6).alias(v) for v in values))


def two_denominators(df: DataFrame, by: list[str], pages: list[str], contents: list[str], manual: Column) -> DataFrame:
    """(by, n, n_scored, means): page metrics over all cases, content metrics over those that need no manual judgement."""
    scored = df.select(*by, *pages, *(F.when(~manual, F.col(c)).alias(c) for c in contents), F.when(~manual, 1).alias("scored__"))
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.count("scored__").alias("n_scored"), *(F.round(F.avg(c), 6).alias(c) for c in [*pages, *contents]))


def prefix_grid(pools: dict[int, DataFrame], ks: tuple[int, ...], query: str = "query_id") -> DataFrame:
    """(candidates, k, row…): one re-ranked list per pool size, every k a prefix of it."""
    out = None
    for size, ranked in pools.items():
        part = ranked.where(F.col("rank") <= max(ks)).withColumn("candidates", F.lit(size))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))


def selection_grid(reranked: DataFrame, thresholds: tuple[float, ...], weights: tuple[float, ...] = (), top_k: int = 7) -> DataFrame:
    """(config, query_id, chunk_id, rerank_score, rank): the first ``top_k``; those at or above each threshold; and, with embeddings, MMR of each weight after each threshold."""
    cols = ["query_id", "chunk_id", "rerank_score", "rank"]
    first = reranked.where(F.col("rank") <= top_k)
    names = F.array(F.lit(f"top{top_k}"), *(F.when(F.col("rerank_score") >= t, F.lit(f"t={t}")) for t in thresholds))
    out = first.withColumn("config", F.explode(F.array_compact(names))).select("config", *cols)
    for t in thresholds:
        for w in weights:
            out = out.unionByName(R.mmr_select(reranked, w, top_k, t).select(F.lit(f"t={t} mmr={w}").alias("config"), *cols))
    return out


def quota_grid(results: DataFrame, counts: tuple[int, ...], ks: tuple[int, ...], key: str = "session") -> DataFrame:
    """(session, queries, k, chunk_id, query_no, rank): for every number of queries a batch may hold and every total k, each query's share of places, a chunk at its first sight only.

    ``results``: (session, query_no from 1, rank, chunk_id).
    """
    grid = F.explode(F.array(*(F.struct(F.lit(q).alias("queries"), F.lit(k).alias("k")) for q in counts for k in ks)))
    g = results.withColumn("g__", grid).select(*results.columns, "g__.queries", "g__.k").where("query_no <= queries")
    g = g.where(F.col("rank") <= E.quota(F.col("k"), F.col("queries"), F.col("query_no") - 1))
    first = g.groupBy(key, "queries", "k", "chunk_id").agg(F.min(F.struct("query_no", "rank")).alias("f"))
    return first.select(key, "queries", "k", "chunk_id", "f.query_no", "f.rank")


def evaluate_ids(chosen: DataFrame, chunks: DataFrame, gold: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case: page metrics, tokens, and support_fraction, the share of returned chunks on a gold page.

    ``chosen``: (case, rank, chunk_id); a chunk id returned twice for a case is an
    error, an unknown one too.
    """
    twice = F.count("*").over(Window.partitionBy(case, "chunk_id"))
    safe = chosen.withColumn("chunk_id", F.when(twice > 1, F.raise_error(F.lit("a chunk id is returned twice"))).otherwise(F.col("chunk_id")))
    known = chunks.select("chunk_id", "document_id", "page", "token_count", F.lit(True).alias("known__"))
    r = safe.join(known, "chunk_id", "left").withColumn("chunk_id", F.when(F.col("known__"), F.col("chunk_id")).otherwise(F.raise_error(F.lit("an unknown chunk id"))))
    on = r.join(gold.select(case, "document_id", "page").distinct().withColumn("gold__", F.lit(1)), [case, "document_id", "page"], "left")
    more = on.groupBy(case).agg(F.count("chunk_id").alias("chunks"), F.sum("token_count").alias("tokens"), F.round(F.count("gold__") / F.count("*"), 6).alias("support_fraction"))
    return M.page_metrics(r, gold, case).join(more, case, "left").na.fill(0, ["chunks", "tokens", "support_fraction"])


def against_baseline(df: DataFrame, case: str, config: str, base: str, values: list[str]) -> DataFrame:
    """(config, metric, n, base_mean, mean, delta, improved, worse, unchanged): every other configuration against ``base`` over the cases both completed."""
    long = df.select(case, config, F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values))).alias("m")).select(case, config, "m.*").where("value is not null")
    b = long.where(F.col(config) == base).select(case, "metric", F.col("value").alias("base__"))
    j = long.where(F.col(config) != base).join(b, [case, "metric"]).withColumn("d__", F.col("value") - F.col("base__"))
    mean = lambda c: F.round(F.avg(c), 6)
    return j.groupBy(config, "metric").agg(F.count("*").alias("n"), mean("base__").alias("base_mean"), mean("value").alias("mean"), mean("d__").alias("delta"), F.count_if(F.col("d__") > 1e-12).alias("improved"), F.count_if(F.col("d__") < -1e-12).alias("worse"), F.count_if(F.abs("d__") <= 1e-12).alias("unchanged"))


def model_grid(models: dict[str, tuple[DataFrame, DataFrame]], chunks: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS, budget: int = BUDGET) -> DataFrame:
    """(model, mode, query_id, page metrics): every encoder's (questions with qvec, chunks with embedding) ranked by cosine and scored in all modes.

    ``chunks``: (chunk_id, document_id, page, token_count).
    """
    out = None
    for name, (queries, vectors) in models.items():
        r = R.dense_topk(queries, vectors, max(ks)).join(chunks.select("chunk_id", "document_id", "page", "token_count"), "chunk_id")
        part = score_modes(r, gold, ks, budget).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def score_chunkings(chunkings: dict[str, DataFrame], queries: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """(config, n_chunks, n_words, questions, hits, mrr): ways of cutting pages, (chunk_id, document_id, page, n_words, text) each, searched by BM25 and scored by the gold page in the first ``k``."""
    out = None
    for name, c in chunkings.items():
        c = c.select("chunk_id", "document_id", "page", "n_words", X.tokens(F.col("text")).alias("t"))
        c = materialize(c.withColumn("dl", F.size("t")), "chunking")  # with its tokens, without its texts, so that it is written once
        top = R.bm25_topk(queries, c, k).join(c.select("chunk_id", "document_id", "page"), "chunk_id")
        m = M.page_metrics(top, gold, "query_id").agg(F.count("*").alias("questions"), F.sum("hit").alias("hits"), F.round(F.avg("mrr"), 6).alias("mrr"))
        part = c.agg(F.count("*").alias("n_chunks"), F.sum("n_words").alias("n_words")).join(m).withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _named(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.concat_ws("|", "document_id", "page", "chunk_no").alias("chunk_id"), "document_id", "page", F.size(X.words(F.col("chunk"))).alias("n_words"), F.col("chunk").alias("text"))


def window_chunkings(pages: DataFrame, configs: list[tuple[int, int]]) -> dict[str, DataFrame]:
    """Pages (document_id, page, text) cut into word windows by every (size, overlap)."""
    return {f"{size}/{overlap}": _named(K.word_windows(pages, ["document_id", "page"], size=size, overlap=overlap)) for size, overlap in configs}


def paragraph_chunkings(pages: DataFrame, sizes: list[int]) -> dict[str, DataFrame]:
    """Pages cut at paragraphs, then sentences, then words, pieces left apart and packed."""
    cut = lambda n, pack: K.chunk_rows(pages, ["document_id", "page"], "text", lambda t: K.sentence_chunks(t, n, pack, K.word_count))
    return {f"paragraphs {n}{' packed' if pack else ''}": _named(cut(n, pack)) for n in sizes for pack in (False, True)}


def adaptive_rounds(results: DataFrame, enough: Column, k: int, key: str = "session") -> DataFrame:
    """(config, session, chunk_id, searches): one search, two that share ``k`` places, or a second one only where the first isn't ``enough``.

    ``results``: (session, query_no 1 or 2, rank, chunk_id, score); ``enough`` is an
    aggregate over a session's first search.  A session without results is in no
    configuration.
    """
    fine = results.where("query_no = 1").groupBy(key).agg(enough.alias("fine__"))
    r = results.join(fine, key, "left").withColumn("fine__", F.coalesce("fine__", F.lit(False)))
    share = F.col("rank") <= E.quota(F.lit(k), F.lit(2), F.col("query_no") - 1)
    first = (F.col("query_no") == 1) & (F.col("rank") <= k)
    configs = F.array_compact(F.array(F.when(first, F.lit("one")), F.when(share, F.lit("two")), F.when(F.when(F.col("fine__"), first).otherwise(share), F.lit("adaptive"))))
    searches = F.when(F.col("config") == "one", 1).when(F.col("config") == "two", 2).otherwise(F.when(F.col("fine__"), 1).otherwise(2))
    return r.withColumn("config", F.explode(configs)).select("config", key, "chunk_id", searches.alias("searches")).distinct()


def unit_hits(units: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """(document_id, unit_id, page[, chunk_id]) where an evidence unit is found in a text of its document.

    ``units``: (document_id, unit_id, unit as JSON); ``texts``: (document_id, page, text) and,
    for chunks, chunk_id.  Null texts hold nothing.
    """
    keys = ["page"] + (["chunk_id"] if "chunk_id" in texts.columns else [])
    j = units.select("document_id", "unit_id", "unit").join(texts.select("document_id", *keys, F.col(text).alias("text__")).where("text__ is not null"), "document_id")
    out = ", ".join(f"{c} {j.schema[c].dataType.simpleString()}" for c in ("document_id", "unit_id", *keys))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            forms: dict[str, str] = {}
            hit = [N.match_normal(forms.setdefault(t, N.normal(t)), json.loads(u)) is not None for u, t in zip(pdf["unit"], pdf["text__"])]
            yield pdf.loc[hit, ["document_id", "unit_id", *keys]]

    return j.mapInPandas(work, out)


def rubric(units: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, unit_id, pages): all pages of its document a unit is found on; a unit found nowhere is an error."""
    hits = unit_hits(units, pages).groupBy("document_id", "unit_id").agg(F.sort_array(F.collect_set("page")).alias("pages"))
    j = units.select("document_id", "unit_id").join(hits, ["document_id", "unit_id"], "left")
    return j.withColumn("pages", F.when(F.col("pages").isNull(), F.raise_error(F.concat(F.lit("a unit is found on no page: "), F.col("unit_id").cast("string")))).otherwise(F.col("pages")))


def reachability(units: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, unit_id, in_page, in_chunk): can a unit be found in a page's text at all, and in a single chunk?"""
    seen = lambda d, name: unit_hits(units, d).select("document_id", "unit_id").distinct().withColumn(name, F.lit(True))
    j = units.select("document_id", "unit_id").join(seen(pages, "in_page"), ["document_id", "unit_id"], "left").join(seen(chunks, "in_chunk"), ["document_id", "unit_id"], "left")
    return j.na.fill(False, ["in_page", "in_chunk"])
