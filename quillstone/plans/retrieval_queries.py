"""Catalogue: BM25, dense retrieval, fusion, re-ranking, selection, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import evidence as E
from quillstone.operators import metrics as M
from quillstone.operators import retrieval as R
from quillstone.plans.common import BM25_SCORES, CORPUS, DENSE_SCORES, RERANK, RRF, corpus, questions, table
from quillstone.session import materialize

_ALL = DENSE_SCORES + BM25_SCORES + RRF + RERANK
_int = "cast({} as integer) as {}".format


def bm25_terms(s: SparkSession, d: str) -> DataFrame:
    c = R.tokenised(corpus(s, d))
    return R.terms(R.postings(c), R.corpus_stats(c).first()["n"]).select("term", "df", F.round("idf", 9).alias("idf"))


def bm25_corpus_stats(s: SparkSession, d: str) -> DataFrame:
    return R.corpus_stats(corpus(s, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_postings(s: SparkSession, d: str) -> DataFrame:
    return R.postings(corpus(s, d)).select("term", "chunk_id", "tf", F.col("dl").cast("bigint").alias("dl"))


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return R.bm25_topk(questions(s, d), corpus(s, d))


def dense_topk(s: SparkSession, d: str) -> DataFrame:
    return R.dense_topk(questions(s, d), corpus(s, d))


def dense_topk_excluding(s: SparkSession, d: str) -> DataFrame:
    q, c = questions(s, d), corpus(s, d)
    first = R.dense_topk(q, c, 5)
    return R.dense_topk(q, c, 5, exclude=first)


def vector_validity(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d)
    v = F.col("embedding")
    return c.select("chunk_id", F.coalesce(R.valid_vector(v), F.lit(False)).alias("usable"), F.coalesce(R.valid_vector(v, unit=True), F.lit(False)).alias("unit"))


def label_knn_hit(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    c = e.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    q = c.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec"))
    me = q.select("query_id", F.col("query_id").alias("chunk_id"))
    top = R.dense_topk(q, c.select("chunk_id", "embedding"), 10, exclude=me)
    lab = c.select("chunk_id", "label")
    j = top.join(lab, "chunk_id").join(lab.select(F.col("chunk_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return j.groupBy("query_id").agg(F.count(F.when(F.col("label") == F.col("own"), 1)).alias("same"), F.coalesce(F.min(F.when(F.col("label") == F.col("own"), F.col("rank"))), F.lit(0)).alias("first_rank"))


def _ranks(df: DataFrame) -> DataFrame:
    """A list a chunk isn't in shows as rank 0 in the catalogue's results."""
    return df.na.fill(0, ["dense_rank", "bm25_rank"])


def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    q, c = questions(s, d), corpus(s, d)
    return _ranks(R.rrf(R.dense_topk(q, c), R.bm25_topk(q, c)))


def candidate_union(s: SparkSession, d: str) -> DataFrame:
    q, c = questions(s, d), corpus(s, d)
    a, b = R.dense_topk(q, c), R.bm25_topk(q, c)
    both = a.select("query_id", "chunk_id", F.col("rank").alias("ord")).unionByName(b.select("query_id", "chunk_id", (F.col("rank") + 20).alias("ord")))
    return both.groupBy("query_id", "chunk_id").agg(F.min("ord").alias("ord"))


def _stages(s: SparkSession, d: str, threshold: float | None = None) -> dict[str, DataFrame]:
    return R.Retriever(corpus(s, d), threshold=threshold).stages(questions(s, d))


def rerank_topk(s: SparkSession, d: str) -> DataFrame:
    return _stages(s, d)["reranked"].where("rank <= 5").select("query_id", "chunk_id", "rerank_score", "fused_rank", "rank")


def threshold_select(s: SparkSession, d: str) -> DataFrame:
    return _stages(s, d, 0.5)["selected"].select("query_id", "chunk_id", "rerank_score", "rank")


def hybrid_retrieve(s: SparkSession, d: str) -> DataFrame:
    return _ranks(R.Retriever(corpus(s, d), top_k=7, threshold=0.1).retrieve(questions(s, d))).select("query_id", "chunk_id", "rrf_score", "dense_rank", "bm25_rank", "rerank_score", "rank")


def compare_methods(s: SparkSession, d: str) -> DataFrame:
    return R.Retriever(corpus(s, d)).trace(questions(s, d)).where("stage <> 'selected'")


def mmr_select(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d)
    top = R.dense_topk(questions(s, d), c).withColumnRenamed("score", "rerank_score").join(c.select("chunk_id", "embedding"), "chunk_id")
    return R.mmr_select(top, 0.6, 5)


def _gold(s: SparkSession, d: str) -> DataFrame:
    """A question's own page is its gold page."""
    c = corpus(s, d, asking=True).where("page is not null")
    return c.select(F.col("chunk_id").alias("query_id"), "document_id", "page")


def page_metrics(s: SparkSession, d: str) -> DataFrame:
    r = dense_topk(s, d).join(corpus(s, d).select("chunk_id", "document_id", "page"), "chunk_id")
    return M.page_metrics(r, _gold(s, d), case="query_id")


def recall_at_k(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d).select("chunk_id", "document_id", "page")
    relevant = _gold(s, d).join(c, ["document_id", "page"]).select("query_id", "chunk_id")
    return M.recall_at(dense_topk(s, d), relevant, [5, 10, 20])


def stage_diagnostics(s: SparkSession, d: str) -> DataFrame:
    t = R.Retriever(corpus(s, d)).trace(questions(s, d)).where("stage <> 'selected'")
    r = t.join(corpus(s, d).select("chunk_id", "document_id", "page"), "chunk_id").join(_gold(s, d).withColumn("gold", F.lit(1)), ["query_id", "document_id", "page"], "left")
    per = r.groupBy("stage", "query_id").agg(F.max(F.coalesce("gold", F.lit(0))).alias("hit"), F.min(F.when(F.col("gold") == 1, F.col("rank"))).alias("first"))
    return per.groupBy("stage").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def budget_prefix(s: SparkSession, d: str) -> DataFrame:
    r = dense_topk(s, d).join(corpus(s, d).select("chunk_id", "token_count"), "chunk_id")
    return M.budget_prefix(r, 2000).select("query_id", "chunk_id", "rank", F.col("used").cast("bigint").alias("used"))


def k_prefix_grid(s: SparkSession, d: str) -> DataFrame:
    r = dense_topk(s, d).join(corpus(s, d).select("chunk_id", "token_count", "document_id"), "chunk_id").withColumn("k", F.explode(F.array(F.lit(5), F.lit(7), F.lit(10)))).where("rank <= k")
    return r.groupBy("query_id", "k").agg(F.sum("token_count").alias("tokens"), F.count_distinct("document_id").alias("documents"))


def _rounds(s: SparkSession, d: str) -> DataFrame:
    """Two searches a session: dense, then BM25.  Each is written, k rows a session, so that its shuffles are gone before the next step's."""
    q, c = questions(s, d), corpus(s, d)
    cols = [F.col("query_id").alias("session"), "chunk_id", "rank"]
    dense = materialize(R.dense_topk(q, c, 5).select(*cols, F.lit(1).alias("round")), "rounds")
    return dense.unionByName(materialize(R.bm25_topk(q, c, 5).select(*cols, F.lit(2).alias("round")), "rounds"))


def evidence_registry(s: SparkSession, d: str) -> DataFrame:
    return E.register(_rounds(s, d))


def search_history(s: SparkSession, d: str) -> DataFrame:
    searches = questions(s, d).select(F.col("query_id").alias("session")).withColumn("round", F.explode(F.array(F.lit(1), F.lit(2))))
    h = E.search_history(searches, _rounds(s, d))
    return h.select("session", "round", F.array_join("retrieved", ",").alias("retrieved"), F.array_join("new_ids", ",").alias("new_ids"), "new_count")


def context_assembly(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d).select("chunk_id", F.col("document_id").alias("document"), F.coalesce(F.concat(F.lit("page "), F.col("page").cast("string")), F.lit("")).alias("location"), F.coalesce("text", F.lit("")).alias("text"))
    return E.context(evidence_registry(s, d).join(c, "chunk_id")).select("session", F.sha2("context", 256).alias("context"))


def _answers(s: SparkSession, d: str) -> DataFrame:
    """A synthetic answer per session, citing by the length of its question."""
    n = F.length("question") % 12
    return questions(s, d).select(F.col("query_id").alias("session"), F.concat(F.lit("As stated [E1] and [E"), n.cast("string"), F.lit("], again [E1].")).alias("answer"))


def citation_check(s: SparkSession, d: str) -> DataFrame:
    return E.check_citations(_answers(s, d), evidence_registry(s, d)).select("session", "label", "chunk_id", "known")


def citation_status(s: SparkSession, d: str) -> DataFrame:
    a = _answers(s, d)
    return E.citation_status(a, E.check_citations(a, evidence_registry(s, d)))


def citation_strip(s: SparkSession, d: str) -> DataFrame:
    return _answers(s, d).select("session", X.without_citations(F.col("answer")).alias("clean"))


def evidence_usage(s: SparkSession, d: str) -> DataFrame:
    rounds = _rounds(s, d)
    used = E.check_citations(_answers(s, d), E.register(rounds)).where("known").select("session", "chunk_id")
    return E.evidence_usage(rounds, used)


def mmr_sql(pool: str, weight: float, k: int) -> str:
    """(query_id, chunk_id, score, place): maximal marginal relevance in SQL over a pool (query_id, chunk_id, score, rank, v), a step per place over the candidates not taken yet."""
    steps = [f"""m0 as ({pool}), sim as (select a.query_id, a.chunk_id, b.chunk_id as other, list_cosine_similarity(a.v, b.v) as s from m0 a join m0 b using (query_id)),
t0 as (select query_id, chunk_id, cast(0 as integer) as place from m0 where false)"""]
    for n in range(1, k + 1):
        taken = " union all ".join(f"select * from t{i}" for i in range(n))
        steps.append(f"""t{n} as (with taken as ({taken}), left_ as (select query_id, chunk_id, score, rank from m0 anti join taken using (query_id, chunk_id)),
near as (select s.query_id, s.chunk_id, max(s) as s from sim s join taken t on t.query_id = s.query_id and t.chunk_id = s.other group by all),
gain as (select l.query_id, l.chunk_id, l.rank, round({weight} * score - {1 - weight} * greatest(0, coalesce(s, 0)), 12) as g from left_ l left join near using (query_id, chunk_id))
select query_id, chunk_id, cast({n} as integer) as place from gain qualify row_number() over (partition by query_id order by g desc, rank) = 1)""")
    all_ = " union all ".join(f"select * from t{i}" for i in range(1, k + 1))
    return "with " + ", ".join(steps) + f" select z.query_id, z.chunk_id, score, place from ({all_}) z join m0 using (query_id, chunk_id)"


_PAGE = ", g as (select chunk_id as query_id, document_id, page from c where position_no % 20 = 0 and page is not null)"
_ROUNDS = DENSE_SCORES + BM25_SCORES + r""",
rd as (select query_id as session, chunk_id, rank, 1 as round from d where rank <= 5 union all select query_id, chunk_id, rank, 2 from b where rank <= 5),
fs as (select session, chunk_id, min({'round': round, 'rank': rank}) as k from rd group by all),
ev as (select session, chunk_id, k.round as round, k.rank as rank, row_number() over (partition by session order by k.round, k.rank, chunk_id) as citation_no from fs),
an as (select query_id as session, 'As stated [E1] and [E' || (length(question) % 12) || '], again [E1].' as answer from q),
ci as (select distinct session, unnest(regexp_extract_all(answer, '\[(E\d+)\]', 1)) as label from an),
cc as (select session, label, chunk_id, chunk_id is not null as known from ci left join (select session, 'E' || citation_no as label, chunk_id from ev) using (session, label))"""

SQL = {
    "bm25_terms": f"with {CORPUS}{BM25_SCORES} select term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) as idf from te, st",
    "bm25_corpus_stats": f"with {CORPUS}{BM25_SCORES} select n, round(avgdl, 6) as avgdl from st",
    "bm25_postings": f"with {CORPUS}{BM25_SCORES} select term, chunk_id, tf, dl from p",
    "bm25_topk": f"with {CORPUS}{BM25_SCORES} select query_id, chunk_id, score, {_int('rank', 'rank')} from b",
    "dense_topk": f"with {DENSE_SCORES} select query_id, chunk_id, score, {_int('rank', 'rank')} from d",
    "dense_topk_excluding": f"with {DENSE_SCORES}, x as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as n from ds) where n between 6 and 10) select query_id, chunk_id, score, {_int('n - 5', 'rank')} from x",
    "vector_validity": f"with {CORPUS} select chunk_id, chunk_id in (select chunk_id from ok) as usable, coalesce(abs(sqrt(list_inner_product(list_transform(embedding, lambda x: cast(x as double)), list_transform(embedding, lambda x: cast(x as double)))) - 1) <= 1e-4, false) as unit from c",
    "label_knn_hit": r"""
with e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
s as (select a.vec_id as query_id, a.label as own, b.label, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.v, b.v), 6) desc, b.vec_id) as rank
      from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
select query_id, count(*) filter (label = own) as same, cast(coalesce(min(rank) filter (label = own), 0) as integer) as first_rank from s where rank <= 10 group by query_id""",
    "rrf_fusion": f"with {DENSE_SCORES}{BM25_SCORES}{RRF} select query_id, chunk_id, rrf_score, {_int('coalesce(dense_rank, 0)', 'dense_rank')}, {_int('coalesce(bm25_rank, 0)', 'bm25_rank')}, {_int('rank', 'rank')} from f",
    "candidate_union": f"with {DENSE_SCORES}{BM25_SCORES} select query_id, chunk_id, cast(min(ord) as integer) as ord from (select query_id, chunk_id, rank as ord from d union all select query_id, chunk_id, rank + 20 from b) group by all",
    "rerank_topk": f"with {_ALL} select query_id, chunk_id, rerank_score, {_int('fused_rank', 'fused_rank')}, {_int('rank', 'rank')} from r where rank <= 5",
    "threshold_select": f"with {_ALL} select query_id, chunk_id, rerank_score, {_int('rank', 'rank')} from r where rank <= 5 and rerank_score >= 0.5",
    "hybrid_retrieve": f"with {_ALL} select r.query_id, r.chunk_id, rrf_score, {_int('coalesce(dense_rank, 0)', 'dense_rank')}, {_int('coalesce(bm25_rank, 0)', 'bm25_rank')}, rerank_score, {_int('r.rank', 'rank')} from r join f on r.query_id = f.query_id and r.chunk_id = f.chunk_id where r.rank <= 7 and rerank_score >= 0.1",
    "compare_methods": f"""with {_ALL}
select query_id, 'dense' as stage, {_int("rank", "rank")}, chunk_id, score from d union all select query_id, 'bm25', cast(rank as integer), chunk_id, score from b
union all select query_id, 'fused', cast(rank as integer), chunk_id, rrf_score from f union all select query_id, 'reranked', cast(rank as integer), chunk_id, rerank_score from r""",
    "mmr_select": f"with {DENSE_SCORES} select query_id, chunk_id, score as rerank_score, place as rank from ({mmr_sql('select d.query_id, d.chunk_id, d.score, d.rank, v from d join ok using (chunk_id)', 0.6, 5)})",
    "page_metrics": f"""with {DENSE_SCORES}{_PAGE}, m as (select d.query_id, d.rank, c.document_id, c.page, g.query_id is not null as gold from d join c using (chunk_id) left join g on g.query_id = d.query_id and g.document_id = c.document_id and g.page = c.page),
x as (select query_id, count(distinct {{'d': document_id, 'p': page}}) filter (gold) as found, min(rank) filter (gold) as first, count(distinct {{'d': document_id, 'p': page}}) as u, count(*) as n from m group by query_id)
select query_id, cast(coalesce(found, 0) > 0 as integer) as hit, round(coalesce(found, 0) / 1.0, 6) as coverage, cast(coalesce(found, 0) = 1 as integer) as all_hit, coalesce(round(1.0 / first, 6), 0.0) as mrr,
       coalesce(u, 0) as unique_pages, case when n > 0 then round(1 - u / n, 6) else 0.0 end as repeat_fraction from g left join x using (query_id)""",
    "recall_at_k": f"""with {DENSE_SCORES}{_PAGE}, rel as (select g.query_id, c.chunk_id from g join c using (document_id, page)), w as (select query_id, count(*) as want from rel group by 1),
x as (select w.query_id, k, want, count(*) filter (rank <= k) as hits, min(rank) filter (rank <= k) as first from w cross join (select unnest([5, 10, 20]) as k) left join (select d.query_id, d.rank from d join rel using (query_id, chunk_id)) z on z.query_id = w.query_id group by all)
select query_id, k, hits, round(hits / want, 6) as recall, cast(hits > 0 as integer) as hit, coalesce(round(1.0 / first, 6), 0.0) as mrr from x""",
    "stage_diagnostics": f"""with {_ALL}{_PAGE}, t as (select query_id, 'dense' as stage, rank, chunk_id from d union all select query_id, 'bm25', rank, chunk_id from b union all select query_id, 'fused', rank, chunk_id from f union all select query_id, 'reranked', rank, chunk_id from r),
x as (select stage, t.query_id, max(cast(g.query_id is not null as integer)) as hit, min(rank) filter (g.query_id is not null) as first from t join c using (chunk_id) left join g on g.query_id = t.query_id and g.document_id = c.document_id and g.page = c.page group by all)
select stage, count(*) as n, cast(sum(hit) as bigint) as hits, round(avg(coalesce(1.0 / first, 0)), 6) as mrr from x group by stage""",
    "budget_prefix": f"with {DENSE_SCORES}, x as (select query_id, chunk_id, rank, cast(sum(coalesce(token_count, 0)) over (partition by query_id order by rank) as bigint) as used from d join c using (chunk_id)) select query_id, chunk_id, {_int('rank', 'rank')}, used from x where used <= 2000",
    "k_prefix_grid": f"with {DENSE_SCORES} select query_id, k, cast(sum(token_count) as bigint) as tokens, count(distinct document_id) as documents from d join c using (chunk_id) cross join (select unnest([5, 7, 10]) as k) where rank <= k group by all",
    "evidence_registry": f"with {_ROUNDS} select session, {_int('citation_no', 'citation_no')}, chunk_id, round, {_int('rank', 'rank')}, 'E' || citation_no as citation_id from ev",
    "search_history": f"""with {_ROUNDS}, x as (select session, chunk_id, round, rank, round = min(round) over (partition by session, chunk_id) as new from rd)
select s.session, s.round, coalesce(string_agg(chunk_id, ',' order by rank), '') as retrieved, coalesce(string_agg(chunk_id, ',' order by rank) filter (new), '') as new_ids, cast(count(*) filter (new) as integer) as new_count
from (select query_id as session, unnest([1, 2]) as round from q) s left join x using (session, round) group by all""",
    "context_assembly": f"""with {_ROUNDS}
select session, sha256(string_agg('[E' || citation_no || ']' || chr(10) || 'Document: ' || document_id || chr(10) || 'Location: ' || coalesce('page ' || page, '') || chr(10) || 'Text:' || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by citation_no)) as context
from ev join c using (chunk_id) group by session""",
    "citation_check": f"with {_ROUNDS} select * from cc",
    "citation_status": f"with {_ROUNDS} select session, case when count(*) filter (not known) > 0 then 'invalid' else 'valid' end as status from cc group by session",
    "citation_strip": rf"with {CORPUS}, an as (select query_id as session, 'As stated [E1] and [E' || (length(question) % 12) || '], again [E1].' as answer from q) select session, regexp_replace(answer, '\[E\d+\]', '', 'g') as clean from an",
    "evidence_usage": f"with {_ROUNDS} select session, round, {_int('rank', 'rank')}, chunk_id, (session, chunk_id) in (select (session, chunk_id) from cc where known) as used from rd",
}


def queries() -> dict:
    names = [
        bm25_terms, bm25_corpus_stats, bm25_postings, bm25_topk, dense_topk, dense_topk_excluding, vector_validity, label_knn_hit, rrf_fusion, candidate_union,
        rerank_topk, threshold_select, hybrid_retrieve, compare_methods, mmr_select, page_metrics, recall_at_k, stage_diagnostics, budget_prefix, k_prefix_grid,
        evidence_registry, search_history, context_assembly, citation_check, citation_status, citation_strip, evidence_usage,
    ]
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    return SQL
