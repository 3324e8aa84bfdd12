"""Catalogue: evaluation grids and record checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import experiments as G
from quillstone.operators import metrics as M
from quillstone.operators import records as C
from quillstone.operators import retrieval as R
from quillstone.plans.common import BM25_SCORES, CORPUS, DENSE_SCORES, RERANK, RRF, corpus, once, questions, table
from quillstone.plans.retrieval_queries import _gold, _rounds, dense_topk, mmr_sql
from quillstone.session import materialize

_METRICS = ["hit", "coverage", "all_hit", "mrr", "unique_pages", "repeat_fraction"]


def _ranked(s: SparkSession, d: str) -> DataFrame:
    return dense_topk(s, d).join(corpus(s, d).select("chunk_id", "document_id", "page", "token_count"), "chunk_id")


def rank_questions(s: SparkSession, d: str) -> DataFrame:
    """Every question's page metrics in the top 5, 10 and 20 and within 2,000 tokens, from one ranking."""
    return G.score_modes(_ranked(s, d), _gold(s, d))


def mode_summary(s: SparkSession, d: str) -> DataFrame:
    return G.means(rank_questions(s, d), ["mode"], _METRICS)


def retrieval_k_grid(s: SparkSession, d: str) -> DataFrame:
    """Candidates 20 and 50 x the first 5, 7 and 10 after re-ranking: page hits and tokens."""
    pools = {n: r.select("query_id", "chunk_id", "rank") for n, r in R.Retriever(corpus(s, d), candidate_k=50).pools(questions(s, d), (20, 50)).items()}
    r = G.prefix_grid(pools, (5, 7, 10)).join(corpus(s, d).select("chunk_id", "document_id", "page", "token_count"), "chunk_id")
    g = _gold(s, d).withColumn("gold", F.lit(1))
    per = r.join(g, ["query_id", "document_id", "page"], "left").groupBy("candidates", "k", "query_id").agg(F.max(F.coalesce("gold", F.lit(0))).alias("hit"), F.sum("token_count").alias("tokens"))
    return per.groupBy("candidates", "k").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.round(F.avg("tokens"), 6).alias("tokens"))


def _reranked(s: SparkSession, d: str) -> DataFrame:
    return materialize(R.Retriever(corpus(s, d)).stages(questions(s, d))["reranked"], "reranked")


def selection_grid(s: SparkSession, d: str) -> DataFrame:
    """Top 7 and thresholds 0.1, 0.3 and 0.5: chunks returned, questions answered, chunks on the question's own page."""
    again = R.Retriever(corpus(s, d)).stages(questions(s, d))["reranked"]  # read once, so not written
    r = G.selection_grid(again, (0.1, 0.3, 0.5)).join(corpus(s, d).select("chunk_id", "document_id", "page"), "chunk_id")
    g = _gold(s, d).withColumn("gold", F.lit(1))
    return r.join(g, ["query_id", "document_id", "page"], "left").groupBy("config").agg(F.count("*").alias("chunks"), F.count_distinct("query_id").alias("questions"), F.count("gold").alias("direct"))


def selection_mmr_grid(s: SparkSession, d: str) -> DataFrame:
    """The same thresholds followed by MMR of weights 0.6 and 0.8."""
    r = _reranked(s, d).join(corpus(s, d).where(R.valid_vector(F.col("embedding"))).select("chunk_id", "embedding"), "chunk_id")
    return G.selection_grid(r, (0.1, 0.3, 0.5), (0.6, 0.8)).groupBy("config").agg(F.count("*").alias("chunks"), F.count_distinct("query_id").alias("questions"), F.round(F.avg("rerank_score"), 6).alias("score"))


def batch_query_grid(s: SparkSession, d: str) -> DataFrame:
    """One or two queries a batch x 5, 7 and 10 places: different chunks and how many the second query adds."""
    r = _rounds(s, d).select("session", F.col("round").alias("query_no"), "rank", "chunk_id")
    g = G.quota_grid(r, (1, 2), (5, 7, 10))
    return g.groupBy("session", "queries", "k").agg(F.count("*").alias("chunks"), F.count_if(F.col("query_no") == 2).alias("added"))


def evaluate_ids(s: SparkSession, d: str) -> DataFrame:
    return G.evaluate_ids(dense_topk(s, d).where("rank <= 7").select("query_id", "rank", "chunk_id"), corpus(s, d), _gold(s, d), case="query_id")


def two_denominators(s: SparkSession, d: str) -> DataFrame:
    """Questions by length: page hits over all, coverage over those whose chunk has a title."""
    q = questions(s, d).select("query_id", (F.length("question") % 3).alias("cohort"), F.col("question") == "")
    m = rank_questions(s, d).where("mode = 'top10'").join(q.toDF("query_id", "cohort", "manual"), "query_id")
    return G.two_denominators(m, ["cohort"], ["hit"], ["coverage", "mrr"], F.col("manual"))


def against_baseline(s: SparkSession, d: str) -> DataFrame:
    """Dense and fused rankings of the first 5 against BM25, over the questions all answer."""
    st = R.Retriever(corpus(s, d)).stages(questions(s, d))
    g = _gold(s, d).withColumn("gold", F.lit(1))
    c = corpus(s, d).select("chunk_id", "document_id", "page")
    out = None
    for name in ("bm25", "dense", "fused"):
        part = st[name].where("rank <= 5").select(F.lit(name).alias("config"), "query_id", "chunk_id", "rank")
        out = part if out is None else out.unionByName(part)
    hit = F.max(F.coalesce("gold", F.lit(0)))
    first = F.coalesce(1.0 / F.min(F.when(F.col("gold") == 1, F.col("rank"))), F.lit(0.0))
    per = out.join(c, "chunk_id").join(g, ["query_id", "document_id", "page"], "left").groupBy("config", "query_id").agg(hit.alias("hit"), first.alias("mrr"))
    return G.against_baseline(per, "query_id", "config", "bm25", ["hit", "mrr"])


def model_grid(s: SparkSession, d: str) -> DataFrame:
    """The vectors as they are against their first 32 components: mean page metrics by model and mode."""
    q, c = questions(s, d), corpus(s, d)
    half = lambda df, v: df.withColumn(v, F.slice(v, 1, 32))
    m = G.model_grid({"full": (q, c), "first32": (half(q, "qvec"), half(c, "embedding"))}, c, _gold(s, d))
    return G.means(m, ["model", "mode"], ["hit", "mrr"])


def chunk_grid(s: SparkSession, d: str) -> DataFrame:
    """Pages cut into 100, 200 and 300 words with and without overlap, searched by the questions' titles."""
    pages = once(table(s, d, "parsed_pages"), "document_id", "page").select("document_id", "page", "text")
    return G.score_chunkings(G.window_chunkings(pages, [(100, 0), (100, 20), (200, 30), (300, 45)]), questions(s, d), _gold(s, d))


def paragraph_grid(s: SparkSession, d: str) -> DataFrame:
    """Pages cut at paragraphs and sentences of at most 80 and 160 words, apart and packed."""
    pages = once(table(s, d, "parsed_pages"), "document_id", "page").select("document_id", "page", "text")
    return G.score_chunkings(G.paragraph_chunkings(pages, [80, 160]), questions(s, d), _gold(s, d))


def adaptive_query_grid(s: SparkSession, d: str) -> DataFrame:
    """One search, two, or a second only where the first one's best score is below 0.95: the question's own page found, chunks and searches."""
    q, c = questions(s, d), corpus(s, d)
    # the first search's scores and both lists are read: each search is made and written once
    parts = [materialize(x.select(F.col("query_id").alias("session"), F.lit(n).alias("query_no"), "rank", "chunk_id", "score"), "rounds") for n, x in ((1, R.dense_topk(q, c, 8)), (2, R.bm25_topk(q, c, 8)))]
    r = G.adaptive_rounds(parts[0].unionByName(parts[1]), F.max("score") >= 0.95, 8)
    g = _gold(s, d).select(F.col("query_id").alias("session"), "document_id", "page").withColumn("gold", F.lit(1))
    per = r.join(c.select("chunk_id", "document_id", "page"), "chunk_id").join(g, ["session", "document_id", "page"], "left").groupBy("config", "session").agg(F.max(F.coalesce("gold", F.lit(0))).alias("hit"), F.count("*").alias("chunks"), F.max("searches").alias("searches"))
    return G.means(per, ["config"], ["hit", "chunks", "searches"])


def rerank_truncation(s: SparkSession, d: str) -> DataFrame:
    """How many of a question's candidates a re-ranker of 64 and one of 128 tokens would cut."""
    r = dense_topk(s, d).join(questions(s, d).select("query_id", "question"), "query_id").join(corpus(s, d).select("chunk_id", "text"), "chunk_id")
    out = [R.truncated(r, n).groupBy("query_id").agg(F.lit(n).alias("most"), F.count("*").alias("pairs"), F.count_if("truncated").alias("cut"), F.max("tokens").alias("longest")) for n in (64, 128)]
    return out[0].unionByName(out[1])


def ocr_sample(s: SparkSession, d: str) -> DataFrame:
    """Pages for a comparison of OCR engines: five of each OCR status, no two of one document."""
    pages = once(table(s, d, "parsed_pages"), "document_id", "page").select("document_id", "page", F.concat_ws("-", "document_id", "page").alias("key"))
    j = pages.join(table(s, d, "library_documents").select("document_id", F.coalesce("ocr_status", F.lit("none")).alias("stratum")), "document_id")
    return M.grouped_sample(j, "stratum", "document_id", "key", 5, "ocr").select("stratum", "document_id", "page", "pick")


def _units(s: SparkSession, d: str) -> DataFrame:
    """Headings of pdf documents as evidence units: a phrase each."""
    e = once(table(s, d, "elements"), "element_id").where("kind = 'heading' and source.page is not null and text rlike '[A-Za-z]{3}'")
    unit = F.to_json(F.struct(F.array(F.struct(F.array("text").alias("phrases"))).alias("anchors")))
    return e.select("document_id", F.col("element_id").alias("unit_id"), unit.alias("unit"))


def unit_reachability(s: SparkSession, d: str) -> DataFrame:
    """Can a heading be found in its document's pages, and in a single chunk?"""
    pages = once(table(s, d, "parsed_pages"), "document_id", "page").select("document_id", "page", "text")
    return G.reachability(_units(s, d), pages, corpus(s, d).select("document_id", "page", "chunk_id", "text"))


def unit_rubric(s: SparkSession, d: str) -> DataFrame:
    """The pages of its document each heading is found on."""
    pages = once(table(s, d, "parsed_pages"), "document_id", "page").select("document_id", "page", "text")
    return G.rubric(_units(s, d), pages).select("unit_id", F.size("pages").alias("n_pages"), F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


def provenance_fields(s: SparkSession, d: str) -> DataFrame:
    e = once(table(s, d, "elements"), "element_id")
    p = C.provenance(F.col("source"))
    return e.select("element_id", F.array_join(F.map_keys(p), ",").alias("fields"), F.coalesce(F.element_at(p, "page"), F.lit("")).alias("page"))


def question_template(s: SparkSession, d: str) -> DataFrame:
    q = questions(s, d).select("query_id", "question")
    return q.select("query_id", C.target_question(F.col("question"), F.substring("query_id", 1, 12)).alias("question"))


def positional_join(s: SparkSession, d: str) -> DataFrame:
    """Chunks and vectors, two tables in one order, joined by position with equal ids."""
    c = once(table(s, d, "chunks"), "chunk_id")
    v = c.where(R.valid_vector(F.col("embedding"))).select("position_no", "chunk_id", F.round(X.norm(F.col("embedding")), 4).alias("length"))
    return C.zip_by_position(c.where(R.valid_vector(F.col("embedding"))).select("position_no", "chunk_id", "token_count"), v).select("position_no", "chunk_id", F.coalesce("token_count", F.lit(-1)).alias("token_count"), "length")


def round_trip(s: SparkSession, d: str) -> DataFrame:
    """What is written and read back holds the same rows, both ways."""
    c = once(table(s, d, "chunks"), "chunk_id").select("chunk_id", "position_no", "embedding")
    back = materialize(c, "round-trip")
    diff = C.symmetric_difference(c, back).agg(F.count_if(F.col("side") == "left").alias("missing"), F.count_if(F.col("side") == "right").alias("extra"))
    return diff.join(back.agg(F.count("*").alias("n")))


def index_symmetry(s: SparkSession, d: str) -> DataFrame:
    """Chunk ids of the table against those inside the JSON that parses."""
    c = once(table(s, d, "chunks"), "chunk_id")
    inside = c.select(F.try_variant_get(F.try_parse_json("chunk_json"), "$.chunk_id", "string").alias("chunk_id")).where("chunk_id is not null")
    return C.symmetric_difference(c.select("chunk_id"), inside)


def reading_order(s: SparkSession, d: str) -> DataFrame:
    e = once(table(s, d, "elements"), "element_id").where("source.page is not null").select("document_id", F.col("source.page").alias("page"), F.col("source.bbox").alias("bbox"), "ordinal", "element_id")
    return C.reading_order(e).select("element_id", "reading_no")


_G = ", g as (select chunk_id as query_id, document_id, page from c where position_no % 20 = 0 and page is not null)"
_POOL = lambda n: (DENSE_SCORES + BM25_SCORES + RRF + RERANK).replace("rank <= 20", f"rank <= {n}")
_MODES = DENSE_SCORES + _G + r""",
rk as (select query_id, rank, document_id, page, cast(sum(coalesce(token_count, 0)) over (partition by query_id order by rank) as bigint) as used from d join c using (chunk_id)),
md as (select unnest(['top5', 'top10', 'top20', 'budget2000']) as mode),
mr as (select mode, rk.* from rk, md where (mode = 'top5' and rank <= 5) or (mode = 'top10' and rank <= 10) or (mode = 'top20' and rank <= 20) or (mode = 'budget2000' and used <= 2000)),
mm as (select mode, mr.query_id, rank, mr.document_id, mr.page, g.query_id is not null as gold from mr left join g on g.query_id = mr.query_id and g.document_id = mr.document_id and g.page = mr.page),
mx as (select mode, query_id, count(distinct {'d': document_id, 'p': page}) filter (gold) as found, min(rank) filter (gold) as first, count(distinct {'d': document_id, 'p': page}) as u, count(*) as n from mm group by all),
rq as (select md.mode, g.query_id, cast(coalesce(found, 0) > 0 as integer) as hit, round(coalesce(found, 0) / 1.0, 6) as coverage, cast(coalesce(found, 0) = 1 as integer) as all_hit, coalesce(round(1.0 / first, 6), 0.0) as mrr,
       coalesce(u, 0) as unique_pages, case when n > 0 then round(1 - u / n, 6) else 0.0 end as repeat_fraction from g cross join md left join mx on mx.mode = md.mode and mx.query_id = g.query_id)"""
_GRID = lambda n: f"with {_POOL(n)}{_G}, x as (select {n} as candidates, k, r.query_id, max(cast(g.query_id is not null as integer)) as hit, sum(token_count) as tokens from r join c using (chunk_id) cross join (select unnest([5, 7, 10]) as k) left join g on g.query_id = r.query_id and g.document_id = c.document_id and g.page = c.page where r.rank <= k group by all) select candidates, k, count(*) as n, cast(sum(hit) as bigint) as hits, round(avg(tokens), 6) as tokens from x group by all"
_OK = "(select *, list_transform(embedding, lambda x: cast(x as double)) as v from (select distinct on (chunk_id) * from chunks) where embedding is not null and len(list_filter(embedding, lambda x: x <> 0)) > 0)"

_MODEL = lambda name, n: f"select '{name}' as model, * from (with {_MODES.replace('list_transform(embedding, lambda x: cast(x as double)) as v', f'list_transform(embedding[1:{n}], lambda x: cast(x as double)) as v')} select mode, count(*) as n, round(avg(hit), 6) as hit, round(avg(mrr), 6) as mrr from rq group by mode)"
_W = r"[\s\x{85}\p{Z}\v]+"


def _chunk_config(size: int, overlap: int) -> str:
    """BM25 over one way of cutting the pages, scored by the gold page in the first 5."""
    step = size - overlap
    bm25 = BM25_SCORES.replace("from c)", "from wc)", 1).replace("rank <= 20", "rank <= 5")
    return f"""select * from (with {CORPUS}{_G},
w0 as (select document_id, page, list_filter(string_split_regex(text, '{_W}'), lambda x: x <> '') as w from (select distinct on (document_id, page) * from parsed_pages)),
w1 as (select document_id, page, w, unnest(range(0, case when len(w) <= {size} then 1 else cast(ceil((len(w) - {size}) / {step}.0) as bigint) + 1 end)) as no from w0 where len(w) > 0),
wc as (select document_id || '|' || page || '|' || no as chunk_id, document_id, page, list_slice(w, no * {step} + 1, no * {step} + {size}) as p, array_to_string(list_slice(w, no * {step} + 1, no * {step} + {size}), ' ') as text from w1){bm25},
x as (select g.query_id, min(b.rank) as first from g left join (select b.query_id, b.rank, wc.document_id, wc.page from b join wc using (chunk_id)) b on b.query_id = g.query_id and b.document_id = g.document_id and b.page = g.page group by 1)
select '{size}/{overlap}' as config, (select count(*) from wc) as n_chunks, (select cast(sum(len(p)) as bigint) from wc) as n_words, count(*) as questions, count(first) as hits, round(avg(coalesce(round(1.0 / first, 6), 0)), 6) as mrr from x)"""


def _mmr_config(threshold: float, weight: float) -> str:
    pool = f"select query_id, chunk_id, score, rank, v from rv where score >= {threshold}"
    return f"select 't={threshold} mmr={weight}' as config, query_id, score from ({mmr_sql(pool, weight, 7)})"


SQL = {
    "selection_mmr_grid": f"""with {_POOL(20)}, rv as (select r.query_id, r.chunk_id, rerank_score as score, r.rank, v from r join ok using (chunk_id)), s as (select 'top7' as config, 0.0 as t union all select 't=' || t, t from (select unnest([0.1, 0.3, 0.5]) as t)),
x as (select config, query_id, score from rv join s on score >= t where rank <= 7 union all """ + " union all ".join(_mmr_config(t, w) for t in (0.1, 0.3, 0.5) for w in (0.6, 0.8)) + """)
select config, count(*) as chunks, count(distinct query_id) as questions, round(avg(score), 6) as score from x group by config""",
    "model_grid": _MODEL("full", 64) + " union all " + _MODEL("first32", 32),
    "chunk_grid": " union all ".join(_chunk_config(*c) for c in [(100, 0), (100, 20), (200, 30), (300, 45)]),
    "adaptive_query_grid": f"""with {DENSE_SCORES}{BM25_SCORES}{_G}, z as (select query_id as session, 1 as query_no, rank, chunk_id, score from d where rank <= 8 union all select query_id, 2, rank, chunk_id, score from b where rank <= 8),
fi as (select session, max(score) >= 0.95 as fine from z where query_no = 1 group by 1), y as (select z.*, coalesce(fine, false) as fine from z left join fi using (session)),
cf as (select 'one' as config, session, chunk_id, 1 as searches from y where query_no = 1 union select 'two', session, chunk_id, 2 from y where rank <= 4 union select 'adaptive', session, chunk_id, case when fine then 1 else 2 end from y where case when fine then query_no = 1 else rank <= 4 end),
x as (select config, session, max(cast(g.query_id is not null as integer)) as hit, count(*) as chunks, max(searches) as searches from cf join c using (chunk_id) left join g on g.query_id = session and g.document_id = c.document_id and g.page = c.page group by all)
select config, count(*) as n, round(avg(hit), 6) as hit, round(avg(chunks), 6) as chunks, round(avg(searches), 6) as searches from x group by config""",
    "rerank_truncation": f"with {DENSE_SCORES}, n as (select query_id, len(regexp_extract_all(lower(question), '[a-z0-9]+')) + len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) + 3 as t from d join q using (query_id) join c using (chunk_id)) select query_id, cast(m as integer) as most, count(*) as pairs, count(*) filter (t > m) as cut, cast(max(t) as integer) as longest from n cross join (select unnest([64, 128]) as m) group by query_id, m",
    "ocr_sample": """with p as (select document_id, page, document_id || '-' || page as key, coalesce(ocr_status, 'none') as stratum from (select distinct document_id, page from parsed_pages) join library_documents using (document_id)),
f as (select * from p qualify row_number() over (partition by document_id order by sha256('ocr' || key), key) = 1)
select stratum, document_id, page, cast(row_number() over (partition by stratum order by sha256('ocr' || key), key) as integer) as pick from f qualify pick <= 5""",
    "rank_questions": f"with {_MODES} select * from rq",
    "mode_summary": f"with {_MODES} select mode, count(*) as n, " + ", ".join(f"round(avg({m}), 6) as {m}" for m in _METRICS) + " from rq group by mode",
    "retrieval_k_grid": f"select * from ({_GRID(20)}) union all select * from ({_GRID(50)})",
    "selection_grid": f"""with {_POOL(20)}{_G}, s as (select 'top7' as config, 0.0 as t union all select 't=' || t, t from (select unnest([0.1, 0.3, 0.5]) as t))
select config, count(*) as chunks, count(distinct r.query_id) as questions, count(g.query_id) as direct from r join s on rerank_score >= t join c using (chunk_id) left join g on g.query_id = r.query_id and g.document_id = c.document_id and g.page = c.page where r.rank <= 7 group by config""",
    "batch_query_grid": f"""with {DENSE_SCORES}{BM25_SCORES}, z as (select query_id as session, 1 as query_no, rank, chunk_id from d where rank <= 5 union all select query_id, 2, rank, chunk_id from b where rank <= 5),
gr as (select unnest([1, 2]) as queries), kk as (select unnest([5, 7, 10]) as k),
y as (select session, queries, k, chunk_id, min(query_no) as query_no from z, gr, kk where query_no <= queries and rank <= k // queries + cast(query_no - 1 < k % queries as integer) group by all)
select session, queries, k, count(*) as chunks, count(*) filter (query_no = 2) as added from y group by all""",
    "evaluate_ids": f"""with {DENSE_SCORES}{_G}, m as (select d.query_id, d.rank, c.document_id, c.page, token_count, g.query_id is not null as gold from d join c using (chunk_id) left join g on g.query_id = d.query_id and g.document_id = c.document_id and g.page = c.page where rank <= 7),
x as (select query_id, count(distinct {{'d': document_id, 'p': page}}) filter (gold) as found, min(rank) filter (gold) as first, count(distinct {{'d': document_id, 'p': page}}) as u, count(*) as n, cast(sum(token_count) as bigint) as tokens, count(*) filter (gold) as direct from m group by query_id)
select query_id, cast(coalesce(found, 0) > 0 as integer) as hit, round(coalesce(found, 0) / 1.0, 6) as coverage, cast(coalesce(found, 0) = 1 as integer) as all_hit, coalesce(round(1.0 / first, 6), 0.0) as mrr, coalesce(u, 0) as unique_pages,
       case when n > 0 then round(1 - u / n, 6) else 0.0 end as repeat_fraction, coalesce(n, 0) as chunks, coalesce(tokens, 0) as tokens, coalesce(round(direct / n, 6), 0.0) as support_fraction from g left join x using (query_id)""",
    "two_denominators": f"with {_MODES} select cast(length(question) % 3 as integer) as cohort, count(*) as n, count(*) filter (question <> '') as n_scored, round(avg(hit), 6) as hit, round(avg(coverage) filter (question <> ''), 6) as coverage, round(avg(mrr) filter (question <> ''), 6) as mrr from rq join q using (query_id) where mode = 'top10' group by 1",
    "against_baseline": f"""with {_POOL(20)}{_G}, t as (select 'bm25' as config, query_id, chunk_id, rank from b where rank <= 5 union all select 'dense', query_id, chunk_id, rank from d where rank <= 5 union all select 'fused', query_id, chunk_id, rank from f where rank <= 5),
pm as (select config, t.query_id, cast(max(cast(g.query_id is not null as integer)) as double) as hit, coalesce(1.0 / min(rank) filter (g.query_id is not null), 0.0) as mrr from t join c using (chunk_id) left join g on g.query_id = t.query_id and g.document_id = c.document_id and g.page = c.page group by all),
ul as (unpivot pm on hit, mrr into name metric value value), j as (select a.config, a.metric, a.value, z.value as base, a.value - z.value as dl from ul a join ul z on a.query_id = z.query_id and a.metric = z.metric where a.config <> 'bm25' and z.config = 'bm25')
select config, metric, count(*) as n, round(avg(base), 6) as base_mean, round(avg(value), 6) as mean, round(avg(dl), 6) as delta, count(*) filter (dl > 1e-12) as improved, count(*) filter (dl < -1e-12) as worse, count(*) filter (abs(dl) <= 1e-12) as unchanged from j group by all""",
    "provenance_fields": """select element_id, concat_ws(',', case when source.fmt is not null then 'fmt' end, case when source.page is not null then 'page' end, case when source.bbox is not null then 'bbox' end, case when source.paragraph is not null then 'paragraph' end,
case when source.heading_path is not null then 'heading_path' end, case when source.table_no is not null then 'table_no' end, case when source.sheet is not null then 'sheet' end, case when source.cell_range is not null then 'cell_range' end) as fields, coalesce(cast(source.page as varchar), '') as page
from (select distinct on (element_id) * from elements)""",
    "question_template": f"with {CORPUS} select query_id, question || chr(10) || 'Target report: ' || query_id[1:12] || '.pdf' as question from q",
    "positional_join": f"select position_no, chunk_id, coalesce(token_count, -1) as token_count, round(sqrt(list_inner_product(v, v)), 4) as length from {_OK}",
    "round_trip": "select cast(0 as bigint) as missing, cast(0 as bigint) as extra, count(distinct chunk_id) as n from chunks",
    "index_symmetry": """with a as (select distinct chunk_id from chunks), b as (select case when json_valid(chunk_json) then json_extract_string(chunk_json, '$.chunk_id') end as chunk_id from (select distinct on (chunk_id) * from chunks)),
n as (select chunk_id, sum(n) as n from (select chunk_id, 1 as n from a union all select chunk_id, -1 from b where chunk_id is not null) group by 1)
select chunk_id, case when n > 0 then 'left' else 'right' end as side, cast(abs(n) as bigint) as times from n where n <> 0""",
    "reading_order": "select element_id, cast(row_number() over (partition by document_id, source.page order by source.bbox[2] nulls last, source.bbox[1] nulls last, ordinal) as integer) as reading_no from (select distinct on (element_id) * from elements) where source.page is not null",
}


def queries() -> dict:
    names = [
        rank_questions, mode_summary, retrieval_k_grid, selection_grid, selection_mmr_grid, batch_query_grid, evaluate_ids, two_denominators, against_baseline, model_grid, chunk_grid, paragraph_grid, adaptive_query_grid, rerank_truncation, ocr_sample,
        unit_reachability, unit_rubric, provenance_fields, question_template, positional_join, round_trip, index_symmetry, reading_order,
    ]
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    return SQL
