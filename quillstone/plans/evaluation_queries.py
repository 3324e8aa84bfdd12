"""Catalogue: evaluation roll-ups, sampling, conversations, event streams in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import evidence as E
from quillstone.operators import metrics as M
from quillstone.plans.common import once, table
from quillstone.sources import uploads as U
from quillstone.streaming import events as S


def metric_aggregate(s: SparkSession, d: str) -> DataFrame:
    """Conditional counts and means of line items by return flag."""
    l = table(s, d, "lineitem")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))


def cohort_rollup(s: SparkSession, d: str) -> DataFrame:
    """All orders, each priority, and each priority and status, in one aggregation."""
    o = table(s, d, "orders")
    g = o.groupingSets([["o_orderpriority", "o_orderstatus"], ["o_orderpriority"], []], "o_orderpriority", "o_orderstatus").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return g.na.fill("*", ["o_orderpriority", "o_orderstatus"])


def latency_percentiles(s: SparkSession, d: str) -> DataFrame:
    return M.mean_percentiles(table(s, d, "events"), ["event_type"], "value")


def distribution_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def _per_user(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("score"))


def paired_delta(s: SparkSession, d: str) -> DataFrame:
    p = M.paired(_per_user(s, d), "user_id", "event_type", "score", "view", "click")
    return p.select("user_id", F.round("delta", 6).alias("delta"), "change")


def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    p = [M.paired(_per_user(s, d), "user_id", "event_type", "score", "view", o).select(F.lit(o).alias("config"), "delta") for o in ("click", "purchase", "signup")]
    return M.bootstrap(p[0].unionByName(p[1]).unionByName(p[2]), "config")


def config_promotion(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    return M.promote(j, ["o_orderpriority"], [F.desc("mean"), F.asc("o_orderstatus")])


def revenue_by_nation(s: SparkSession, d: str) -> DataFrame:
    """Equi-joins of five tables; small sides are broadcast by their size."""
    l, o, c, n, r = (table(s, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


def stratified_screen(s: SparkSession, d: str) -> DataFrame:
    return M.quota_sample(table(s, d, "documents"), "doc_kind", "doc_id", 4).select("doc_kind", "doc_id", "pick")


def quota_sample(s: SparkSession, d: str) -> DataFrame:
    return M.quota_sample(table(s, d, "documents"), "source", "doc_id", 17, seed="s").select("source", "doc_id", "pick")


def _turns(s: SparkSession, d: str) -> DataFrame:
    """Events as conversation turns: a user's events in order, their text with a citation."""
    return table(s, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.concat("event_type", F.lit(" "), "props", F.lit(" [E1]")).alias("text"))


def conversation_window(s: SparkSession, d: str) -> DataFrame:
    return E.last_turns(_turns(s, d), 5, budget=80).select("conv_id", "turn", "text")


def conversation_budget(s: SparkSession, d: str) -> DataFrame:
    return E.context_suffix(_turns(s, d), 200).select("conv_id", "turn", "clean", F.col("size").cast("bigint").alias("size"))


def query_plan_dedup(s: SparkSession, d: str) -> DataFrame:
    """Section titles of a document as a query plan."""
    p = once(table(s, d, "parsed_pages"), "document_id", "page").where("section is not null").select(F.col("document_id").alias("session"), F.col("page").alias("pos"), F.concat(F.lit(" "), F.upper("section")).alias("query"))
    return E.distinct_queries(p).select("session", "pos", "query")


def query_plan_fallback(s: SparkSession, d: str) -> DataFrame:
    """A document's section titles as a model's reply: more than four fall back on the question."""
    p = once(table(s, d, "parsed_pages"), "document_id", "page").where("section is not null").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page", "section"))).alias("g"))
    reply = F.to_json(F.struct(F.transform("g", lambda x: x["section"]).alias("queries")))
    plans = p.select(F.col("document_id").alias("session"), F.substring("document_id", 1, 12).alias("question"), reply.alias("reply"))
    return E.planned_queries(plans, 12).select("session", F.array_join("queries", "|").alias("queries"), "fell_back")


def event_heartbeats(s: SparkSession, d: str) -> DataFrame:
    """A heartbeat for every whole day a user is silent between two events."""
    return S.idle_gaps(table(s, d, "events"), "1 day", "user_id").groupBy("user_id").agg(F.count("*").alias("gaps"), F.sum("heartbeats").alias("heartbeats"))


def upload_rules(s: SparkSession, d: str) -> DataFrame:
    """Library documents as uploads: formats and sizes that may not come in."""
    u = table(s, d, "library_documents").select(F.col("file_name").alias("name"), F.col("doc_format").alias("fmt"), F.col("size_bytes").alias("size"), "document_id")
    return U.violations(u, u.limit(0)).select(F.coalesce("name", F.lit("upload")).alias("name"), "rule").groupBy("rule").agg(F.count("*").alias("n"))


def quota_split(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "library_documents").select("document_id", "n_tables").where("n_tables > 0")
    q = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_tables") - 1)))
    return q.select("document_id", "i", E.quota(F.lit(20), F.col("n_tables"), F.col("i")).alias("places"))


def run_snapshot_lru(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("session"), F.col("event_id").alias("run_id"), "ts")
    return E.lru(e).select("session", "run_id")


def _stream(s: SparkSession, d: str) -> DataFrame:
    """Events as answer events: errors reset, purchases finish, the rest are deltas."""
    kind = F.when(F.col("event_type") == "error", "answer_reset").when(F.col("event_type") == "purchase", "done").otherwise("answer_delta")
    return table(s, d, "events").select(F.col("user_id").cast("string").alias("request_id"), F.col("event_id").alias("seq"), "ts", kind.alias("type"), F.substring("event_type", 1, 1).alias("text"))


def event_stream_fold(s: SparkSession, d: str) -> DataFrame:
    return S.fold_answers(_stream(s, d))


def tool_argument_assembly(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "events").select(F.col("user_id").alias("request_id"), (F.col("event_id") % 3).alias("call_index"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "purchase", F.substring("event_type", 1, 1)).alias("part"), (F.col("event_type") == "purchase").alias("finished"))
    return S.tool_arguments(p)


def event_tumbling(s: SparkSession, d: str) -> DataFrame:
    return S.tumbling(table(s, d, "events"))


def event_sessions(s: SparkSession, d: str) -> DataFrame:
    return S.sessions(table(s, d, "events"), "6 hours")


def event_dedup(s: SparkSession, d: str) -> DataFrame:
    e = _stream(s, d)
    return e.unionByName(e).dropDuplicates(["request_id", "seq"]).groupBy("type").agg(F.count("*").alias("n"))


def json_fields(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def vector_audit(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.min(X.norm(F.col("embedding"))), 5).alias("shortest"), F.round(F.avg(X.dot(F.col("embedding"), F.col("embedding"))), 5).alias("mean_square"))


_T = "t as (select user_id as conv_id, event_id as turn, event_type || ' ' || props || ' [E1]' as text from events)"
_S = "s as (select cast(user_id as varchar) as request_id, event_id as seq, case event_type when 'error' then 'answer_reset' when 'purchase' then 'done' else 'answer_delta' end as type, event_type[1:1] as text from events)"

SQL = {
    "metric_aggregate": "select l_returnflag, l_linestatus, count(*) as n, count(*) filter (l_discount > 0.05) as discounted, round(sum(l_quantity), 2) as quantity, round(avg(l_extendedprice), 4) as mean_price from lineitem group by all",
    "cohort_rollup": "select coalesce(o_orderpriority, '*') as o_orderpriority, coalesce(o_orderstatus, '*') as o_orderstatus, cast(grouping(o_orderpriority, o_orderstatus) as integer) as level, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by grouping sets ((o_orderpriority, o_orderstatus), (o_orderpriority), ())",
    "latency_percentiles": "select event_type, count(value) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.95), 6) as p95 from events group by event_type",
    "distribution_counts": "select event_type, cast(hour(ts) as integer) as hour, count(*) as n, count(distinct user_id) as users from events group by all",
    "paired_delta": "with u as (select user_id, event_type, round(avg(value), 6) as score from events group by all), p as (select a.user_id, b.score - a.score as d from u a join u b using (user_id) where a.event_type = 'view' and b.event_type = 'click') select user_id, round(d, 6) as delta, case when d > 1e-12 then 'improved' when d < -1e-12 then 'worse' else 'unchanged' end as change from p",
    "config_promotion": "with x as (select o_orderpriority, o_orderstatus, count(*) as n, round(avg(o_totalprice), 4) as mean from orders group by all) select * from x qualify row_number() over (partition by o_orderpriority order by mean desc, o_orderstatus) = 1",
    "revenue_by_nation": "select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all",
    "stratified_screen": "select doc_kind, doc_id, cast(row_number() over (partition by doc_kind order by sha256(cast(doc_id as varchar)), doc_id) as integer) as pick from documents qualify pick <= 4",
    "quota_sample": "select source, doc_id, cast(row_number() over (partition by source order by sha256('s' || doc_id), doc_id) as integer) as pick from documents qualify pick <= 17",
    "conversation_window": f"with {_T}, x as (select *, row_number() over (partition by conv_id order by turn desc) as b from t), y as (select *, sum(length(text)) over (partition by conv_id order by turn desc) as r from x where b <= 5) select conv_id, turn, text from y where r <= 80",
    "conversation_budget": rf"with {_T}, x as (select conv_id, turn, regexp_replace(text, '\[E\d+\]', '', 'g') as clean from t), y as (select *, cast(sum(length(clean)) over w + 2 * (count(*) over w - 1) + 2 as bigint) as size from x window w as (partition by conv_id order by turn desc)) select * from y where size <= 200",
    "query_plan_dedup": "select document_id as session, page as pos, ' ' || upper(section) as query from (select distinct document_id, page, section from parsed_pages where section is not null) qualify row_number() over (partition by document_id, lower(regexp_replace(trim(upper(section)), '\\s+', ' ', 'g')) order by page) = 1".replace("\\\\", "\\"),
    "query_plan_fallback": r"with p as (select document_id, page, section from (select distinct on (document_id, page) * from parsed_pages) where section is not null), n as (select *, count(*) over (partition by document_id) as n, row_number() over (partition by document_id, lower(regexp_replace(trim(section), '\s+', ' ', 'g')) order by page) as first from p) select document_id as session, case when max(n) > 12 then document_id[1:12] else string_agg(trim(section), '|' order by page) filter (first = 1) end as queries, max(n) > 12 as fell_back from n group by document_id",
    "event_heartbeats": "with g as (select user_id, epoch_us(lead(ts) over (partition by user_id order by ts)) - epoch_us(ts) as gap from events), h as (select user_id, (gap - 1) // 86400000000 as n from g where gap > 86400000000) select user_id, count(*) as gaps, cast(sum(n) as bigint) as heartbeats from h group by user_id",
    "upload_rules": "with r as (select case when doc_format not in ('pdf', 'docx', 'xlsx') then 'unknown format' when size_bytes < 1 then 'empty' when size_bytes > 20971520 then 'too large' end as rule from library_documents union all select case when count(*) > 10 then 'too many files' end from library_documents union all select case when sum(size_bytes) > 104857600 then 'too much in total' end from library_documents union all select case when count(distinct document_id) > 10 then 'library too large' end from library_documents) select rule, count(*) as n from r where rule is not null group by rule",
    "quota_split": "select document_id, i, cast(20 // n_tables + cast(i < 20 % n_tables as integer) as integer) as places from (select document_id, n_tables, cast(unnest(range(0, n_tables)) as integer) as i from library_documents where n_tables > 0)",
    "run_snapshot_lru": "select user_id as session, event_id as run_id from events where event_type = 'purchase' qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 5",
    "event_stream_fold": f"with {_S}, r as (select *, coalesce(max(seq) filter (type = 'answer_reset') over (partition by request_id), -1) as reset from s) select request_id, coalesce(string_agg(text, '' order by seq) filter (type = 'answer_delta' and seq > reset), '') as answer, max(cast(type = 'done' as integer)) as done, count(*) as n_events from r group by request_id",
    "tool_argument_assembly": "select user_id as request_id, event_id % 3 as call_index, coalesce(string_agg(event_type[1:1], '' order by event_id) filter (event_type <> 'purchase'), '') as arguments, bool_or(event_type = 'purchase') as complete from events group by all",
    "event_tumbling": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "event_sessions": "with x as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hours then 0 else 1 end as f from events window w as (partition by user_id order by ts)), y as (select *, sum(f) over (partition by user_id order by ts) as g from x) select user_id, min(ts) as start, max(ts) + interval 6 hours as end, count(*) as n from y group by user_id, g",
    "event_dedup": f"with {_S} select type, count(*) as n from s group by type",
    "json_fields": "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "vector_audit": "with e as (select label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings) select label, count(*) as n, round(min(sqrt(list_inner_product(v, v))), 5) as shortest, round(avg(list_inner_product(v, v)), 5) as mean_square from e group by label",
}


def queries() -> dict:
    names = [
        metric_aggregate, cohort_rollup, latency_percentiles, distribution_counts, paired_delta, bootstrap_ci, config_promotion, revenue_by_nation, stratified_screen, quota_sample,
        conversation_window, conversation_budget, query_plan_dedup, query_plan_fallback, event_heartbeats, upload_rules, quota_split, run_snapshot_lru, event_stream_fold, tool_argument_assembly, event_tumbling, event_sessions, event_dedup,
        json_fields, vector_audit,
    ]
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    return SQL
