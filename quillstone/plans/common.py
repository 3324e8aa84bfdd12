"""Tables the catalogue's queries share, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Every key once; re-delivered rows repeat the content."""
    return df.dropDuplicates(list(keys))


def corpus(spark: SparkSession, sf_dir: str, asking: bool = False) -> DataFrame:
    """(chunk_id, position_no, document_id, page, token_count, title, text, embedding): all chunks, or those at a position divisible by 20; title and text where the JSON parses."""
    t = table(spark, sf_dir, "chunks")
    c = (t.where("position_no % 20 = 0") if asking else t).withColumn("v", F.try_parse_json("chunk_json"))
    get = lambda k: F.try_variant_get("v", f"$.{k}", "string").alias(k)
    # read from the JSON before the shuffle, as that is several times its title and text
    return once(c.select("chunk_id", "position_no", "document_id", "page", "token_count", get("title"), get("text"), "embedding"), "chunk_id")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, question, qvec): every chunk at a position divisible by 20 asks with its title and its vector."""
    c = corpus(spark, sf_dir, asking=True)
    return c.select(F.col("chunk_id").alias("query_id"), F.coalesce("title", F.lit("")).alias("question"), F.col("embedding").alias("qvec"))


CORPUS = r"""
c as (select chunk_id, position_no, document_id, page, token_count, embedding,
             case when json_valid(chunk_json) then json_extract_string(chunk_json, '$.title') end as title,
             case when json_valid(chunk_json) then json_extract_string(chunk_json, '$.text') end as text
      from (select distinct on (chunk_id) * from chunks)),
q as (select chunk_id as query_id, coalesce(title, '') as question, embedding as qvec from c where position_no % 20 = 0),
ok as (select *, list_transform(embedding, lambda x: cast(x as double)) as v from c where embedding is not null and len(list_filter(embedding, lambda x: x <> 0)) > 0),
qok as (select query_id, v as qv from q join ok on query_id = chunk_id)"""

DENSE_SCORES = CORPUS + r""",
ds as (select query_id, chunk_id, round(list_cosine_similarity(qv, v), 6) as score from qok, ok),
d as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from ds) where rank <= 20)"""

BM25_SCORES = r""",
tk as (select chunk_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as t from c),
st as (select count(*) as n, avg(len(t)) as avgdl from tk),
p as (select chunk_id, term, count(*) as tf, any_value(dl) as dl from (select chunk_id, len(t) as dl, unnest(t) as term from tk) group by all),
te as (select term, count(*) as df from p group by term),
qt as (select distinct query_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) as term from q),
bs as (select query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
       from qt join p using (term) join te using (term), st group by all),
b as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from bs) where rank <= 20)"""

RRF = r""",
f0 as (select query_id, chunk_id, max(dr) as dense_rank, max(br) as bm25_rank
       from (select query_id, chunk_id, rank as dr, null as br from d union all select query_id, chunk_id, null, rank from b) group by all),
f as (select * from (select *, row_number() over (partition by query_id order by rrf_score desc, dense_rank nulls last, bm25_rank nulls last) as rank
      from (select *, round(coalesce(1.0 / (60 + dense_rank), 0) + coalesce(1.0 / (60 + bm25_rank), 0), 9) as rrf_score from f0)) where rank <= 20)"""

RERANK = r""",
qd as (select query_id, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) as qs from q),
r0 as (select f.query_id, f.chunk_id, f.rank as fused_rank,
              case when len(qs) > 0 then round(len(list_intersect(qs, t)) / len(qs), 6) else 0.0 end as rerank_score
       from f join qd using (query_id) join tk using (chunk_id)),
r as (select *, row_number() over (partition by query_id order by rerank_score desc, fused_rank) as rank from r0)"""
