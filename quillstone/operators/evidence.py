"""Evidence registry, citations, search history, conversations: order-dependent logic as windows over explicit order columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as X


def register(results: DataFrame, key: str = "session") -> DataFrame:
    """(session, citation_no, citation_id, chunk_id, round, rank): chunks numbered E1, E2 … in order of first sight by (round, rank).

    A batch that names a chunk twice registers it once; numbers are never reused.
    """
    first = results.groupBy(key, "chunk_id").agg(F.min(F.struct("round", "rank")).alias("f"))
    no = F.row_number().over(Window.partitionBy(key).orderBy("f.round", "f.rank", "chunk_id"))
    return first.select(key, no.alias("citation_no"), "chunk_id", "f.round", "f.rank").withColumn("citation_id", F.concat(F.lit("E"), F.col("citation_no").cast("string")))


def conflicts(results: DataFrame, chunks: DataFrame, key: str = "session") -> DataFrame:
    """Results that may not be registered: unknown chunks, and chunks whose text differs from the corpus.  A batch with any registers nothing."""
    c = chunks.select("chunk_id", F.col("text").alias("known"))
    j = results.join(c, "chunk_id", "left")
    return j.where(F.col("known").isNull() | (F.col("text") != F.col("known"))).select(key, "round", "chunk_id")


def search_history(searches: DataFrame, results: DataFrame, key: str = "session") -> DataFrame:
    """(session, round, retrieved, new_ids, new_count), searches without a result included.  A round's results are bounded by its top k."""
    r = results.groupBy(key, "round", "chunk_id").agg(F.min("rank").alias("rank"))
    seen = F.min("round").over(Window.partitionBy(key, "chunk_id"))
    r = r.withColumn("new", seen == F.col("round"))
    got = F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "new")))
    lists = r.groupBy(key, "round").agg(got.alias("got"))
    ids = lambda a: F.transform(a, lambda x: x["chunk_id"])
    none = F.expr("cast(array() as array<string>)")
    out = searches.join(lists, [key, "round"], "left").select(
        key, "round", F.coalesce(ids(F.col("got")), none).alias("retrieved"), F.coalesce(ids(F.filter("got", lambda x: x["new"])), none).alias("new_ids")
    )
    return out.withColumn("new_count", F.size("new_ids"))


def context(evidence: DataFrame, key: str = "session") -> DataFrame:
    """(session, context): the registered evidence as the text a model is given.  Needs citation_id, citation_no, document, location, text."""
    one = F.concat(F.lit("["), F.col("citation_id"), F.lit("]\nDocument: "), F.col("document"), F.lit("\nLocation: "), F.col("location"), F.lit("\nText:\n"), F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("citation_no", one.alias("t"))))
    return evidence.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("context"))


def check_citations(answers: DataFrame, evidence: DataFrame, key: str = "session") -> DataFrame:
    """(session, label, chunk_id, known) for every label an answer cites, in order of use."""
    cited = answers.select(key, F.posexplode(X.citations(F.col("answer"))).alias("use_no", "label"))
    j = cited.join(evidence.select(key, F.col("citation_id").alias("label"), "chunk_id"), [key, "label"], "left")
    return j.select(key, "use_no", "label", "chunk_id", F.col("chunk_id").isNotNull().alias("known"))


def citation_status(answers: DataFrame, checked: DataFrame, key: str = "session") -> DataFrame:
    """(session, status): uncited, invalid (an unknown label) or valid."""
    s = checked.groupBy(key).agg(F.count("*").alias("n"), F.sum((~F.col("known")).cast("int")).alias("bad"))
    return answers.select(key).join(s, key, "left").select(key, F.when(F.coalesce("n", F.lit(0)) == 0, "uncited").when(F.col("bad") > 0, "invalid").otherwise("valid").alias("status"))


def evidence_usage(results: DataFrame, used: DataFrame, key: str = "session") -> DataFrame:
    """Every round's results with their rank and whether the answer used them."""
    return results.join(used.select(key, "chunk_id").distinct().withColumn("used", F.lit(True)), [key, "chunk_id"], "left").select(key, "round", "rank", "chunk_id", F.coalesce("used", F.lit(False)).alias("used"))


def last_turns(turns: DataFrame, n: int = 5, budget: int | None = None, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The last ``n`` turns of a conversation, the oldest dropped until the kept ones' characters fit the budget."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    t = turns.withColumn("back__", F.row_number().over(w)).where(F.col("back__") <= n)
    if budget is None:
        return t.drop("back__")
    run = F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("run__", run).where(F.col("run__") <= budget).drop("back__", "run__")


def context_suffix(turns: DataFrame, limit: int, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The longest run of latest turns whose JSON list stays within ``limit`` characters; citations are stripped.

    A list of n texts of lengths l takes sum(l) + 2(n - 1) + 2 characters, as a
    JSON writer with ", " between elements makes it.
    """
    w = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    t = turns.withColumn("clean", X.without_citations(F.col(text)))
    size = F.sum(F.length("clean")).over(w) + 2 * (F.count("*").over(w) - 1) + 2
    return t.withColumn("size", size).where(F.col("size") <= limit)


def quota(k: Column, q: Column, i: Column) -> Column:
    """Share of the i-th (from 0) of q queries in k places."""
    return (F.floor(k / q) + (i < k % q).cast("int")).cast("int")


def distinct_queries(plans: DataFrame, key: str = "session", query: str = "query") -> DataFrame:
    """A plan's queries without repeats up to case and white space, in order of first appearance."""
    k = X.compact(F.col(query))
    w = Window.partitionBy(key, "k__").orderBy("pos")
    return plans.withColumn("k__", k).where("k__ <> ''").withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("k__", "n__")


def planned_queries(plans: DataFrame, most: int | None = None, key: str = "session") -> DataFrame:
    """(session, queries, fell_back): the queries a planning model's reply names, else the question itself.

    ``plans``: (session, question, reply).  A reply counts if it is a JSON object
    with nothing but a list ``queries`` of 1 to ``most`` texts, none of them blank
    or above 4,000 characters; repeats up to case and white space are dropped.
    """
    v = F.try_parse_json("reply")
    q = F.try_variant_get(v, "$.queries", "array<string>")
    fit = (F.schema_of_variant(v) == "OBJECT<queries: ARRAY<STRING>>") & (F.size(q) >= 1) & F.forall(q, lambda x: (X.strip(x) != "") & (F.length(x) <= 4_000))
    fit = F.coalesce(fit if most is None else fit & (F.size(q) <= most), F.lit(False))
    keys = F.transform("q__", X.compact)
    first = F.filter(F.transform("q__", X.strip), lambda x, i: F.array_position("k__", F.element_at("k__", i + 1)) == i + 1)
    p = plans.select(key, "question", fit.alias("fit__"), F.when(fit, q).alias("q__")).withColumn("k__", keys)
    return p.select(key, F.when(F.col("fit__"), first).otherwise(F.array("question")).alias("queries"), (~F.col("fit__")).alias("fell_back"))


def lru(runs: DataFrame, n: int = 5, key: str = "session", at: str = "ts", tie: str = "run_id") -> DataFrame:
    """The ``n`` latest runs of a session."""
    return runs.withColumn("n__", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie)))).where(F.col("n__") <= n).drop("n__")
