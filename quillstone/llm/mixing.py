"""Mixing sources to target weights.

Method: every document has a hash, uniform over 60 bits.  Tokens are summed by
source and hash bucket; a source's budget gives the bucket its threshold falls
into, and only that bucket is summed again by the next bits, until it holds one
document.  Choosing is then a filter ``hash < threshold``: nothing is sorted and a
larger budget chooses a superset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.tokens import TOKENIZER, with_tokens
from quillstone.session import materialize

STEP = 12  #: bits a refinement looks at
BITS = 60  #: bits of the hash
MOST_SOURCES = 10_000  #: the targets are a dimension, planned on the driver


def budgets(total: float, rows: list[tuple[str, float, float]]) -> dict[str, float]:
    """source -> tokens, from (source, share, most tokens it can give).

    What capped sources can't give goes to the others by their shares, until the
    total is reached or all are capped.
    """
    open_ = {s: w for s, w, _ in rows if w and w > 0}
    cap = {s: c for s, _, c in rows}
    got: dict[str, float] = {s: 0.0 for s, _, _ in rows}
    left = total
    while open_ and left > 1e-9:
        weight = sum(open_.values())
        full = [s for s, w in open_.items() if left * w / weight >= cap[s]]
        if not full:
            for s, w in open_.items():
                got[s] = left * w / weight
            break
        for s in full:
            got[s] = cap[s]
            left -= cap[s]
            del open_[s]
    return got


def draw_mix(
    docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER
) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares).

    chosen: (key, source, tokens, repeats), repeats >= 1 and at most the source's
    max_repeats; shares: (source, target_share, max_repeats, tokens_held,
    tokens_drawn, actual_share), one row per target.  The mix holds as many
    tokens as the documents, to within a document per source, unless every
    source is at its cap.  Documents of sources without a target (or a null one)
    aren't drawn; a key delivered again counts once; null and empty texts have
    no tokens and aren't drawn; a null share counts as 0, a null max_repeats as 1.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")).where(F.col("key").isNotNull())
    # sizes first: repeated keys are dropped among narrow rows, no text is shuffled
    sized = materialize(with_tokens(src, tokenizer=tokenizer).dropDuplicates(["key"]).where("tokens > 0").withColumn("h", F.shiftrightunsigned(F.xxhash64(F.col("key"), F.lit("mix")), 64 - BITS)), "mix")
    goal = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    wanted = goal.limit(MOST_SOURCES + 1).collect()
    if len(wanted) > MOST_SOURCES:
        raise ValueError("too many sources for a dimension")
    # one row per source, pre-aggregated
    held = sized.groupBy("source").agg(F.sum("tokens").alias("n"))
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]["n"]
    per = {r["source"]: r["n"] for r in held.join(F.broadcast(goal.select("source")), "source").collect()}
    budget = budgets(float(total), [(r["source"], float(r["target_share"] or 0), float(max(0, r["max_repeats"]) * per.get(r["source"], 0))) for r in wanted])
    plan = {}
    for r in wanted:
        s, n = r["source"], per.get(r["source"], 0)
        if n and budget[s] > 0:
            whole = min(int(budget[s] // n), int(r["max_repeats"]))
            plan[s] = (whole, budget[s] - whole * n if whole < r["max_repeats"] else 0.0)
    below = thresholds(sized, {s: rest for s, (_, rest) in plan.items() if rest > 0})
    steps = [(s, whole, below.get(s, 0)) for s, (whole, _) in sorted(plan.items())]
    table = spark.createDataFrame(steps, "source string, whole int, below bigint")
    times = F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    chosen = sized.join(F.broadcast(table), "source").withColumn("repeats", times.cast("int")).where("repeats > 0").select(F.col("key").alias(key), "source", "tokens", "repeats")
    drawn = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn"))
    shares = (
        goal.join(held, "source", "left")
        .join(drawn, "source", "left")
        .select("source", "target_share", "max_repeats", F.coalesce("n", F.lit(0)).alias("tokens_held"), F.coalesce("drawn", F.lit(0)).alias("tokens_drawn"))
    )
    whole = Window.partitionBy(F.lit(1))
    shares = shares.withColumn("actual_share", F.when(F.sum("tokens_drawn").over(whole) > 0, F.col("tokens_drawn") / F.sum("tokens_drawn").over(whole)).otherwise(0.0))
    return chosen, shares


def thresholds(sized: DataFrame, rest: dict[str, float]) -> dict[str, int]:
    """source -> hash below which its documents hold ``rest`` tokens, to the nearest document."""
    spark = sized.sparkSession
    done: dict[str, int] = {}
    # (prefix of the boundary bucket, tokens still wanted inside it)
    open_ = {s: (0, float(r)) for s, r in rest.items()}
    for bits in range(STEP, BITS + 1, STEP):
        if not open_:
            break
        at = spark.createDataFrame([(s, p, r) for s, (p, r) in open_.items()], "source string, prefix bigint, want double")
        inside = sized.join(F.broadcast(at), "source").where(F.shiftright("h", BITS - bits + STEP) == F.col("prefix")) if bits > STEP else sized.join(F.broadcast(at), "source")
        bucket = F.shiftright("h", BITS - bits)
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("tokens").alias("n"), F.count("*").alias("docs"), F.max("want").alias("want"))
        run = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        # the first bucket whose running sum reaches what is wanted
        edge = sums.withColumn("run", run).where("run >= want").groupBy("source").agg(F.min_by(F.struct("bucket", "n", "docs", "run", "want"), "bucket").alias("e")).select("source", "e.*").collect()
        found = {r["source"]: r for r in edge}
        for s in list(open_):
            r = found.get(s)
            if r is None:  # all of them
                done[s] = 1 << BITS
                del open_[s]
                continue
            want = r["want"] - (r["run"] - r["n"])
            lo, hi = r["bucket"] << (BITS - bits), (r["bucket"] + 1) << (BITS - bits)
            if r["docs"] == 1 or bits == BITS:
                done[s] = hi if want >= r["n"] / 2 else lo
                del open_[s]
            else:
                open_[s] = (r["bucket"], want)
    return done
