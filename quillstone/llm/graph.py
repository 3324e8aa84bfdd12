"""Connected components over an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import checkpointed


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node of the node's component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014),
    which converge in O(log^2 n) rounds; each step is one pre-aggregated shuffle,
    and a node of any degree only meets a minimum, never a list.  Null ends and
    loops are dropped, repeated edges count once, the direction is ignored; no
    edges give no rows.  Every round ends in a reliable checkpoint.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def large_star(e: DataFrame) -> DataFrame:
        d = both(e)
        low = d.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return d.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        d = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = d.groupBy("u").agg(F.min("v").alias("m"))
        moved = d.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def mark(e: DataFrame) -> tuple[int, int]:
        r = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).collect()[0]
        return int(r["n"]), int(r["s"])

    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = checkpointed(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = mark(e)
    if before[0]:
        for _ in range(most_rounds):
            e = checkpointed(small_star(large_star(e)))
            now = mark(e)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
