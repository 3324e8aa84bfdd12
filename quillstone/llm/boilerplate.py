"""Lines repeated across the pages of one document (or the documents of one source).

Method: a line is a node weighted by the number of different pages it occurs
on, two consecutive lines of a page an edge weighted likewise.  Nodes and edges
of high support are kept, their connected components are the boilerplate
blocks, and every occurrence of a block's repeated line is deleted.  The graph
also tells of lines just under the support that belong to a block, since they
never stand without one of its lines; they are reported, not deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.graph import connected_components
from quillstone.session import materialize


def _folded(text: Column, sharp_s: bool) -> Column:
    """Letter case, white space but line breaks, and runs of digits each in one form."""
    x = F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))  # both are the lower case of one letter
    if sharp_s:
        x = F.replace(x, F.lit("ß"), F.lit("ss"))
    x = F.regexp_replace(x, r"(?U)[\s&&[^\n]]+", " ")
    return F.regexp_replace(x, r"\p{Nd}+", "0")


def line_key(line: Column, sharp_s: bool = True) -> Column:
    """Equal for lines that differ only in case, white space of any kind, or the digits of a run.

    With ``sharp_s`` a sharp s equals SS, as upper-cased German has it, although
    these are one letter and two.
    """
    return F.trim(_folded(line, sharp_s))


def has_letters(line: Column, n: int) -> Column:
    """At least ``n`` letters of any script; the search ends at the n-th, and nothing is tried twice."""
    return line.rlike(rf"^(?:\P{{L}}*+\p{{L}}){{{n}}}") if n > 0 else F.lit(True)


def _lines(df: DataFrame, group: str, page: Column, item: list[str], order: Column, text: str, min_letters: int) -> DataFrame:
    """One row per item with its eligible lines as array<struct<no, h1, h2>>; the hash pair is that of the group and the line's key."""
    # folded as a whole, which is cheaper than line by line and leaves lines and letters where they are
    numbered = F.transform(F.split(_folded(F.col(text), sharp_s=False), "\n", -1), lambda x, i: F.struct((i + 1).cast("int").alias("no"), F.trim(x).alias("k")))
    keyed = F.filter(numbered, lambda s: (F.length(s["k"]) >= min_letters) & has_letters(s["k"], min_letters))
    g = F.col(group)
    hashed = F.transform(keyed, lambda s: F.struct(s["no"].alias("no"), F.xxhash64(g, s["k"]).alias("h1"), F.xxhash64(F.lit("b"), g, s["k"]).alias("h2")))
    return df.where(g.isNotNull() & page.isNotNull() & F.col(text).isNotNull()).select(g.alias("g"), page.alias("page"), *(F.col(c).alias(f"item_{c}") for c in item), order.alias("ord"), hashed.alias("lines")).where(F.size("lines") > 0)


def _pack(h1: str, h2: str) -> Column:
    """A hash pair as one number, which the graph's aggregates can update in place."""
    return F.expr(f"cast({h1} as decimal(38,0)) * 1000000000000000000BD + pmod({h2}, 1000000000000000000)").cast("decimal(38,0)")


def _edges(items: DataFrame, least: int) -> DataFrame:
    """(a1, a2, b1, b2, support) of consecutive lines: inside an item, and from an item's last to the next item's first on the same page."""
    n = F.size("lines")
    pair = lambda a, b: F.struct(a["h1"].alias("a1"), a["h2"].alias("a2"), b["h1"].alias("b1"), b["h2"].alias("b2"))
    inside = F.transform(F.sequence(F.lit(2), n), lambda i: pair(F.element_at("lines", (i - 1).cast("int")), F.element_at("lines", i.cast("int"))))
    where = F.xxhash64("g", "page").alias("where")
    within = items.where(n > 1).select(where, F.explode(inside).alias("e")).select("where", "e.*")
    ends = items.select(where, "ord", F.element_at("lines", 1).alias("first"), F.element_at("lines", -1).alias("last")).dropDuplicates(["where", "ord"])
    across = ends.select("where", F.col("last").alias("a"), F.lead("first").over(Window.partitionBy("where").orderBy("ord")).alias("b")).where("b is not null").select("where", pair(F.col("a"), F.col("b")).alias("e")).select("where", "e.*")
    ab = ["a1", "a2", "b1", "b2"]
    return within.unionByName(across).where("a1 <> b1 or a2 <> b2").distinct().groupBy(*ab).agg(F.count("*").alias("support")).where(F.col("support") >= least)


def repeated_lines(
    df: DataFrame,
    group: str = "document_id",
    page: str | Column = "source.page",
    item: str = "element_id",
    order: str = "ordinal",
    text: str = "text",
    min_pages: int = 5,
    min_letters: int = 12,
    near_pages: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """(occurrences, blocks).

    occurrences: (group, item, line_no, block) for every occurrence of a line
    found on at least ``min_pages`` different pages of its group and having at
    least ``min_letters`` letters; blocks: (group, h1, h2, support, repeated,
    block), a row per line.  Not ``repeated`` are lines on ``near_pages`` to
    ``min_pages`` - 1 pages that belong to a block: an edge joins two lines if it
    has the support, or if one of them never stands without the other, and a
    component that holds a repeated line is a block; a repeated line without
    edges is one of its own.  Items whose text, page or group is null give
    nothing; a repeated delivery of an item changes nothing.  A group of any size
    is safe: counts are per (line, page), pre-aggregated before each shuffle.
    """
    page = F.col(page) if isinstance(page, str) else page
    near_pages = min(near_pages, min_pages)
    # the texts are read once; what follows works on hashes
    items = materialize(_lines(df, group, page, [item], F.col(order), text, min_letters), "lines")
    here = items.select("g", "page", F.col(f"item_{item}").alias("item"), F.explode("lines").alias("l")).select("g", "page", "item", F.col("l.no").alias("line_no"), "l.h1", "l.h2")
    nodes = here.select("h1", "h2", "page").distinct().groupBy("h1", "h2").agg(F.count("*").alias("support")).where(F.col("support") >= near_pages)
    nodes = materialize(nodes.withColumn("node", _pack("h1", "h2")), "line-nodes")
    end = lambda c: nodes.select(F.col("h1").alias(f"{c}1"), F.col("h2").alias(f"{c}2"), F.col("support").alias(f"{c}n"), F.col("node").alias(c))
    edges = _edges(items, near_pages).join(end("a"), ["a1", "a2"]).join(end("b"), ["b1", "b2"]).where((F.col("support") >= min_pages) | (F.col("support") == F.least("an", "bn")))
    comps = connected_components(edges)
    labelled = nodes.join(comps, "node", "left").select("h1", "h2", "support", (F.col("support") >= min_pages).alias("repeated"), F.coalesce("component", "node").alias("block"))
    kept = labelled.where("repeated").select("block").distinct()
    found = here.join(labelled.where("repeated"), ["h1", "h2"]).select(F.col("g").alias(group), F.col("item").alias(item), "line_no", F.col("block").cast("string").alias("block")).distinct()
    of_block = labelled.join(kept, "block", "left_semi")
    owner = here.join(of_block, ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("g").alias(group), *(F.first(c).alias(c) for c in ("support", "repeated", "block")))
    return found, owner.select(group, "h1", "h2", "support", "repeated", F.col("block").cast("string").alias("block"))


def without_lines(df: DataFrame, found: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``df`` with the found (keys, line_no) lines deleted from ``text``; rows without any keep theirs.  A line's own break goes with it."""
    gone = found.select(*keys, "line_no").distinct().groupBy(*keys).agg(F.collect_list("line_no").alias("gone__"))
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains("gone__", (i + 1).cast("int")))
    return df.join(gone, keys, "left").withColumn(text, F.when(F.col("gone__").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("gone__")


def page_lines(pages: DataFrame, blocks: DataFrame, group: str = "document_id", page: str = "page", text: str = "text", min_letters: int = 12) -> DataFrame:
    """Occurrences of the blocks' repeated lines in whole page texts: (group, page, line_no)."""
    items = _lines(pages, group, F.col(page), [], F.lit(0), text, min_letters)
    here = items.select("g", "page", F.explode("lines").alias("l")).select("g", "page", F.col("l.no").alias("line_no"), "l.h1", "l.h2")
    return here.join(blocks.where("repeated").select("h1", "h2"), ["h1", "h2"], "left_semi").select(F.col("g").alias(group), F.col("page").alias(page), "line_no").distinct()
