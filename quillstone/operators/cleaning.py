"""Cleaning parsed pages: symbol-only blocks, repeated footers, blank blocks, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as X

FOOTER_PAGES = 3  #: a footer repeats on at least so many pages
EDGE = 2.0  #: points a footer's lower edge may be above the page's lowest block


def drop_symbol_blocks(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Without blocks of trademark signs and white space only; null texts stay."""
    return blocks.where(~F.coalesce(X.only_symbols(F.col(text)), F.lit(False)))


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Without rows whose text is null or white space."""
    return df.where(F.length(X.strip(F.col(text))) > 0)


def drop_footers(blocks: DataFrame, group: str = "document_id", page: str = "page", text: str = "text", bbox: str = "bbox", key: Column | None = None, min_pages: int = FOOTER_PAGES) -> DataFrame:
    """Without repeated footers.

    A footer is a block with a box, at its page's lower edge, whose key
    (``footer_key`` unless given) is found so on at least ``min_pages`` pages of
    its group.  Blocks without a box, a key, a page or a group stay.
    """
    bottom = F.element_at(F.col(bbox), 4)
    lowest = F.max(bottom).over(Window.partitionBy(group, page))
    k = X.footer_key(F.col(text)) if key is None else key
    low = bottom >= lowest - EDGE
    b = blocks.withColumn("key__", F.when(F.coalesce(low, F.lit(False)), k))
    often = b.where(F.col("key__").isNotNull()).select(group, page, "key__").distinct().groupBy(group, "key__").agg(F.count("*").alias("n__")).where(F.col("n__") >= min_pages).select(group, "key__")
    return b.join(often.withColumn("gone__", F.lit(True)), [group, "key__"], "left").where("gone__ is null").drop("key__", "gone__").select(*blocks.columns)


def without_noise(elements: DataFrame) -> DataFrame:
    """Typed elements without pdf text blocks that are repeated footers, symbols only or blank.

    ``elements``: (document_id, kind, text, page, fmt) and, for footers, bbox.
    Tables and other formats stay, and every text stays as it is.
    """
    block = F.coalesce((F.col("fmt") == "pdf") & (F.col("kind") != "table"), F.lit(False))
    blocks = elements.where(block)
    # a symbol block may be its page's lowest, so footers are looked for among all blocks
    kept = drop_footers(blocks) if "bbox" in elements.columns else blocks
    return elements.where(~block).unionByName(drop_blank(drop_symbol_blocks(kept)))


def page_text(blocks: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """(keys, text): the blocks' texts in order, a blank line between."""
    got = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return blocks.where(F.col(text).isNotNull()).groupBy(*keys).agg(F.array_join(F.transform(got, lambda x: x["t"]), "\n\n").alias("text"))


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, block_no, text) from HTML: scripts, styles and tags removed, block-level tags end a block."""
    x = F.regexp_replace(F.col(html), r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article)[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    parts = F.filter(F.transform(F.split(x, "\n"), lambda s: X.strip(F.regexp_replace(s, r"(?U)\s+", " "))), lambda s: s != "")
    return pages.select(key, F.posexplode(parts).alias("block_no", "text"))
