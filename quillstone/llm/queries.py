"""The package's queries over the test tables, and SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm import boilerplate, encoding, mixing, neighbours, packing, split, visual


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs among each other's 10 most similar at a cosine of 0.90 or more."""
    near = neighbours.most_similar(_t(spark, sf_dir, "chunks"), k=10, min_cosine=0.9)
    return neighbours.mutual_pairs(near).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar chunks of every chunk whose position is divisible by 20, against all chunks."""
    near = neighbours.most_similar(_t(spark, sf_dir, "chunks"), k=10, query=F.col("position_no") % 20 == 0)
    return near.select(F.col("id").alias("chunk_id"), "neighbour", "rank", "cosine")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 2's texts: Element.text and the text in chunk_json."""
    e = _t(spark, sf_dir, "elements").select(F.lit("element").alias("item_kind"), F.col("element_id").alias("item_id"), "text")
    c = _t(spark, sf_dir, "chunks").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), split.json_text("chunk_json").alias("text"))
    return e.unionByName(c)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that had to be split."""
    cut = split.split_oversized(_items(spark, sf_dir), ["item_kind", "item_id"], dedupe=False)
    return cut.where("n_pieces > 1").select("item_kind", "item_id").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every item."""
    return split.split_oversized(_items(spark, sf_dir), ["item_kind", "item_id"])


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: its pieces together are the whole text, none is above 2,000 characters, and none shares more than 200 with the one before."""
    p = p2_pieces(spark, sf_dir)
    shared = F.coalesce(F.lag("end").over(Window.partitionBy("item_kind", "item_id").orderBy("piece_no")) - F.col("start"), F.lit(0))
    p = p.select("item_kind", "item_id", "start", "end", F.length("piece").alias("n"), shared.alias("shared"))
    fresh = F.sum(F.col("end") - F.col("start") - F.col("shared")).alias("n_chars")
    return p.groupBy("item_kind", "item_id").agg(fresh, (F.max("n") <= 2000).alias("within"), ((F.min("shared") >= 0) & (F.max("shared") <= 200)).alias("joined"))


P2_COVERAGE = """
with t as (select distinct 'element' as item_kind, element_id as item_id, text from elements
           union select 'chunk', chunk_id, json_extract_string(chunk_json, '$.text') from chunks where json_valid(chunk_json))
select item_kind, item_id, cast(length(text) as bigint) as n_chars, true as within, true as joined from t where text <> ''
"""

P2_FOUND = """
select 'element' as item_kind, element_id as item_id from elements where length(text) > 2000
union
select 'chunk', chunk_id from chunks where json_valid(chunk_json) and length(json_extract_string(chunk_json, '$.text')) > 2000
"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a line repeated on five pages or more of its document."""
    return boilerplate.repeated_lines(_t(spark, sf_dir, "elements"))[0].select("element_id", "line_no")


def p3_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All elements without the repeated lines."""
    e = _t(spark, sf_dir, "elements")
    found, _ = boilerplate.repeated_lines(e)
    return boilerplate.without_lines(e.dropDuplicates(["element_id"]).select("element_id", "document_id", "text"), found, ["element_id"])


def p3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages without the repeated lines."""
    pages = _t(spark, sf_dir, "parsed_pages").dropDuplicates(["document_id", "page"]).select("document_id", "page", "text")
    _, blocks = boilerplate.repeated_lines(_t(spark, sf_dir, "elements"))
    return boilerplate.without_lines(pages, boilerplate.page_lines(pages, blocks), ["document_id", "page"])


def p3_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boilerplate blocks: their repeated lines, the lines just under the support that belong to them, and their pages."""
    n = lambda c: F.count_if(c).alias
    return boilerplate.repeated_lines(_t(spark, sf_dir, "elements"))[1].groupBy("document_id", "block").agg(n(F.col("repeated"))("n_lines"), n(~F.col("repeated"))("n_near"), F.max("support").alias("most_pages"))


def p3_block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p3_blocks`` without their names."""
    return p3_blocks(spark, sf_dir).drop("block")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 5's texts: Element.text and Cell.text."""
    e = _t(spark, sf_dir, "elements").select(F.lit("element").alias("item_kind"), F.col("element_id").alias("item_id"), "text")
    c = _t(spark, sf_dir, "cells").select(F.lit("cell").alias("item_kind"), F.col("cell_id").alias("item_id"), "text")
    return e.unionByName(c)


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element and cell with its text in one consistent form."""
    return visual.one_form(_texts(spark, sf_dir), ["item_kind", "item_id"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements and cells whose text holds a variant."""
    return visual.one_form(_texts(spark, sf_dir), ["item_kind", "item_id"], dedupe=False).where("has_variant").select("item_kind", "item_id").distinct()


def p5_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose text holds a variant: their canonical form holds none, by a pattern of its own, and equal forms are one text."""
    f = p5_forms(spark, sf_dir).where("has_variant").select("item_kind", "item_id", "canonical")
    left = F.col("canonical").rlike(r"[！-～‑\p{Cf}]|[\p{Zs}&&[^ ]]|\p{IsLatin}[\p{L}\p{M}]*[\p{IsCyrillic}\p{IsGreek}]|[\p{IsCyrillic}\p{IsGreek}][\p{L}\p{M}]*\p{IsLatin}")
    return f.select("item_kind", "item_id", (~left).alias("clean"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in containers of 1,024 tokens."""
    return packing.fill_containers(_t(spark, sf_dir, "documents"))


def p6_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are all documents with text placed, is no container overfull, is only what exceeds one split, and are places and parts without gaps?"""
    c = p6_containers(spark, sf_dir)
    boxes = c.groupBy("container").agg(F.sum("tokens").alias("fill"), F.max("place").alias("last"), F.count("*").alias("n"))
    docs = c.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("parts"), F.max(F.col("start") + F.col("tokens")).alias("end"))
    all_boxes = boxes.agg((F.max("fill") <= 1024).alias("fits"), F.bool_and(F.col("last") == F.col("n")).alias("places"))
    all_docs = docs.agg(F.count("*").alias("n_docs"), F.bool_and((F.col("parts") == 1) | (F.col("tokens") > 1024)).alias("whole"), F.bool_and(F.col("end") == F.col("tokens")).alias("complete"))
    return all_docs.join(all_boxes)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with their repeat counts, each with its source's target and actual share."""
    chosen, shares = mixing.draw_mix(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_targets"))
    return chosen.join(F.broadcast(shares.select("source", "target_share", "actual_share")), "source")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's target and actual share."""
    return mixing.draw_mix(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_targets"))[1]


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text as originally written, as far as possible."""
    return encoding.restore(_t(spark, sf_dir, "documents")).select("doc_id", "restored", "garbled", "lost", "chains")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a wrongly decoded passage."""
    return encoding.restore(_t(spark, sf_dir, "documents")).where("garbled").select("doc_id").distinct()


P5_FOUND = r"""
with t as (select 'element' as item_kind, element_id as item_id, text from elements union select 'cell', cell_id, text from cells)
select item_kind, item_id from t
where regexp_matches(text, '[\x{FF01}-\x{FF5E}\x{2011}\x{132}\x{133}\x{1C4}-\x{1CC}\x{1F1}-\x{1F3}\x{FB00}-\x{FB06}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]|\p{Cf}')
   or regexp_matches(text, '\p{Latin}[\p{L}\p{M}]*[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}][\p{L}\p{M}]*\p{Latin}')
   or (regexp_matches(text, '\p{L}\p{M}') and length(nfc_normalize(text)) < length(text))
"""


_P3 = r"""
with e as (select distinct element_id, document_id, source.page as page, text from elements where source.page is not null and text is not null),
l as (select element_id, document_id, page, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from e),
k as (select element_id, document_id, page, line_no,
             trim(regexp_replace(regexp_replace(replace(lower(line), 'ς', 'σ'), '[\s\x{85}\p{Z}\v]+', ' ', 'g'), '\p{Nd}+', '0', 'g')) as k
      from l where length(regexp_replace(line, '\P{L}+', '', 'g')) >= 12),
n as (select document_id, k from k group by all having count(distinct page) >= 5)
"""

P3_FOUND = _P3 + "select distinct element_id, cast(line_no as integer) as line_no from k join n using (document_id, k)"
P3_ELEMENTS = _P3 + """, f as (select element_id, list(distinct line_no) as gone from k join n using (document_id, k) group by element_id),
a as (select distinct element_id, document_id, text from elements)
select a.element_id, document_id, case when gone is null then text else array_to_string(list_transform(list_filter(list_zip(string_split(text, chr(10)), range(1, len(string_split(text, chr(10))) + 1)), lambda x: not list_contains(gone, x[2])), lambda x: x[1]), chr(10)) end as text
from a left join f using (element_id)"""
P3_PAGES = _P3 + r""", pg as (select distinct document_id, page, text from parsed_pages),
pl as (select document_id, page, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from pg where text is not null),
pk as (select document_id, page, line_no, trim(regexp_replace(regexp_replace(replace(lower(line), 'ς', 'σ'), '[\s\x{85}\p{Z}\v]+', ' ', 'g'), '\p{Nd}+', '0', 'g')) as k from pl where length(regexp_replace(line, '\P{L}+', '', 'g')) >= 12),
f as (select document_id, page, list(distinct line_no) as gone from pk join n using (document_id, k) group by all)
select pg.document_id, pg.page, case when gone is null then text else array_to_string(list_transform(list_filter(list_zip(string_split(text, chr(10)), range(1, len(string_split(text, chr(10))) + 1)), lambda x: not list_contains(gone, x[2])), lambda x: x[1]), chr(10)) end as text
from pg left join f using (document_id, page)"""

P3_BLOCK_SIZES = _P3.replace("with e as", "with recursive e as", 1).replace("select distinct element_id, document_id, source.page as page, text from elements", "select distinct element_id, document_id, ordinal, source.page as page, text from elements", 1).replace("select element_id, document_id, page, unnest(", "select element_id, document_id, ordinal, page, unnest(", 1).replace("select element_id, document_id, page, line_no,", "select element_id, document_id, ordinal, page, line_no,", 1) + """,
sn as (select document_id, k, count(distinct page) as support from k group by all having count(distinct page) >= 3),
le as (select document_id, page, k as a, lead(k) over (partition by document_id, page order by ordinal, line_no) as b from k),
ed as (select document_id, a, b, count(distinct page) as support from le where b is not null and a <> b group by all having count(distinct page) >= 3),
ke as (select ed.document_id, a, b from ed join sn x on x.document_id = ed.document_id and x.k = a join sn y on y.document_id = ed.document_id and y.k = b where ed.support >= 5 or ed.support = least(x.support, y.support)),
un as (select document_id, a, b from ke union select document_id, b, a from ke),
rc(document_id, a, b) as (select document_id, k, k from sn union select rc.document_id, rc.a, un.b from rc join un on un.document_id = rc.document_id and un.a = rc.b),
cm as (select document_id, a as k, min(b) as block from rc group by all)
select document_id, count(*) filter (support >= 5) as n_lines, count(*) filter (support < 5) as n_near, max(support) as most_pages from cm join sn using (document_id, k) group by document_id, block having max(support) >= 5"""

P1_FOUND = """
with v as (select chunk_id, list_transform(embedding, lambda x: cast(x as double)) as v from (select distinct on (chunk_id) chunk_id, embedding from chunks) where embedding is not null and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select a.chunk_id as a, b.chunk_id as b, list_cosine_similarity(a.v, b.v) as c from v a join v b on a.chunk_id <> b.chunk_id),
t as (select a, b, c from s qualify row_number() over (partition by a order by round(c, 9) desc, b) <= 10)
select x.a as chunk_id_a, x.b as chunk_id_b from t x join t y on x.a = y.b and x.b = y.a where x.a < x.b and x.c >= 0.9
"""

P6_AUDIT = "select count(distinct doc_id) as n_docs, true as whole, true as complete, true as fits, true as places from documents where text <> ''"



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p1_neighbours": p1_neighbours,
        "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_coverage": p2_coverage,
        "p3_found": p3_found, "p3_elements": p3_elements, "p3_pages": p3_pages, "p3_blocks": p3_blocks, "p3_block_sizes": p3_block_sizes,
        "p5_found": p5_found, "p5_forms": p5_forms, "p5_audit": p5_audit,
        "p6_containers": p6_containers, "p6_audit": p6_audit,
        "p7_mix": p7_mix, "p7_shares": p7_shares,
        "p8_found": p8_found, "p8_restored": p8_restored,
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p2_coverage": P2_COVERAGE, "p3_found": P3_FOUND, "p3_elements": P3_ELEMENTS, "p3_pages": P3_PAGES, "p3_block_sizes": P3_BLOCK_SIZES, "p5_audit": "select *, true as clean from (" + P5_FOUND + ")", "p5_found": P5_FOUND, "p6_audit": P6_AUDIT}
