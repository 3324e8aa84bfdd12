"""Catalogue: text functions, cleaning, chunking, tables, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import chunking as K
from quillstone.operators import cleaning as C
from quillstone.operators import content as N
from quillstone.operators import tables as T
from quillstone.operators import validation as V
from quillstone.plans.common import corpus, once, table


def tokenize_docs(s: SparkSession, d: str) -> DataFrame:
    t = X.tokens(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), F.sha2(F.array_join(t, " "), 256).alias("h"))


def word_count(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).alias("n_words"))


def normalize_whitespace(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "parsed_pages").select("document_id", "page", F.sha2(X.normalize_space(F.col("text")), 256).alias("h")).distinct()


def merge_broken_lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "parsed_pages").select("document_id", "page", X.merge_lines(F.col("text")).alias("merged")).distinct()


def normalize_pages(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "parsed_pages"), "document_id", "page").select("document_id", "page", F.sha2(X.normalize_text(F.col("text")), 256).alias("h"))


def compact_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.sha2(X.compact(F.col("text")), 256).alias("h"))


def content_ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").groupBy(X.document_id(F.col("text")).alias("document_id")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


def symbol_block_filter(s: SparkSession, d: str) -> DataFrame:
    return C.drop_blank(C.drop_symbol_blocks(once(table(s, d, "elements"), "element_id"))).select("element_id")


def repeated_line_footer(s: SparkSession, d: str) -> DataFrame:
    e = once(table(s, d, "elements"), "element_id").select("document_id", F.col("source.page").alias("page"), "element_id", "text", F.col("source.bbox").alias("bbox")).where("page is not null")
    return C.drop_footers(e, key=F.regexp_replace(X.compact(F.col("text")), r"\d+", "0")).select("element_id")


def page_assembly(s: SparkSession, d: str) -> DataFrame:
    e = once(table(s, d, "elements"), "element_id").select("document_id", F.col("source.page").alias("page"), "ordinal", "text").where("page is not null")
    return C.page_text(e, ["document_id", "page"], "ordinal").select("document_id", "page", F.sha2("text", 256).alias("h"))


def fixed_window_chunks(s: SparkSession, d: str) -> DataFrame:
    return K.word_windows(table(s, d, "documents"), ["doc_id"], size=100, overlap=20).select("doc_id", "chunk_no", F.sha2("chunk", 256).alias("h"), "n_words")


def chunk_coverage_audit(s: SparkSession, d: str) -> DataFrame:
    return K.coverage_audit(K.word_windows(table(s, d, "documents"), ["doc_id"], size=100, overlap=20), ["doc_id"], 100, 20)


def chunk_token_stats(s: SparkSession, d: str) -> DataFrame:
    c = once(table(s, d, "chunks"), "chunk_id")
    p = F.percentile("token_count", F.array(F.lit(0.5), F.lit(0.95)))
    return c.groupBy("document_id").agg(F.count("*").alias("n"), F.max("token_count").alias("largest"), p.alias("p"), F.sum(F.greatest(F.lit(0), F.col("token_count") - 255)).alias("over")).select("document_id", "n", "largest", F.round(F.col("p")[0], 6).alias("median"), F.round(F.col("p")[1], 6).alias("p95"), "over")


def paragraph_pack_chunks(s: SparkSession, d: str) -> DataFrame:
    return K.packed_chunks(once(table(s, d, "parsed_pages"), "document_id", "page"), ["document_id", "page"], size=120, overlap=20)


def sentence_chunks(s: SparkSession, d: str) -> DataFrame:
    return K.chunk_rows(table(s, d, "documents"), ["doc_id"], "text", lambda t: K.sentence_chunks(t, 80, True, K.word_count))


def token_window_chunks(s: SparkSession, d: str) -> DataFrame:
    return K.chunk_rows(table(s, d, "documents"), ["doc_id"], "text", lambda t: K.token_windows(t, 120, 18, K.word_spans))


def sentence_span_audit(s: SparkSession, d: str) -> DataFrame:
    return K.span_audit(sentence_chunks(s, d), table(s, d, "documents"), ["doc_id"], 80)


def window_span_audit(s: SparkSession, d: str) -> DataFrame:
    return K.span_audit(token_window_chunks(s, d), table(s, d, "documents"), ["doc_id"], 120)


def paragraph_pack_words(s: SparkSession, d: str) -> DataFrame:
    """Packed without overlap, a page's chunks hold its words and none too many."""
    c = K.packed_chunks(once(table(s, d, "parsed_pages"), "document_id", "page"), ["document_id", "page"], size=120, overlap=0)
    return c.groupBy("document_id", "page").agg(F.sum("n_words").alias("n_words"), F.sha2(F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "chunk"))), lambda x: X.words(x["chunk"]))), " "), 256).alias("h"), (F.max("n_words") <= 120).alias("ok"))


def _structured(s: SparkSession, d: str) -> DataFrame:
    get = lambda *names: [F.col(f"source.{n}").alias(n) for n in names]
    e = once(table(s, d, "elements"), "element_id").select("document_id", "ordinal", "element_id", "kind", "text", "table_id", *get("page", "fmt", "bbox", "paragraph", "table_no", "sheet", "cell_range"))
    cells, tables = once(table(s, d, "cells"), "cell_id"), table(s, d, "doc_tables")
    heads = T.column_headers(cells, tables).groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("col_no", "header"))).alias("h"))
    header = F.array_join(F.transform("h", lambda x: F.concat(F.lit("C"), x["col_no"].cast("string"), F.lit(": "), x["header"])), " | ")
    places = T.header_cells(cells, tables).groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("row_no", "col_no"))).alias("header_cell_refs"))
    about = tables.select("table_id", F.col("header_origin").alias("origin")).join(heads.select("table_id", header.alias("header")), "table_id", "left").join(places, "table_id", "left")
    return K.structured_chunks(e, T.render_rows(cells, tables).join(about, "table_id", "left"), 120)


def structured_chunks(s: SparkSession, d: str) -> DataFrame:
    return _structured(s, d)


def structured_text_audit(s: SparkSession, d: str) -> DataFrame:
    """Per document: the text of all text chunks in order without white space, as a hash, and their number of spans' elements."""
    c = _structured(s, d).where("kind = 'text'")
    got = F.sort_array(F.collect_list(F.struct("chunk_no", "text", "element_ids")))
    t = c.groupBy("document_id", "page").agg(got.alias("g"))
    joined = F.regexp_replace(F.array_join(F.transform("g", lambda x: x["text"]), ""), r"(?U)\s+", "")
    return t.select("document_id", F.coalesce("page", F.lit(0)).alias("page"), F.sha2(joined, 256).alias("h"), F.size(F.array_distinct(F.flatten(F.transform("g", lambda x: x["element_ids"])))).alias("n_elements"))


def structured_row_audit(s: SparkSession, d: str) -> DataFrame:
    """Per table row: how many of its text's characters the chunks' spans cover, and how many cells they name."""
    c = _structured(s, d).where("kind = 'table'").select("table_id", F.col("source.row_start").alias("row_no"), F.col("text_spans")[0].alias("x"), F.size("cell_refs").alias("cells"))
    return c.groupBy("table_id", "row_no").agg(F.sum(F.col("x.end") - F.col("x.start")).alias("n_chars"), F.max("cells").alias("n_cells"))


def nearby_context(s: SparkSession, d: str) -> DataFrame:
    e = once(table(s, d, "elements"), "element_id").select("document_id", "ordinal", "element_id", "kind", "text", F.col("source.page").alias("page"))
    return K.nearby_context(e).select("element_id", F.array_join("refs", ",").alias("refs"))


def literal_evidence_audit(s: SparkSession, d: str) -> DataFrame:
    e = once(table(s, d, "elements").where("text is not null and source.page is not null"), "element_id").select("element_id", "document_id", F.col("source.page").alias("page"), F.col("text").alias("evidence_text"))
    pages = once(table(s, d, "parsed_pages"), "document_id", "page").select("document_id", "page", "text")
    return N.literal_audit(e, pages, ["document_id", "page"]).select("element_id", "literal")


def adjacent_segments(s: SparkSession, d: str) -> DataFrame:
    """The windows that hold a figure, neighbours stitched together."""
    w = K.word_windows(table(s, d, "documents"), ["doc_id"], size=50, overlap=0)
    c = w.where(F.col("chunk").rlike("[0-9]")).select(F.lit(1).alias("case_id"), F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), F.concat_ws("-", "doc_id", "chunk_no").alias("chunk_id"), F.col("chunk").alias("text"), (F.col("chunk_no") * 50).alias("char_start"), (F.col("chunk_no") * 50 + 50).alias("char_end"))
    return N.stitched(c).select("document_id", "island", F.length("text").alias("n_chars"), F.size("parts").alias("n_parts"))


def location_label(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "elements"), "element_id").select("element_id", X.location_label(F.col("source")).alias("label"))


def location_rules(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "elements"), "element_id").select("element_id", F.array_join(V.location_violations(F.col("source")), ";").alias("broken"))


def grid_rules(s: SparkSession, d: str) -> DataFrame:
    return V.grid_violations(once(table(s, d, "cells"), "cell_id"), table(s, d, "doc_tables"))


def reference_rules(s: SparkSession, d: str) -> DataFrame:
    return V.reference_violations(table(s, d, "elements"), table(s, d, "doc_tables"))


def latest_delivery(s: SparkSession, d: str) -> DataFrame:
    return V.latest(table(s, d, "chunks").select("chunk_id", "position_no", "token_count", "loaded_at"), ["chunk_id"]).na.fill(-1, ["token_count"])


def incremental_new_docs(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "parsed_pages").select("document_id")
    return V.new_documents(table(s, d, "library_documents"), pages).select("document_id", "doc_format")


def delete_document(s: SparkSession, d: str) -> DataFrame:
    gone = table(s, d, "library_documents").where("ocr_status = 'pending'")
    return V.without_documents(once(table(s, d, "chunks"), "chunk_id").select("chunk_id", "document_id"), gone).select("chunk_id")


def row_span_expand(s: SparkSession, d: str) -> DataFrame:
    return T.covered_positions(once(table(s, d, "cells"), "cell_id")).select("cell_id", "row_no", "col_no")


def column_headers(s: SparkSession, d: str) -> DataFrame:
    return T.column_headers(once(table(s, d, "cells"), "cell_id"), table(s, d, "doc_tables"))


def table_row_render(s: SparkSession, d: str) -> DataFrame:
    return T.render_rows(once(table(s, d, "cells"), "cell_id"), table(s, d, "doc_tables")).select("table_id", "row_no", "row_text")


def table_preview(s: SparkSession, d: str) -> DataFrame:
    return T.preview(once(table(s, d, "cells"), "cell_id")).select("table_id", "row_no", F.array_join("texts", "\t").alias("line"))


def span_overlap_join(s: SparkSession, d: str) -> DataFrame:
    """Chunk spans against sentence spans of the same document."""
    docs = table(s, d, "documents")
    a = K.word_windows(docs, ["doc_id"], size=60, overlap=10).select("doc_id", "chunk_no", (F.col("chunk_no") * 50).alias("a0"), (F.col("chunk_no") * 50 + F.col("n_words")).alias("a1"))
    b = K.word_windows(docs, ["doc_id"], size=35, overlap=0).select("doc_id", F.col("chunk_no").alias("part_no"), (F.col("chunk_no") * 35).alias("b0"), (F.col("chunk_no") * 35 + F.col("n_words")).alias("b1"))
    return a.join(b, "doc_id").where("a0 < b1 and a1 > b0").groupBy("doc_id", "chunk_no").agg(F.count("*").alias("parts"), F.sum(F.least("a1", "b1") - F.greatest("a0", "b0")).alias("shared"))


_WS = r"[\s\x{85}\p{Z}\v]+"
_STRIP = rf"'^{_WS}|{_WS}$', '', 'g'"
_WORDS = rf"list_filter(string_split_regex(text, '{_WS}'), lambda x: x <> '')"
_NORM = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {_STRIP})"


def _merge(x: str) -> str:
    lines = rf"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: case when regexp_replace(l, {_STRIP}) = '' then chr(1) else regexp_replace(l, {_STRIP}) end), ' ')"
    return rf"regexp_replace(regexp_replace({lines}, '( ?\x01)+ ?', chr(10) || chr(10), 'g'), {_STRIP})"




def _compact(x: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({x}, '{_WS}', ' ', 'g'), {_STRIP}))"


_E = "e as (select * from (select distinct on (element_id) * from elements))"
_CE = "ce as (select * from (select distinct on (cell_id) * from cells)), hr as (select table_id, unnest(header_rows) as row_no from doc_tables)"
_COV = _CE + ", cov as (select table_id, cell_id, text, unnest(range(row_no, row_no + greatest(coalesce(row_span, 1), 1))) as row_no, col_no, col_span from ce), cov2 as (select table_id, cell_id, text, cast(row_no as integer) as row_no, cast(unnest(range(col_no, col_no + greatest(coalesce(col_span, 1), 1))) as integer) as col_no from cov)"
_HEAD = _COV + r""", hd0 as (select table_id, col_no, text, min(row_no) as r from cov2 join hr using (table_id, row_no) where trim(coalesce(text, '')) <> '' group by all),
hd as (select table_id, col_no, string_agg(text, ' / ' order by r, text) as header from hd0 group by all)"""
_WIN = r"w as (select doc_id, {words} as w from documents), ww as (select doc_id, unnest(range(0, case when len(w) <= {size} then 1 else cast(ceil((len(w) - {size}) / {step}.0) as bigint) + 1 end)) as chunk_no, w from w where len(w) > 0), wc as (select doc_id, cast(chunk_no as integer) as chunk_no, list_slice(w, chunk_no * {step} + 1, chunk_no * {step} + {size}) as p from ww)"


def _win(size: int, overlap: int) -> str:
    return _WIN.replace("{words}", _WORDS).replace("{size}", str(size)).replace("{step}", str(size - overlap))


SQL = {
    "tokenize_docs": "select doc_id, cast(len(t) as integer) as n_tokens, cast(len(list_distinct(t)) as integer) as n_distinct, sha256(array_to_string(t, ' ')) as h from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents)",
    "word_count": f"select doc_id, cast(len({_WORDS}) as integer) as n_words from documents",
    "normalize_whitespace": f"select distinct document_id, page, sha256({_NORM}) as h from parsed_pages",
    "merge_broken_lines": f"select distinct document_id, page, {_merge('text')} as merged from parsed_pages",
    "normalize_pages": f"select distinct document_id, page, sha256({_merge(_NORM)}) as h from parsed_pages",
    "compact_text": f"select doc_id, sha256({_compact('text')}) as h from documents",
    "content_ids": "select sha256(text) as document_id, min(doc_id) as first_id, count(*) as copies from documents group by 1",
    "symbol_block_filter": rf"with {_E} select element_id from e where text is not null and not regexp_full_match(text, '[®™\s\p{{Z}}\x{{85}}\v]+') and regexp_replace(text, {_STRIP}) <> ''",
    "repeated_line_footer": rf"""with {_E}, b as (select element_id, document_id, source.page as page, source.bbox[4] as y, regexp_replace({_compact('text')}, '\d+', '0', 'g') as k from e where source.page is not null),
m as (select *, y >= max(y) over (partition by document_id, page) - 2 as low from b), o as (select document_id, k from m where low and k is not null group by all having count(distinct page) >= 3)
select element_id from m where not (coalesce(low, false) and k is not null and (document_id, k) in (select (document_id, k) from o))""",
    "page_assembly": f"with {_E} select document_id, source.page as page, sha256(string_agg(text, chr(10) || chr(10) order by ordinal, text)) as h from e where source.page is not null and text is not null group by all",
    "fixed_window_chunks": f"with {_win(100, 20)} select doc_id, chunk_no, sha256(array_to_string(p, ' ')) as h, cast(len(p) as integer) as n_words from wc",
    "chunk_coverage_audit": f"with {_win(100, 20)} select doc_id, count(*) as n_chunks, cast(sum(len(p) - case when chunk_no > 0 then 20 else 0 end) as bigint) as words, cast(max(len(p)) as integer) as largest, max(len(p)) <= 100 as ok from wc group by doc_id",
    "chunk_token_stats": "select document_id, count(*) as n, max(token_count) as largest, round(quantile_cont(token_count, 0.5), 6) as median, round(quantile_cont(token_count, 0.95), 6) as p95, cast(sum(greatest(0, token_count - 255)) as bigint) as over from (select distinct on (chunk_id) * from chunks) group by document_id",
    "sentence_span_audit": rf"select doc_id, cast(length(regexp_replace(text, '{_WS}', '', 'g')) as integer) as n_solid, true as exact, true as within from documents where regexp_replace(text, '{_WS}', '', 'g') <> ''",
    "window_span_audit": rf"select doc_id, cast(length(regexp_replace(text, '{_WS}', '', 'g')) as integer) as n_solid, true as exact, true as within from documents where regexp_replace(text, '{_WS}', '', 'g') <> ''",
    "paragraph_pack_words": f"select document_id, page, cast(len({_WORDS}) as bigint) as n_words, sha256(array_to_string({_WORDS}, ' ')) as h, true as ok from (select distinct document_id, page, text from parsed_pages) where len({_WORDS}) > 0",
    "nearby_context": f"""with {_E}, g0 as (select *, coalesce(sum(cast(kind = 'table' as integer)) over (partition by document_id order by ordinal rows between unbounded preceding and 1 preceding), 0) as grp from e),
n as (select element_id, kind, source.page as page, list({{'i': element_id, 'p': source.page, 't': text}}) over (partition by document_id, grp order by ordinal rows between 3 preceding and 1 preceding) as seen from g0)
select element_id, array_to_string(list_transform(list_filter(coalesce(seen, []), lambda x: coalesce(x.p = page, true) and x.t is not null), lambda x: x.i), ',') as refs from n where kind = 'table'""",
    "structured_text_audit": rf"""with {_E}, b as (select element_id, document_id, ordinal, kind, text, source.page as page, source.fmt as fmt, source.bbox[4] as y from e where kind <> 'table'),
m as (select *, coalesce(y >= max(y) over (partition by document_id, page) - 2, false) as low, lower(nullif(regexp_extract(regexp_replace(regexp_replace(text, '{_WS}', ' ', 'g'), {_STRIP}), '^([^|\n]+\|\s*\d{{4}}\s+Form\s+10-K)\s*\|\s*\d+$', 1, 'i'), '')) as k from b),
o as (select document_id, k from m where fmt = 'pdf' and low and k is not null group by all having count(distinct page) >= 3),
n as (select * from m where trim(coalesce(text, '')) <> '' and (fmt <> 'pdf' or (regexp_replace(text, {_STRIP}) <> '' and not regexp_full_match(text, '[®™\s\p{{Z}}\x{{85}}\v]+') and not (low and k is not null and (document_id, k) in (select (document_id, k) from o)))))
select document_id, coalesce(page, 0) as page, sha256(regexp_replace(string_agg(text, '' order by ordinal, element_id), '{_WS}', '', 'g')) as h, cast(count(*) as integer) as n_elements from n where regexp_replace(text, {_STRIP}) <> '' group by all""",
    "structured_row_audit": rf"""with {_HEAD}, y as (select table_id, col_no, regexp_extract(header, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:[^0-9]|$)', 1) as year from hd)
select table_id, row_no, cast(length(string_agg('C' || col_no || case when coalesce(year, '') <> '' then ' [' || year || ']' else '' end || ': ' || text || case when number_format is not null and number_format <> 'General' then ' [format=' || number_format || ']' else '' end, ' | ')) as bigint) as n_chars, cast(count(*) as integer) as n_cells
from ce left join y using (table_id, col_no) where trim(coalesce(text, '')) <> '' and (table_id, row_no) not in (select (table_id, row_no) from hr) and table_id in (select table_id from elements where kind = 'table') group by all""",
    "literal_evidence_audit": f"with {_E} select e.element_id, coalesce(max(cast(contains({_compact('p.text')}, {_compact('e.text')}) as integer)), 0) as literal from e left join (select distinct document_id, page, text from parsed_pages) p on p.document_id = e.document_id and p.page = e.source.page where e.text is not null and e.source.page is not null group by e.element_id",
    "adjacent_segments": f"""with {_win(50, 0)}, c as (select *, chunk_no - row_number() over (partition by doc_id order by chunk_no) as g from wc where regexp_matches(array_to_string(p, ' '), '[0-9]')),
i as (select doc_id, g, sum(length(array_to_string(p, ' '))) as n, count(*) as k from c group by all)
select doc_id as document_id, row_number() over (partition by doc_id order by g) as island, cast(n as integer) as n_chars, cast(k as integer) as n_parts from i""",
    "location_label": f"""with {_E} select element_id, case source.fmt when 'pdf' then 'page ' || source.page when 'xlsx' then source.sheet || '!' || source.cell_range
else concat_ws(', ', case when len(source.heading_path) > 0 then array_to_string(source.heading_path, ' / ') end, 'paragraph ' || source.paragraph, 'table ' || source.table_no) end as label from e""",
    "location_rules": f"""with {_E} select element_id, concat_ws(';', case when source.fmt not in ('pdf', 'docx', 'xlsx') or source.fmt is null then 'unknown format' end, case when source.fmt = 'pdf' and (source.page is null or source.page < 1) then 'pdf without page' end,
case when source.fmt <> 'pdf' and source.page is not null then 'page outside pdf' end, case when source.fmt <> 'pdf' and source.bbox is not null then 'box outside pdf' end, case when source.fmt = 'docx' and source.paragraph is null and source.table_no is null then 'docx without paragraph or table' end,
case when source.fmt = 'xlsx' and (source.sheet is null or source.cell_range is null) then 'xlsx without sheet or range' end, case when len(source.bbox) <> 4 or source.bbox[1] > source.bbox[3] or source.bbox[2] > source.bbox[4] then 'box not ordered' end) as broken from e""",
    "grid_rules": f"""with {_CE} select table_id, row_no, col_no, 'outside the grid' as rule from ce join doc_tables using (table_id) where row_no < 1 or col_no < 1 or row_no + row_span - 1 > n_rows or col_no + col_span - 1 > n_cols
union all select table_id, row_no, col_no, 'anchor used twice' from ce group by all having count(*) > 1""",
    "reference_rules": "select document_id, element_id, 'no such table' as rule from elements e where kind = 'table' and not exists (select 1 from doc_tables t where t.document_id = e.document_id and t.table_id = e.table_id) union all select document_id, element_id, 'id used twice' from elements group by all having count(*) > 1",
    "latest_delivery": "select chunk_id, position_no, coalesce(token_count, -1) as token_count, loaded_at from chunks qualify row_number() over (partition by chunk_id order by loaded_at desc) = 1",
    "incremental_new_docs": "select document_id, doc_format from library_documents where document_id not in (select document_id from parsed_pages)",
    "delete_document": "select distinct chunk_id from chunks where document_id not in (select document_id from library_documents where ocr_status = 'pending')",
    "row_span_expand": f"with {_COV} select cell_id, row_no, col_no from cov2",
    "column_headers": f"with {_HEAD} select table_id, col_no, header from hd",
    "table_row_render": rf"""with {_HEAD}, y as (select table_id, col_no, regexp_extract(header, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:[^0-9]|$)', 1) as year from hd)
select table_id, row_no, string_agg('C' || col_no || case when coalesce(year, '') <> '' then ' [' || year || ']' else '' end || ': ' || text || case when number_format is not null and number_format <> 'General' then ' [format=' || number_format || ']' else '' end, ' | ' order by col_no) as row_text
from ce left join y using (table_id, col_no) where trim(coalesce(text, '')) <> '' and (table_id, row_no) not in (select (table_id, row_no) from hr) group by all""",
    "table_preview": f"""with {_CE}, g as (select table_id, row_no, max(col_no) as last from ce where row_no <= 100 and col_no <= 50 group by all), x as (select table_id, row_no, unnest(range(1, last + 1)) as col_no from g)
select x.table_id, x.row_no, string_agg(coalesce(ce.text, ''), chr(9) order by x.col_no) as line from x left join ce using (table_id, row_no, col_no) group by all""",
    "span_overlap_join": f"""with {_win(60, 10)}, a as (select doc_id, chunk_no, chunk_no * 50 as a0, chunk_no * 50 + len(p) as a1 from wc), n as (select doc_id, len(w) as n from w where len(w) > 0),
b as (select doc_id, n, unnest(range(0, cast(ceil(n / 35.0) as bigint))) * 35 as b0 from n)
select doc_id, chunk_no, count(*) as parts, cast(sum(least(a1, least(b0 + 35, n)) - greatest(a0, b0)) as bigint) as shared from a join b using (doc_id) where a0 < least(b0 + 35, n) and a1 > b0 group by all""",
}


def queries() -> dict:
    names = [
        tokenize_docs, word_count, normalize_whitespace, merge_broken_lines, normalize_pages, compact_text, content_ids, symbol_block_filter, repeated_line_footer, page_assembly,
        fixed_window_chunks, chunk_coverage_audit, chunk_token_stats, paragraph_pack_chunks, sentence_chunks, token_window_chunks, sentence_span_audit, window_span_audit, paragraph_pack_words, structured_chunks, structured_text_audit, structured_row_audit, nearby_context,
        literal_evidence_audit, adjacent_segments, span_overlap_join, location_label, location_rules, grid_rules, reference_rules, latest_delivery, incremental_new_docs, delete_document,
        row_span_expand, column_headers, table_row_render, table_preview,
    ]
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    return SQL
