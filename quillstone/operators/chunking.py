"""Chunking: fixed word windows (JVM), paragraph packing, token windows and structured chunks (per-row Python folds)."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import text as X
from quillstone.operators import cleaning as C
from quillstone.operators import tables as T1


def check_config(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("the chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size is needed")


def word_windows(df: DataFrame, key: list[str], text: str = "text", size: int = 500, overlap: int = 80) -> DataFrame:
    """(key, chunk_no, chunk, n_words): windows of ``size`` words, ``overlap`` shared; the last one ends with the text.

    Built-ins only.  Null and blank texts give no window.
    """
    check_config(size, overlap)
    step = size - overlap
    n = F.size("w")
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(float(step))).cast("int"))
    w = df.select(*key, X.words(F.col(text)).alias("w")).where(n > 0)
    at = w.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    part = F.slice("w", F.col("chunk_no") * step + 1, F.lit(size))
    return at.select(*key, "chunk_no", F.array_join(part, " ").alias("chunk"), F.size(part).alias("n_words"))


def coverage_audit(chunks: DataFrame, key: list[str], size: int, overlap: int) -> DataFrame:
    """(key, n_chunks, words, largest, ok): words once overlaps are taken off, and whether no chunk exceeds ``size``."""
    shared = F.when(F.col("chunk_no") > 0, overlap).otherwise(0)
    return chunks.groupBy(*key).agg(F.count("*").alias("n_chunks"), F.sum(F.col("n_words") - shared).alias("words"), F.max("n_words").alias("largest")).withColumn("ok", F.col("largest") <= size)


def pack_paragraphs(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs (blank-line separated) packed greedily into at most ``size`` words.

    A paragraph above ``size`` closes the chunk and is cut into windows.  A new
    chunk starts with the last words of the one before, at most ``overlap`` and at
    most what the paragraph leaves room for; paragraph breaks among them stay.
    """
    check_config(size, overlap)
    out: list[str] = []
    held: list[tuple[int, str]] = []  # the open chunk's words, each with its paragraph's number

    def close() -> None:
        if held:
            out.append("\n\n".join(" ".join(w for _, w in g) for _, g in groupby(held, key=lambda x: x[0])))

    for no, words in enumerate(q.split() for q in re.split(r"\n\s*\n", text)):
        if len(words) > size:
            close()
            held = []
            last = -(-(len(words) - size) // (size - overlap))
            out += [" ".join(words[i * (size - overlap) :][:size]) for i in range(last + 1)]
            continue
        if words and held and len(held) + len(words) > size:
            close()
            shared = min(overlap, size - len(words))
            held = held[len(held) - shared :] if shared < len(held) else held
        held += [(no, w) for w in words]
    close()
    return out


def _atoms(text: str, most: int, count: Callable[[str], int]) -> Iterator[tuple[int, int, int]]:
    """(start, end, tokens) of words with the white space after them; a word above ``most`` is halved until its parts fit."""
    for m in re.finditer(r"\S+\s*|\s+", text):
        todo = [m.span()]
        while todo:
            a, b = todo.pop()
            n = count(text[a:b])
            if n <= most or b - a == 1:
                yield a, b, n
            else:
                todo += [((a + b) // 2, b), (a, (a + b) // 2)]


def char_pieces(text: str, most: int, count: Callable[[str], int]) -> list[tuple[int, int]]:
    """(start, end) of consecutive pieces of at most ``most`` tokens each that together are the text.

    Words are counted once and summed, so a piece is found by search in the
    running sums and ends at a word's end; the piece as a whole is counted again,
    as a tokenizer may find more in it than in its words.
    """
    atoms = list(_atoms(text, most, count))
    sums = np.concatenate([[0], np.cumsum([n for *_, n in atoms])])
    out, first = [], 0
    while first < len(atoms):
        last = max(first + 1, int(np.searchsorted(sums, sums[first] + most, "right")) - 1)
        while last > first + 1 and count(text[atoms[first][0] : atoms[last - 1][1]]) > most:
            last -= 1
        out.append((atoms[first][0], atoms[last - 1][1]))
        first = last
    return out


def sentence_chunks(text: str, most: int, pack: bool, count: Callable[[str], int]) -> list[tuple[int, int]]:
    """(start, end) of paragraphs, whole where they fit, else by sentences, else by pieces.

    Sentences of a broken paragraph share a chunk while they fit.  With ``pack``
    whole paragraphs are joined while they fit; parts of broken ones stay apart.
    """
    spans: list[tuple[int, int]] = []
    whole: list[bool] = []

    def add(a: int, b: int, joins: bool, is_whole: bool) -> None:
        if joins and spans and whole[-1] == is_whole and count(text[spans[-1][0] : b]) <= most:
            spans[-1] = spans[-1][0], b
        else:
            spans.append((a, b))
            whole.append(is_whole)

    for p in re.finditer(r"\S(?:.*?\S)?(?=\s*\n\s*\n|\s*\Z)", text, re.S):
        if count(p[0]) <= most:
            add(*p.span(), pack, True)
            continue
        first = True  # a broken paragraph's first part joins nothing before it
        for s in re.finditer(r"\S.*?(?:[.!?。！？]+(?=\s|$)|\Z)", p[0], re.S):
            a, b = p.start() + s.start(), p.start() + s.end()
            parts = [(a, b)] if count(s[0]) <= most else [(a + i, a + j) for i, j in char_pieces(s[0], most, count)]
            for part in parts:
                add(*part, len(parts) == 1 and not first, False)
                first = len(parts) > 1
    return spans


def token_windows(text: str, size: int, overlap: int, spans: Callable[[str], list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """(start, end) of windows of at most ``size`` tokens; a window ends at a paragraph's end in its last quarter where there is one.

    A window is tokenised again by itself, and shortened should that make more tokens of it.
    """
    check_config(size, overlap)
    t = spans(text)
    out, at = [], 0
    while at < len(t):
        end = min(at + size, len(t))
        if end < len(t):
            quarter = range(end, at + max(1, size * 3 // 4), -1)
            end = next((k for k in quarter if "\n\n" in text[t[k - 1][1] : t[k][0]]), end)
        while end > at + 1 and len(spans(text[t[at][0] : t[end - 1][1]])) > size:
            end -= 1
        out.append((t[at][0], t[end - 1][1]))
        if end == len(t):
            break
        at = max(end - overlap, at + 1)
    return out


def word_count(text: str) -> int:
    """The default token counter."""
    return len(text.split())


def word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\S+", text)]


def chunk_rows(df: DataFrame, key: list[str], text: str, cut: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    """(key, chunk_no, start, end, chunk) by a function from a text to spans; null and empty texts give nothing."""
    src = df.select(*key, F.col(text).alias("text__")).where("text__ is not null and text__ <> ''")
    schema = T.StructType([*(src.schema[k] for k in key), *(T.StructField(c, T.IntegerType()) for c in ("chunk_no", "start", "end")), T.StructField("chunk", T.StringType())])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*k, i, a, b, t[a:b]) for *k, t in pdf.itertuples(index=False) for i, (a, b) in enumerate(cut(t))]
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    return src.mapInPandas(work, schema)


def packed_chunks(df: DataFrame, key: list[str], text: str = "text", size: int = 500, overlap: int = 80) -> DataFrame:
    """(key, chunk_no, chunk, n_words) by ``pack_paragraphs``."""
    check_config(size, overlap)
    src = df.select(*key, F.col(text).alias("text__")).where("text__ is not null")
    schema = T.StructType([*(src.schema[k] for k in key), T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.StringType()), T.StructField("n_words", T.IntegerType())])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*k, i, c, len(c.split())) for *k, t in pdf.itertuples(index=False) for i, c in enumerate(pack_paragraphs(t, size, overlap))]
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    return src.mapInPandas(work, schema)


def span_audit(chunks: DataFrame, source: DataFrame, key: list[str], most_words: int, text: str = "text") -> DataFrame:
    """(key, n_solid, exact, within) per text with chunks: characters other than white space that its chunks cover, each chunk is its slice [start, end), and none has more than ``most_words`` words."""
    spans = F.sort_array(F.collect_list(F.struct("start", "end", "chunk")))
    j = chunks.groupBy(*key).agg(spans.alias("s__")).join(source.select(*key, F.col(text).alias("t__")), key)
    cut = lambda a, b: F.substring(F.col("t__"), a + 1, F.greatest(b - a, F.lit(0)))
    solid = lambda x: F.length(F.regexp_replace(x, r"(?U)\s+", ""))
    # what lies between the end reached so far and a chunk's start is not covered
    reached = F.aggregate("s__", F.struct(F.lit(0).alias("at"), F.lit(0).alias("missed")), lambda acc, x: F.struct(F.greatest(acc["at"], x["end"]).alias("at"), (acc["missed"] + solid(cut(acc["at"], x["start"]))).alias("missed")))
    j = j.withColumn("r__", reached)
    missed = F.col("r__.missed") + solid(cut(F.col("r__.at"), F.length("t__")))
    exact = F.forall("s__", lambda x: cut(x["start"], x["end"]) == x["chunk"])
    within = F.forall("s__", lambda x: F.size(X.words(x["chunk"])) <= most_words)
    return j.select(*key, (solid(F.col("t__")) - missed).alias("n_solid"), exact.alias("exact"), within.alias("within"))


# ---------------------------------------------------------------- structured chunks

VERSION = "1"  #: of the chunks' form; part of their ids

# What stands before a table's rows.
NEARBY = "Nearby text: {}\n"
HEADER = "Table {}; header ({}): {}\n"
BARE = "Table {}; headers in structured source\n"

_SPAN = "struct<element_id: string, start: int, end: int>"
_CELL = "struct<row_no: int, col_no: int>"
_SOURCE = "struct<fmt: string, page: int, bbox: array<double>, paragraph: int, table_no: int, sheet: string, cell_range: string, row_start: int, row_end: int>"
_STRUCTURED = (
    "chunk_id string, document_id string, chunk_no bigint, kind string, page int, text string, token_count int, element_ids array<string>, table_id string, context_refs array<string>, "
    f"source {_SOURCE}, text_spans array<{_SPAN}>, cell_refs array<{_CELL}>, header_cell_refs array<{_CELL}>"
)


def table_prefix(table: str, header: str, origin: str, nearby: str, most: int, count: Callable[[str], int]) -> tuple[str, bool]:
    """(what repeats before a table's rows, is nearby text in it): nearby text up to a fifth of ``most``, the header while both stay within half, else the table's name."""
    near = NEARBY.format(nearby) if nearby and count(nearby) <= most // 5 else ""
    full = near + HEADER.format(table, origin or "unknown", header)
    return (full, bool(near)) if count(full) <= most // 2 else (BARE.format(table), False)


def _place(ordinal: int, row: int, piece: int) -> int:
    """A number that ascends in reading order and is unique in its document."""
    if not (0 <= row < 1 << 20 and 0 <= piece < 1 << 16):
        raise ValueError("a table of more than a million rows, or a row of more than 65,536 pieces")
    return (ordinal << 36) | (row << 16) | piece


def _chunk(u, row: int, piece: int, kind: str, text: str, tokens: int, ids: list[str], refs: list[str], source: dict, spans: list[dict], cells: list, heads: list, most: int) -> tuple:
    """One chunk's row; the id holds a digest of all that makes the chunk."""
    made = json.dumps([text, source, ids, refs, spans], sort_keys=True, ensure_ascii=False)
    no = _place(int(u.ordinal), row, piece)
    cid = f"{u.document_id}_v{VERSION}_t{most}_c{no:x}_{hashlib.sha256(made.encode()).hexdigest()[:16]}"
    return cid, u.document_id, no, kind, source["page"], text, tokens, ids, u.table_id, refs, source, spans, cells, heads


def _source(u, **more) -> dict:
    known = {k: getattr(u, k) for k in ("fmt", "paragraph", "table_no", "sheet", "cell_range")}
    whole = {k: None if v is None or v != v else int(v) if k in ("paragraph", "table_no") else v for k, v in known.items()}
    return {**whole, "page": None if pd.isna(u.page) else int(u.page), "bbox": None, "row_start": None, "row_end": None, **more}


def _union(boxes: list) -> list[float] | None:
    b = np.array([x for x in boxes if x is not None and len(x) == 4], "f8").reshape(-1, 4)
    return [*b[:, :2].min(0).tolist(), *b[:, 2:].max(0).tolist()] if len(b) else None


def _text_chunks(u, most: int, count: Callable[[str], int]) -> list[tuple]:
    """A page's texts (an element's, outside pdf), a line break between, cut into pieces."""
    ends = np.cumsum([len(p["text"]) + 1 for p in u.parts])
    joined = "\n".join(p["text"] for p in u.parts)
    out = []
    for n, (a, b) in enumerate(char_pieces(joined, most, count)):
        if not joined[a:b].strip():
            continue
        hit = range(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "left")) + 1)
        mine = [(u.parts[i], int(ends[i]) - len(u.parts[i]["text"]) - 1) for i in hit]
        spans = [{"element_id": p["element_id"], "start": max(0, a - s), "end": min(len(p["text"]), b - s)} for p, s in mine]
        box = _union([p["bbox"] for p, _ in mine]) if u.fmt == "pdf" else None
        ids = [p["element_id"] for p, _ in mine]
        out.append(_chunk(u, 0, n, "text", joined[a:b], count(joined[a:b]), ids, [], _source(u, bbox=box), spans, [], [], most))
    return out


def _row_chunks(u, most: int, count: Callable[[str], int]) -> list[tuple]:
    """A table row, cut into pieces with the table's prefix before each."""
    pre, near = table_prefix(u.table_id, u.header or "", u.origin, u.nearby or "", most, count)
    room = most - count(pre)
    if room < 1:
        raise ValueError("a table's name alone takes all tokens")
    box = None if u.bbox is None else [float(x) for x in u.bbox]
    cells = u.cell_range if u.fmt != "xlsx" or not u.cell_range else T1.a1_slice(u.cell_range, int(u.row_no), int(u.row_no))
    source = _source(u, bbox=box, cell_range=cells, row_start=int(u.row_no), row_end=int(u.row_no))
    refs = list(u.refs) if near and u.refs is not None else []
    pick = lambda x: [] if x is None else [{"row_no": int(c["row_no"]), "col_no": int(c["col_no"])} for c in x]
    return [
        _chunk(u, int(u.row_no), n, "table", pre + u.row_text[a:b], count(pre + u.row_text[a:b]), [u.element_id], refs, source, [{"element_id": u.element_id, "start": a, "end": b}], pick(u.cell_refs), pick(u.header_cell_refs), most)
        for n, (a, b) in enumerate(char_pieces(u.row_text, room, count))
    ]


def structured_chunks(elements: DataFrame, rows: DataFrame, max_tokens: int = 300, count: Callable[[str], int] = word_count) -> DataFrame:
    """Chunks of typed documents: paragraphs and headings joined per page (per element outside pdf), table rows with a repeated prefix.

    ``elements``: (document_id, ordinal, element_id, kind, text, table_id, page, fmt) and, where
    known, bbox, paragraph, table_no, sheet and cell_range; pdf text blocks that are
    noise (``without_noise``) are left out.  ``rows``: (document_id, table_id, row_no,
    row_text, header) and, where known, origin, cell_refs and header_cell_refs.

    Out come chunk_id (stable: the place and a digest of text and sources),
    chunk_no (ascending in reading order and unique in the document, not dense), kind,
    page, text, token_count, element_ids, table_id, context_refs (the elements of
    the nearby text, where it is in the chunk), source (of all elements in the
    chunk: the boxes' union; of a table's row: its range), text_spans (the part of
    each element, or of the row's text), cell_refs and header_cell_refs.

    A page or one table row is a unit of work, so documents and tables of any
    size spread over tasks; the three last paragraphs before a table (on its page)
    are its nearby text.  Blank texts and rows give no chunk.
    """
    if max_tokens < 16:
        raise ValueError("max_tokens must be at least 16")
    elements = C.without_noise(elements)
    for c, kind in (("bbox", "array<double>"), ("paragraph", "int"), ("table_no", "int"), ("sheet", "string"), ("cell_range", "string")):
        if c not in elements.columns:
            elements = elements.withColumn(c, F.lit(None).cast(kind))
    for c, kind in (("origin", "string"), ("cell_refs", f"array<{_CELL}>"), ("header_cell_refs", f"array<{_CELL}>")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    at = ["page", "fmt", "paragraph", "table_no", "sheet", "cell_range"]
    unit = F.when(F.col("fmt") == "pdf", F.concat(F.lit("p"), F.col("page").cast("string"))).otherwise(F.concat(F.lit("e"), F.col("element_id")))
    texts = elements.where("kind <> 'table' and trim(coalesce(text, '')) <> ''").withColumn("unit", F.coalesce(unit, F.lit("p")))
    parts = F.sort_array(F.collect_list(F.struct("ordinal", "element_id", "text", "bbox"))).alias("parts")
    # a page is one row with its parts in order, so Python sees batches of pages instead of a call for each
    pages = texts.groupBy("document_id", "unit").agg(parts, *(F.min(c).alias(c) for c in ("ordinal", *at))).withColumn("table_id", F.lit(None).cast("string"))
    tables = elements.where("kind = 'table'").select("document_id", "ordinal", "element_id", "table_id", "bbox", *at).join(nearby_context(elements), ["document_id", "element_id"], "left")
    known = rows.where("trim(row_text) <> ''").select("document_id", "table_id", "row_no", "row_text", "header", "origin", "cell_refs", "header_cell_refs")

    def cut(f) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        names = [x.split()[0] for x in re.sub(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", "", _STRUCTURED).split(",")]

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame([r for u in pdf.itertuples(index=False) for r in f(u, max_tokens, count)], columns=names).astype({"page": "Int32"})

        return work

    return pages.mapInPandas(cut(_text_chunks), _STRUCTURED).unionByName(known.join(tables, ["document_id", "table_id"]).mapInPandas(cut(_row_chunks), _STRUCTURED))


def nearby_context(elements: DataFrame, n: int = 3) -> DataFrame:
    """(document_id, element_id, nearby, refs) per table: the last ``n`` text elements since the table before, on the same page where pages exist."""
    order = Window.partitionBy("document_id").orderBy("ordinal")
    g = elements.withColumn("group", F.sum(F.when(F.col("kind") == "table", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy("document_id", "group").orderBy("ordinal").rowsBetween(-n, -1)
    seen = F.collect_list(F.struct("element_id", "text", "page")).over(w)
    same = F.filter(F.col("seen"), lambda x: F.coalesce(x["page"] == F.col("page"), F.lit(True)) & x["text"].isNotNull())
    return (
        g.withColumn("group", F.coalesce("group", F.lit(0)))
        .withColumn("seen", seen)
        .where("kind = 'table'")
        .withColumn("near", same)
        .select("document_id", "element_id", F.array_join(F.transform("near", lambda x: x["text"]), " | ").alias("nearby"), F.transform("near", lambda x: x["element_id"]).alias("refs"))
    )
