"""Text functions, chunkers, cleaning, content scoring."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import chunking as K
from quillstone.operators import cleaning as C
from quillstone.operators import content as N

TEXT = st.text(alphabet="ab .\n,é", max_size=200)


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_tokens_and_words(spark):
    assert one(spark, X.tokens, "R&D 64,377 Émile", "", None) == [["r", "d", "64", "377", "mile"], [], []]
    assert one(spark, X.words, "a b c　d", "  ") == [["a", "b", "c", "d"], []]


def test_normalisation(spark):
    assert one(spark, X.normalize_space, " a\t b\r\nc\n\n\n\nd ") == ["a b\nc\n\nd"]
    assert one(spark, X.merge_lines, "a\nb\n\nc\n \n\nd") == ["a b\n\nc\n\nd"]
    assert one(spark, X.normalize_text, "x \r\n y\n\n\n\nz") == ["x y\n\nz"]
    assert one(spark, X.compact, " A\n b ") == ["a b"]


def test_footer_key_and_citations(spark):
    assert one(spark, X.footer_key, "Acme Inc. | 2025 Form 10-K | 9", "body") == ["acme inc. | 2025 form 10-k", None]
    assert one(spark, X.citations, "x [E2][E1] [E2] [E]") == [["E2", "E1"]]
    assert one(spark, X.without_citations, "x [E2].") == ["x ."]


def test_footers(spark):
    foot, schema = "Acme Inc. | 2025 Form 10-K | {}", "document_id string, page int, text string, bbox array<double>"
    rows = []
    for p in (1, 2, 3):
        rows += [("d", p, foot.format(p), [0.0, 10.0, 9.0, 20.0]), ("d", p, "body", [0.0, 30.0, 9.0, 40.0]), ("d", p, "® ™ ®", [0.0, 50.0, 9.0, 60.0]), ("d", p, foot.format(p), [0.0, 700.0, 9.0, 710.0])]
    b = spark.createDataFrame(rows, schema)
    assert C.drop_footers(C.drop_symbol_blocks(b)).count() == 6
    assert C.drop_footers(b.where("page = 1")).count() == 4
    assert C.drop_footers(b.withColumn("bbox", F.lit(None).cast("array<double>"))).count() == 12


def test_html(spark):
    h = spark.createDataFrame([(1, "<p>a <b>b</b></p><script>x<y</script><div>c &amp; d</div>")], "page_id int, html string")
    assert [(r.block_no, r.text) for r in C.html_blocks(h).collect()] == [(0, "a b"), (1, "c & d")]


def test_word_windows(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(23))), (2, ""), (3, None)], "id int, text string")
    got = K.word_windows(df, ["id"], size=7, overlap=2).orderBy("chunk_no").collect()
    words = [r.chunk.split() for r in got]
    assert all(len(w) <= 7 for w in words) and all(a[-2:] == b[:2] for a, b in zip(words, words[1:]))
    assert words[0] + [x for w in words[1:] for x in w[2:]] == [f"w{i}" for i in range(23)]
    with pytest.raises(ValueError):
        K.word_windows(df, ["id"], size=3, overlap=3)


def test_packing():
    assert K.pack_paragraphs("a b c\n\nd e f", 5, 0) == ["a b c", "d e f"]
    assert K.pack_paragraphs("a b c d\n\ne f g h i", 5, 2) == ["a b c d", "e f g h i"]
    assert K.pack_paragraphs("a b c d\n\ne f g h", 5, 2) == ["a b c d", "d\n\ne f g h"]


@settings(max_examples=60, deadline=None)
@given(TEXT, st.integers(2, 9))
def test_packing_keeps_words(text, size):
    got = K.pack_paragraphs(text, size, 0)
    assert all(len(c.split()) <= size for c in got)
    assert [w for c in got for w in c.split()] == text.split()


@settings(max_examples=60, deadline=None)
@given(TEXT, st.integers(1, 9))
def test_pieces_are_the_text(text, most):
    got = K.char_pieces(text, most, len)
    assert "".join(text[a:b] for a, b in got) == text and all(b - a <= most for a, b in got)


@settings(max_examples=60, deadline=None)
@given(TEXT, st.integers(1, 6), st.booleans())
def test_sentence_chunks_cover(text, most, pack):
    got = K.sentence_chunks(text, most, pack, K.word_count)
    assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    assert re.sub(r"\s", "", "".join(text[a:b] for a, b in got)) == re.sub(r"\s", "", text)
    assert all(K.word_count(text[a:b]) <= most for a, b in got)


def test_span_audit(spark):
    text = "one two  three. four"
    src = spark.createDataFrame([(i, text) for i in range(5)], "id int, text string")
    ok = [(0, 0, 9, text[0:9]), (0, 4, 20, text[4:20])]
    bad = [(1, 0, 3, "one"), (1, 9, 20, text[9:20]), (2, 0, 20, text.upper()), (3, 0, 20, text), (4, 0, 14, text[:14])]
    got = {r.id: (r.n_solid, r.exact, r.within) for r in K.span_audit(spark.createDataFrame(ok + bad, "id int, start int, end int, chunk string"), src, ["id"], 3).collect()}
    assert got == {0: (16, True, True), 1: (13, True, True), 2: (16, False, False), 3: (16, True, False), 4: (11, True, True)}


def test_broken_paragraphs_stay_apart():
    text = "a b\n\nc d\n\none two three. four five. six\n\ne f\n\ng h"
    cut = lambda pack: [text[a:b] for a, b in K.sentence_chunks(text, 5, pack, K.word_count)]
    assert cut(True) == ["a b\n\nc d", "one two three. four five.", "six", "e f\n\ng h"]
    assert cut(False) == ["a b", "c d", "one two three. four five.", "six", "e f", "g h"]


def test_windows_are_tokenised_again():
    spans = lambda t: [m.span() for m in re.finditer(r"^\w|\w+", t)]  # a word's first letter is a token at the start of a text only
    text = "alpha beta gamma delta epsilon"
    got = K.token_windows(text, 3, 0, spans)
    assert all(len(spans(text[a:b])) <= 3 for a, b in got) and got[0][0] == 0 and got[-1][1] == len(text)
    assert "".join(text[a:b] for a, b in got).replace(" ", "") == text.replace(" ", "")


def test_structured_chunks(spark):
    e = spark.createDataFrame(
        [("d", 1, "e1", "heading", "Title", None, 1, "pdf"), ("d", 2, "e2", "paragraph", "one two three four", None, 1, "pdf"), ("d", 3, "e3", "table", None, "t1", 1, "pdf"), ("d", 4, "e4", "paragraph", "next page", None, 2, "pdf")],
        "document_id string, ordinal int, element_id string, kind string, text string, table_id string, page int, fmt string",
    )
    rows = spark.createDataFrame([("d", "t1", 2, "C1: Sales | C2: 5", "C2: 2020", "")], "document_id string, table_id string, row_no int, row_text string, header string, years string")
    got = K.structured_chunks(e, rows, 20).orderBy("page", "kind", "chunk_no").collect()
    assert all(r.token_count <= 20 for r in got)
    assert [r.kind for r in got] == ["table", "text", "text"]
    assert got[0].text.endswith("C1: Sales | C2: 5") and "C2: 2020" in got[0].text and got[0].element_ids == ["e3"]
    assert set(got[1].element_ids) == {"e1", "e2"}


def test_structured_chunks_leave_noise_out(spark):
    foot, low, rows = "Acme Inc. | 2025 Form 10-K | {}", [0.0, 700.0, 9.0, 710.0], []
    for p in (1, 2, 3):
        rows += [("d", 10 * p, f"s{p}", "paragraph", "® ™", None, p, "pdf", [0.0, 5.0, 9.0, 9.0]), ("d", 10 * p + 1, f"b{p}", "paragraph", f"body  {p}\n®", None, p, "pdf", [0.0, 30.0, 9.0, 40.0])]
        rows += [("d", 10 * p + 2, f"f{p}", "paragraph", foot.format(p), None, p, "pdf", low), ("d", 10 * p + 3, f"t{p}", "table", None, f"t{p}", p, "pdf", None)]
    rows += [("w", 1, "x1", "paragraph", "®", None, None, "docx", None), ("o", 1, "o1", "paragraph", foot.format(1), None, 1, "pdf", low), ("n", 1, "n1", "paragraph", "no format", None, None, None, None)]
    e = spark.createDataFrame(rows, "document_id string, ordinal int, element_id string, kind string, text string, table_id string, page int, fmt string, bbox array<double>")
    cells = spark.createDataFrame([("d", f"t{p}", 2, "C1: 5", "C1: 2020", "") for p in (1, 2, 3)], "document_id string, table_id string, row_no int, row_text string, header string, years string")
    got = K.structured_chunks(e, cells, 40).collect()
    assert sorted((r.document_id, r.text, *r.element_ids) for r in got if r.kind == "text") == [("d", f"body  {p}\n®", f"b{p}") for p in (1, 2, 3)] + [("n", "no format", "n1"), ("o", foot.format(1), "o1"), ("w", "®", "x1")]
    assert {(*r.context_refs,) for r in got if r.kind == "table"} == {(f"b{p}",) for p in (1, 2, 3)}
    assert len(K.structured_chunks(e.drop("bbox"), cells, 40).where("exists(element_ids, x -> x like 'f%')").collect()) == 3


def test_structured_chunk_sources(spark):
    rows = [("d", 1, "a", "paragraph", "one two three four five six seven eight nine ten", None, 1, "pdf", [5.0, 10.0, 50.0, 20.0], None, None), ("d", 2, "b", "paragraph", "eleven twelve thirteen fourteen fifteen sixteen seventeen", None, 1, "pdf", [1.0, 30.0, 60.0, 40.0], None, None)]
    rows += [("x", 1, "n", "paragraph", "EUR m", None, None, "xlsx", None, "S", "A1:A1"), ("x", 2, "t", "table", None, "T9", None, "xlsx", None, "S", "B2:D5"), ("x", 3, "h", "table", None, "T10", None, "xlsx", None, "S", "F2:F9")]
    e = spark.createDataFrame(rows, "document_id string, ordinal int, element_id string, kind string, text string, table_id string, page int, fmt string, bbox array<double>, sheet string, cell_range string")
    long = "C1: " + "中文ABC " * 40
    r = [("x", "T9", 2, "C1: a | C2: 5", "C2: 2020", "declared", [(2, 1), (2, 2)], [(1, 2)]), ("x", "T10", 3, long, "C1: " + "w " * 30, None, None, None), ("x", "T10", 4, " ", "", None, None, None)]
    r = spark.createDataFrame(r, "document_id string, table_id string, row_no int, row_text string, header string, origin string, cell_refs array<struct<row_no: int, col_no: int>>, header_cell_refs array<struct<row_no: int, col_no: int>>")
    got = K.structured_chunks(e, r, 16).orderBy("document_id", "chunk_no").collect()
    assert len({c.chunk_id for c in got}) == len({(c.document_id, c.chunk_no) for c in got}) == len(got) and all(c.token_count <= 16 for c in got)
    text = [c for c in got if c.document_id == "d"]
    assert "".join(c.text for c in text) == rows[0][4] + "\n" + rows[1][4]
    assert text[0].element_ids == ["a", "b"] and text[0].source.bbox == [1.0, 10.0, 60.0, 40.0] and text[-1].source.bbox == [1.0, 30.0, 60.0, 40.0]
    assert [(x.element_id, x.start) for x in text[0].text_spans] == [("a", 0), ("b", 0)] and text[0].text_spans[1].end == text[1].text_spans[0].start and text[1].text_spans[0].end == len(rows[1][4])
    one = next(c for c in got if c.table_id == "T9")
    assert one.text == "Nearby text: EUR m\nTable T9; header (declared): C2: 2020\nC1: a | C2: 5" or one.text.startswith("Table T9; header")
    assert one.source.cell_range == "B3:D3" and one.source.row_start == 2 and [tuple(x) for x in one.cell_refs] == [(2, 1), (2, 2)] and [tuple(x) for x in one.header_cell_refs] == [(1, 2)]
    cut = [c for c in got if c.table_id == "T10"]
    assert len(cut) > 1 and all(c.text.startswith("Table T10; headers in structured source\n") for c in cut) and "".join(c.text.split("\n", 1)[1] for c in cut) == long
    again = K.structured_chunks(e.orderBy(F.desc("ordinal")), r, 16).collect()
    assert {c.chunk_id for c in again} == {c.chunk_id for c in got}
    with pytest.raises(ValueError):
        K.structured_chunks(e, r, 15)


UNIT = {"id": "u", "pages": [63], "anchors": [{"phrases": ["Capital spending"]}, {"number": "4625"}], "max_span": 60, "values_after_label": True}


@pytest.mark.parametrize("text,hit", [("Capital spending (4,625) (4,100)", True), ("Capital spending 14,625", False), ("Capital spending 4,625.7", False), ("4,625 Capital spending", False), ("capital-SPENDING was 4625.", True)])
def test_match_unit(text, hit):
    assert (N.match_unit(text, UNIT) is not None) == hit


def test_phrases_and_numbers():
    t = N.normal("Net-Sales  of 1 234 567.5 and 12,345; ﬁnal 4.5 % or 14.5")
    assert [t[a:b] for a, b in N.phrase_spans(t, "NET sales")] == ["net-sales"] and [t[a:b] for a, b in N.phrase_spans(t, "final 4.5")] == ["final 4.5"]
    assert N.phrase_spans(t, "45") == N.phrase_spans(t, "4.5") == [(t.index("4.5"), t.index("4.5") + 3)] and not N.phrase_spans("45", "4.5")
    assert [t[a:b] for a, b in N.number_spans(t, "1,234,567.5")] == ["1 234 567.5"] and not N.number_spans(t, "34567.5") and [t[a:b] for a, b in N.number_spans(t, "12345")] == ["12,345"]
    for bad in ("", "a1", "1.x"):
        with pytest.raises(ValueError):
            N.number_spans(t, bad)
    with pytest.raises(ValueError):
        N.phrase_spans(t, " – ")


def test_ligatures_shift_nothing(spark):
    schema = "case_id string, document_id string, page int, chunk_id string, text string, char_start int, char_end int"
    crit = spark.createDataFrame([("x", "D", False, json.dumps([UNIT]))], "case_id string, document_id string, manual_required boolean, units string")
    rows = [("x", "D", 63, "a", "ﬃ ﬃ ß ﬃ ", 0, 8), ("x", "D", 63, "b", "Capital spending 4,625", 8, 30), ("x", "D", 63, "c", " and the rest", 30, 43)]
    assert N.score_content(spark.createDataFrame(rows, schema), crit).first().supporting == ["b"]


def test_long_islands(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(200)))], "document_id int, text string")
    w = K.word_windows(df, ["document_id"], size=10, overlap=0)
    c = w.select(F.lit(1).alias("case_id"), "document_id", F.lit(1).alias("page"), F.col("chunk_no").cast("string").alias("chunk_id"), F.col("chunk").alias("text"), (F.col("chunk_no") * 10).alias("char_start"), (F.col("chunk_no") * 10 + 10).alias("char_end"))
    sizes = lambda x: [len(r.parts) for r in N.stitched(x).orderBy("island").collect()]
    assert sizes(c) == [20] and sizes(c.where("chunk_id not in ('7', '8', '19')")) == [7, 10]


def test_content_over_neighbours(spark):
    schema = "case_id string, document_id string, page int, chunk_id string, text string, char_start int, char_end int"
    crit = spark.createDataFrame([("x", "D", False, json.dumps([UNIT])), ("m", "D", True, json.dumps([UNIT]))], "case_id string, document_id string, manual_required boolean, units string")
    a, b = ("x", "D", 63, "a", "Capital spending ", 0, 17), ("x", "D", 63, "b", "(4,625)", 17, 24)
    score = lambda rows: {r.case_id: r for r in N.score_content(spark.createDataFrame(rows, schema), crit).collect()}
    assert score([a])["x"].all_units == 0
    got = score([a, b])
    assert got["x"].all_units == 1 and got["x"].supporting == ["a", "b"] and got["m"].all_units is None
    assert score([a, (*b[:5], 18, 25)])["x"].all_units == 0
    assert score([a, ("x", "D", 64, *b[3:])])["x"].all_units == 0
    with pytest.raises(Exception, match="twice"):
        score([a, a])
