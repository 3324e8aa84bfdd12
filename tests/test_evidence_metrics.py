"""Evidence, conversations, metrics, statistics, validation, tables."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillstone.operators import evidence as E
from quillstone.operators import metrics as M
from quillstone.operators import tables as T
from quillstone.operators import validation as V


def test_registry_and_citations(spark):
    r = spark.createDataFrame([("s", 1, 1, "a"), ("s", 1, 2, "b"), ("s", 2, 1, "b"), ("s", 2, 2, "c"), ("s", 2, 3, "c")], "session string, round int, rank int, chunk_id string")
    reg = E.register(r)
    assert {x.chunk_id: x.citation_id for x in reg.collect()} == {"a": "E1", "b": "E2", "c": "E3"}
    a = spark.createDataFrame([("s", "[E1][E3][E99]"), ("t", "nothing")], "session string, answer string")
    c = E.check_citations(a, reg)
    assert [(x.label, x.chunk_id, x.known) for x in c.orderBy("use_no").collect()] == [("E1", "a", True), ("E3", "c", True), ("E99", None, False)]
    assert {x.session: x.status for x in E.citation_status(a, c).collect()} == {"s": "invalid", "t": "uncited"}
    s = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3)], "session string, round int")
    h = {x["round"]: x for x in E.search_history(s, r).collect()}
    assert h[2].new_ids == ["c"] and h[1].new_count == 2 and h[3].retrieved == []
    u = E.evidence_usage(r.where("rank < 3"), spark.createDataFrame([("s", "b")], "session string, chunk_id string"))
    assert [x.used for x in u.orderBy("round", "rank").collect()] == [False, True, True, False]


def test_conflicts(spark):
    c = spark.createDataFrame([("a", "x")], "chunk_id string, text string")
    r = spark.createDataFrame([("s", 1, "a", "x"), ("s", 1, "a", "y"), ("s", 1, "m", "z")], "session string, round int, chunk_id string, text string")
    assert E.conflicts(r, c).count() == 2


def test_conversation(spark):
    t = spark.createDataFrame([("c", i, f"{i} [E1]") for i in range(1, 8)], "conv_id string, turn int, text string")
    assert sorted(r.turn for r in E.last_turns(t).collect()) == [3, 4, 5, 6, 7]
    assert sorted(r.turn for r in E.last_turns(t, 5, budget=12).collect()) == [6, 7]
    assert sorted(r.turn for r in E.context_suffix(t, 10).collect()) == [6, 7]
    assert E.context_suffix(t, 1).count() == 0
    q = spark.createDataFrame([("s", 1, "Net  Sales"), ("s", 2, "net sales "), ("s", 3, "x")], "session string, pos int, query string")
    assert sorted(r.pos for r in E.distinct_queries(q).collect()) == [1, 3]
    k = spark.createDataFrame([(7, 3, i) for i in range(3)], "k int, q int, i int").select(E.quota(F.col("k"), F.col("q"), F.col("i")).alias("n"))
    assert sum(r.n for r in k.collect()) == 7


def test_page_metrics(spark):
    r = spark.createDataFrame([("x", 1, "A", 1), ("x", 2, "A", 1), ("x", 3, "B", 1)], "case_id string, rank int, document_id string, page int")
    g = spark.createDataFrame([("x", "B", 1), ("x", "B", 2), ("y", "B", 1)], "case_id string, document_id string, page int")
    m = {x.case_id: x for x in M.page_metrics(r, g).collect()}
    assert m["x"].coverage == 0.5 and m["x"].mrr == 0.333333 and m["x"].repeat_fraction == 0.333333 and m["x"].all_hit == 0
    assert m["y"].hit == 0 and m["y"].mrr == 0


def test_gold_pages(spark):
    ev = "array<struct<doc_name: string, evidence_doc_name: string, evidence_page_num: int>>"
    ok = spark.createDataFrame([("x", "A", [("B", None, 0), (None, "B", 0)])], f"case_id string, doc_name string, evidence {ev}")
    assert [(r.document_id, r.page) for r in M.gold_pages(ok).collect()] == [("B", 1)]
    with pytest.raises(Exception, match="negative"):
        M.gold_pages(spark.createDataFrame([("x", "A", [("B", None, -1)])], f"case_id string, doc_name string, evidence {ev}")).collect()


def test_budget(spark):
    r = spark.createDataFrame([("q", i + 1, c) for i, c in enumerate((1500, 700, 100))], "query_id string, rank int, token_count int")
    assert [(x["rank"], x.used) for x in M.budget_prefix(r, 2000).collect()] == [(1, 1500)]


def test_paired_and_bootstrap(spark):
    rows = [(i, c, float(v)) for i in range(40) for c, v in (("a", i), ("b", i + (1 if i % 2 else 0)))]
    p = M.paired(spark.createDataFrame(rows, "case_id int, config string, value double"), "case_id", "config", "value", "a", "b")
    assert {r.change: r["count"] for r in p.groupBy("change").count().collect()} == {"improved": 20, "unchanged": 20}
    b = M.bootstrap(p.withColumn("g", F.lit("x")), "g", resamples=2000).first()
    assert b.n == 40 and b.low < 0.5 < b.high and abs(b["mean"] - 0.5) < 1e-9


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 10)], "g string, v double")
    assert M.mean_percentiles(df, ["g"], "v").first().p95 == round(float(np.percentile([1, 2, 10], 95)), 6)


def test_locations(spark):
    ddl = "s struct<fmt: string, page: int, bbox: array<double>, paragraph: int, table_no: int, sheet: string, cell_range: string>"
    rows = [(("pdf", 1, [0.0, 0.0, 1.0, 1.0], None, None, None, None),), (("docx", 2, None, 1, None, None, None),), (("pdf", None, None, None, None, None, None),), (("xlsx", None, None, None, None, "S", None),)]
    got = [r[0] for r in spark.createDataFrame(rows, ddl).select(V.location_violations(F.col("s"))).collect()]
    assert got == [[], ["page outside pdf"], ["pdf without page"], ["xlsx without sheet or range"]]


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, 5)], "k string, v int, loaded_at int")
    assert {(r.k, r.v) for r in V.latest(df, ["k"]).collect()} == {("a", 2), ("b", 3)}


def test_table_rows(spark):
    cells = spark.createDataFrame(
        [("d", "t", "a", 1, 1, 1, 1, "", None), ("d", "t", "b", 1, 2, 1, 2, "FY 2020", None), ("d", "t", "c", 2, 1, 1, 1, "Sales", None), ("d", "t", "e", 2, 2, 1, 1, "5", "0%"), ("d", "t", "f", 2, 3, 1, 1, None, None)],
        "document_id string, table_id string, cell_id string, row_no int, col_no int, row_span int, col_span int, text string, number_format string",
    )
    tabs = spark.createDataFrame([("t", [1])], "table_id string, header_rows array<int>")
    assert [r.row_text for r in T.render_rows(cells, tabs).collect()] == ["C1: Sales | C2 [2020]: 5 [format=0%]"]
    assert {(r.col_no, r.header) for r in T.column_headers(cells, tabs).collect()} == {(2, "FY 2020"), (3, "FY 2020")}
    assert T.preview(cells).where("row_no = 2").first().texts == ["Sales", "5", ""]


def test_year_table(spark):
    rows = [("d", 1, x0, y0, x1, y0 + 10, t) for y0, items in ((0.0, [(200.0, 230.0, "2022"), (300.0, 330.009, "2021")]), (12.0, [(10.0, 90.0, "Inventories"), (195.0, 230.0, "2,388"), (290.0, 330.0, "3,055")]), (24.009, [(10.0, 90.0, "Prepaid"), (195.0, 230.0, "8,358"), (290.0, 330.0, "6,906")]), (36.0, [(10.0, 90.0, "Liabilities"), (190.0, 230.0, "50,171"), (290.0, 330.0, "47,160")]), (48.0, [(10.0, 90.0, "Far off"), (160.0, 205.0, "1"), (290.0, 330.0, "2")])) for x0, x1, t in items]
    got = T.year_tables(spark.createDataFrame(rows, "document_id string, page int, x0 double, y0 double, x1 double, y1 double, text string"), ["document_id", "page"]).collect()
    assert {(r.label, r.year, r.value) for r in got if r.label == "Liabilities"} == {("Liabilities", "2022", "50,171"), ("Liabilities", "2021", "47,160")}
    assert len({r.label for r in got}) == 3


def test_year_table_with_nil(spark):
    body = (("Inventories", "2,388", "–"), ("Prepaid", "-", "6,906"), ("Liabilities", "50,171", "47,160"), ("12", "1", "2"))
    rows = [("d", 200.0, 0.0, 230.0, 10.0, "2022"), ("d", 300.0, 0.0, 330.0, 10.0, "2021")]
    for i, (label, a, b) in enumerate(body, 1):
        rows += [("d", 10.0, 12.0 * i, 90.0, 12.0 * i + 10, label), ("d", 195.0, 12.0 * i, 230.0, 12.0 * i + 10, a), ("d", 290.0, 12.0 * i, 330.0, 12.0 * i + 10, b)]
    got = T.year_tables(spark.createDataFrame(rows, "document_id string, x0 double, y0 double, x1 double, y1 double, text string"), ["document_id"]).collect()
    assert {(r.label, r.year): r.value for r in got} == {(n, y): v for n, a, b in body[:3] for y, v in (("2022", a), ("2021", b))}


def test_four_known_rows(spark):
    """Rows of a balance sheet, with currency signs apart from their figures, in jittered lines."""
    known = {"Inventories": ("2,388", "3,055"), "Prepaid expenses and other": ("8,358", "6,906"), "Total current assets": ("37,857", "36,728"), "Total current liabilities": ("50,171", "47,160")}
    rows = [("d", 300.0, 100.0, 322.0, 110.0, "2022"), ("d", 400.0, 100.009, 422.0, 110.0, "2021")]
    for i, (label, (a, b)) in enumerate(known.items(), 1):
        y = 100.0 + 14 * i
        rows += [("d", 20.0, y, 180.0, y + 10, label), ("d", 280.0, y + 0.009, 285.0, y + 10, "$"), ("d", 292.0, y, 322.0, y + 10, a), ("d", 392.0, y, 422.0, y + 10.009, b)]
    got = T.year_tables(spark.createDataFrame(rows, "document_id string, x0 double, y0 double, x1 double, y1 double, text string"), ["document_id"]).collect()
    assert {(r.label, r.year): r.value for r in got} == {(n, y): v for n, (a, b) in known.items() for y, v in (("2022", "$" + a), ("2021", b))}


def test_heading_paths(spark):
    rows = [("d", 1, 1, "A"), ("d", 2, None, "p"), ("d", 3, 2, "B"), ("d", 4, None, "p"), ("d", 5, 1, "C"), ("d", 6, None, "p")]
    got = T.heading_paths(spark.createDataFrame(rows, "document_id string, ordinal int, level int, text string")).orderBy("ordinal").collect()
    assert [r.heading_path for r in got] == [["A"], ["A"], ["A", "B"], ["A", "B"], ["C"], ["C"]]


def test_spans_and_boxes(spark):
    b = spark.createDataFrame([("t", "m", 0.0, 0.0, 20.0, 10.0), ("t", "a", 0.0, 10.0, 10.0, 20.0), ("t", "b", 10.0, 10.0, 20.0, 20.0)], "table_id string, cell_id string, x0 double, y0 double, x1 double, y1 double")
    assert {r.cell_id: (r.row_span, r.col_span) for r in T.grid_spans(b).collect()} == {"m": (1, 2), "a": (1, 1), "b": (1, 1)}
    assert T.bbox_union(spark.createDataFrame([Row(k=1, bbox=[1.0, 2.0, 3.0, 4.0]), Row(k=1, bbox=[0.0, 3.0, 2.0, 9.0])]), ["k"]).first().bbox == [0.0, 2.0, 3.0, 9.0]
    assert T.a1_slice("B2:D9", 2, 3) == "B3:D4" and T.column_letters(28) == "AB"


def test_evidence_usage_searches_once(spark, monkeypatch):
    from quillstone.operators import retrieval as R
    from quillstone.plans import retrieval_queries as P

    calls = []
    for name in ("dense_topk", "bm25_topk"):
        monkeypatch.setattr(R, name, lambda *a, f=getattr(R, name), **kw: (calls.append(1), f(*a, **kw))[1])
    assert P.evidence_usage(spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 2
