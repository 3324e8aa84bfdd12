"""Evaluation grids and record operators."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.operators import experiments as G
from quillstone.operators import records as C


@pytest.fixture(scope="module")
def ranked(spark):
    rows = [("q", 1, "A", 1, 1500), ("q", 2, "A", 1, 700), ("q", 3, "B", 1, 100), ("p", 1, "C", 1, None)]
    return spark.createDataFrame(rows, "query_id string, rank int, document_id string, page int, token_count int")


@pytest.fixture(scope="module")
def gold(spark):
    return spark.createDataFrame([("q", "B", 1), ("q", "B", 2), ("p", "C", 1), ("none", "C", 1)], "query_id string, document_id string, page int")


def test_modes(ranked, gold):
    got = {(r.mode, r.query_id): r for r in G.score_modes(ranked, gold, (2, 5), 2000).collect()}
    assert len(got) == 9 and got["top5", "q"].mrr == pytest.approx(1 / 3, abs=1e-6) and got["top5", "q"].coverage == 0.5 and got["top2", "q"].hit == 0
    assert got["budget2000", "q"].unique_pages == 1 and got["budget2000", "p"].hit == 1 and got["top5", "none"].hit == 0
    m = {r.mode: r for r in G.means(G.score_modes(ranked, gold, (2, 5), 2000), ["mode"], ["hit"]).collect()}
    assert m["top5"].n == 3 and m["top5"].hit == pytest.approx(2 / 3, abs=1e-6)


def test_two_denominators(spark):
    df = spark.createDataFrame([("a", 1, 1.0, False), ("a", 0, None, True), ("a", 1, 0.0, False), ("b", 1, 0.5, True)], "g string, hit int, content double, manual boolean")
    got = {r.g: r for r in G.two_denominators(df, ["g"], ["hit"], ["content"], F.col("manual")).collect()}
    assert (got["a"].n, got["a"].n_scored, got["a"].content) == (3, 2, 0.5) and got["b"].content is None and got["b"].n_scored == 0


def test_prefix_and_selection_grids(spark):
    r = spark.createDataFrame([("q", c, s, i) for i, (c, s) in enumerate((("a", 0.9), ("b", 0.3), ("c", 0.05)), 1)], "query_id string, chunk_id string, rerank_score double, rank int")
    g = G.prefix_grid({2: r.where("rank <= 2"), 3: r}, (1, 3)).groupBy("candidates", "k").count()
    assert {(x.candidates, x.k): x["count"] for x in g.collect()} == {(2, 1): 1, (2, 3): 2, (3, 1): 1, (3, 3): 3}
    v = r.withColumn("embedding", F.when(F.col("chunk_id") == "c", F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))))
    s = G.selection_grid(v, (0.1, 0.95), (0.6,), 7).groupBy("config").count()
    assert {x.config: x["count"] for x in s.collect()} == {"top7": 3, "t=0.1": 2, "t=0.1 mmr=0.6": 2}


def test_quota_grid(spark):
    rows = [("s", n, r, c) for n, ids in ((1, "abc"), (2, "bde")) for r, c in enumerate(ids, 1)]
    got = G.quota_grid(spark.createDataFrame(rows, "session string, query_no int, rank int, chunk_id string"), (1, 2), (3,)).collect()
    assert {(r.queries, r.chunk_id, r.query_no) for r in got} == {(1, "a", 1), (1, "b", 1), (1, "c", 1), (2, "a", 1), (2, "b", 1)}


def test_evaluate_ids(spark, gold):
    chunks = spark.createDataFrame([("x", "B", 1, 10), ("y", "B", 9, 5)], "chunk_id string, document_id string, page int, token_count int")
    pick = lambda rows: spark.createDataFrame(rows, "query_id string, rank int, chunk_id string")
    got = {r.query_id: r for r in G.evaluate_ids(pick([("q", 1, "y"), ("q", 2, "x")]), chunks, gold, "query_id").collect()}
    assert got["q"].support_fraction == 0.5 and got["q"].tokens == 15 and got["q"].mrr == 0.5 and got["none"].chunks == 0 and len(got) == 3
    for bad in ([("q", 1, "x"), ("q", 2, "x")], [("q", 1, "?")]):
        with pytest.raises(Exception, match="chunk id"):
            G.evaluate_ids(pick(bad), chunks, gold, "query_id").collect()


def test_against_baseline(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0), (2, "b", 3.0), (3, "a", 1.0), (4, "b", None)], "case int, config string, score double")
    r = G.against_baseline(df, "case", "config", "a", ["score"]).collect()
    assert len(r) == 1 and (r[0].n, r[0].improved, r[0].unchanged, r[0].worse, r[0].delta) == (2, 1, 1, 0, 0.5)


def test_rubric_and_reachability(spark):
    unit = lambda p, n: json.dumps({"anchors": [{"phrases": [p]}, {"number": n}], "max_span": 60, "values_after_label": True})
    u = spark.createDataFrame([("d", "u", unit("Capital spending", "4625")), ("d", "w", unit("Dividends", "7"))], "document_id string, unit_id string, unit string")
    pages = spark.createDataFrame([("d", 1, "Capital spending (4,625) and dividends 7"), ("d", 2, "x"), ("d", 3, "CAPITAL-spending 4 625"), ("e", 1, "Dividends 7"), ("d", 4, None)], "document_id string, page int, text string")
    chunks = spark.createDataFrame([("d", 1, "a", "Capital spending"), ("d", 1, "b", "(4,625) and dividends 7")], "document_id string, page int, chunk_id string, text string")
    assert {r.unit_id: r.pages for r in G.rubric(u, pages).collect()} == {"u": [1, 3], "w": [1]}
    assert {(r.unit_id, r.in_page, r.in_chunk) for r in G.reachability(u, pages, chunks).collect()} == {("u", True, False), ("w", True, True)}
    with pytest.raises(Exception, match="no page"):
        G.rubric(u, pages.where("page = 3")).collect()


def test_adaptive_rounds(spark):
    rows = [("s", n, r, f"{n}{r}", 0.9 if n == 1 else 5.0) for n in (1, 2) for r in (1, 2, 3)] + [("t", n, r, f"{n}{r}", 0.1) for n in (1, 2) for r in (1, 2, 3)] + [("u", 2, 1, "21", 5.0)]
    got = {}
    for r in G.adaptive_rounds(spark.createDataFrame(rows, "session string, query_no int, rank int, chunk_id string, score double"), F.max("score") >= 0.5, 3).collect():
        got.setdefault((r.config, r.session, r.searches), set()).add(r.chunk_id)
    two = {"11", "12", "21"}
    assert got == {("one", "s", 1): {"11", "12", "13"}, ("one", "t", 1): {"11", "12", "13"}, ("two", "s", 2): two, ("two", "t", 2): two, ("two", "u", 2): {"21"}, ("adaptive", "s", 1): {"11", "12", "13"}, ("adaptive", "t", 2): two, ("adaptive", "u", 2): {"21"}}


def test_chunkings(spark):
    pages = spark.createDataFrame([("D", 1, "alpha beta gamma.\n\ndelta china"), ("D", 2, "other words here")], "document_id string, page int, text string")
    q = spark.createDataFrame([("q", "china")], "query_id string, question string")
    gold = spark.createDataFrame([("q", "D", 1)], "query_id string, document_id string, page int")
    got = {r.config: r for r in G.score_chunkings(G.window_chunkings(pages, [(2, 0)]) | G.paragraph_chunkings(pages, [3]), q, gold).collect()}
    assert got["2/0"].n_chunks == 5 and got["paragraphs 3"].n_chunks == 3 and all(r.hits == 1 and r.mrr == 1 and r.n_words == 8 for r in got.values())


def test_records(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b"), (1, "b")], "position_no int, chunk_id string")
    b = spark.createDataFrame([(0, "a"), (1, "c")], "position_no int, chunk_id string")
    assert {(r.chunk_id, r.side, r.times) for r in C.symmetric_difference(a, b).collect()} == {("b", "left", 2), ("c", "right", 1)} and C.symmetric_difference(a, a).count() == 0
    assert C.zip_by_position(a.distinct(), a.distinct().withColumn("v", F.lit(1))).where("v = 1").count() == 2
    for bad in (b, a.limit(1)):
        with pytest.raises(Exception, match="position"):
            C.zip_by_position(a.distinct(), bad).collect()
    assert spark.range(1).select(C.target_question(F.lit("Why?"), F.lit("ACME_2020"))).first()[0] == "Why?\nTarget report: ACME_2020.pdf"


def test_reading_order_and_page_elements(spark):
    ddl = "document_id string, page int, x0 double, y0 double, x1 double, y1 double, text string"
    lines = spark.createDataFrame([("d", 1, 0.0, 50.0, 9.0, 60.0, "below"), ("d", 1, 20.0, 0.0, 29.0, 9.0, "right"), ("d", 1, 0.0, 0.0, 9.0, 9.0, "left"), ("d", 1, 2.0, 22.0, 8.0, 28.0, "in the table"), ("d", 1, 0.0, 90.0, 9.0, 99.0, " ")], ddl)
    t = spark.createDataFrame([("d", 1, 1, 0.0, 20.0, 30.0, 40.0)], "document_id string, page int, table_no int, x0 double, y0 double, x1 double, y1 double")
    got = C.page_elements(lines, t, ["document_id", "page"]).orderBy("reading_no").collect()
    assert [(r.kind, r.text) for r in got] == [("paragraph", "left"), ("paragraph", "right"), ("table", None), ("paragraph", "below")]
    e = lines.select("document_id", "page", F.array("x0", "y0").alias("bbox"), F.col("y0").alias("ordinal"), "text").unionByName(lines.limit(1).select("document_id", "page", F.lit(None).cast("array<double>").alias("bbox"), F.lit(-1.0).alias("ordinal"), F.lit("no box").alias("text")))
    assert [r.text for r in C.reading_order(e).orderBy("reading_no").collect()] == ["left", "right", "in the table", "below", " ", "no box"]


def test_chunkings_shuffle_no_pairs(spark):
    from test_retrieval import shuffled_rows

    c = spark.createDataFrame([(f"c{i:03d}", "d", i, 2, f"revenue x{i}") for i in range(400)], "chunk_id string, document_id string, page int, n_words int, text string")
    q = spark.createDataFrame([(f"q{i:03d}", f"revenue x{i}") for i in range(400)], "query_id string, question string")
    gold = q.select("query_id", F.lit("d").alias("document_id"), F.substring("query_id", 2, 3).cast("int").alias("page"))
    before = shuffled_rows(spark)
    r = G.score_chunkings({"a": c}, q, gold).collect()[0]
    assert (r.n_chunks, r.n_words, r.questions, r.hits, r.mrr) == (400, 800, 400, 400, 1.0)
    assert shuffled_rows(spark) - before < 40_000  # of 160,000 pairs


def test_selection_grid_writes_no_reranked_list(spark, data, monkeypatch):
    from quillstone.operators import retrieval as R
    from quillstone.plans import grid_queries
    from quillstone.session import materialize

    written = []
    for where in (grid_queries, R):
        monkeypatch.setattr(where, "materialize", lambda df, name: (written.append(name), materialize(df, name))[1])
    assert {r.config for r in grid_queries.selection_grid(spark, data).collect()} == {"top7", "t=0.1", "t=0.3", "t=0.5"}
    assert "dense" in written and "reranked" not in written


@pytest.mark.parametrize("name", ["adaptive_query_grid", "batch_query_grid", "citation_check", "context_assembly"])
def test_searches_are_written_once(spark, data, name):
    """What follows the searches reads their written lists, so none is made again and their shuffles are gone."""
    import __spark_entry__

    assert "MapIn" not in __spark_entry__.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()


def test_chunkings_are_written_once(spark, monkeypatch):
    """A way of cutting is written with its tokens; neither its texts nor the tokens apart are written."""
    from quillstone.operators import retrieval as R

    written = []
    for module in (G, R):
        real = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, real=real: written.append((name, df.columns)) or real(df, name))
    pages = spark.createDataFrame([("d", 1, "a b c d"), ("d", 2, "c c e")], "document_id string, page int, text string")
    q = spark.createDataFrame([("q", "e")], "query_id string, question string")
    gold = spark.createDataFrame([("q", "d", 2)], "query_id string, document_id string, page int")
    r = G.score_chunkings(G.window_chunkings(pages, [(2, 0), (2, 1)]), q, gold).collect()
    assert {(x.config, x.n_chunks, x.n_words, x.questions, x.hits, x.mrr) for x in r} == {("2/0", 4, 7, 1, 1, 1.0), ("2/1", 5, 10, 1, 1, 1.0)}
    assert sorted(n for n, _ in written) == ["asked", "asked", "chunking", "chunking"]
    assert not any("text" in c for _, c in written)
