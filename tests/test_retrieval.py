"""BM25, dense, fusion, selection: the published worked examples and brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import retrieval as R


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string, embedding array<float>")


def questions(spark, rows):
    return spark.createDataFrame(rows, "query_id string, question string, qvec array<float>")


def ids(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_bm25_two_chunks(spark):
    c = chunks(spark, [("a", "china revenue", [1.0, 0.0]), ("b", "operating cash", [0.0, 1.0])])
    q = questions(spark, [("x", "China china", [1.0, 0.0]), ("y", "unknown", [1.0, 0.0]), ("z", "", [1.0, 0.0])])
    got = R.bm25_topk(q, c).collect()
    assert [(r.query_id, r.chunk_id, r["rank"]) for r in got] == [("x", "a", 1)]
    assert got[0].score > 0


def test_bm25_against_formula(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta eps".split()
    docs = {f"d{i:02d}": " ".join(rng.choices(words, k=rng.randrange(0, 9))) for i in range(30)}
    c = chunks(spark, [(k, t, [1.0]) for k, t in docs.items()])
    q = questions(spark, [("q", "alpha delta alpha", [1.0])])
    toks = {k: re.findall("[a-z0-9]+", t) for k, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)

    def score(t):
        s = 0
        for w in ("alpha", "delta"):
            df = sum(w in x for x in toks.values())
            tf = t.count(w)
            s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
        return s

    want = {k: round(score(t), 6) for k, t in toks.items() if score(t) > 0}
    got = {r.chunk_id: r.score for r in R.bm25_scores(q, c).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_empty_corpus(spark):
    c, q = chunks(spark, []), questions(spark, [("q", "a", [1.0])])
    assert R.bm25_topk(q, c).count() == 0 and R.dense_topk(q, c).count() == 0
    assert R.corpus_stats(c).first()["avgdl"] == 0
    assert R.Retriever(c).retrieve(q).count() == 0


def test_dense_order_and_bad_vectors(spark):
    c = chunks(spark, [("a", "", [1.0, 0.0]), ("b", "", [0.8, 0.6]), ("c", "", [0.6, 0.8]), ("n", "", None), ("z", "", [0.0, 0.0]), ("i", "", [float("nan"), 1.0])])
    q = questions(spark, [("q", "", [1.0, 0.0])])
    assert ids(R.dense_topk(q, c, 5).orderBy("rank"), "chunk_id", "rank") == [("a", 1), ("b", 2), ("c", 3)]


def test_dense_against_brute_force(spark):
    v = np.random.default_rng(0).normal(size=(200, 8)).astype("f4")
    c = chunks(spark, [(f"c{i:03d}", "", x.tolist()) for i, x in enumerate(v)])
    q = questions(spark, [(f"c{i:03d}", "", v[i].tolist()) for i in range(0, 200, 20)])
    got = {}
    for r in R.dense_topk(q, c, 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for k, lst in got.items():
        s = np.round(u @ u[int(k[1:])], 6)
        assert [x for _, x in sorted(lst)] == [f"c{i:03d}" for i in np.lexsort((np.arange(200), -s))[:7]]


def test_exclusion_refills_every_stage(spark):
    c = chunks(spark, [(str(i), "revenue " * (6 - i), [1.0, i / 10]) for i in range(6)])
    q = questions(spark, [("q", "revenue", [1.0, 0.0])])
    r = R.Retriever(c, candidate_k=2, top_k=2)
    gone = lambda *x: spark.createDataFrame([("q", i) for i in x], "query_id string, chunk_id string")
    for out, want in (((0, 1), {"2", "3"}), ((0, 1, 2, 3), {"4", "5"})):
        s = r.stages(q, gone(*map(str, out)))
        for stage in ("dense", "bm25", "fused", "selected"):
            assert {x.chunk_id for x in s[stage].collect()} == want
    assert r.retrieve(q, gone(*map(str, range(6)))).count() == 0


def test_rrf_worked_example(spark):
    rank = "query_id string, chunk_id string, rank int"
    d = spark.createDataFrame([("q", "a", 18), ("q", "b", 2)], rank)
    b = spark.createDataFrame([("q", "a", 1), ("q", "b", 4), ("q", "c", 9)], rank)
    got = R.rrf(d, b).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"]
    assert round(got[0].rrf_score, 6) == 0.031754 and round(got[1].rrf_score, 6) == 0.029214
    assert got[2].dense_rank is None


@pytest.mark.parametrize("t,k,want", [(0.1, 4, [0.9, 0.1]), (0.95, 4, []), (None, 3, [0.9, 0.1, 0.09])])
def test_threshold(spark, t, k, want):
    c = spark.createDataFrame([("q", x, i + 1, s) for i, (x, s) in enumerate(zip("abcd", (0.9, 0.1, 0.09, 0.01)))], "query_id string, chunk_id string, rank int, s double")
    r = R.rerank(c, F.col("s"), 4)
    assert [x.rerank_score for x in R.threshold_select(r, t, k).orderBy("rank").collect()] == want


def test_rerank_rejects_nan(spark):
    c = spark.createDataFrame([("q", "a", 1, float("nan"))], "query_id string, chunk_id string, rank int, s double")
    with pytest.raises(Exception, match="finite"):
        R.rerank(c, F.col("s")).collect()


@pytest.mark.parametrize("w,k,t,want", [(0.6, 2, None, ["a", "c"]), (1.0, 2, None, ["a", "b"]), (0.6, 2, 0.85, ["a", "b"]), (0.6, 3, None, ["a", "c", "b"])])
def test_mmr(spark, w, k, t, want):
    c = spark.createDataFrame([("q", "a", 0.9, 1, [1.0, 0.0]), ("q", "b", 0.89, 2, [1.0, 0.0]), ("q", "c", 0.8, 3, [0.0, 1.0])], "query_id string, chunk_id string, rerank_score double, rank int, embedding array<float>")
    assert ids(R.mmr_select(c, w, k, t).orderBy("rank"), "chunk_id") == [(x,) for x in want]


@pytest.mark.parametrize("a", [(0, 5), (6, 5), (True, 5), (5, 5, -1), (5, 5, 60, math.inf)])
def test_limits(a):
    with pytest.raises(ValueError):
        R.check_limits(*a)


def shuffled_rows(spark):
    """Rows written to shuffles so far."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    none = sc._gateway.new_array(jvm.double, 0)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_bm25_shuffles_no_pairs(spark):
    c = chunks(spark, [(f"c{i:03d}", "revenue " * (1 + i % 7) + f"x{i % 5}", [1.0]) for i in range(400)])
    q = questions(spark, [(f"q{i:03d}", f"revenue x{i % 6} y{i}", [1.0]) for i in range(400)])
    want = {tuple(r) for r in R.ranked(R.bm25_scores(q, c), [F.desc("score"), F.asc("chunk_id")], 3).select("query_id", "chunk_id", "score", "rank").collect()}
    before = shuffled_rows(spark)
    got = R.bm25_topk(q, c, 3).select("query_id", "chunk_id", "score", "rank").collect()
    assert {tuple(r) for r in got} == want and len(got) == 1200
    # of 160,000 pairs: 3 rows a query and task, and linear tables beside them
    assert shuffled_rows(spark) - before < 3 * 400 * 16 + 5_000


def test_bm25_exclusion_and_ties_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    c = chunks(spark, [(f"c{i:02d}", "revenue cash" if i % 2 else "revenue", [1.0]) for i in range(40)]).repartition(5)
    q = questions(spark, [(f"q{i}", ["Cash, revenue", "revenue cash", "revenue", "none", ""][i % 5], [1.0]) for i in range(20)])
    gone = spark.createDataFrame([("q0", f"c{i:02d}") for i in range(1, 40, 2)] + [("q2", "c00")], "query_id string, chunk_id string")
    scores = R.bm25_scores(q, c).join(gone, ["query_id", "chunk_id"], "left_anti")
    want = {tuple(r) for r in R.ranked(scores, [F.desc("score"), F.asc("chunk_id")], 4).select("query_id", "chunk_id", "score", "rank").collect()}
    assert {tuple(r) for r in R.bm25_topk(q, c, 4, exclude=gone).select("query_id", "chunk_id", "score", "rank").collect()} == want


def test_best_is_exact_when_single_precision_is_not():
    rng = np.random.default_rng(3)
    m = rng.normal(size=(5, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    v = np.repeat(m, 60, axis=0) + rng.normal(size=(300, 16)) * 1e-4
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.array([f"{i:03d}" for i in rng.permutation(300)], object)
    best = R._Best(5, 7)
    for at in range(0, 300, 50):
        i, j = best.offered(m.astype("f4") @ v[at : at + 50].T.astype("f4"), 2.4e-7 * 20 + 1e-6)
        best.add(i, np.round(np.einsum("ij,ij->i", m[i], v[at + j]), 6), ids[at + j])
    i, at, _, c = best.rows()
    exact = np.round(m @ v.T, 6)
    assert list(i) == list(range(5))
    for n in range(5):
        assert list(c[at[n] : at[n + 1]]) == list(ids[np.lexsort((ids.astype(str), -exact[n]))[:7]])


def test_pools_search_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    c = chunks(spark, [(f"c{i:02d}", " ".join(rng.choice(["a", "b", "c", "d"], 6)), rng.normal(size=4).tolist()) for i in range(40)])
    q = questions(spark, [(f"q{i}", "a b", rng.normal(size=4).tolist()) for i in range(4)])
    cols = ["query_id", "chunk_id", "fused_rank", "rerank_score", "rank"]
    want = {n: sorted(map(tuple, R.Retriever(c, candidate_k=n).stages(q)["reranked"].select(*cols).collect())) for n in (5, 12)}
    calls = []
    searches = {name: getattr(R, name) for name in ("dense_topk", "bm25_topk")}
    for name, f in searches.items():
        monkeypatch.setattr(R, name, lambda *a, f=f, **kw: (calls.append(1), f(*a, **kw))[1])
    got = R.Retriever(c, candidate_k=12).pools(q, (5, 12))
    assert {n: sorted(map(tuple, r.select(*cols).collect())) for n, r in got.items()} == want and len(calls) == 2


def test_fusion_shuffles_once(spark):
    rank = "query_id string, chunk_id string, rank int"
    d, b = (spark.createDataFrame([(f"q{i % 3}", f"c{i}", 1 + i // 3) for i in range(at, at + 30)], rank) for at in (0, 15))
    out = R.rrf(d, b, top_k=7)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append(r["rank"])
    assert all(sorted(x) == list(range(1, 8)) for x in got.values()) and len(got) == 3


def test_corpus_shuffles_no_json(spark, tmp_path):
    from quillstone.plans.common import corpus

    row = lambda i: (f"c{i}", i, "d", 1, 2, '{"title": "t%d", "text": "x%d", "context_refs": ["r"]}' % (i, i), [1.0])
    chunks = spark.createDataFrame([row(i) for i in (0, 1, 1, 2)], "chunk_id string, position_no long, document_id string, page int, token_count int, chunk_json string, embedding array<float>")
    chunks.write.parquet(f"{tmp_path}/chunks.parquet")
    c = corpus(spark, str(tmp_path))
    assert ids(c.orderBy("chunk_id"), "chunk_id", "title", "text") == [(f"c{i}", f"t{i}", f"x{i}") for i in range(3)]
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert "chunk_json" in plan and "chunk_json" not in next(line for line in plan.splitlines() if "Aggregate" in line)


def test_written_tables_leave_no_shuffles(spark):
    import time

    from quillstone.session import FREE_SHUFFLES, materialize

    held = lambda: {f.getName() for f in list_of(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    list_of = lambda x: [x.apply(i) for i in range(x.size())]
    before, was = held(), spark.conf.get(FREE_SHUFFLES, "false")
    df = materialize(spark.range(10_000).repartition(3, "id").groupBy(F.col("id") % 7).count(), "counts")
    for _ in range(20):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and df.count() == 7 and spark.conf.get(FREE_SHUFFLES, "false") == was
