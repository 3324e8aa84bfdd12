"""The package's operators against brute force, round trips and edge cases."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import boilerplate, encoding, graph, mixing, neighbours, packing, split, visual
from quillstone.llm.tokens import with_tokens

VECTORS = "chunk_id string, embedding array<float>, id int, neighbour string, h1 long, vec string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "y") for i, v in rows], VECTORS)


# ---------------------------------------------------------------- 1


def brute(rows, k, least=-2.0):
    rows = {i: np.array(v, "f8") for i, v in rows if i is not None and v is not None and np.any(v) and np.all(np.isfinite(v))}
    ids = sorted(rows)
    m = np.array([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    s = m @ m.T
    out = {}
    for n, i in enumerate(ids):
        near = sorted(((-round(s[n, j], 9), ids[j]) for j in range(len(ids)) if j != n))[:k]
        out[i] = [(j, -c) for c, j in near if -c >= least]
    return out


def test_search_holds_one_tile_of_products(tmp_path, monkeypatch):
    """However many queries meet a leaf, their products with it take the room of one tile."""
    import tracemalloc

    import pandas as pd
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: type("One", (), {"partitionId": lambda self: 0})())
    n, dim = 16_000, 64
    v = np.random.default_rng(3).normal(size=(n, dim)) + 30  # in one place, so that most queries meet most leaves
    v[1] = v[0] + 1e-3
    rows = pd.DataFrame({"vec": list(v.astype("f4")), "isq": 1, "h1": np.arange(n), "h2": 0})
    block = next(neighbours._pack([], dim)(iter([rows])))
    (tmp_path / "block=0").mkdir()
    block.drop(columns="block").to_parquet(tmp_path / "block=0" / "0.parquet")
    search = neighbours._search(str(tmp_path), dim, 3, 2e-4, 0.99, [0], block["block_lo"][0], block["block_hi"][0])
    tracemalloc.start()
    found = pd.concat(search(iter([pd.DataFrame({"block": [0], "part": [0], "of": [1]})])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(0, 1), (1, 0)} == set(zip(found["h1"], found["nh1"]))
    assert peak < 36e6  # a leaf's products with all queries are 33 MB, the vectors 4 MB


def test_chi2():
    assert neighbours.chi2_quantile(0.99, 8) == pytest.approx(20.09, abs=0.01)
    assert neighbours.chi2_quantile(0.9, 16) == pytest.approx(23.54, abs=0.01)


def test_most_similar_recall_and_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(500, 24))
    rows = [(f"c{i:04d}", v.tolist()) for i, v in enumerate(base)]
    rows += [(f"d{i:04d}", (v + 0.15 * rng.normal(size=24)).tolist()) for i, v in enumerate(base[:150])]
    rows += [(f"e{i:04d}", (3 * v).tolist()) for i, v in enumerate(base[:40])] + [(f"f{i:04d}", v.tolist()) for i, v in enumerate(base[:40])]
    rows += rows[:5]
    df = vectors(spark, rows)
    want = brute(dict(rows).items(), 10)
    got = {}
    for r in neighbours.most_similar(df, k=10).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour, r.cosine))
    hit = sum(sum(c >= want[i][-1][1] - 1e-6 for _, _, c in got.get(i, [])) for i in want)
    assert hit / sum(map(len, want.values())) >= 0.9
    assert all([r for r, _, _ in sorted(x)] == list(range(1, len(x) + 1)) for x in got.values())
    pairs = {(r.a, r.b) for r in neighbours.mutual_pairs(neighbours.most_similar(df, k=10, min_cosine=0.9)).collect()}
    close = {i: {j for j, c in v if c >= 0.9} for i, v in want.items()}
    assert pairs == {(i, j) for i in close for j in close[i] if i < j and i in close[j]}


def test_most_similar_edges(spark):
    one = [1.0, 0.0, 0.0]
    rows = [("a", one), ("b", one), ("c", one), ("d", [0.0, 1.0, 0.0]), ("n", None), ("z", [0.0] * 3), ("w", [math.nan, 1.0, 0.0]), ("e", []), ("s", [1.0]), (None, one), ("a", one)]
    got = {(r.id, r["rank"]): (r.neighbour, round(r.cosine, 6)) for r in neighbours.most_similar(vectors(spark, rows), k=2).collect()}
    assert got == {("a", 1): ("b", 1), ("a", 2): ("c", 1), ("b", 1): ("a", 1), ("b", 2): ("c", 1), ("c", 1): ("a", 1), ("c", 2): ("b", 1), ("d", 1): ("a", 0), ("d", 2): ("b", 0)}
    assert neighbours.most_similar(vectors(spark, rows[:1]).limit(0)).count() == 0
    assert neighbours.most_similar(vectors(spark, [("n", None)])).count() == 0
    asked = neighbours.most_similar(vectors(spark, rows), k=2, query=F.col("chunk_id") == "d").collect()
    assert {r.id for r in asked} == {"d"}


def test_hot_group_of_copies(spark):
    rows = [(f"c{i:03d}", [1.0, 2.0]) for i in range(60)] + [("x", [2.0, 1.0])]
    pairs = neighbours.mutual_pairs(neighbours.most_similar(vectors(spark, rows), k=10, min_cosine=0.9))
    assert pairs.count() == 55  # the eleven smallest ids


def test_copies_and_others(spark):
    """Hot copies are joined by broadcast, the rest as usual: both as brute force has it."""
    rng = np.random.default_rng(9)
    rows = [(f"h{i:03d}", [1.0, 2.0, 3.0]) for i in range(90)] + [(f"r{i:03d}", rng.normal(size=3).tolist()) for i in range(120)]
    got = {}
    for r in neighbours.most_similar(vectors(spark, rows), k=5).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour, r.cosine))
    want = brute(rows, 5)
    assert set(got) == set(want)
    assert [x[1] for x in sorted(got["h050"])] == [j for j, _ in want["h050"]] == [f"h{i:03d}" for i in range(5)]
    hit = sum(sum(c >= want[i][-1][1] - 1e-6 for _, _, c in got[i]) for i in want)
    assert hit / (5 * len(want)) >= 0.9


# ---------------------------------------------------------------- 2


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab ,.\n。é", max_size=400), st.integers(8, 60), st.integers(0, 7))
def test_pieces(text, limit, overlap):
    got = split.pieces(text, limit, overlap)
    if not text:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(0 < b - a <= limit for a, b in got)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a <= c <= b < d and b - c <= overlap
    s = split.boundary_strengths(text)
    assert all(s[b] or not s[a + 1 : b].any() for a, b in [(got[i - 1][1] if i else 0, got[i][1]) for i in range(len(got) - 1)])


def test_strongest_boundary_near_the_middle():
    t = "a" * 40 + ". " + "b" * 30 + "\n\n" + "c" * 40
    assert split.cut_points(t, 80) == [74]


def test_split_frame(spark):
    long = ("word " * 500 + "\n\n") * 40
    df = spark.createDataFrame([("k", "a", "short", 1), ("k", "b", long, 2), ("k", "c", "", 3), ("k", "d", None, 4), ("k", "a", "short", 5), (None, "e", "x" * 4500, 6)], "kind string, id string, text string, piece int")
    got = split.split_oversized(df, ["kind", "id"]).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.id, r.piece_no)):
        by.setdefault(r.id, []).append(r)
    assert set(by) == {"a", "b", "e"} and len(by["a"]) == 1
    assert all(len(r.piece) <= 2000 and r.piece == long[r.start : r.end] for r in by["b"])
    covered = 0
    for r in by["b"]:
        assert r.start <= covered
        covered = r.end
    assert covered == len(long)
    assert split.split_oversized(df.limit(0), ["id"]).count() == 0


def test_json_text(spark):
    rows = ['{"text": "ab"}', '{"text": "ab', '{"text": null}', "{}", None, "[1]"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string")
    assert [r[0] for r in df.orderBy("i").select(split.json_text("j")).collect()] == ["ab", None, None, None, None, None]


# ---------------------------------------------------------------- 3

ELEMENT = "document_id string, element_id string, ordinal int, text string, page int, g string, h string, item string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], ELEMENT)


def test_repeated_lines(spark):
    rows = []
    for p in range(1, 7):
        rows.append(("d", f"e{p}", p, f"Annual Report 20{p:02d}\nPage {p} of many pages\nbody number {'x' * p} here", p))
        rows.append(("d", f"f{p}", 10 + p, "short 1" if p % 2 else None, p))
    rows += [("d", "e1", 1, rows[0][3], 1), ("d", "n", 99, "ANNUAL  report 7", None), (None, "q", 1, "Annual Report 1", 1), ("x", "y", 1, "Annual Report 1", 1), ("d", "z", 50, "annual report 12345\n", 6)]
    df = pages(spark, rows)
    found, blocks = boilerplate.repeated_lines(df, page="page")
    got = {(r.element_id, r.line_no) for r in found.collect()}
    assert got == {(f"e{p}", n) for p in range(1, 7) for n in (1, 2)} | {("z", 1)}
    assert blocks.select("block").distinct().count() == 1 and blocks.count() == 2
    clean = {r.element_id: r.text for r in boilerplate.without_lines(df.dropDuplicates(["element_id"]), found, ["element_id"]).collect()}
    assert clean["e3"] == "body number xxx here" and clean["z"] == "" and clean["f2"] is None and clean["n"] == "ANNUAL  report 7"
    page = spark.createDataFrame([("d", 1, "x\nAnnual report 1\ny"), ("x", 1, "Annual report 1")], "document_id string, page int, text string")
    assert [(r.document_id, r.page, r.line_no) for r in boilerplate.page_lines(page, blocks).collect()] == [("d", 1, 2)]
    assert boilerplate.repeated_lines(df.limit(0), page="page")[0].count() == 0


def test_line_key(spark):
    rows = ["Seite 1  von 20", "SEITE 12 von 3 ", "seite x von 3", "straße", "STRASSE"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    k = [r[0] for r in df.orderBy("i").select(boilerplate.line_key(F.col("t"))).collect()]
    assert k[0] == k[1] != k[2] and k[3] == k[4]


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("q", "q"), (None, "z")] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)], "a string, b string")
    got = {r.node: r.component for r in graph.connected_components(e).collect()}
    assert {got[x] for x in "abcd"} == {"a"} and got["y"] == "x" and "q" not in got
    assert {v for k, v in got.items() if k.startswith("n")} == {"n000"}
    assert graph.connected_components(e.limit(0)).count() == 0


# ---------------------------------------------------------------- 5


def test_has_variant():
    assert all(map(visual.has_variant, ["Ａ", "a­", "a b", "é", "ﬂ", "a‑b", "аb"]))
    assert not any(map(visual.has_variant, ["рынок m² ½ ™ “x”\n", "", "plain", "Ωmega"[1:]]))


def test_one_form(spark):
    rows = [("a", "Net sales"), ("b", "Ｎｅｔ sales"), ("c", "Net sales"), ("d", "Nеt sales"), ("e", "Café"), ("f", "Café"), ("g", "NET SALES"), ("h", None), ("i", ""), ("a", "Net sales"), ("j", "x​y"), ("k", "m² ™ – “q”\n"), ("l", "рост"), ("m", "z" * 100_000)]
    df = spark.createDataFrame([(k, t, "v", 1) for k, t in rows], "id string, text string, value string, n int")
    got = {r.id: (r.canonical, r.has_variant) for r in visual.one_form(df, ["id"]).collect()}
    assert len(got) == 13
    assert {got[x][0] for x in "abcd"} == {"Net sales"} and [got[x][1] for x in "abcd"] == [False, True, True, True]
    assert got["e"] == ("Café", True) and got["f"] == ("Café", False) and got["g"] == ("NET SALES", False)
    assert got["h"] == (None, False) and got["i"] == ("", False) and got["j"] == ("xy", True) and not got["k"][1] and not got["l"][1]
    assert visual.one_form(df.limit(0), ["id"]).count() == 0


# ---------------------------------------------------------------- 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 250), max_size=60), st.integers(10, 100))
def test_pack_group(sizes, capacity):
    rows = packing.pack_group(list(range(len(sizes))), np.array(sizes, "i8"), capacity)
    fill, per = {}, {}
    for k, c, _, t, start in rows:
        fill[c] = fill.get(c, 0) + t
        per.setdefault(k, []).append((start, t))
    assert all(f <= capacity for f in fill.values())
    for k, s in enumerate(sizes):
        parts = sorted(per[k])
        assert sum(t for _, t in parts) == s and (len(parts) == 1 or s > capacity)
        assert parts[0][0] == 0 and all(a + t == b for (a, t), (b, _) in zip(parts, parts[1:]))
    places = {}
    for _, c, p, _, _ in rows:
        places.setdefault(c, []).append(p)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())


def test_local_search_empties_bins():
    rng = np.random.default_rng(5)
    size = rng.integers(150, 520, 400)
    where, free = packing.best_fit_decreasing(size, 1000)
    w2, f2 = packing.local_search(size, where, free, 1000)
    assert len(np.unique(w2)) <= len(np.unique(where))
    for b in np.unique(w2):
        assert size[w2 == b].sum() == 1000 - f2[b] <= 1000
    # 6+3, 4+4+1 and 2: the 2 goes in for the 1, which then fills the first
    size = np.array([6, 3, 4, 4, 1, 2])
    assert len(np.unique(packing.local_search(size, np.array([0, 0, 1, 1, 1, 2]), np.array([1, 1, 8]), 10)[0])) == 2


@pytest.mark.parametrize("seed,least", [(159, 88), (453, 25), (990, 28), (1124, 33), (1753, 34), (2423, 22)])
def test_local_search_tries_every_item(seed, least):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, int(rng.integers(5, 60)), int(rng.integers(60, 400)))
    where, free = packing.local_search(size, *packing.best_fit_decreasing(size, 100), 100)
    assert len(np.unique(where)) == least == -(-size.sum() // 100)
    assert all(size[where == b].sum() == 100 - free[b] <= 100 for b in np.unique(where))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60))
def test_local_search_leaves_no_improvement(sizes):
    size = np.array(sizes)
    where, free = packing.local_search(size, np.arange(len(size)), np.full(len(size), 30) - size, 30)
    assert all(size[where == b].sum() == 30 - free[b] <= 30 for b in range(len(free)))
    used = sorted(set(where.tolist()))
    if len(used) == -(-size.sum() // 30):
        return
    fill = {b: int(size[where == b].sum()) for b in used}
    for a in used:
        mine = [int(s) for s in size[where == a]]
        outs = [(s,) for s in mine] + [(s, t) for i, s in enumerate(mine) for t in mine[i + 1 :]]
        for b in used:
            if b == a or 30 in (fill[a], fill[b]):
                continue
            for out in outs:
                for back in [0] * (len(out) == 1) + [int(s) for s in size[where == b]]:
                    d = sum(out) - back
                    assert not (d > 0 and fill[b] + d <= 30 and fill[b] + d > fill[a])


def test_containers(spark):
    rows = [(i, "one two three " * (1 + i % 7)) for i in range(200)] + [(900, "long text " * 3000), (901, None), (902, ""), (None, "x"), (3, "one two three " * 4)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, container int, key string")
    got = packing.fill_containers(df).collect()
    assert {r.doc_id for r in got} == {*range(200), 900}
    fill = {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r.tokens
    assert max(fill.values()) <= 1024 and len(fill) == -(-sum(fill.values()) // 1024)
    assert packing.fill_containers(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 7


def test_budgets():
    b = mixing.budgets(100, [("a", 0.5, 10), ("b", 0.25, 1000), ("c", 0.25, 1000), ("d", 0.0, 50)])
    assert b == {"a": 10, "b": 45, "c": 45, "d": 0}
    assert mixing.budgets(100, [("a", 1.0, 10)]) == {"a": 10}


def test_mix(spark):
    rows = [(i, "abc", "word " * (5 + i % 11)) for i in range(400)] + [(1000 + i, "rare", "word " * 20) for i in range(10)] + [(2000, "none", "w w w"), (2001, None, "w"), (2002, "abc", None), (2003, "abc", ""), (0, "abc", "word " * 5)]
    docs = spark.createDataFrame([(*r, 7, 1) for r in rows], "doc_id long, source string, text string, tokens int, h int")
    goal = spark.createDataFrame([("abc", 0.5, 2), ("rare", 0.5, 3), ("gone", 0.0, 1), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.draw_mix(docs, goal)
    c = chosen.collect()
    assert len({r.doc_id for r in c}) == len(c) and {r.source for r in c} == {"abc", "rare"}
    assert all(1 <= r.repeats <= (3 if r.source == "rare" else 2) for r in c)
    held = with_tokens(docs.dropDuplicates(["doc_id"]).select("doc_id", "text")).agg(F.sum("tokens")).first()[0]
    drawn = sum(r.tokens * r.repeats for r in c)
    assert abs(drawn - held) <= 30
    s = {r.source: r for r in shares.collect()}
    assert s["rare"].tokens_drawn == 3 * s["rare"].tokens_held and sum(r.actual_share for r in s.values()) == pytest.approx(1) and s["gone"].tokens_drawn == 0
    assert mixing.draw_mix(docs.limit(0), goal)[0].count() == 0 and mixing.draw_mix(docs, goal.limit(0))[1].count() == 0


def test_thresholds_are_nested(spark):
    df = spark.range(3000).select(F.lit("s").alias("source"), F.shiftrightunsigned(F.xxhash64("id"), 4).alias("h"), (F.col("id") % 9 + 1).alias("tokens"))
    total = df.agg(F.sum("tokens")).first()[0]
    last = 0
    for want in (0.2, 0.9):
        t = mixing.thresholds(df, {"s": total * want})["s"]
        got = df.where(F.col("h") < t).agg(F.sum("tokens")).first()[0]
        assert abs(got - total * want) <= 9 and t >= last
        last = t
    assert mixing.thresholds(df, {"s": total * 2})["s"] == 1 << 60


# ---------------------------------------------------------------- 8

CLEAN = {
    "fr": ["Le comité d’audit a différé l’écart d’acquisition après l’été, la société mère a relevé la clôture intermédiaire.", "Le siège a cédé les créances échues à périmètre constant, les stocks de pièces détachées."],
    "de": ["Der Vorstand prüfte die jährliche Ausschüttung, sämtliche Kreditlinien wegen gestörter Lieferwege und größten Mietverträge.", "Die Führungsebene veräußerte das übrige Ergebnis trotz höherer Löhne."],
    "ru": ["Совет директоров отложил долгосрочные займы несмотря на рост цен.", "Дочерняя компания раскрыла прочие доходы во втором полугодии."],
    "en": ["The company’s “other” income – € 12 million – was § 4 compliant.", "The leasing arm reviewed the café concession in Malmö."],
}


@pytest.fixture(scope="module")
def restorer():
    return encoding.Restorer(*encoding.learn({k: [f"{a} {b} {i}" for i in range(30) for a in v for b in v] for k, v in CLEAN.items()}))


CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp1251")]


def read_as(text, enc):
    """Bytes as decoders read them: what the encoding leaves open becomes a C1 control."""
    back = {b: c for c, b in encoding._bytes_of(enc).items()}
    return "".join(back.get(b, chr(b)) for b in text)


@pytest.mark.parametrize("right,wrong", CHAINS)
@pytest.mark.parametrize("lang", ["fr", "de", "en"])
def test_round_trip(restorer, right, wrong, lang):
    text = " ".join(CLEAN[lang])
    bad = read_as(text.encode(right), wrong)
    fixed, chains, gain = restorer.restore(bad)
    assert fixed == text and chains and gain > 0


@pytest.mark.parametrize("right,wrong", [("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp1252"), ("utf-8", "cp1252")])
def test_cyrillic(restorer, right, wrong):
    text = " ".join(CLEAN["ru"])
    assert restorer.restore(read_as(text.encode(right), wrong))[0] == text


def test_twice_and_in_places(restorer):
    a, b = CLEAN["fr"]
    twice = read_as(read_as(a.encode(), "cp1252").encode(), "cp1252")
    fixed, chains, _ = restorer.restore(f"{b}\n{twice}")
    assert fixed == f"{b}\n{a}" and "|" in chains[0]


@pytest.fixture(scope="module")
def chinese():
    zh = ["管理层扩大了租赁负债见附注59。", "董事会重新评估了应收账款为期156个月，第5页。", "仓储部门批准了资本支出约百分之350。"]
    return encoding.Restorer(*encoding.learn({"zh": [f"{i}\n{a}{b}" for i in range(30) for a in zh for b in zh]}))


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1"])
@pytest.mark.parametrize("text", ["管理层扩大了租赁负债见附注59。", "资本支出约百分之350。\n\n", "董事会重新评估了第5页。", "350。"])
def test_single_gbk_characters(chinese, wrong, text):
    bad = read_as(text.encode("gbk"), wrong)
    assert chinese.restore(bad)[0] == text
    assert chinese.restore(f"{bad}董事会重新评估了应收账款。")[0] == f"{text}董事会重新评估了应收账款。"


def test_short_gbk_run_beside_a_long_one(chinese):
    # the full stop after X is no known pair: it takes the long run's word for it
    bad = read_as("管理层扩大了租赁负债见附注59。\nABX。\n".encode("gbk"), "cp1252")
    assert chinese.restore(bad)[0] == "管理层扩大了租赁负债见附注59。\nABX。\n"
    assert chinese.restore("ABX¡£\n")[0] == "ABX¡£\n"


def test_clean_signs_beside_gbk(chinese):
    bad = read_as("管理层扩大了租赁负债".encode("gbk"), "cp1252")
    assert chinese.restore(f"Corvash®™ {bad}")[0] == "Corvash®™ 管理层扩大了租赁负债"


@pytest.mark.parametrize("text", ["", "plain", *(" ".join(v) for v in CLEAN.values()), "Caf&eacute; &amp; Co", "A DEMONSTRAÇÃO DO RESULTADO"])
def test_clean_stays(restorer, text):
    assert restorer.restore(text)[0] == text


def test_restore_frame(spark):
    bad = read_as(CLEAN["fr"][0].encode(), "cp1252")
    rows = [(i, f"{CLEAN[k][i % 2]} {i}", k) for i in range(40) for k in CLEAN] + [(500, bad, "fr"), (501, None, "fr"), (502, "", None), (503, "lost � here", "en"), (504, "a" * 200_000, None), (505, "é " * 50_000, "xx")]
    df = spark.createDataFrame([(*r, "k", False) for r in rows], "doc_id long, text string, lang string, key string, garbled boolean")
    got = {r.doc_id: r for r in encoding.restore(df).where("doc_id >= 500").collect()}
    assert len(got) == 6 and got[500].garbled and got[500].restored == CLEAN["fr"][0]
    assert got[501].restored is None and not got[501].garbled and not got[502].garbled and got[503].garbled and got[503].lost and not got[504].garbled
    assert encoding.restore(df.limit(0)).count() == 0


def test_restored_texts(spark):
    """p8's frame over several languages: every text comes back as written."""
    from test_encoding_languages import LEGACY, SENTENCES, read_as as read, texts

    rows, want = [], {}
    for n, lang in enumerate(sorted(SENTENCES)):
        for i, t in enumerate(texts(lang, 60, 1)):
            k = 1000 * n + i
            bad = {7: read(t.encode(), "cp1252"), 17: read(t.encode(), "cp1251"), 27: read(t.encode(LEGACY[lang]), "cp1252")}.get(i, t)
            rows.append((k, bad, lang))
            want[k] = (t, bad != t)
    got = {r.doc_id: (r.restored, r.garbled) for r in encoding.restore(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    wrong = {k for k in want if got[k] != want[k]}
    assert len(wrong) <= 0.05 * 3 * len(SENTENCES) and not any(want[k][0] != rows_[1] and got[k][0] not in (want[k][0], rows_[1]) for k, rows_ in zip(want, rows)), wrong


def test_all_labelled_documents_teach(spark):
    """A 65th language, a language's last documents and long ones count as any."""
    by = {f"l{i:02d}": [f"the café no. {i} {n}" for n in range(3)] for i in range(70)}
    by["xx"] = [f"the café {n} é{chr(33 + (n // 2 if n < 180 else 0))}" for n in range(400)] + [f"{n} " + "plain words. " * 900 + f"ö{n % 2}ö" for n in range(60)]
    rows = [(f"{lang}-{i}", t, lang) for lang, texts in by.items() for i, t in enumerate(texts)]
    got = encoding.fit(spark.createDataFrame(rows, "key string, text string, lang string").repartition(3), "key", "text", "lang")
    assert got == encoding.learn(by) and len(got[0]) == 71
    assert {f"é{chr(33 + n)}" for n in range(90)} | {"ö0", "ö1"} <= set(got[1])


def test_merged_dictionaries_hold_every_group():
    """What only one group's documents say is in the language's dictionary."""
    groups = [[f"the {a} {w} of quarter {n} was restated. " for n in range(60) for w in ("Umsatzerlöse", "Rückstellungen")] for a in ("first", "second", "third")]
    texts = [[f"{x}{a}" for x in g] for a, g in zip(("Öffentlichkeitsarbeit", "Grundstücksverkäufe", "Währungsschwankungen"), groups)]
    one = encoding._merged([encoding._trained(t) for t in texts])
    assert all(a.encode() in one for a in ("Öffentlichkeitsarbeit", "Grundstücksverkäufe", "Währungsschwankungen")) and len(one) <= encoding.DICT_BYTES
    assert encoding._merged([one]) == one
