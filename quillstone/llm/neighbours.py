"""Most similar vectors for every vector.

Method: unit vectors are projected on ``M`` random directions (a 2-stable,
orthonormalised Gaussian matrix scaled so that projected squared distances of a
pair at distance d follow about d^2 * chi2(M)).  A kd-tree over the first
``TREE_DIMS`` projections orders the collection: its upper levels come from a
bounded sample, its lower levels are exact medians inside a block.  A query
visits leaves in order of projected distance; in each it verifies by exact
cosine the points whose projected distance passes the chi-square test against
the query's current k-th distance, and it stops visiting once the test says no
unseen leaf can hold a nearer point with probability above ``1 - p_stop``.

Distribution: rows with bit-identical vectors are folded into one representative
first (partial aggregation), so a hot group of copies is one point.  The
representatives are written as blocks of at most ``BLOCK`` rows into the shared
folder; a task owns the queries of one block and streams the others past them,
so no task holds more than two blocks and nothing is shuffled per pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import remove_dir, work_dir

M = 16  #: projections
TREE_DIMS = 6  #: of these, the tree's dimensions
LEAF = 512  #: most rows of a leaf
BLOCK = 32_768  #: most rows of a block
TILE = 512  #: queries tested against a leaf at a time, so that their products stay in the cache
SAMPLE = 65_536  #: bound of the sample the tree's upper levels are fitted on
HOT = 100  #: a vector whose copies are more than 1/HOT of the rows is hot, so there are fewer than HOT
SEED = 20_240_607

PAIR_SCHEMA = "h1 bigint, h2 bigint, nh1 bigint, nh2 bigint, cosine double"
BLOCK_SCHEMA = "block int, n int, h bigint, keys binary, isq binary, vec binary, proj binary, leaves array<int>, lo binary, hi binary, block_lo binary, block_hi binary"


def chi2_cdf(x: float, m: int) -> float:
    """Regularised lower incomplete gamma P(m/2, x/2) by its power series."""
    if x <= 0:
        return 0.0
    a, y = m / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-14:
        n += 1
        term *= y / n
        total += term
    return min(1.0, total * math.exp(-y + a * math.log(y) - math.lgamma(a)))


def chi2_quantile(p: float, m: int) -> float:
    """Smallest x with ``chi2_cdf(x, m) >= p`` by bisection."""
    lo, hi = 0.0, 10.0 * m + 100
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


def projection(dim: int) -> np.ndarray:
    """dim x M orthonormal columns times sqrt(dim); M shrinks to dim for short vectors."""
    m = min(M, dim)
    q = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, m)))[0]
    return (q * math.sqrt(dim)).astype("f4")


def _split(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Index arrays of the leaves of an exact kd-tree with median splits."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        ix = todo.pop()
        if len(ix) <= most:
            out.append(ix)
            continue
        x = points[ix]
        d = int(np.argmax(x.var(0)))
        order = np.argsort(x[:, d], kind="stable")
        half = len(ix) // 2
        todo += [ix[order[half:]], ix[order[:half]]]
    return out


def _fit_tree(points: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Upper tree as nodes (dimension, threshold, left, right); a child < 0 is cell ``-child-1``.  Cells are numbered from left to right."""
    nodes: list[list] = []
    count = 0

    def grow(ix: np.ndarray, want: int) -> int:
        nonlocal count
        x = points[ix]
        if want <= 1 or len(ix) < 4 or not (spread := x.var(0)).max() > 0:
            count += 1
            return -count
        d = int(np.argmax(spread))
        cut = float(np.median(x[:, d]))
        left = x[:, d] <= cut
        if left.all():
            left = x[:, d] < cut
        at = len(nodes)
        nodes.append([d, cut, 0, 0])
        nodes[at][2] = grow(ix[left], want // 2)
        nodes[at][3] = grow(ix[~left], want - want // 2)
        return at

    grow(np.arange(len(points)), cells)
    return [tuple(n) for n in nodes]


def _cells(tree: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    """The cell of every point."""
    out = np.zeros(len(points), "i4")
    todo = [(0, np.arange(len(points)))] if tree else []
    while todo:
        at, ix = todo.pop()
        if at < 0:
            out[ix] = -at - 1
            continue
        d, cut, left, right = tree[at]
        go = points[ix, d] <= cut
        todo += [(left, ix[go]), (right, ix[~go])]
    return out


def _unit(vectors: pd.Series, dim: int) -> np.ndarray:
    v = np.stack(vectors.to_numpy()).astype("f8") if len(vectors) else np.zeros((0, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("f4")


def usable(vec: Column) -> Column:
    """Neither null, empty nor all zero, and every component finite."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & ok & F.exists(vec, lambda x: x != 0)


class _Blocks:
    """Reads packed blocks from the shared folder, from any executor."""

    def __init__(self, path: str):
        import pyarrow.fs as fs

        self.fs, self.root = fs.FileSystem.from_uri(path)

    def read(self, block: int, columns: list[str]) -> dict:
        import pyarrow.dataset as ds

        t = ds.dataset(f"{self.root}/block={block}", filesystem=self.fs, format="parquet").to_table(columns=columns)
        return {c: t.column(c)[0].as_py() for c in columns}


def _pack(tree, dim: int):
    """Rows sorted by cell -> packed blocks whose rows are ordered by the leaves of a local kd-tree."""

    def pack(batches):
        from pyspark import TaskContext

        proj = projection(dim)
        at, seq, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def emit(pdf: pd.DataFrame):
            nonlocal seq
            v = _unit(pdf["vec"], dim)
            p = v @ proj
            t = p[:, :TREE_DIMS]
            leaves = _split(t, LEAF)
            order = np.concatenate(leaves)
            lo, hi = np.stack([t[i].min(0) for i in leaves]), np.stack([t[i].max(0) for i in leaves])
            keys = pdf[["h1", "h2"]].to_numpy("i8")[order]
            seq += 1
            return pd.DataFrame([{
                "block": at * 10_000 + seq - 1, "n": len(pdf), "h": int(pdf["isq"].sum()), "keys": keys.tobytes(),
                "isq": pdf["isq"].to_numpy("u1")[order].tobytes(), "vec": v[order].tobytes(), "proj": p[order].tobytes(),
                "leaves": np.array([len(i) for i in leaves], "i4"), "lo": lo.astype("f4").tobytes(), "hi": hi.astype("f4").tobytes(),
                "block_lo": lo.min(0).astype("f4").tobytes(), "block_hi": hi.max(0).astype("f4").tobytes(),
            }])

        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            while rows >= BLOCK:
                whole = pd.concat(held, ignore_index=True)
                yield emit(whole.iloc[:BLOCK].reset_index(drop=True))
                held = [whole.iloc[BLOCK:].reset_index(drop=True)]
                rows = len(held[0])
        if rows:
            yield emit(pd.concat(held, ignore_index=True))

    return pack


def _search(path: str, dim: int, k: int, d2_most: float, p_stop: float, blocks: list[int], los: bytes, his: bytes):
    """Queries of a block against all blocks; see the module's head."""

    def search(batches):
        store = _Blocks(path)
        m, td = min(M, dim), min(TREE_DIMS, dim)
        quant, tree_quant = chi2_quantile(p_stop, m), chi2_quantile(p_stop, td)
        box_lo, box_hi = np.frombuffer(los, "f4").reshape(-1, td), np.frombuffer(his, "f4").reshape(-1, td)
        products, tests = np.empty(TILE * LEAF, "f4"), np.empty(TILE * LEAF, bool)
        for pdf in batches:
            for qb, part, of in zip(pdf["block"], pdf["part"], pdf["of"]):
                b = store.read(int(qb), ["keys", "isq", "vec", "proj"])
                isq = np.frombuffer(b["isq"], "u1").astype(bool).copy()
                turn = np.arange(len(isq)) * of // len(isq)  # runs of neighbouring leaves
                isq &= turn == part
                qkey = np.frombuffer(b["keys"], "i8").reshape(-1, 2)[isq]
                qv = np.frombuffer(b["vec"], "f4").reshape(-1, dim)[isq]
                qp = np.frombuffer(b["proj"], "f4").reshape(-1, m)[isq]
                if not len(qv):
                    continue
                q_half = 0.5 * np.einsum("ij,ij->i", qp, qp)
                qa, qt = np.concatenate([qp, np.ones((len(qp), 1), "f4")], 1), np.ascontiguousarray(qp[:, :td].T)
                best = np.full((len(qv), k), -2.0)
                best_key = np.zeros((len(qv), k, 2), "i8")
                d2 = np.full(len(qv), d2_most)
                # blocks in order of the projected distance between block boxes
                gap = np.maximum(0, np.maximum(box_lo - qp[:, :td].max(0), qp[:, :td].min(0) - box_hi))
                for j in np.argsort((gap**2).sum(1) + 1e-9 * (np.array(blocks) != qb), kind="stable"):
                    # the stopping test on whole blocks: no query's bound reaches this box
                    near = np.maximum(0, np.maximum(box_lo[j] - qp[:, :td], qp[:, :td] - box_hi[j]))
                    alive = (near**2).sum(1) <= d2 * tree_quant
                    if not alive.any():
                        continue
                    o = store.read(blocks[j], ["keys", "vec", "proj", "leaves", "lo", "hi"])
                    key = np.frombuffer(o["keys"], "i8").reshape(-1, 2)
                    v = np.frombuffer(o["vec"], "f4").reshape(-1, dim)
                    p = np.frombuffer(o["proj"], "f4").reshape(-1, m)
                    pa = np.concatenate([p, -0.5 * np.einsum("ij,ij->i", p, p)[:, None]], 1)
                    lo, hi = np.frombuffer(o["lo"], "f4").reshape(-1, td), np.frombuffer(o["hi"], "f4").reshape(-1, td)
                    start = np.concatenate([[0], np.cumsum(o["leaves"])])
                    act = np.flatnonzero(alive)
                    x, limit = qt[:, act], d2[act] * tree_quant
                    off, dist = np.empty((2, len(act)), "f4")
                    centre = qp[act, :td].mean(0)
                    for leaf in np.argsort((np.maximum(0, np.maximum(lo - centre, centre - hi)) ** 2).sum(1), kind="stable"):
                        dist[:] = 0
                        for c in range(td):
                            np.clip(x[c], lo[leaf, c], hi[leaf, c], out=off)
                            np.subtract(x[c], off, out=off)
                            np.multiply(off, off, out=off)
                            np.add(dist, off, out=dist)
                        met = act[dist <= limit]
                        s, e = start[leaf], start[leaf + 1]
                        moved = False
                        for f in range(0, len(met), TILE):
                            qi = met[f : f + TILE]
                            # projected squared distance <= quantile * d2, as one product
                            product = np.matmul(qa[qi], pa[s:e].T, out=products[: len(qi) * (e - s)].reshape(len(qi), e - s))
                            passed = np.greater_equal(product, (q_half[qi] - 0.5 * quant * d2[qi]).astype("f4")[:, None], out=tests[: product.size].reshape(product.shape))
                            hits = np.flatnonzero(passed)
                            if not len(hits):
                                continue
                            if len(hits) > 0.05 * passed.size:
                                full = qv[qi] @ v[s:e].T
                                full[~passed] = -2
                                keep = np.flatnonzero(full >= best[qi].min(1).astype("f4")[:, None] - 1e-6)
                            else:
                                keep = hits
                            rq, rp = qi[keep // (e - s)], s + keep % (e - s)
                            cos = np.empty(len(keep))
                            for c in range(0, len(keep), 65_536):
                                cos[c : c + 65_536] = np.einsum("ij,ij->i", qv[rq[c : c + 65_536]].astype("f8"), v[rp[c : c + 65_536]].astype("f8"))
                            kk = key[rp]
                            good = ((kk != qkey[rq]).any(1)) & (cos >= best[rq].min(1)) & (2 - 2 * cos <= d2_most + 1e-9)
                            if good.any():
                                _merge(best, best_key, rq[good], kk[good], cos[good])
                                u = np.unique(rq[good])
                                d2[u] = np.minimum(d2_most, 2 - 2 * best[u].min(1))
                                moved = True
                        if moved:
                            limit = d2[act] * tree_quant
                got = np.argwhere(best > -1.5)
                if len(got):
                    r, c = got[:, 0], got[:, 1]
                    yield pd.DataFrame({"h1": qkey[r, 0], "h2": qkey[r, 1], "nh1": best_key[r, c, 0], "nh2": best_key[r, c, 1], "cosine": best[r, c]})

    return search


def _merge(best: np.ndarray, best_key: np.ndarray, rows: np.ndarray, keys: np.ndarray, cos: np.ndarray) -> None:
    """Merge found points into the rows' k best; ties go to the smaller key."""
    k = best.shape[1]
    u, inv = np.unique(rows, return_inverse=True)
    r = np.concatenate([np.repeat(np.arange(len(u)), k), inv])
    c = np.concatenate([best[u].ravel(), cos])
    kk = np.concatenate([best_key[u].reshape(-1, 2), keys])
    o = np.lexsort((kk[:, 1], kk[:, 0], -c, r))
    r, c, kk = r[o], c[o], kk[o]
    first = np.searchsorted(r, np.arange(len(u)))
    place = np.arange(len(r)) - first[r]
    ok = place < k
    best[u[r[ok]], place[ok]] = c[ok]
    best_key[u[r[ok]], place[ok]] = kk[ok]


def most_similar(
    df: DataFrame,
    id_col: str = "chunk_id",
    vec_col: str = "embedding",
    k: int = 10,
    min_cosine: float | None = None,
    p_stop: float = 0.99,
    query: Column | None = None,
) -> DataFrame:
    """The ``k`` nearest other rows of every row by cosine: (id, neighbour, rank, cosine).

    ``min_cosine`` bounds the search: only neighbours at or above it are wanted,
    which bounds each query's distance from the start.  ``query`` restricts the
    rows that ask (all rows answer).  Rows with a null id, and null, empty,
    all-zero or non-finite vectors, take no part; vectors whose length is not
    the commonest one neither, as their cosine with the rest is undefined.  A
    repeated id counts once (its smallest vector hash).  Ties go to the smaller
    id within copies, and to the smaller vector hash between different vectors;
    other columns are ignored, so clashing names don't matter.  Empty input
    gives an empty result.
    """
    spark = df.sparkSession
    out_schema = "id string, neighbour string, rank int, cosine double"
    base = (
        df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"), (F.lit(True) if query is None else F.coalesce(query, F.lit(False))).alias("isq"))
        .where(F.col("id").isNotNull() & usable(F.col("vec")))
        .select("id", "isq", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("b"), "vec").alias("h2"))
    )
    where = work_dir(spark, "neighbours")
    # one row per different vector, folded before the shuffle
    reps = base.groupBy("h1", "h2").agg(F.any_value("vec").alias("vec"), F.max(F.col("isq").cast("int")).alias("isq"))
    reps.write.parquet(f"{where}/reps")
    reps = spark.read.parquet(f"{where}/reps")
    dims = reps.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], out_schema)
    dim, n = int(dims[0]["d"]), int(dims[0]["count"])
    reps = reps.where(F.size("vec") == dim)
    share = max(1, -(-n // SAMPLE))
    td = min(TREE_DIMS, dim)

    @F.pandas_udf("binary")
    def place(vec: pd.Series) -> pd.Series:
        return pd.Series([p.tobytes() for p in (_unit(vec, dim) @ projection(dim))[:, :td]])

    sample = [r[0] for r in reps.where(F.pmod("h2", F.lit(share)) == 0).select(place("vec")).limit(2 * SAMPLE).collect()]
    points = np.frombuffer(b"".join(sample), "f4").reshape(-1, td)
    cells = max(1, -(-n // (BLOCK // 2)))
    tree = _fit_tree(points, cells) if len(points) else []

    @F.pandas_udf("int")
    def cell(vec: pd.Series) -> pd.Series:
        return pd.Series(_cells(tree, (_unit(vec, dim) @ projection(dim))[:, :td]))

    parts = max(1, min(cells, 4096))
    packed = (
        reps.withColumn("cell", cell("vec"))
        .repartitionByRange(parts, "cell")
        .sortWithinPartitions("cell", "h1", "h2")
        .mapInPandas(_pack(tree, dim), BLOCK_SCHEMA)
    )
    packed.write.partitionBy("block").parquet(f"{where}/blocks")
    # one box of TREE_DIMS numbers a block, of some 16,000 vectors
    boxes = spark.read.parquet(f"{where}/blocks").select("block", "h", "block_lo", "block_hi").orderBy("block").collect()
    los = np.stack([np.frombuffer(r["block_lo"], "f4") for r in boxes])
    his = np.stack([np.frombuffer(r["block_hi"], "f4") for r in boxes])
    asking = [r["block"] for r in boxes if r["h"] > 0]
    # a block's queries are further cut so that few blocks still use every core
    d2_most = 4.0 if min_cosine is None else max(0.0, 2 - 2 * min_cosine)
    of = max(1, min(16, -(-96 // max(1, len(asking))), -(-n // 2048)))
    todo = spark.createDataFrame([(b, i, of) for b in asking for i in range(of)], "block int, part int, of int").repartitionByRange(max(1, len(asking) * of), "block", "part")
    found = todo.mapInPandas(_search(f"{where}/blocks", dim, k, d2_most, p_stop, [r["block"] for r in boxes], los.tobytes(), his.tobytes()), PAIR_SCHEMA)
    found.write.parquet(f"{where}/found")
    for done in ("reps", "blocks"):
        remove_dir(spark, f"{where}/{done}")
    return _expand(base, spark.read.schema(PAIR_SCHEMA).parquet(f"{where}/found"), k, min_cosine)


def _hash_pairs(df: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    return df.sparkSession.createDataFrame(pairs, "h1 bigint, h2 bigint")


def _expand(base: DataFrame, found: DataFrame, k: int, min_cosine: float | None) -> DataFrame:
    """From representatives back to rows: copies are neighbours at cosine 1, and a neighbour stands for its copies."""
    members = base.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h"), F.max("isq").alias("isq")).select("id", "isq", "h.h1", "h.h2")
    by_copy = Window.partitionBy("h1", "h2").orderBy("id")
    # no more than k + 1 ids of a group can be anyone's neighbours; the limit is applied before the shuffle
    heads = members.select("h1", "h2", "id").withColumn("n", F.row_number().over(by_copy)).where(F.col("n") <= k + 1)
    copies = heads.join(heads.where("n = 2").select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", F.col("id").alias("neighbour"), F.lit(1.0).alias("cosine"))
    others = found.join(heads.where(F.col("n") <= k).select(F.col("h1").alias("nh1"), F.col("h2").alias("nh2"), F.col("id").alias("neighbour")), ["nh1", "nh2"]).select("h1", "h2", "neighbour", "cosine")
    order = [F.desc("cosine"), F.asc("neighbour")]
    near = copies.unionByName(others).withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(*order))).where(F.col("n") <= 2 * k + 1)
    lists = near.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("n", "neighbour", "cosine"))).alias("near"))
    mine = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k)
    asking = members.where("isq").select("id", "h1", "h2")
    # copies of one vector may be a third of all rows: theirs, fewer than HOT lists of at most 2k + 1, go to the rows
    total = base.count()
    hot = heads.where(F.col("n") == k + 1).select("h1", "h2").join(members.groupBy("h1", "h2").agg(F.count("*").alias("copies")), ["h1", "h2"]).where(F.col("copies") * HOT > total).select("h1", "h2")
    pairs = [(r["h1"], r["h2"]) for r in hot.collect()]
    if pairs:
        hot = _hash_pairs(base, pairs)
        paired = asking.join(F.broadcast(lists.join(F.broadcast(hot), ["h1", "h2"], "left_semi")), ["h1", "h2"]).unionByName(asking.join(F.broadcast(hot), ["h1", "h2"], "left_anti").join(lists, ["h1", "h2"]))
    else:
        paired = asking.join(lists, ["h1", "h2"])
    rows = paired.select("id", F.posexplode(mine).alias("p", "x"))
    out = rows.select("id", F.col("x.neighbour").alias("neighbour"), (F.col("p") + 1).cast("int").alias("rank"), F.col("x.cosine").alias("cosine"))
    return out if min_cosine is None else out.where(F.col("cosine") >= min_cosine)


def mutual_pairs(neighbours: DataFrame) -> DataFrame:
    """Pairs that are in each other's lists, the smaller id first: (a, b)."""
    a, b = F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")
    return neighbours.select(a, b).groupBy("a", "b").count().where("count = 2").select("a", "b")
