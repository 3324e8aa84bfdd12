"""Filling containers of fixed capacity with items.

Method: items are placed best-fit decreasing, then a swap-based local search
works on the underfull bins: it takes the emptiest one and moves an item out of
it, exchanges one for one or two for one with another bin, always such that the
sum of squared fills grows, until bins empty or nothing improves.

Distribution: items are dealt by hash into groups of about ``GROUP`` items, each
packed in one task of bounded size; a group leaves at most about one
part-filled container, of thousands.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.tokens import TOKENIZER, with_tokens
from quillstone.session import materialize

GROUP = 20_000  #: items a group holds on average
SPAN = 100_000_000  #: container numbers a group may use


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of every item, free space of every bin).  The fullest bin that still takes the item is found in a bit set of free spaces."""
    where = np.empty(len(sizes), "i8")
    free: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    have = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        fits = have >> s
        if fits:
            f = s + (fits & -fits).bit_length() - 1
            b = by_free[f].pop()
            if not by_free[f]:
                have &= ~(1 << f)
        else:
            b, f = len(free), capacity
            free.append(capacity)
        where[i] = b
        free[b] = f = f - s
        if f:
            by_free[f].append(b)
            have |= 1 << f
    return where, np.array(free, "i8")


def _best_exchange(sums: np.ndarray, size: np.ndarray, gap: np.ndarray, fill_a: int, capacity: int) -> tuple[int, int, int]:
    """(tokens that change bins, index in ``sums``, index in ``size``) of the best exchange of a sum for a smaller item, (0, -1, -1) without one.

    ``sums`` ascend.  The largest that an item's bin has room for is the best for that item.
    """
    if not len(sums) or not len(size):
        return 0, -1, -1
    n = np.searchsorted(sums, size + gap, "right") - 1
    d = sums[np.maximum(n, 0)] - size
    d[(n < 0) | (capacity - gap + d <= fill_a)] = 0
    g = int(np.argmax(d))
    return (int(d[g]), int(n[g]), g) if d[g] > 0 else (0, -1, -1)


def local_search(sizes: np.ndarray, where: np.ndarray, free: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Empty underfull bins by moves, one-for-one and two-for-one exchanges, each growing the sum of squared fills.

    Ends when the number of bins is the least possible, or when no item or pair
    of items of any underfull bin has an improving move or exchange.
    """
    where, free = where.copy(), free.copy()
    least = -(-int(sizes.sum()) // capacity)
    alive = int((free < capacity).sum())
    tried = np.zeros(len(free), bool)
    while alive > least:
        under = np.flatnonzero((free > 0) & (free < capacity) & ~tried)
        if len(under) < 1:
            break
        a = int(under[np.argmax(free[under])])
        mine = list(np.flatnonzero(where == a))
        tried[a] = True
        while mine:
            pool = np.flatnonzero((free[where] > 0) & (where != a))
            gap, size = free[where[pool]], sizes[pool]
            best, op = 0, None
            fill_a = int(capacity - free[a])
            # items of one size are alike
            of: dict[int, list[int]] = {}
            for i in mine:
                of.setdefault(int(sizes[i]), []).append(i)
            single = np.array(sorted(of), "i8")
            # a move: into the bin it fills best
            bins = np.flatnonzero((free > 0) & (free < capacity))
            bins = bins[bins != a]
            bins = bins[np.argsort(free[bins], kind="stable")]
            at = np.searchsorted(free[bins], single)
            for s, n in zip(single[::-1].tolist(), at[::-1].tolist()):
                if n < len(bins) and capacity - free[bins[n]] + s > fill_a:
                    best, op = s, ((of[s][0],), None, int(bins[n]))
                    break
            # for one smaller item of another bin
            d, n, g = _best_exchange(single, size, gap, fill_a, capacity)
            if d > best:
                best, op = d, ((of[int(single[n])][0],), int(pool[g]), int(where[pool[g]]))
            # two for one
            x, y = np.triu_indices(len(single))
            can = (x != y) | np.array([len(of[s]) > 1 for s in single.tolist()])[x]
            x, y = single[x[can]], single[y[can]]
            twos, first = np.unique(x + y, return_index=True)
            d, n, g = _best_exchange(twos, size, gap, fill_a, capacity)
            if d > best:
                i, i2 = of[int(x[first[n]])][0], of[int(y[first[n]])][-1]
                best, op = d, ((i, i2), int(pool[g]), int(where[pool[g]]))
            if op is None:
                break
            gone, back, b = op
            for i in gone:
                where[i] = b
                mine.remove(i)
            if back is not None:
                where[back] = a
                mine.append(back)
            free[b] -= best
            free[a] += best
            # what was tried before may improve now
            tried[:] = False
            tried[a] = True
        if not mine:
            alive -= 1
    return where, free


def pack_group(keys: list, sizes: np.ndarray, capacity: int) -> list[tuple]:
    """(key, container, place, tokens, start) with containers numbered from 0; oversized items fill containers of their own and leave a rest."""
    rows, rest_key, rest_size, rest_start = [], [], [], []
    n = 0
    for k, s in zip(keys, sizes):
        whole, rest = divmod(int(s), capacity)
        for w in range(whole):
            rows.append((k, n, 1, capacity, w * capacity))
            n += 1
        if rest:
            rest_key.append(k)
            rest_size.append(rest)
            rest_start.append(whole * capacity)
    if rest_size:
        size = np.array(rest_size, "i8")
        where, free = best_fit_decreasing(size, capacity)
        where, free = local_search(size, where, free, capacity)
        number = np.full(len(free), -1, "i8")
        used = np.unique(where)
        number[used] = n + np.arange(len(used))
        at = dict.fromkeys(used.tolist(), 0)
        for i in np.argsort(-size, kind="stable"):
            b = int(where[i])
            at[b] += 1
            rows.append((rest_key[i], int(number[b]), at[b], int(size[i]), rest_start[i]))
    return rows


def fill_containers(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, container, place, tokens, start): where every text goes.

    A text is split only if it alone exceeds ``capacity``; then it has several
    rows, ``start`` being the first token of each.  Places count from 1.  A key
    delivered again counts once; null keys, null and empty texts have nothing to
    place; an empty table gives no containers.  Other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    src = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null and text <> ''")
    # sizes first: repeated keys are dropped among narrow rows, no text is shuffled
    sized = materialize(with_tokens(src, tokenizer=tokenizer).dropDuplicates(["key"]), "sizes")
    return pack_sizes(sized, "key", "tokens", capacity).withColumnRenamed("key", key)


def pack_sizes(sized: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """As ``fill_containers``, for items whose sizes are known."""
    n = sized.count()
    groups = max(1, -(-n // GROUP))
    kind = sized.schema[key].dataType.simpleString()
    dealt = sized.select(F.col(key).alias("key"), F.col(size).alias("size"), F.pmod(F.xxhash64(F.col(key), F.lit("deal")), F.lit(groups)).alias("g"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        rows = pack_group(list(pdf["key"]), pdf["size"].to_numpy("i8"), capacity)
        out = pd.DataFrame(rows, columns=["key", "container", "place", "tokens", "start"])
        out["container"] += int(pdf["g"].iloc[0]) * SPAN
        return out

    # a task per group: left to itself, adaptive execution puts these few rows into one task
    return dealt.repartitionByRange(groups, "g").groupBy("g").applyInPandas(pack, f"key {kind}, container bigint, place int, tokens int, start int").withColumnRenamed("key", key)
