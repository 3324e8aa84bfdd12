"""Splitting oversized items at natural boundaries, by recursive bisection."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Strength of a cut after each match, from weakest to strongest.
_BOUNDARIES = [
    (1, re.compile(r"\s+")),
    (2, re.compile(r"[,;:，；：、]\s*")),
    (3, re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？][”’」』）]*\s*")),
    (4, re.compile(r"[^\S\n]*\n[^\S\n]*")),
    (5, re.compile(r"\s*\n[^\S\n]*\n\s*")),
]


def boundary_strengths(text: str) -> np.ndarray:
    """For every position p, the strength of a cut between p-1 and p (0: none)."""
    s = np.zeros(len(text) + 1, "u1")
    for strength, pattern in _BOUNDARIES:
        ends = [m.end() for m in pattern.finditer(text)]
        s[ends] = strength
    s[0] = s[-1] = 0
    return s


def cut_points(text: str, most: int) -> list[int]:
    """Starts of the pieces after the first, such that none is longer than ``most``.

    A span longer than ``most`` is cut at the strongest boundary of its middle
    half (the one nearest the midpoint among equals); without one there, at the
    strongest boundary anywhere in it; without any, at the midpoint.
    """
    s = boundary_strengths(text)
    cuts: list[int] = []
    todo = [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= most:
            continue
        quarter, mid = (hi - lo) // 4, (lo + hi) // 2
        at = 0
        for x, y in ((lo + quarter, hi - quarter), (lo, hi)):
            inner = s[x + 1 : y]
            if len(inner) and (top := inner.max()):
                where = np.flatnonzero(inner == top) + x + 1
                at = int(where[np.argmin(np.abs(where - mid))])
                break
        at = at or mid
        cuts.append(at)
        todo += [(lo, at), (at, hi)]
    return sorted(cuts)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of every piece; together they cover the text, and each starts up to ``overlap`` characters inside the one before."""
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text))]
    edges = [0, *cut_points(text, limit - overlap), len(text)]
    s = boundary_strengths(text)
    out = [(0, edges[1])]
    for i in range(1, len(edges) - 1):
        back = max(edges[i - 1], edges[i] - overlap)
        starts = np.flatnonzero(s[back : edges[i]])
        # a shared part begins at a boundary where one lies in reach
        out.append((back + int(starts[0]) if len(starts) else back, edges[i + 1]))
    return out


def split_oversized(df: DataFrame, keys: list[str], text: str = "text", limit: int = 2000, overlap: int = 200, dedupe: bool = True) -> DataFrame:
    """Pieces of at most ``limit`` characters (Unicode code points): (keys, piece_no, n_pieces, start, end, piece).

    Only texts above the limit visit Python; the others are one piece each, made
    in the JVM.  Null and empty texts give no piece, rows with a null key are
    kept.  With ``dedupe`` a key delivered again counts once; without it the
    caller removes repeats from the (much smaller) result.  Offsets count from
    0, ``end`` is exclusive, ``piece_no`` counts from 1.  Columns besides keys
    and text are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit is needed")
    src = df.select(*keys, F.col(text).alias("text__"))
    if dedupe:
        src = src.dropDuplicates(keys)
    own = [src.schema[k] for k in keys]
    schema = T.StructType([*own, *(T.StructField(c, T.IntegerType()) for c in ("piece_no", "n_pieces", "start", "end")), T.StructField("piece", T.StringType())])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *key, t in pdf.itertuples(index=False):
                found = pieces(t, limit, overlap)
                rows += [(*key, i, len(found), a, b, t[a:b]) for i, (a, b) in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    long = src.where(F.length("text__") > limit).mapInPandas(cut, schema)
    n = F.length("text__")
    short = src.where((n > 0) & (n <= limit)).select(
        *keys, F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), n.cast("int").alias("end"), F.col("text__").alias("piece")
    )
    return short.unionByName(long)


def json_text(column: str | Column) -> Column:
    """The text held in a JSON object; null where it doesn't parse, has no text or a null one."""
    c = F.col(column) if isinstance(column, str) else column
    return F.try_variant_get(F.try_parse_json(c), "$.text", "string")
