"""Similarities of token sets and texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Of two arrays as sets; ``empty`` where both have no element."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def hashed_jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """The same of arrays without repeats, by their sizes and intersection only."""
    both, sizes = F.array(F.size(F.array_intersect(a, b))), F.size(a) + F.size(b)
    return F.transform(both, lambda n: F.when(sizes == n, F.lit(empty)).otherwise(n / (sizes - n)))[0]  # a lambda's argument is evaluated once


def overlap(a: Column, b: Column) -> Column:
    """(shared, only_a, only_b, any): two arrays as sets, in the order of the first."""
    return F.struct(F.array_intersect(a, b).alias("shared"), F.array_except(a, b).alias("only_a"), F.array_except(b, a).alias("only_b"), F.coalesce(F.arrays_overlap(a, b), F.lit(False)).alias("any"))


def without(tokens: Column, stop: list[str]) -> Column:
    return F.array_except(tokens, F.array(*(F.lit(x) for x in stop)))


def shingles(tokens: Column, k: int = 5) -> Column:
    """Distinct hashes of ``k`` consecutive tokens; shorter lists are one shingle."""
    n = F.size(tokens)
    run = tokens
    for j in range(1, k):  # side by side with the tokens after them: no element evaluates the whole list again
        run = F.zip_with(run, F.slice(tokens, j + 1, F.greatest(n - j, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    many = F.transform(F.slice(run, 1, F.greatest(n - k + 1, F.lit(0))), lambda x: F.xxhash64(x))
    return F.when(n >= k, F.array_distinct(many)).when(n > 0, F.array(F.xxhash64(F.array_join(tokens, " ")))).otherwise(F.array().cast("array<bigint>"))


#: Segments that are matched at a time: their table of run lengths stays in the processor's cache.
_TOGETHER = 1024


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, end in a, end in b) of each column's longest common run; the first in a, then the first in b, of equal ones."""
    kind = np.uint8 if len(b) < 255 else np.int32
    old, new = np.zeros((len(b) + 1, b.shape[1]), kind), np.zeros((len(b) + 1, b.shape[1]), kind)
    best, at, to = (np.zeros(b.shape[1], np.int64) for _ in range(3))
    for i, row in enumerate(a):
        np.add(old[:-1], 1, out=new[1:])
        new[1:] *= b == row
        most = new.max(0)
        up = np.flatnonzero(most > best)
        if len(up):
            best[up], at[up], to[up] = most[up], i, new[1:, up].argmax(0)
        old, new = new, old
    return best, at + 1, to + 1


def sequence_ratios(a: list[str], b: list[str], least: float = 0.0) -> np.ndarray:
    """Ratcliff-Obershelp on characters of each pair, as ``difflib`` without junk: 2 M / S, all pairs a level of the recursion at a time.

    Pairs that can't reach ``least``, as what is matched and the shorter of each two parts left are too few, are given up: theirs is 0.
    """
    size = np.array([[len(x), len(y)] for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    total, n = size.sum(1), len(a)
    text = np.frombuffer("".join(x for pair in zip(a, b) for x in pair).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = (text + 2).astype(np.uint8 if text.max(initial=0) < 254 else np.uint32)  # 0 and 1 stand for no character
    ends = np.cumsum(size.ravel()).reshape(-1, 2)
    matched, need = np.zeros(n, np.int64), least * total / 2 - 1e-9
    alo, ahi, blo, bhi = ends[:, 0] - size[:, 0], ends[:, 0], ends[:, 0], ends[:, 1]
    pair = np.arange(n)
    while True:
        left = np.bincount(pair, np.minimum(ahi - alo, bhi - blo), n)
        keep = np.flatnonzero((matched + left >= need)[pair] & (ahi > alo) & (bhi > blo))
        if not len(keep):
            break
        pair, alo, ahi, blo, bhi = (x[keep] for x in (pair, alo, ahi, blo, bhi))
        wide, parts = np.lexsort((ahi - alo, bhi - blo)), []
        for k in range(0, len(wide), _TOGETHER):
            at = wide[k : k + _TOGETHER]
            sides = []
            for none, lo, hi in ((0, alo[at], ahi[at]), (1, blo[at], bhi[at])):
                place = lo + np.arange((hi - lo).max())[:, None]
                sides.append(np.where(place < hi, text[np.minimum(place, len(text) - 1)], text.dtype.type(none)))
            run, i, j = _longest(*sides)
            np.add.at(matched, pair[at], run)
            at, run, i, j = (x[run > 0] for x in (at, run, i, j))
            parts.append((pair[at], alo[at], alo[at] + i - run, blo[at], blo[at] + j - run))
            parts.append((pair[at], alo[at] + i, ahi[at], blo[at] + j, bhi[at]))
        pair, alo, ahi, blo, bhi = (np.concatenate(x) for x in zip(*parts))
    return np.where(total == 0, 1.0, np.where(matched >= need, 2.0 * matched / np.maximum(total, 1), 0.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp on characters, for pairs that blocking has left: Spark has no such function.  Pairs that a batch has twice are compared once."""
    place: dict[tuple[str, str], int] = {}
    at = [place.setdefault(pair, len(place)) for pair in zip(a.fillna(""), b.fillna(""))]
    return pd.Series(sequence_ratios(*([p[k] for p in place] for k in (0, 1)))[at], dtype="float64")


def may_reach(a: Column, b: Column, least: float) -> Column:
    """Whether the lengths of two texts allow a ``sequence_ratio`` of ``least``: no more characters can match than the shorter one has."""
    la, lb = (F.length(F.coalesce(x, F.lit(""))) for x in (a, b))
    return 2 * F.least(la, lb) + 1e-9 >= least * (la + lb)
