"""Seeded permutations of 0..n-1 that are computed place by place, without a sort.

A place is written in mixed radix as (left, right) with ``a * b`` just above n.  Each
round of an alternating Feistel network adds a hash of one half to the other, modulo
that half's radix, which can be undone, so a round permutes the a * b places.  A place
that lands beyond n walks on along its cycle until it is inside.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

ROUNDS = 6
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _scrambled(seed: np.ndarray, round_: int, half: np.ndarray) -> np.ndarray:
    h = seed ^ (half.astype(np.uint64) * _ODD + np.uint64(round_ + 1))
    for shift in (30, 27, 31):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def permuted(place: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Where each ``place`` (from 0, below its ``n``) goes; places with equal ``n`` and ``seed`` share a permutation."""
    n, seed = n.astype(np.int64), seed.astype(np.int64).view(np.uint64)
    a = np.ceil(np.sqrt(n)).astype(np.int64)
    b = -(-n // np.maximum(a, 1))
    x, todo = place.astype(np.int64).copy(), np.arange(len(place))
    while len(todo):
        (ta, tb), key = (a[todo], b[todo]), seed[todo]
        left, right = x[todo] // tb, x[todo] % tb
        for r in range(ROUNDS):
            if r % 2:
                right = ((right.astype(np.uint64) + _scrambled(key, r, left) % tb.astype(np.uint64)) % tb.astype(np.uint64)).astype(np.int64)
            else:
                left = ((left.astype(np.uint64) + _scrambled(key, r, right) % ta.astype(np.uint64)) % ta.astype(np.uint64)).astype(np.int64)
        x[todo] = left * tb + right
        todo = todo[x[todo] >= n[todo]]
    return x


def _permuted(place: pd.Series, n: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series(permuted(place.to_numpy(), n.to_numpy(), seed.to_numpy()))


def partner(place: Column, n: Column, *seed: Column) -> Column:
    """The permuted place; none of the inputs may be null."""
    return F.pandas_udf(_permuted, "long")(place.cast("long"), n.cast("long"), F.xxhash64(*seed))
