"""Exact top-k search by tiled matrix products.

Vectors become integers.  The stated queries go to the tasks in blocks of
bounded size; every task cuts its shard into tiles, multiplies a block of
queries with a tile (BLAS calls, exact as integers), selects the best of the
tile for each query and keeps one running list per query.  The lists of the
tasks then merge in a tree: first within buckets of tasks, then across buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import union, written

#: Candidates in a tile, queries in a product, queries sent in one pass.
TILE_ROWS, QUERY_ROWS, PASS_QUERIES = 4096, 512, 32_768
#: Buckets of the first level of merging.
MERGE_BUCKETS = 32


def quantise(vectors: DataFrame, *, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, q``: floor(scale * x) of each component.

    Null vectors and those with a null or non-finite component leave here, as do null ids.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad).select("vec_id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")).alias("q"))


def _matrix(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and rows, by the vectors' length."""
    offsets = column.offsets.to_numpy()
    flat, lengths = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    out = {}
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        out[int(d)] = rows, flat[(offsets[rows][:, None] + np.arange(d)[None, :])]
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by (score down, id up), in that order; both arguments (rows, n) of integers."""
    if scores.shape[1] > k:
        keep = np.argpartition(scores, -k, axis=1)[:, -k:]
        kth = np.take_along_axis(scores, keep, 1).min(axis=1)
        # where more than k reach the k-th score, ids decide among those alone
        for r in np.flatnonzero((scores >= kth[:, None]).sum(axis=1) > k):
            at = np.flatnonzero(scores[r] >= kth[r])
            keep[r] = at[np.lexsort((ids[r, at], _down(scores[r, at])))[:k]]
        scores, ids = np.take_along_axis(scores, keep, 1), np.take_along_axis(ids, keep, 1)
    order = np.lexsort((ids, _down(scores)), axis=1)
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _down(scores: np.ndarray) -> np.ndarray:
    """Ascends where scores descend, over the whole range of a long."""
    return ~scores


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best, ties to smaller ids.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows with another id.  Vectors that are null or hold null or non-finite
    components take no part, nor do rows without an id; vectors of different lengths
    are not compared (those of length 0 score 0 with each other).  Of repeated rows
    each counts as a candidate, and equal queries (id and vector) get one list;
    queries of one id and different vectors get a list each.  An empty table gives
    an empty result; other columns are not read.  Scores are exact integers; those
    that a long can't hold become the nearest long.

    A pass sends ``PASS_QUERIES`` queries to all tasks and writes their lists, so the
    driver holds the queries of one pass at a time.
    """
    spark = vectors.sparkSession
    rows = quantise(vectors, scale=scale, id_col=id_col, vec_col=vec_col)
    queries = written(rows.where(F.col("vec_id") % every == 0).distinct().withColumn("query", F.xxhash64("vec_id", "q")))
    passes = max(1, -(-queries.count() // PASS_QUERIES))
    parts = []
    for i in range(passes):
        # a block's size is bounded by the hash's evenness
        block = queries.where(F.pmod(F.col("query"), F.lit(passes)) == i).toArrow()
        by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if block.num_rows:
            own, names = (block.column(c).to_numpy() for c in ("vec_id", "query"))
            by_length = {d: (own[at], names[at], m) for d, (at, m) in _matrix(block.column("q").combine_chunks()).items()}
        sent = spark.sparkContext.broadcast(by_length)
        parts.append(written(rows.mapInArrow(_search(sent, k), FOUND)))
        sent.destroy()
    order = [F.desc("score"), F.asc("vec_id")]
    first = W.partitionBy("query_id", "query", "bucket").orderBy(*order)
    last = W.partitionBy("query_id", "query").orderBy(*order)
    merged = union(parts).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    merged = merged.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")


FOUND = "query_id long, query long, vec_id long, score long, bucket int"


def _search(sent, k: int):
    def run(batches):
        from pyspark import TaskContext

        bucket = TaskContext.get().partitionId() % MERGE_BUCKETS
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            ids = b.column(0).to_numpy()
            if not b.num_rows:
                continue
            for d, (at, m) in _matrix(b.column(1)).items():
                if d not in sent.value:
                    continue
                qids, _, qm = sent.value[d]
                for t in range(0, len(at), TILE_ROWS):
                    tile, tids = m[t : t + TILE_ROWS], ids[at[t : t + TILE_ROWS]]
                    for s in range(0, len(qids), QUERY_ROWS):
                        block, own = qm[s : s + QUERY_ROWS], qids[s : s + QUERY_ROWS]
                        scores = products(block, tile)
                        # the query's own row comes last and leaves at the end
                        scores[own[:, None] == tids[None, :]] = np.iinfo(np.int64).min
                        scores, who = _best(scores, np.broadcast_to(tids, scores.shape), k)
                        if (d, s) in best:
                            scores, who = (np.concatenate(x, axis=1) for x in zip(best[d, s], (scores, who)))
                        # own rows of equal id must not fill the places of others
                        best[d, s] = _best(scores, who, k)
        for (d, s), (scores, who) in best.items():
            own, names = (np.repeat(x[s : s + QUERY_ROWS], scores.shape[1]) for x in sent.value[d][:2])
            keep = who.ravel() != own
            yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(names[keep]), pa.array(who.ravel()[keep]), pa.array(scores.ravel()[keep]), pa.array(np.full(keep.sum(), bucket, np.int32))], ["query_id", "query", "vec_id", "score", "bucket"])

    return run


def products(block: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Inner products of integer rows (held in float64), exact, as longs.

    Sums below 2**53 are exact in float64.  Larger factors are cut into digits of
    ``bits`` bits, whose products again sum exactly; these add up modulo 2**64, which
    is right wherever the result is a long.  Only what could leave that range goes
    by Python's integers.
    """
    d = max(1, block.shape[1])
    a, b = (float(np.abs(x).max(initial=0)) for x in (block, tile))
    if a * b * d < 2.0**53:
        return (block @ tile.T).astype(np.int64)
    if a * b * d < 2.0**63:
        bits = (52 - int(np.ceil(np.log2(d)))) // 2
        out = np.zeros((len(block), len(tile)), np.int64)
        for i, x in enumerate(_digits(block, bits)):
            for j, y in enumerate(_digits(tile, bits)):
                if bits * (i + j) < 64:
                    out += (x @ y.T).astype(np.int64) << np.int64(bits * (i + j))
        return out
    exact = np.array([[int(x) for x in r] for r in block], object).reshape(block.shape) @ np.array([[int(x) for x in r] for r in tile], object).reshape(tile.shape).T
    return np.clip(exact, np.iinfo(np.int64).min, np.iinfo(np.int64).max).astype(np.int64)


def _digits(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Digits of integers in float64, least first; all but the last are from 0 to 2**bits - 1."""
    out, most = [], 2.0**bits
    while np.abs(x).max(initial=0) >= most:
        high = np.floor(x / most)
        out.append(x - high * most)
        x = high
    return [*out, x]
