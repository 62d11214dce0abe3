"""Exact dense neighbours of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most query vectors that one broadcast block holds.
BLOCK = 4096


def exact_knn(queries: DataFrame, targets: DataFrame, k: int, decimals: int = 12) -> DataFrame:
    """The k nearest targets of every query by cosine (rounded), equal ones by smaller id: q, t, score, rank.

    queries(id, v), targets(id, v), ids being 64-bit integers; a vector isn't its own neighbour; null, empty and zero vectors
    have none. Queries are split into blocks of at most BLOCK by hash, each block becomes an array that meets the targets'
    partitions, and only k rows per query and partition go on. A block is fetched by the driver, whose memory it bounds.
    """
    fine = lambda df: df.filter(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))
    queries, targets = fine(queries), fine(targets)
    n = queries.count()
    blocks = max(1, -(-2 * n // BLOCK))
    out = None
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "v").toArrow()
        if not rows.num_rows:
            continue
        ids = rows.column("id").to_numpy()
        m = np.stack([np.asarray(x, np.float64) for x in rows.column("v").to_pylist()])
        one = targets.select("id", "v").mapInArrow(_block(ids, m / np.linalg.norm(m, axis=1, keepdims=True), k, decimals), "q bigint, t bigint, score double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return queries.sparkSession.createDataFrame([], "q bigint, t bigint, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "t"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def _block(ids: np.ndarray, unit: np.ndarray, k: int, decimals: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column("id").to_numpy(zero_copy_only=False)
            if not len(t):
                continue
            v = np.stack([np.asarray(x, np.float64) for x in b.column("v").to_pylist()])
            s = np.round(unit @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, decimals)
            s[ids[:, None] == t[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(t, s.shape), -s), axis=1)[:, :k]
            q = np.repeat(ids, order.shape[1])
            score = np.take_along_axis(s, order, 1).ravel()
            keep = np.isfinite(score)
            yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(t[order].ravel()[keep]), pa.array(score[keep])], ["q", "t", "score"])

    return run
