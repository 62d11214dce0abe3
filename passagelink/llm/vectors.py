"""Most similar vectors by cells around sampled vectors, several to a vector; large cells along space-filling curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagelink.session import materialize, shuffle_width, tidy

#: Curves, projected dimensions, bits a dimension, and rows on each side of a vector along the curve of its cell it is compared with.
CURVES, DIMS, BITS, WINDOW = 4, 8, 6, 16_384
SEED = 20240517
#: Vectors for each center of a cell, centers at most, which every task holds (two bytes a number), and cells of a vector.
TILE, TILES, EACH = 1_536, 32_768, 5
#: Up to so many times TILE vectors are one cell. Steps of a coordinate where cells are chosen: sums of products stay below 2**24, so that they are exact.
ONE, STEPS = 4, 2_048
#: Rows of a block that are compared at once.
STEP = 256
#: How far a cosine of vectors rounded to 16 bits may be off; rounding spreads a tenth of that.
SLACK = 5e-5
#: Arrow type of a cosine.
_FLOAT = pa.float32()


def usable_vectors(df: DataFrame, ident: str, vector: str, time: str, size: int) -> DataFrame:
    """Of each identifier the usable vector of latest time: ``size`` finite numbers, not all zero.

    Null times count as earliest. Vectors that tie in time are taken by the larger array, so that the result is one
    and the same on every run. Null identifiers, null, short, long, zero, NaN-bearing and infinite vectors are left out.
    """
    v = F.col(vector)
    fine = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return (
        df.filter(F.col(ident).isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
        .groupBy(F.col(ident).alias("id")).agg(F.max(F.struct(F.coalesce(F.col(time), F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), v.cast("array<float>").alias("v"))).alias("m"))
        .select("id", F.col("m.v").alias("v"))
    )


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of cells (unsigned integers below 2**bits) along the Hilbert curve of that many dimensions.

    The transform of J. Skilling, Programming the Hilbert curve (2004), over all rows at once.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for k in range(dims):
            high = (x[k] & np.uint64(q)) != 0
            t = np.where(high, np.uint64(0), (x[0] ^ x[k]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if k:
                x[k] ^= t
        q >>= 1
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for k in range(dims):
            key = (key << np.uint64(1)) | ((x[k] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def _frames(size: int, curves: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """A random projection with orthonormal directions and a random shift for each curve; the same on every run."""
    rng = np.random.default_rng(SEED)
    return np.stack([np.linalg.qr(rng.standard_normal((size, size)))[0][:, :dims] for _ in range(curves)]), rng.random((curves, dims))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of every number (the finalizer of splitmix64)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _row_hash(x: np.ndarray) -> np.ndarray:
    """A hash of every row of an array of integers."""
    with np.errstate(over="ignore"):
        at = np.arange(1, x.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return _mixed(_mixed(x.astype(np.int64).view(np.uint64) + at).sum(1, dtype=np.uint64)).view(np.int64)


def _usable(b: pa.RecordBatch, size: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows of a batch with an identifier and a usable vector (column v), and those vectors."""
    v, ident = b.column("v"), b.column("id")
    n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(v), -1))
    pick = np.flatnonzero((n == size) & np.asarray(ident.is_valid()))
    b = b.take(pa.array(pick))
    raw = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, size)
    fine = np.flatnonzero(np.isfinite(raw).all(1) & (raw != 0).any(1))
    return b.take(pa.array(fine)), raw[fine]


def _units(raw: np.ndarray) -> np.ndarray:
    d = raw.astype(np.float64)
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def _blobs(x: np.ndarray) -> pa.Array:
    """The rows of an array as binary values."""
    x = np.ascontiguousarray(x)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.itemsize * x.shape[1]), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())


def _array(blobs: pa.Array, kind: type, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), kind).reshape(-1, size)


def _dot(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)


def _steps(u: np.ndarray) -> np.ndarray:
    """Unit vectors in whole steps, whose products are exact in single precision in any order of summation."""
    return np.rint(u * STEPS).astype(np.float32)


def _cells(x: np.ndarray, centers: np.ndarray, each: int) -> np.ndarray:
    """The ``each`` nearest centers of every row, of equally near ones the first; both from ``_steps()``."""
    out = [np.empty((0, each), np.int64)]
    for lo in range(0, len(x), STEP):
        near = x[lo : lo + STEP] @ centers.T
        edge = np.full(len(near), -np.inf, np.float32)
        parts = max(each, 64)
        if wide := near.shape[1] // parts:
            top = near[:, : wide * parts].reshape(len(near), parts, wide).max(2)
            edge = np.partition(top, parts - each, axis=1)[:, parts - each]
        r, c = np.nonzero(near >= edge[:, None])
        order = np.lexsort((c, -near[r, c], r))
        r, c = r[order], c[order]
        out.append(c[np.arange(len(r)) - np.searchsorted(r, r) < each].reshape(-1, each))
    return np.concatenate(out)


def _near_rows(u: np.ndarray, begin: int, end: int, k: int, least: float, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows near the rows [begin, end) of a cell, and their cosines: of each row the k best in its window and all that may tie."""
    lo, hi = max(0, begin - window), min(len(u), end + window)
    sim = u[begin:end] @ u[lo:hi].T
    both = np.arange(begin, end)
    sim[both - begin, both - lo] = -2
    edge = np.full(end - begin, max(least, -1.0) - SLACK, np.float32)
    # the k-th of the highest values of k or more parts of a row is no more than the k-th of the row
    parts = max(k, 64)
    if wide := sim.shape[1] // parts:
        top = sim[:, : wide * parts].reshape(end - begin, parts, wide).max(2)
        edge = np.maximum(edge, np.partition(top, parts - k, axis=1)[:, parts - k] - 2 * SLACK)
    r, c = np.nonzero(sim >= np.maximum(edge, -1.5)[:, None])
    w = sim[r, c]
    # of those the k best again, now of all of the row
    order = np.argsort(r + (1 - w.astype(np.float64)) / 4, kind="stable")
    r, c, w = r[order], c[order], w[order]
    first = np.searchsorted(r, np.arange(end - begin))
    last = np.minimum(first + k - 1, len(r) - 1)[r]
    keep = (np.arange(len(r)) - first[r] < k) | (w >= w[last] - 2 * SLACK)
    return begin + r[keep], lo + c[keep], w[keep]


def nearest(
    rows: DataFrame, k: int, size: int, least: float = -1.0, queries: DataFrame | None = None, exact: bool = True,
    curves: int = CURVES, dims: int = DIMS, bits: int = BITS, window: int = WINDOW, tile: int = TILE, each: int = EACH,
) -> DataFrame:
    """For every vector of ``rows(id, t, v)`` the k most similar others by cosine, of those with at least ``least``.

    Columns out: query_id, target_id, cosine_similarity, rank (by cosine downward, equal ones by smaller target_id).
    ``queries(id)`` restricts whose neighbours are wanted. An identifier counts with its usable vector of latest ``t``
    (null: earliest); equal times are decided by a hash of the vector. Usable are ``size`` finite numbers, not all
    zero; null identifiers and all other vectors are left out. A collection of one vector or none gives no rows.

    Directions that several vectors share are one class, equal to 9 decimals in every coordinate: its k + 1 smallest
    members stand for it, so any number of copies costs as much as one vector. One class in ``tile``, by hash, is the
    center of a cell, so cells are small where vectors are dense, and their number grows with the table. Each class
    goes to the cells of its ``each`` nearest centers, and in a cell everything meets everything; only in a cell of more
    than ``window`` rows a vector meets the ``window`` rows on both sides along a Hilbert curve through projections. The
    choice of cells is exact, so the result does not depend on how Spark partitions the rows; what is lost is what shares
    no cell.

    Vectors move once to their classes and once to each of their cells, rounded to 16 bits. The cells' results are
    merged and reranked: where rounding leaves the order or the threshold open, the vectors themselves decide, in double
    precision, rounded to 9 decimals. ``exact`` computes every cosine that way; otherwise those that rounding leaves no
    doubt about stay as they are, within 5e-5, which changes no pair and no rank.
    """
    spark = rows.sparkSession
    mats, shifts = _frames(size, curves, dims)
    tie = 63 - dims * bits  # bits left for the hash that orders ties

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b, raw = _usable(b, size)
            cols = [b.column("id"), b.column("t"), pa.array(_row_hash(raw.view(np.int32))), pa.array(_row_hash(np.rint(_units(raw) * 1e9)))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "t", "vh", "cls"])

    rows = rows.select(F.col("id").cast("string").alias("id"), "t", F.col("v").cast("array<float>").alias("v"))
    kind = rows.schema["t"].dataType.simpleString()
    told = rows.mapInArrow(describe, f"id string, t {kind}, vh bigint, cls bigint")
    # nulls are smallest
    members = materialize(told.groupBy("id").agg(F.max(F.struct("t", "vh", "cls")).alias("m")).select("id", "m.vh", "m.cls"))
    few = materialize(members.withColumn("m", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).filter(F.col("m") <= k + 1))
    reps = few.filter("m = 1").select("id", "vh", "cls")
    tidy(spark)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b, raw = _usable(b, size)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(_row_hash(raw.view(np.int32))), b.column("v")], ["id", "vh", "v"])

    n = reps.count()
    n_cells = 1 if n <= ONE * tile else min(-(-n // tile), TILES)
    of_each = min(each, n_cells)
    centers = np.zeros((1, size), np.int16)
    if n_cells > 1:
        pick = F.broadcast(reps.withColumn("o", F.xxhash64("cls", F.lit(SEED))).orderBy("o", "cls").limit(n_cells))
        got = rows.join(pick.select("id"), "id", "left_semi").mapInArrow(whole, "id string, vh bigint, v array<float>").join(pick, ["id", "vh"]).select("o", "cls", "v").collect()  # at most TILES, and copies of the same rows
        centers = _steps(_units(np.array([r.v for r in sorted({r.cls: r for r in got}.values(), key=lambda r: (r.o, r.cls))], np.float32))).astype(np.int16)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b, raw = _usable(b, size)
            u = _units(raw)
            scale = np.abs(u).max(1, keepdims=True)
            small = np.concatenate([scale.astype(np.float32).view(np.int16), np.rint(u / scale * 32767).astype(np.int16)], 1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(_row_hash(raw.view(np.int32))), _blobs(small)], ["id", "vh", "v"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = centers.astype(np.float32)
        for b in batches:
            small, cls = _array(b.column("v"), np.int16, size + 2), b.column("cls").to_numpy(zero_copy_only=False)
            u = small[:, 2:].astype(np.float64) * (small[:, :2].copy().view(np.float32).astype(np.float64) / 32767)
            # coordinates of projected unit vectors spread as 1/sqrt(size); three deviations to each side fill the curve's cubes
            cubes = [np.clip(((u @ mats[c] * np.sqrt(size) + 3 + shifts[c]) / 7 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1) for c in range(curves)]
            keys = np.stack([(hilbert_keys(x, bits) << tie) | (cls & ((1 << tie) - 1)) for x in cubes])
            to = _cells(_steps(u), middle, of_each)
            for c in range(of_each):
                cols = [pa.array(to[:, c].astype(np.int32)), pa.array(keys[to[:, c] % curves, np.arange(len(cls))]), b.column("cls"), b.column("v")]
                yield pa.RecordBatch.from_arrays(cols, ["tile", "key", "cls", "v"])

    placed = rows.mapInArrow(hashed, "id string, vh bigint, v binary").join(reps.hint("shuffle_hash"), ["id", "vh"]).select("cls", "v")
    placed = placed.mapInArrow(route, "tile int, key bigint, cls bigint, v binary")
    width = min(n_cells, 16 * shuffle_width(spark))
    tiles = placed.repartitionById(width, F.pmod("tile", F.lit(width)).cast("int")).sortWithinPartitions("tile", "key", "cls")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, cls = np.empty((0, size), np.float32), np.empty(0, np.int64)
        tile_no, begin = -1, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the cell that are not in u yet

        def near(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal begin, u, cls, held
            if held:
                u, cls, held = np.concatenate([u, *(x for x, _ in held)]), np.concatenate([cls, *(x for _, x in held)]), []
            to = len(u) if last else begin + max(0, (len(u) - window - begin) // STEP * STEP)
            while begin < to:
                stop = min(begin + STEP, to)
                q, t, w = _near_rows(u, begin, stop, k, least, window)
                yield pa.RecordBatch.from_arrays([pa.array(cls[q]), pa.array(cls[t]), pa.array(w, _FLOAT)], ["a", "b", "w"])
                begin = stop
            if begin > window + (1 << 16):
                drop = begin - window
                u, cls, begin = u[drop:], cls[drop:], window

        for b in batches:
            no, ids, small = b.column("tile").to_numpy(zero_copy_only=False), b.column("cls").to_numpy(zero_copy_only=False), _array(b.column("v"), np.int16, size + 2)
            vec = small[:, 2:].astype(np.float32) * (small[:, :2].copy().view(np.float32) / 32767)
            for lo, hi in zip(*(lambda cuts: (cuts[:-1], cuts[1:]))(np.flatnonzero(np.concatenate([[True], no[1:] != no[:-1], [True]])))):
                if no[lo] != tile_no:
                    yield from near(True)
                    u, cls, tile_no, begin = u[:0], cls[:0], no[lo], 0
                # a row that is sent twice stands beside its copy
                before = held[-1][1][-1:] if held else cls[-1:]
                fresh = ids[lo:hi] != np.concatenate([before if len(before) else ids[lo : lo + 1] ^ 1, ids[lo : hi - 1]])
                if fresh.any():
                    held.append((vec[lo:hi][fresh], ids[lo:hi][fresh]))
                if len(u) + sum(len(x) for _, x in held) - begin >= window + (1 << 13):
                    yield from near(False)
        yield from near(True)

    near = tiles.mapInArrow(meet, "a bigint, b bigint, w float").repartition("a").groupBy("a", "b").agg(F.max("w").cast("double").alias("w"))
    near = near.withColumn("r", F.rank().over(Window.partitionBy("a").orderBy(F.desc("w")))).withColumn("kth", F.min(F.when(F.col("r") <= k, F.col("w"))).over(Window.partitionBy("a")))
    near = near.filter(F.col("w") >= F.col("kth") - 2 * SLACK)
    beside = Window.partitionBy("a").orderBy(F.desc("w"), "b")
    gap = F.least(F.coalesce(F.lag("w").over(beside) - F.col("w"), F.lit(9.0)), F.coalesce(F.col("w") - F.lead("w").over(beside), F.lit(9.0)))
    near = materialize(near.select("a", "b", "w", ((F.lit(exact)) | (gap <= 2 * SLACK) | (F.abs(F.col("w") - least) <= SLACK)).alias("open")))

    del told, placed, tiles
    tidy(spark)

    # the vectors of pairs that are still open; their classes are written, so that Spark knows how many they are before it joins
    doubt = near.filter("open").select("a", "b")
    need = materialize(doubt.select(F.col("a").alias("cls")).union(doubt.select(F.col("b").alias("cls"))).distinct().join(reps.select("id", "vh", "cls"), "cls"))
    vec = materialize(rows.mapInArrow(whole, "id string, vh bigint, v array<float>").join(need, ["id", "vh"]).dropDuplicates(["cls"]).select("cls", "v"))
    side = lambda c: vec.select(F.col("cls").alias(c), F.col("v").alias(f"v{c}"))
    sure = doubt.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.round(_dot("va", "vb") / (F.sqrt(_dot("va", "va")) * F.sqrt(_dot("vb", "vb"))), 9).alias("e"))
    near = near.join(sure, ["a", "b"], "left").select("a", "b", F.coalesce("e", "w").alias("w")).filter(F.col("w") >= least)

    wanted = members.select("id", "cls") if queries is None else members.select("id", "cls").join(queries.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
    own = wanted.join(few.select("cls", F.col("id").alias("target_id")), "cls").filter(F.col("id") != F.col("target_id")).select(F.col("id").alias("query_id"), "target_id", F.lit(1.0).alias("w"))
    # what a class offers its neighbours is the same for all members of the asking class
    offers = near.join(few.select(F.col("cls").alias("b"), F.col("id").alias("target_id"), "m"), "b").filter(F.col("m") <= k)
    offers = offers.withColumn("o", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "target_id"))).filter(F.col("o") <= k).select(F.col("a").alias("cls"), "target_id", "w")
    other = wanted.join(offers, "cls").select(F.col("id").alias("query_id"), "target_id", "w")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("w"), "target_id"))
    return own.unionByName(other).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "target_id", F.col("w").alias("cosine_similarity"), "rank")
