"""Centroid clustering: Lloyd's rounds over blocks of vectors along a Hilbert curve, with zone maps that leave centroids out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, small_batches, text_partitions

#: Integer components must stay below this, so that squared distances fit a long.
_MOST = 1 << 27


def kept_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id and embedding of the rows whose vector has ``dims`` components, none of them null or not finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.when(F.size("embedding") == dims, finite).otherwise(False)
    return small_batches(vectors).where(F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def _integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype("f8") * scale)
    if len(x) and np.abs(x).max() >= _MOST:
        raise ValueError(f"components times {scale} must stay below {_MOST}: squared distances wouldn't fit a long")
    return x.astype("i8").reshape(-1, dims)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of points (rows of cell numbers below ``2 ** bits``) on the Hilbert curve, as rows of bytes that sort like them.

    The numbers are brought to the curve's transposed form from the highest bit down (Skilling's construction); one bit of each
    dimension after the other then makes the key.
    """
    x = cells.astype("u4").T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for d in range(n):
            on = (x[d] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low).astype("u4")
            x[0] ^= np.where(on, low, swap)
            x[d] ^= swap
    for d in range(1, n):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], "u4")
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype("u1"), axis=1)


def _spread(kept: DataFrame, dims: int, scale: int) -> list[tuple]:
    """(least, greatest, variance) of each dimension: ``dims`` rows."""

    def run(batches):
        low, high = np.full(dims, np.iinfo("i8").max), np.full(dims, np.iinfo("i8").min)
        n, total, squares = 0, np.zeros(dims), np.zeros(dims)
        for b in batches:
            x = _integers(b.column(0), dims, scale)
            if len(x):
                low, high, n = np.minimum(low, x.min(0)), np.maximum(high, x.max(0)), n + len(x)
                total, squares = total + x.sum(0), squares + (x.astype("f8") ** 2).sum(0)
        if n:
            cols = [np.arange(dims, dtype="i4"), low, high, np.full(dims, float(n)), total, squares]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["d", "low", "high", "n", "s", "q"])

    parts = map_batches(kept.select("embedding"), run, "d int, low long, high long, n double, s double, q double")
    mean = F.sum("s") / F.sum("n")
    return parts.groupBy("d").agg(F.min("low"), F.max("high"), F.sum("q") / F.sum("n") - mean * mean).orderBy("d").collect()


def zone_blocks(kept: DataFrame, dims: int, scale: int, size: int = 256, bits: int = 4) -> DataFrame:
    """Blocks of at most ``size`` vectors that lie together on a Hilbert curve: ids, points (all components), low and high (the
    block's box), sums (by component). Dimensions take part in the order of their variance; ties on the curve are dealt by a hash of
    vec_id, so that many equal vectors share no partition."""
    spread = _spread(kept, dims, scale)
    low, width = (np.array([f(r) for r in spread], "f8") for f in (lambda r: r[1], lambda r: max(1, r[2] - r[1] + 1)))
    order = np.argsort([-r[3] for r in spread], kind="stable") if spread else np.arange(dims)

    def place(batches):
        for b in batches:
            x = _integers(b.column(1), dims, scale)
            if len(x):
                cells = np.minimum((x - low) / width * (1 << bits), (1 << bits) - 1).astype("u4")[:, order]
                keys = hilbert_keys(cells, bits)
                points = pa.FixedSizeListArray.from_arrays(pa.array(x.astype("i4").ravel()), dims).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), points, pa.array([k.tobytes() for k in keys], pa.binary())], ["vec_id", "point", "key"])

    def block(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, dims)
            for at in range(0, len(x), size):
                p, ids = x[at : at + size], b.column(0).slice(at, size)
                values = [ids, pa.array(p.ravel()), pa.array(p.min(0)), pa.array(p.max(0)), pa.array(p.sum(0, dtype="i8"))]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                rows = [pa.ListArray.from_arrays([0, len(v)], v.cast(k)) for v, k in zip(values, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(rows, ["ids", "points", "low", "high", "sums"])

    placed = map_batches(kept, place, "vec_id long, point array<int>, key binary")
    along = placed.repartitionByRange(text_partitions(kept), "key", F.xxhash64("vec_id")).sortWithinPartitions("key")
    return materialize(map_batches(along, block, "ids array<long>, points array<int>, low array<int>, high array<int>, sums array<long>"), "zones")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Ascending numbers of the centroids that can be nearest to a point of the box: those whose least squared distance from the box
    isn't above another's greatest."""
    least = (np.maximum(np.maximum(low - centroids, centroids - high), 0) ** 2).sum(1)
    most = (np.maximum(np.abs(centroids - low), np.abs(centroids - high)) ** 2).sum(1)
    return np.flatnonzero(least <= most.min())


def _nearest(batches, centroids: np.ndarray) -> Iterator[tuple]:
    """For each block: its ids, points, sums, the candidates, and each point's place among them (None where there is one only)."""
    dims = centroids.shape[1]
    for b in batches:
        columns = [b.column(k) for k in range(b.num_columns)]
        for i in range(b.num_rows):
            ids, flat, low, high, sums = (c[i].values for c in columns)
            x = flat.to_numpy().reshape(-1, dims).astype("i8")
            able = candidates(low.to_numpy().astype("i8"), high.to_numpy().astype("i8"), centroids)
            at = None
            if len(able) > 1:
                c = centroids[able]
                at = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)  # ties: the first, and so the smallest number
            yield ids, x, sums.to_numpy(), able, at


def _totals(blocks: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """(cluster, dimension) -> sum of the components; (cluster, -1) -> number of vectors. Added up in each task, then by key."""
    k, dims = centroids.shape

    def run(batches):
        total = np.zeros((k, dims + 1), "i8")
        for _, x, sums, able, at in _nearest(batches, centroids):
            if at is None:
                total[able[0], :dims] += sums
                total[able[0], dims] += len(x)
            else:
                for j in np.unique(at):
                    mine = x[at == j]
                    total[able[j], :dims] += mine.sum(0)
                    total[able[j], dims] += len(mine)
        c, d = np.nonzero(total)
        where = np.where(d == dims, -1, d)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(where, pa.int32()), pa.array(total[c, d])], ["c", "d", "total"])

    parts = map_batches(small_batches(blocks, 64), run, "c int, d int, total long")
    found = parts.groupBy("c", "d").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
    return {(r.c, r.d): int(r.total) for r in found.collect()}  # k * (dims + 1) numbers


def first_centroids(kept: DataFrame, k: int, scale: int, seed: str) -> np.ndarray:
    """Integer components of the ``k`` vectors with the smallest SHA-256 of ``seed`` and vec_id; rows of null vec_id don't start a cluster."""
    name = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id is not null").withColumn("h", name).orderBy("h", "embedding").limit(k).collect()
    return np.array([np.floor(np.array(r.embedding, "f8") * scale) for r in first], "i8")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3:") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector with ``dims`` finite components.

    Components count as ``floor(scale * x)``, and all sums are exact. Vectors are written once in blocks along a Hilbert curve, each with
    its box; a round compares a block's vectors with those centroids only that its box leaves, and takes the block's stored sums
    where it leaves one. A round sends ``k`` centroids out and gets sums back, ``k * (dims + 1)`` numbers of each task.

    Other vectors are left out: null ones, those of another length, with null or non-finite components. Rows are vectors of their own, so
    repeated ones are repeated; those of a null vec_id are assigned, but start no cluster; equal distances go to the smaller number.
    With fewer than ``k`` vectors there are as many clusters; an empty table gives an empty one; other columns are ignored. Components
    beyond 2 ** 27 fail with a ValueError.
    """
    kept = kept_vectors(vectors, dims)
    centroids = first_centroids(kept, k, scale, seed)
    none = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], none)
    blocks = zone_blocks(kept, dims, scale)
    for _ in range(rounds):
        total = _totals(blocks, centroids)
        centroids = np.array([
            [total.get((c, d), 0) // total[c, -1] for d in range(dims)] if (c, -1) in total else row for c, row in enumerate(centroids.tolist())
        ], "i8")

    def assign(batches):
        for ids, x, _, able, at in _nearest(batches, centroids):
            own = able[np.zeros(len(x), "i8") if at is None else at]
            far = ((x - centroids[own]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array(far)], ["vec_id", "cluster", "distance"])

    found = materialize(map_batches(small_batches(blocks, 64), assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}

    def of(values: list, kind: str) -> Column:
        return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>"), F.col("cluster"))

    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return found.select(
        "vec_id", "cluster", "distance", of([inertia.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(names, "string").alias("centroid_sha256"),
    )
