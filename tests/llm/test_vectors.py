"""Operators on vectors against brute force, with rows that take no part, ties and repeated rows."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from assaykit.llm import negatives, zonecluster

KIND = "vec_id long, embedding array<float>, label int, score double, cluster string, a long, rank int"


def vectors(dims, n=260, seed=3):
    """Clusters, exact ties (small whole numbers), one vector that a third of the rows hold, repeated rows, and rows of no use."""
    rng = random.Random(seed)
    hot = [rng.choice((-1, 0, 1, 2)) / 4 for _ in range(dims)]
    rows = []
    for i in range(n):
        v = list(hot) if i % 3 == 0 else [rng.choice((-3, -1, 0, 1, 2, 5)) / 4 for _ in range(dims)] if i % 3 == 1 else [rng.gauss(0, 0.3) for _ in range(dims)]
        rows.append((i * 5, v, i % 4))
    rows += [rows[10], rows[10], rows[50], (None, hot, 1), (5001, None, 1), (5002, hot, None), (5003, [*hot[:-1], None], 1), (5004, [*hot[:-1], math.nan], 1),
             (5005, [*hot[:-1], math.inf], 2), (5006, [], 1), (5007, hot[:-1], 2), (5050, [0.0] * dims, 3)]
    return [(*r, 1.0, "c", 1, 2) for r in rows]


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale):
    return [math.floor(float(np.float32(x)) * scale) for x in v]


def brute_negatives(rows, scale=256, step=50):
    kept = [(i, whole(v, scale), c) for i, v, c in rows if i is not None and c is not None and finite(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    out = []
    for i, v, c in kept:
        if i % step:
            continue
        scored = sorted((-dot(v, w), j, d) for j, w, d in kept if j != i)
        for s, j, _ in [x for x in scored if x[2] == c][:5]:
            good = [(n, x) for n, x, d in scored if d != c and 50 * -s <= 100 * -n <= 95 * -s][:3]
            out += [(i, j, r, x, -s, -n) for r, (n, x) in enumerate(good, 1)]
    return sorted(out)


def brute_clusters(rows, dims, k, rounds, scale=1024, seed="3:"):
    kept = [(i, whole(v, scale)) for i, v, _ in rows if finite(v) and len(v) == dims]
    first = sorted((hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]
    if not kept:
        return []

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = lambda j: sum(d for _, d, c in found if c in j)
    name = lambda j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
    return [(i, c, d, total([c]), total(range(k)), name(c)) for i, d, c in found]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("dims", [3, 64, 70])
def test_negatives_equal_brute_force(spark, dims):
    rows = vectors(dims)
    frame = spark.createDataFrame(rows, KIND).repartition(5)
    want = brute_negatives([r[:3] for r in rows])
    assert ordered(negatives.mine_negatives(frame).collect()) == ordered(want) and len(want) > 20
    assert ordered(negatives.mine_negatives(frame, slice_size=3, levels=1).collect()) == ordered(want)


def test_negatives_of_nothing(spark):
    frame = spark.createDataFrame(vectors(4), KIND)
    for few in (frame.limit(0), frame.where("label is null"), frame.where("vec_id = 50"), frame.where("vec_id % 50 != 0")):
        assert negatives.mine_negatives(few).collect() == []
    with pytest.raises(ValueError, match="long"):
        negatives.mine_negatives(spark.createDataFrame([(0, [1e9, 1.0], 1), (1, [1e9, 1.0], 1)], "vec_id long, embedding array<double>, label int"))


def test_intervals_hold_and_tighten():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.standard_normal((300, 90))).astype("i8")
    norm = np.sqrt((x.astype("f8") ** 2).sum(1))
    wide = np.zeros((300, negatives.padded(90)))
    wide[:, :90] = x / norm[:, None]
    a = negatives.Anchors(np.arange(40), np.zeros(40, "i8"), x[:40])
    true, widths = x[:40] @ x.T, []
    for levels in (1, 2, 4):
        codes, along, reach, rest = negatives.encode(wide @ negatives.rotation(128), levels)
        names = ["vec_id", "label", "point", "norm", "code", "alignment", "reach", "rest"]
        lists = [pa.array(list(v.reshape(300, -1))) for v in (x, codes.transpose(1, 0, 2).copy().view("i8"), along.T.copy())]
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(300)), pa.array(np.zeros(300, "i8")), lists[0], pa.array(norm), lists[1], lists[2], pa.array(reach), pa.array(rest)], names)
        low, high = a.bounds(np.arange(40), negatives.Codes(batch, levels))
        assert (low <= true).all() and (true <= high).all()
        widths.append((high - low).mean())
    assert widths[0] > 1.4 * widths[1] > 1.8 * widths[2]


@pytest.mark.parametrize("n", [260, 6, 1])
def test_clusters_equal_brute_force(spark, n):
    rows = vectors(64)[: n if n < 20 else None]
    frame = spark.createDataFrame(rows, KIND).repartition(5)
    want = brute_clusters([r[:3] for r in rows], 64, 8, 10)
    assert ordered(zonecluster.cluster(frame).collect()) == ordered(want) and len(want) >= n


def test_clusters_of_nothing_and_of_few_dimensions(spark):
    rows = vectors(3)
    frame = spark.createDataFrame(rows, KIND)
    assert zonecluster.cluster(frame).collect() == [] and zonecluster.cluster(frame.limit(0), dims=3).collect() == []
    assert zonecluster.cluster(frame.where("vec_id is null"), dims=3).collect() == []
    assert ordered(zonecluster.cluster(frame, dims=3, k=5, rounds=3).collect()) == ordered(brute_clusters([r[:3] for r in rows], 3, 5, 3))
    with pytest.raises(Exception, match="must stay below"):
        zonecluster.cluster(spark.createDataFrame([(0, [1e9])], "vec_id long, embedding array<double>"), dims=1).collect()


@pytest.mark.parametrize(("dims", "bits"), [(1, 3), (2, 4), (3, 3), (5, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = [k.tobytes() for k in zonecluster.hilbert_keys(cells, bits)]
    along = cells[sorted(range(len(cells)), key=keys.__getitem__)].astype(int)
    assert len(set(keys)) == len(cells) and (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def test_boxes_leave_the_nearest_centroids():
    rng = np.random.default_rng(2)
    left = 0
    for _ in range(200):
        points = rng.integers(-5, 6, 4) + rng.integers(0, 4, (20, 4))
        centroids = rng.integers(-8, 9, (6, 4))
        able = zonecluster.candidates(points.min(0), points.max(0), centroids)
        far = ((points[:, None] - centroids) ** 2).sum(2)
        assert set(np.unique(np.nonzero(far == far.min(1)[:, None])[1])) <= set(able.tolist())
        left += len(able)
    assert left < 0.8 * 200 * 6


def test_blocks_hold_all_vectors_and_their_boxes(spark):
    frame = spark.createDataFrame(vectors(8), KIND).repartition(4)
    kept = zonecluster.kept_vectors(frame, 8)
    blocks = zonecluster.zone_blocks(kept, 8, 1024, size=16).collect()
    assert sorted(str(i) for b in blocks for i in b.ids) == sorted(str(r.vec_id) for r in kept.collect())
    for b in blocks:
        x = np.array(b.points).reshape(-1, 8)
        assert 0 < len(x) == len(b.ids) <= 16
        assert (x.min(0).tolist(), x.max(0).tolist(), x.sum(0).tolist()) == (b.low, b.high, b.sums)
