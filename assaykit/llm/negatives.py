"""Hard-negative mining: exact searches for positives and negatives behind intervals of rotated one-bit codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize, small_batches

#: Rows and anchors whose intervals are computed at once: 1 MB an array.
_ROWS, _ANCHORS = 4096, 32
#: A window of scores that holds none.
_NOTHING = (1 << 62, -(1 << 62))
CODES = "vec_id long, label long, point array<long>, norm double, code array<long>, alignment array<double>, reach double, rest double"


def takes_part() -> Column:
    """Whether a row has a vec_id, a label, and a vector without null or non-finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine that has the same linear algebra; any will do for right results."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def padded(dims: int) -> int:
    """Components of a rotated vector: whole words of 64 signs."""
    return max(64, -(-dims // 64) * 64)


def encode(units: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sign codes (levels x rows x words), alignments (levels x rows), length of what they add up to and of what is left (rows) of rotated
    unit vectors.

    A level's code is the signs of what the levels before left, as a unit vector; its alignment is that rest's inner product with it, and
    the rest loses this share. So a vector is the sum of alignments times codes, but for a rest of known length.
    """
    rest, codes, alignments = units.copy(), [], []
    for _ in range(levels):
        on = rest >= 0
        sign = np.where(on, 1.0, -1.0) / np.sqrt(units.shape[1])
        along = (rest * sign).sum(1)
        rest -= along[:, None] * sign
        codes.append(np.packbits(on, axis=1).view("<u8"))
        alignments.append(along)
    return np.array(codes), np.array(alignments), np.sqrt(((units - rest) ** 2).sum(1)), np.sqrt((rest**2).sum(1))


def _points(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Integer components, with zeros behind shorter vectors."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype("f8") * scale)
    if len(flat) and np.abs(flat).max() >= 1 << 62:
        raise ValueError(f"components times {scale} don't fit a long")
    sizes = np.diff(column.offsets.to_numpy())
    x = np.zeros((len(sizes), dims), "i8")
    x[np.arange(dims) < sizes[:, None]] = flat.astype("i8")
    return x


def stored_codes(vectors: DataFrame, scale: int, dims: int, levels: int) -> DataFrame:
    """The written table of codes: a row for each vector that takes part, with its integer components, norm, sign codes, alignments and
    the share of its length that the codes leave."""
    turn = rotation(padded(dims))

    def run(batches):
        for b in batches:
            x = _points(b.column(2), dims, scale)
            if not len(x):
                continue
            norm = np.sqrt((x.astype("f8") ** 2).sum(1))
            wide = np.zeros((len(x), len(turn)))
            wide[:, :dims] = x / np.where(norm > 0, norm, 1)[:, None]
            codes, along, reach, rest = encode(wide @ turn, levels)
            lists = lambda a, kind: pa.array(list(a.reshape(len(x), -1)), pa.list_(kind))
            cols = [lists(x, pa.int64()), pa.array(norm), lists(codes.transpose(1, 0, 2).copy().view("i8"), pa.int64()), lists(along.T.copy(), pa.float64()), pa.array(reach), pa.array(rest)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["vec_id", "label", "point", "norm", "code", "alignment", "reach", "rest"])

    rows = small_batches(vectors).where(takes_part()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    return materialize(map_batches(rows, run, CODES), "codes")


class Codes:
    """Rows of the code table as arrays."""

    def __init__(self, batch: pa.RecordBatch, levels: int):
        flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
        n = batch.num_rows
        self.ids, self.labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
        self.norm, self.reach, self.rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("norm", "reach", "rest"))
        self.points = flat("point").reshape(n, -1)
        self.code = flat("code").view("u8").reshape(n, levels, -1)
        self.alignment = flat("alignment").reshape(n, levels)

    def part(self, at) -> Codes:
        out = object.__new__(type(self))
        out.__dict__ = {k: v[at] for k, v in self.__dict__.items()}
        return out


class Anchors:
    """Rotated anchors in bit planes: each component is ``low + step * u`` but for an error of known length, ``u`` of ``bits`` bits."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, bits: int = 6):
        self.ids, self.labels, self.points = ids, labels, points
        dims = padded(points.shape[1])
        wide = np.zeros((len(ids), dims))
        wide[:, : points.shape[1]] = points
        q = wide @ rotation(dims)
        self.low = q.min(1)
        self.step = np.maximum((q.max(1) - self.low) / ((1 << bits) - 1), 1e-300)
        u = np.rint((q - self.low[:, None]) / self.step[:, None]).astype("i8")
        near = self.low[:, None] + self.step[:, None] * u
        self.total, self.error, self.norm = near.sum(1), np.sqrt(((q - near) ** 2).sum(1)), np.sqrt((q**2).sum(1))
        self.planes = np.array([np.packbits((u >> p) & 1 == 1, axis=1).view("<u8") for p in range(bits)])

    def bounds(self, at: np.ndarray, rows: Codes) -> tuple[np.ndarray, np.ndarray]:
        """(low, high): what the inner products of the anchors ``at`` (down) with ``rows`` (across) can't be beyond.

        Counts of common bits give the products of the quantised anchor with each code. The true product differs by the anchor's
        quantisation error times the length of what the codes add up to, and by what the codes leave of the row times the anchor's length (Cauchy-Schwarz).
        """
        shape, width = (len(at), len(rows.ids)), np.sqrt(self.planes.shape[2] * 64.0)
        both, count, word_sum = np.empty(shape, "u8"), np.empty(shape, "u1"), np.empty(shape, "u4")
        product, term = np.zeros(shape), np.empty(shape)
        weight = rows.alignment * (2 / width) * rows.norm[:, None]
        for level in range(weight.shape[1]):
            word_sum[:] = 0
            for plane in self.planes[::-1]:  # from the highest bit down
                np.left_shift(word_sum, 1, out=word_sum)
                for word in range(plane.shape[1]):
                    np.bitwise_and(plane[at, word][:, None], rows.code[:, level, word], out=both)
                    np.add(word_sum, np.bitwise_count(both, out=count), out=word_sum)
            product += np.multiply(word_sum, weight[:, level], out=term)
        # what depends on the anchor or the row alone: products of two columns and two rows
        ones = np.bitwise_count(rows.code).sum(2, dtype="f8")
        estimate = np.column_stack([self.low[at], -self.total[at]]) @ np.array([(weight * ones).sum(1), weight.sum(1) / 2])
        estimate += np.multiply(product, self.step[at][:, None], out=product)
        slack = np.array([rows.reach, rows.rest + 1e-9]) * rows.norm
        half = np.column_stack([self.error[at], self.norm[at]]) @ slack + 1e-6
        return estimate - half, estimate + half


def _scores(anchor: np.ndarray, points: np.ndarray, exact_floats: bool) -> np.ndarray:
    """Integer inner products; in floats where no sum reaches 2 ** 53."""
    return (points.astype("f8") @ anchor.astype("f8")).astype("i8") if exact_floats else points @ anchor


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The ``most`` best (score, vec_id), in order."""
    if len(scores) > 4 * most:
        edge = np.partition(scores, len(scores) - most)[len(scores) - most]
        keep = scores >= edge
        scores, ids = scores[keep], ids[keep]
    at = np.lexsort((ids, -scores))[:most]
    return list(zip(scores[at].tolist(), ids[at].tolist(), strict=True))


def _merge(a: list, b: list, most: int) -> list:
    return sorted([*a, *b], key=lambda x: (-x[0], x[1]))[:most] if a else b


def _blocks(rows: Codes, size: int) -> Iterator[Codes]:
    for at in range(0, len(rows.ids), size):
        yield rows.part(slice(at, at + size))


def _positives(codes: DataFrame, anchors: Anchors, levels: int, most: int, floats: bool) -> DataFrame:
    """a (number of the anchor), score, vec_id: each task's best rows of the anchor's label."""
    held = codes.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        a, best = held.value, {}
        order = np.argsort(a.labels, kind="stable")
        labels = a.labels[order]
        for b in batches:
            whole = Codes(b, levels)
            for label in np.unique(whole.labels):
                mine = order[np.searchsorted(labels, label) : np.searchsorted(labels, label, "right")]
                if not len(mine):
                    continue
                for rows in _blocks(whole.part(whole.labels == label), _ROWS):
                    for some in np.array_split(mine, -(-len(mine) // _ANCHORS)):
                        low, high = a.bounds(some, rows)
                        own = a.ids[some][:, None] == rows.ids
                        low[own], high[own] = -np.inf, -np.inf
                        if low.shape[1] > most:  # so many rows are as good as the least of them surely is
                            sure = np.partition(low, low.shape[1] - most, axis=1)[:, low.shape[1] - most]
                        else:
                            sure = np.full(len(some), -np.inf)
                        for i, x in enumerate(some.tolist()):
                            known = best.get(x, [])
                            edge = max(sure[i], known[-1][0] if len(known) == most else -np.inf)
                            at = np.flatnonzero((high[i] >= edge) & ~own[i])
                            if len(at):
                                found = _best(_scores(a.points[x], rows.points[at], floats), rows.ids[at], most)
                                best[x] = _merge(known, found, most)
        yield from _batches([(x, s, v) for x, rows in best.items() for s, v in rows], ["a", "score", "vec_id"])

    return map_batches(small_batches(codes, _ROWS), run, "a long, score long, vec_id long")


def _batches(rows: list[tuple], names: list[str], size: int = 100_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), size):
        columns = zip(*rows[at : at + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _negatives(codes: DataFrame, anchors: Anchors, windows: dict[int, list[tuple]], levels: int, most: int, floats: bool) -> DataFrame:
    """a, positive (its place among the anchor's), score, vec_id: each task's best rows of other labels in each window of scores."""
    held = codes.sparkSession.sparkContext.broadcast((anchors, windows))

    def run(batches):
        a, windows = held.value
        best = {}
        known = np.array(sorted(windows), "i8")
        least = np.array([min(w[0] for w in windows[x]) for x in known.tolist()], "f8")  # rises as windows fill
        greatest = np.array([max(w[1] for w in windows[x]) for x in known.tolist()], "f8")
        for b in batches:
            for rows in _blocks(Codes(b, levels), _ROWS):
                for part in np.array_split(np.arange(len(known)), -(-len(known) // _ANCHORS)) if len(known) else ():
                    some = known[part]
                    low, high = a.bounds(some, rows)
                    may = (high >= least[part][:, None]) & (low <= greatest[part][:, None]) & (a.labels[some][:, None] != rows.labels)
                    for i in np.flatnonzero(may.any(1)).tolist():
                        x, at = int(some[i]), np.flatnonzero(may[i])
                        scores, ids = _scores(a.points[x], rows.points[at], floats), rows.ids[at]
                        order = np.lexsort((ids, -scores))
                        scores, ids = scores[order], ids[order]
                        edges = []
                        for j, (bottom, top) in enumerate(windows[x]):
                            first = np.searchsorted(-scores, -top)
                            got = [(s, v) for s, v in zip(scores[first : first + most].tolist(), ids[first : first + most].tolist(), strict=True) if s >= bottom]
                            if got:
                                best[x, j] = _merge(best.get((x, j), []), got, most)
                            now = best.get((x, j), [])
                            edges.append(max(bottom, now[-1][0]) if len(now) == most else bottom)
                        least[part[i]] = min(edges)
        yield from _batches([(x, j, s, v) for (x, j), rows in best.items() for s, v in rows], ["a", "positive", "score", "vec_id"])

    return map_batches(small_batches(codes, _ROWS), run, "a long, positive long, score long, vec_id long")


def _slices(anchors: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and points of at most ``size`` anchors at a time, in no order."""
    held: list = []
    for r in anchors.select("vec_id", "label", "point").toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield _columns(held)
            held = []
    if held:
        yield _columns(held)


def _columns(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([r.vec_id for r in rows]), np.array([r.label for r in rows]), np.array([r.point for r in rows], "i8")


def mine_negatives(vectors: DataFrame, anchors: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   levels: int = 4, slice_size: int = 16_384) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that ``anchors`` selects (default: vec_id
    divisible by 50).

    A score is the inner product of ``floor(scale * x)``. An anchor's positives are its best ``positives`` other rows of its label (ties:
    smaller vec_id); a positive's negatives are the best ``negatives`` rows of other labels whose score is ``low`` to ``high`` hundredths
    of the positive's. Both are exact: rotated one-bit codes (``levels`` of them, each of what the one before left) bound every score by
    an interval, and only rows whose interval reaches what is asked for are scored.

    Codes are written once. Anchors go out ``slice_size`` at a time (some 20 MB), each slice in two passes over the codes, which
    are never shuffled; a task sends on its best rows for each anchor and no others, and a window takes the best of those.

    Rows without vec_id, label or vector, or with a null or non-finite component take no part. Shorter vectors have zeros behind their end.
    Rows are rows of their own, so repeated ones are found and searched for again; rows with the anchor's vec_id are never its positives.
    A negative positive score has no negatives. Empty tables give empty ones; other columns are ignored. Scores that a long
    can't hold fail with a ValueError.
    """
    spark = vectors.sparkSession
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    dims = vectors.where(takes_part()).agg(F.max(F.size("embedding"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], kind)
    codes = stored_codes(vectors, scale, max(1, dims), levels)
    longest = codes.agg(F.max("norm")).first()[0] ** 2
    if longest * (1 + 1e-9) >= 1 << 63:
        raise ValueError("inner products of these vectors don't fit a long")
    floats = longest * (1 + 1e-9) < 1 << 53
    found = None
    for ids, labels, points in _slices(codes.where(F.col("vec_id") % 50 == 0 if anchors is None else anchors), slice_size):
        one = _mine_slice(codes, Anchors(ids, labels, points), positives, negatives, low, high, levels, floats)
        found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], kind) if found is None else found


def _mine_slice(codes: DataFrame, anchors: Anchors, positives: int, negatives: int, low: int, high: int, levels: int, floats: bool) -> DataFrame:
    first = Window.partitionBy("a").orderBy(F.desc("score"), "vec_id")
    near = _positives(codes, anchors, levels, positives, floats).withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    of: dict[int, list[tuple]] = {}
    for r in near.collect():  # at most ``positives`` for each anchor of the slice
        of.setdefault(r.a, []).append((r.place, r.score, r.vec_id))
    of = {a: [(s, v) for _, s, v in sorted(rows)] for a, rows in of.items()}
    # scores from low to high hundredths of the positive's: none if that is negative
    windows = {a: [(-(-low * s // 100), high * s // 100) if s >= 0 else _NOTHING for s, _ in rows] for a, rows in of.items()}
    windows = {a: rows for a, rows in windows.items() if rows[0] != _NOTHING}
    best = Window.partitionBy("a", "positive").orderBy(F.desc("score"), "vec_id")
    far = _negatives(codes, anchors, windows, levels, negatives, floats).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    rows = [(a, j, int(anchors.ids[a]), v, s) for a, mine in of.items() if a in windows for j, (s, v) in enumerate(mine)]
    named = codes.sparkSession.createDataFrame(rows, "a long, positive long, anchor_id long, positive_id long, positive_score long")
    answer = far.join(F.broadcast(named), ["a", "positive"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
    return materialize(answer, "negatives")
