"""MinHash near-duplicates: b-bit signatures, and a multi-index Hamming join that finds all pairs under the signature distance."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize, text_frame
from .components import connected_components
from .jaccard import parity_sketch, shingle_set, small, verify

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Index:
    """How signatures are split: ``chunks`` of ``width`` positions of 16 bits, of which ``errors`` may differ.

    If two signatures differ in at most ``threshold`` positions, some chunk differs in ``errors`` at most, or the chunks together would
    have more differences. With 64 positions and a threshold of 31, two sets of a Jaccard similarity of 0.8 differ in more with a
    probability of 8.2e-8.
    """

    chunks: int = 16
    width: int = 4
    errors: int = 1

    @property
    def positions(self) -> int:
        return self.chunks * self.width

    @property
    def threshold(self) -> int:
        return self.chunks * (self.errors + 1) - 1


def signature(hashes: np.ndarray, positions: int) -> np.ndarray:
    """The last 16 bits of the least hash of a set (not an empty one) under each of ``positions`` hash functions."""
    rng = np.random.Generator(np.random.PCG64(12))
    flip, factor = (rng.integers(0, 1 << 63, positions, dtype="u8")[:, None] for _ in range(2))
    least = np.full(positions, np.iinfo("u8").max, "u8")
    for at in range(0, len(hashes), 4096):
        x = (hashes[at : at + 4096] ^ flip) * (factor | np.uint64(1))
        x ^= x >> np.uint64(32)
        x *= _MIX
        least = np.minimum(least, x.min(1))
    return (least & np.uint64(0xFFFF)).astype("<u2")


def chunk_keys(signatures: np.ndarray, index: Index) -> np.ndarray:
    """For each signature (a row), a key for each chunk and each way to leave ``errors`` of its positions out: two chunks with that many
    differences at most agree in one."""
    x, keys = signatures.astype("u8").reshape(len(signatures), index.chunks, index.width), []
    for k, kept in enumerate(itertools.combinations(range(index.width), index.width - index.errors)):
        key = np.full((len(x), index.chunks), np.uint64(k), "u8") + np.arange(index.chunks, dtype="u8") * np.uint64(1 << 20)
        for d in kept:
            key = (key ^ (key >> np.uint64(31))) * _MIX + x[:, :, d]
        keys.append((key ^ (key >> np.uint64(29))) * _MIX)
    return np.concatenate(keys, axis=1)


def signatures(docs: DataFrame, size: int, index: Index) -> DataFrame:
    """doc_id, n (shingles), d1, d2 (digest of the set), signature and parity sketch (null for sets without shingles); one row per row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import xxhash

        for b in batches:
            n, d1, d2, marks, sketches = [], [], [], [], []
            for text in b.column(1).to_pylist():
                h = shingle_set(text, size)
                n.append(len(h))
                for seed, d in ((1, d1), (2, d2)):
                    d.append(xxhash.xxh3_64_intdigest(h.tobytes(), seed) - (1 << 63))
                marks.append(signature(h, index.positions).tobytes() if len(h) else None)
                sketches.append(parity_sketch(h).tobytes() if len(h) else None)
            longs = [pa.array(x, pa.int64()) for x in (n, d1, d2)]
            yield pa.RecordBatch.from_arrays([b.column(0), *longs, pa.array(marks, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "n", "d1", "d2", "signature", "sketch"])

    return map_batches(text_frame(docs), run, f"doc_id {kind}, n long, d1 long, d2 long, signature binary, sketch binary")


def _postings(reps: DataFrame, index: Index) -> DataFrame:
    """t (key), v: one row for each key of each representative."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = chunk_keys(np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(b.num_rows, -1), index).view("i8")
                at = np.arange(b.num_rows + 1, dtype="i4") * keys.shape[1]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(keys.ravel()))], ["v", "keys"])

    return map_batches(reps.select("v", "signature"), run, "v long, keys array<long>").select(F.explode("keys").alias("t"), "v")


def bounded_pairs(a: dict, b: dict, percent: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of the pairs of different components that pass the bounds of size, sketch and signature distance."""
    i, j = np.nonzero((a["c"][:, None] != b["c"]) & (100 * np.minimum(a["n"][:, None], b["n"]) >= percent * np.maximum(a["n"][:, None], b["n"])))
    return near(a, b, i, j, percent, threshold)


def near(a: dict, b: dict, i: np.ndarray, j: np.ndarray, percent: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i in a, j in b), those whose sketches differ in no more bits than their sets may in shingles, and whose signatures
    differ in ``threshold`` positions at most."""
    kept = []
    for s in range(0, len(i), 1 << 15):  # some MB at a time
        p, q = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
        sizes = a["n"][p] + b["n"][q]
        allowed = sizes - 2 * -(-percent * sizes // (100 + percent))
        good = np.bitwise_count(a["sketch"][p] ^ b["sketch"][q]).sum(1, dtype="i8") <= allowed
        p, q = p[good], q[good]
        good = (a["signature"][p] != b["signature"][q]).sum(1) <= threshold
        kept.append((p[good], q[good]))
    return (i, j) if not kept else tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def _columns(b: pa.RecordBatch, names: dict[str, str]) -> dict:
    """Arrays of a batch: numbers, signatures as rows of 16-bit numbers, sketches as rows of 64-bit ones."""
    out = {}
    for name, column in names.items():
        values = b.column(column)
        if name in ("signature", "sketch"):
            out[name] = np.frombuffer(b"".join(values.to_pylist()), "<u2" if name == "signature" else "<u8").reshape(b.num_rows, -1)
        else:
            out[name] = values.to_numpy(zero_copy_only=False)
    return out


def _near_pairs(pairs: DataFrame, features: DataFrame, percent: int, threshold: int) -> DataFrame:
    """u, v, distance of the pairs (u, v) that pass all bounds; features are joined to both sides."""
    left, right = (features.select(*[F.col(c).alias(f"{c}_{side}") for c in ("v", "n", "sketch", "signature")]) for side in "uv")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (_columns(b, {c: f"{c}_{side}" for c in ("n", "sketch", "signature")}) for side in "uv")
            rows = np.flatnonzero(100 * np.minimum(x["n"], y["n"]) >= percent * np.maximum(x["n"], y["n"]))
            rows, _ = near(x, y, rows, rows, percent, threshold)
            far = (x["signature"][rows] != y["signature"][rows]).sum(1).astype("i4")
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(rows)) for c in ("u", "v")), pa.array(far)], ["u", "v", "distance"])

    both = pairs.join(left, pairs.u == left.v_u).join(right, pairs.v == right.v_v).drop("v_u", "v_v")
    return map_batches(both, run, "u long, v long, distance int")


def first_met(a: dict, b: dict, i: np.ndarray, j: np.ndarray, t: int, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i in a, j in b), those whose least common key is ``t``. Lists of the same members are one, of the least key; so a pair
    has a list under its least common key, and comes from there only."""
    if not len(i):
        return i, j
    (x, at), (y, to) = (np.unique(k, return_inverse=True) for k in (i, j))
    p, q = (chunk_keys(side["signature"][rows], index).view("i8") for side, rows in ((a, x), (b, y)))
    good = np.empty(len(i), bool)
    for s in range(0, len(i), 4096):
        left, right = p[at[s : s + 4096]], q[to[s : s + 4096]]
        good[s : s + 4096] = np.where(left == right, left, np.iinfo("i8").max).min(1) == t
    return i[good], j[good]


def _cells(batches: Iterator[pa.RecordBatch], percent: int, index: Index) -> Iterator[pa.RecordBatch]:
    """Pairs under all bounds of each cell (rows of one t, i, j lie together): of one block with itself, or of two blocks."""
    held: list[pa.RecordBatch] = []

    def pairs(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = _columns(rows, {c: c for c in ("t", "i", "j", "block", "v", "c", "n", "sketch", "signature")})
        change = np.flatnonzero((np.diff(x["t"]) != 0) | (np.diff(x["i"]) != 0) | (np.diff(x["j"]) != 0)) + 1
        us, vs = [], []
        for s, e in zip([0, *change.tolist()], [*change.tolist(), len(x["t"])], strict=True):
            cell = {k: x[k][s:e] for k in ("v", "c", "n", "sketch", "signature", "block")}
            a = b = cell
            if x["i"][s] != x["j"][s]:
                a, b = ({k: w[cell["block"] == x[side][s]] for k, w in cell.items()} for side in "ij")
            i, j = first_met(a, b, *bounded_pairs(a, b, percent, index.threshold), x["t"][s], index)
            us.append(np.minimum(a["v"][i], b["v"][j]))
            vs.append(np.maximum(a["v"][i], b["v"][j]))
        found = np.unique(np.array([np.concatenate(us), np.concatenate(vs)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["u", "v"])

    def last_cell(b: pa.RecordBatch) -> int:
        """Where the batch's last cell begins."""
        same = np.ones(b.num_rows, bool)
        for c in ("t", "i", "j"):
            x = b.column(c).to_numpy()
            same &= x == x[-1]
        return int(b.num_rows - np.argmin(same[::-1])) if not same.all() else 0

    for b in batches:
        if b.num_rows:
            held.append(b)
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            at = last_cell(whole)
            if at:
                yield from pairs(whole.slice(0, at))
            held = [whole.slice(at)]
    if held:
        yield from pairs(held[0])


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, index: Index = Index(), list_size: int = 16, tries: int = 4, block: int = 1024) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included) and kept of each row.

    Two documents link when the Jaccard similarity of their sets of ``size``-word shingles is ``percent`` hundredths or more, confirmed
    on whole sets. Candidates are all pairs whose MinHash signatures differ in at most ``index.threshold`` positions: signatures
    are split into chunks, and some chunk of such a pair has ``index.errors`` differences at most; for each chunk, all ways to leave so
    many positions out are posted, so the pair shares a key.

    Equal sets are one representative; keys that the same representatives share are one list. Long lists make no pairs of all their members:
    first, each member meets the first of its salted part of a list, at most ``tries`` of the nearest are confirmed, and what is
    linked becomes a component. Then, exactly, lists that still hold several components are dealt into blocks of about ``block``
    members; blocks meet blocks, but no two blocks of a list's largest component; sizes, sketches and signatures are compared in the
    block, and what passes is confirmed. A list may hold any share of all documents: its blocks go to many tasks.

    Null and empty texts have no shingles, link with nothing and are kept. Rows with one doc_id are one document. Rows of null doc_id
    make no links; those whose set another row has aren't kept and have its component, the others are kept, of null component. An empty
    table gives an empty one; other columns are ignored. Very long texts are hashed piece by piece.
    """
    rows = materialize(signatures(docs, size, index), "signatures")
    full = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    first = full.groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").cast("long").alias("v"), "n", "signature", "sketch")).alias("r"))
    reps = materialize(first.select("d1", "d2", "r.*"), "representatives")
    features = reps.select("v", "n", "sketch", "signature")

    # lists of several members, one for each set of members
    postings, h = _postings(reps, index), F.xxhash64("v")
    lists = postings.groupBy("t").agg(
        F.count("*").alias("length"), F.min("v").alias("least"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("h1"), F.sum(F.shiftrightunsigned(h, 32)).alias("h2")
    )
    lists = lists.where("length > 1").groupBy("length", "least", "h1", "h2").agg(F.min("t").alias("t")).select("t", "length")
    shared = materialize(postings.join(materialize(lists, "lists"), "t").select("t", "v", "length"), "shared")

    # members meet the first of their part; the order is the same in all lists, so like lists give like pairs
    part = Window.partitionBy("t", F.pmod(F.xxhash64("v"), F.ceil(F.col("length") / list_size)))
    head = F.min(F.struct(F.xxhash64(F.lit(1), "v").alias("h"), "v")).over(part)
    met = shared.select("v", head.getField("v").alias("u")).where("u != v").distinct()
    ranked = Window.partitionBy("v").orderBy("distance", "u")
    tried = _near_pairs(met, features, percent, index.threshold).withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= tries)
    tried = materialize(tried.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "tried")
    known = small(materialize(connected_components(verify(docs, tried, size, percent)), "known"))

    # what is left: lists that hold several components
    placed = materialize(shared.join(known, "v", "left").select("t", "v", F.coalesce("component", "v").alias("c")), "placed")
    sizes = placed.groupBy("t", "c").agg(F.count("*").alias("k")).groupBy("t").agg(
        F.count("*").alias("components"), F.sum("k").alias("length"), F.max(F.struct("k", "c")).alias("most")
    )
    blocks = lambda members: F.ceil(members / block)
    split = sizes.where("components > 1").select(
        "t", F.col("most.c").alias("most"), blocks(F.col("length") - F.col("most.k")).alias("outside"), blocks(F.col("most.k")).alias("inside")
    )
    split = small(materialize(split, "split"))
    dealt = F.pmod(F.xxhash64("v", "t"), F.when(F.col("c") == F.col("most"), F.col("inside")).otherwise(F.col("outside")))
    dealt = dealt + F.when(F.col("c") == F.col("most"), F.col("outside")).otherwise(0)
    last = F.col("outside") + F.col("inside") - 1
    # a block meets itself and all others, but for blocks of the largest component, which don't meet each other
    up_to = F.when(F.col("block") < F.col("outside"), F.col("block")).otherwise(F.col("outside") - 1)
    ij = lambda k, up: F.struct((k if up else F.col("block")).alias("i"), (F.col("block") if up else k).alias("j"))
    before = F.transform(F.sequence(F.lit(0).cast("long"), up_to.cast("long")), lambda k: ij(k, True))
    after = F.when((F.col("block") < F.col("outside")) & (F.col("block") < last), F.transform(F.sequence(F.col("block") + 1, last), lambda k: ij(k, False)))
    open_ = placed.join(split, "t").withColumn("block", dealt)
    cells = open_.select("t", "v", "c", "block", F.explode(F.concat(before, F.coalesce(after, F.array().cast("array<struct<i:bigint,j:bigint>>")))).alias("at"))
    cells = cells.select("t", "at.i", "at.j", "block", "v", "c").join(features, "v")
    cells = cells.repartition("t", "i", "j").sortWithinPartitions("t", "i", "j").select("t", "i", "j", "block", "v", "c", "n", "sketch", "signature")
    pairs = materialize(map_batches(cells, lambda b: _cells(b, percent, index), "u long, v long").distinct(), "pairs")
    links = known.select(F.col("component").alias("u"), "v").union(verify(docs, pairs, size, percent).select("u", "v"))

    named = reps.select("d1", "d2", "v").join(connected_components(links), "v", "left").select("d1", "d2", F.coalesce("component", "v").alias("component_id"))
    placed = rows.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2").join(named, ["d1", "d2"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id").cast("long")).otherwise(F.col("component_id"))
    return placed.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
