"""Best-fit packing by a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, text_frame
from .tokens import encode_batches, encoding


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's ids, cut every ``capacity`` ids."""
    end = np.array([end_id], "<u4").tobytes()
    frame = text_frame(docs)

    def run(batches):
        for b in batches:
            at, rows = [], []
            for k, ids in enumerate(encode_batches(tokenizer, b.column(1).to_pylist(), end)):
                for piece, s in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[s : s + 4 * capacity]
                    at.append(k)
                    rows.append((piece, s // 4, len(cut) // 4, zlib.crc32(cut)))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int32(), pa.int64(), pa.int64(), pa.int64()])]
            who = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([who, *cols], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(
        frame, encoding(tokenizer, run), f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(bins: list[list[int]], room: list[int], items: list[int], lengths: list[int], capacity: int) -> None:
    """Put each item in turn into the fullest bin that takes it; bins and room grow in place."""
    free = sorted((r, k) for k, r in enumerate(room))
    for i in items:
        need = lengths[i]
        at = bisect_left(free, (need, -1))
        if at < len(free):
            left, k = free.pop(at)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
            room.append(0)
        room[k] = left - need
        insort(free, (left - need, k))


def fill_by_swaps(bins: list[list[int]], room: list[int], items: list[int], lengths: list[int]) -> None:
    """Let bins with room exchange an item for a larger one of ``items`` that fills them better; what comes out takes its place.
    Bins get fuller and the items that are left smaller, so they fit more gaps."""
    left = sorted((lengths[i], i) for i in items)
    for k in sorted(range(len(bins)), key=lambda k: room[k]):
        for j, i in enumerate(bins[k]):
            if not room[k]:
                break
            at = bisect_left(left, (lengths[i] + room[k] + 1, -1)) - 1
            if at >= 0 and left[at][0] > lengths[i]:
                size, other = left.pop(at)
                bins[k][j] = other
                room[k] -= size - lengths[i]
                insort(left, (lengths[i], i))
    items[:] = [i for _, i in left]


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> float:
    """Mean squared fill: the same items in fewer, fuller bins score higher."""
    return sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Inject well-filled bins of ``b`` into ``a`` whole, drop bins of ``a`` that share an item, best-fit the displaced."""
    filled = sorted(b, key=lambda x: -sum(lengths[i] for i in x))[: max(1, len(b) // 2)]
    injected = rng.sample(filled, max(1, len(filled) // 2))
    taken = {i for x in injected for i in x}
    kept = [x for x in a if taken.isdisjoint(x)]
    displaced = [i for x in a if not taken.isdisjoint(x) for i in x if i not in taken]
    # the worst bins of what is left are opened too, so that their items can fill gaps
    kept.sort(key=lambda x: sum(lengths[i] for i in x))
    opened = kept[: max(1, len(kept) // 20)]
    displaced += [i for x in opened for i in x]
    child = [list(x) for x in [*injected, *kept[len(opened) :]]]
    room = [capacity - sum(lengths[i] for i in x) for x in child]
    fill_by_swaps(child, room, displaced, lengths)
    displaced.sort(key=lambda i: (-lengths[i], i))
    best_fit(child, room, displaced, lengths, capacity)
    return child


def _read(flat: bytes, n: int) -> list[list[list[int]]]:
    """Solutions from their bin numbers per item."""
    out = []
    for which in np.frombuffer(flat, "<i4").reshape(-1, n) if n else []:
        order = np.argsort(which, kind="stable")
        cuts = np.flatnonzero(np.diff(which[order])) + 1
        out.append([x.tolist() for x in np.split(order, cuts)])
    return out


def _flat(bins: list[list[int]], n: int) -> bytes:
    which = np.empty(n, "<i4")
    for k, x in enumerate(bins):
        which[x] = k
    return which.tobytes()


def evolve(lengths: list[int], population: bytes | None, migrant: bytes | None, seed: int, capacity: int, size: int, generations: int):
    """One epoch of one island: (population, best solution, its number of bins, its fitness). It ends early once the items can't
    go into fewer bins."""
    least = -(-sum(lengths) // capacity)
    rng, n = random.Random(seed), len(lengths)
    if population is None:
        order = sorted(range(n), key=lambda i: (-lengths[i], i))
        starts = [order]
        for _ in range(size - 1):  # nearly decreasing orders
            starts.append(sorted(range(n), key=lambda i: -lengths[i] * rng.uniform(0.8, 1.0)))
        people = []
        for items in starts:
            bins: list[list[int]] = []
            best_fit(bins, [], items, lengths, capacity)
            people.append(bins)
    else:
        people = _read(population, n)
    scored = [(len(p), -fitness(p, lengths, capacity), p) for p in people + (_read(migrant, n) if migrant else [])]
    scored = sorted(scored, key=lambda x: x[:2])[:size]
    for _ in range(generations if n > 1 else 0):
        if scored[0][0] <= least:
            break
        a, b = rng.sample(scored, 2) if len(scored) > 1 else scored * 2
        child = crossover(a[2], b[2], lengths, capacity, rng)
        scored.append((len(child), -fitness(child, lengths, capacity), child))
        scored = sorted(scored, key=lambda x: x[:2])[:size]
    flat = [_flat(p, n) for _, _, p in scored]
    return b"".join(flat), flat[0], scored[0][0], -scored[0][1]


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, block_items: int = 32768, block_sequences: int = 450, islands: int = 3,
    epochs: int = 2, population: int = 4, generations: int = 6,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids; one row per piece.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents longer than ``capacity`` are
    cut. Full pieces are sequences of their own. The others are dealt by chance into blocks of about ``block_sequences``
    sequences (``block_items`` pieces at most, where they are very short); each block is evolved on ``islands`` islands (tasks of their own), whose elite moves to the next island after each
    epoch; the best island's packing is taken. A block wastes at most about one sequence more than a global packing.

    Null text: the end id alone. Repeated rows are packed each; doc_id may be null. Equal lengths are told apart by
    their row number in the pieces table, which is written to the shared folder, so lost tasks give the same rows again.
    """
    pieces = materialize(cut_pieces(docs, tokenizer, end_id, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full, part = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    size = part.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("ids")).first()
    blocks = max(1, -(-size.ids // (capacity * block_sequences)), -(-size.n // block_items))
    problems = (
        part.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"), "length", "uid")
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("length", "uid")), asc=False).alias("items"))
    )
    problems = materialize(problems, "blocks")
    kinds = "block long, island int, lengths array<long>, population binary, elite binary, bins int, fit double"

    def epoch(k: int):
        def run(batches):
            for b in batches:
                rows = b.to_pylist()
                for r in rows:
                    seed = (r["block"] * 1_000_003 + r["island"]) * 1009 + k
                    r["population"], r["elite"], r["bins"], r["fit"] = evolve(
                        r["lengths"], r["population"], r.pop("migrant"), seed, capacity, population, generations
                    )
                yield pa.RecordBatch.from_pylist(rows, b.schema.remove(b.schema.get_field_index("migrant")).append(
                    pa.field("elite", pa.binary())).append(pa.field("bins", pa.int32())).append(pa.field("fit", pa.float64())))

        return run

    # a block is bounded work, so a partition for each few islands spreads them over all cores
    spread = max(1, min(blocks * islands, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    state = (
        problems.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.length").alias("lengths"))
        .withColumns({"population": F.lit(None).cast("binary"), "migrant": F.lit(None).cast("binary")})
        .repartition(spread, "block", "island")
    )
    for k in range(epochs):
        state = materialize(map_batches(state, epoch(k), kinds), "islands")
        if k < epochs - 1:
            moved = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("elite").alias("migrant"))
            state = state.drop("elite", "bins", "fit").join(moved, ["block", "island"]).repartition(spread, "block", "island")
    best = state.groupBy("block").agg(F.min_by("elite", F.struct("bins", -F.col("fit"), "island")).alias("elite"))

    def place(batches):
        for b in batches:
            for r in b.to_pylist():
                which = np.frombuffer(r["elite"], "<i4").astype("i8")
                lengths = np.array(r["lengths"], "i8")
                order = np.argsort(which, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                new = np.r_[True, np.diff(which[order]) != 0]
                offset = np.empty(len(order), "i8")
                offset[order] = before - np.maximum.accumulate(np.where(new, before, 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["uids"], pa.int64()), pa.array(-1 - (r["block"] * (1 << 32) + which)), pa.array(offset)],
                    ["uid", "sequence_id", "offset"],
                )

    placed = (
        best.join(problems, "block")
        .select("block", "elite", F.col("items.length").alias("lengths"), F.col("items.uid").alias("uids"))
        .mapInArrow(place, "uid long, sequence_id long, offset long")
    )
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    alone = full.select(*names[:5], F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return part.join(placed, "uid").select(*names).unionByName(alone)
