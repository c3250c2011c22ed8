"""N-gram Jaccard join: a grouped prefix join over word shingles, and the groups of documents that it links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blank_words, map_batches, materialize, small_batches, text_frame
from .components import connected_components

#: Counters of the frequency table (2 bytes each: 8 MB for any corpus), and the rows in which it is added up.
_TABLE_BITS, _SLICES = 22, 128
_SKETCH_BITS = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct shingles of ``size`` words; of fewer words, the whole sequence is one."""
    import xxhash

    words = blank_words(text)
    if not words:
        return np.empty(0, "u8")
    w = np.array(list(map(xxhash.xxh3_64_intdigest, words)), "u8")
    if len(w) < size:
        w = np.concatenate([w, np.zeros(size - len(w), "u8")])
    n = len(w) - size + 1
    h = w[:n].copy()
    for k in range(1, size):
        h = ((h * _MIX) ^ (h >> np.uint64(29))) + w[k : k + n]
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return np.unique(h ^ (h >> np.uint64(29)))


def least_overlap(a: int, b: int, percent: int) -> int:
    """Shared shingles that sets of these sizes need for a Jaccard similarity of ``percent`` hundredths."""
    return -(-percent * (a + b) // (100 + percent))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _TABLE_BITS)).astype("i8")


def frequency_table(docs: DataFrame, size: int) -> np.ndarray:
    """How many documents hold the shingles of each slot, at most 65535. Any table orders shingles rightly, an exact one
    just makes shorter lists; so its size is fixed, and it may be broadcast for any corpus."""

    def count(batches):
        import zstandard

        table, held, n = np.zeros(1 << _TABLE_BITS, "<u4"), [], 0
        for b in batches:
            for text in b.column(0).to_pylist():
                held.append(_slot(shingle_set(text, size)))
                n += len(held[-1])
                if n >= 1_000_000:
                    np.add(table, np.bincount(np.concatenate(held), minlength=len(table)), out=table, casting="unsafe")
                    held, n = [], 0
        if n:
            np.add(table, np.bincount(np.concatenate(held), minlength=len(table)), out=table, casting="unsafe")
        pack = zstandard.ZstdCompressor(level=1)
        rows = [pack.compress(x.tobytes()) for x in np.split(table, _SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(rows, pa.binary())], ["slice", "counts"])

    def add(batches):
        import zstandard

        unpack, now, total = zstandard.ZstdDecompressor(), None, None
        for b in batches:
            for k, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = np.frombuffer(unpack.decompress(counts), "<u4").astype("u8")
                if k != now and now is not None:
                    yield _row(now, total)
                now, total = k, found if k != now else total + found
        if now is not None:
            yield _row(now, total)

    def _row(k, total):
        return pa.RecordBatch.from_arrays(
            [pa.array([k], pa.int32()), pa.array([np.minimum(total, 65535).astype("<u2").tobytes()], pa.binary())], ["slice", "counts"]
        )

    parts = map_batches(small_batches(docs).select(F.col("text").cast("binary")), count, "slice int, counts binary")
    summed = map_batches(parts.repartition(_SLICES, "slice").sortWithinPartitions("slice"), add, "slice int, counts binary")
    table = np.zeros(1 << _TABLE_BITS, "<u2")
    for r in summed.collect():  # 8 MB
        width = len(table) // _SLICES
        table[r.slice * width : (r.slice + 1) * width] = np.frombuffer(r.counts, "<u2")
    return table


def prefix(hashes: np.ndarray, table: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles, by slot count and hash, of which two similar sets must share one."""
    n = len(hashes)
    key = (table[_slot(hashes)].astype("u8") << np.uint64(48)) | (hashes >> np.uint64(16))
    return hashes[np.argsort(key, kind="stable")[: n - -(-percent * n // 100) + 1]]


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Bit i: whether an odd number of shingles falls on i. Two sets differ in at least as many shingles as sketches in bits."""
    odd = (np.bincount((hashes & np.uint64(_SKETCH_BITS - 1)).astype("i8"), minlength=_SKETCH_BITS) & 1).astype("u1")
    return np.packbits(odd).view("<i8")


def prefixes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n (shingles), d1, d2 (digest of the set), p1, p2 (digest of the prefix), prefix, sketch; one row per row."""
    held = docs.sparkSession.sparkContext.broadcast(frequency_table(docs, size))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import xxhash

        digest = lambda x, seed: xxhash.xxh3_64_intdigest(x.tobytes(), seed) - (1 << 63)
        for b in batches:
            n, digests, first, sketch = [], [], [], []
            for text in b.column(1).to_pylist():
                h = shingle_set(text, size)
                p = prefix(h, held.value, percent) if len(h) else h
                n.append(len(h))
                digests.append([digest(h, 1), digest(h, 2), digest(p, 1), digest(p, 2)])
                first.append(p.view("i8"))
                sketch.append(parity_sketch(h))
            longs = [pa.array([d[k] for d in digests], pa.int64()) for k in range(4)]
            cols = [b.column(0), pa.array(n, pa.int64()), *longs, pa.array(first, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "d1", "d2", "p1", "p2", "prefix", "sketch"])

    return map_batches(text_frame(docs), run, f"doc_id {kind}, n long, d1 long, d2 long, p1 long, p2 long, prefix array<long>, sketch array<long>")


def _need(na: Column, nb: Column, percent: int) -> Column:
    return F.floor((percent * (na + nb) + (100 + percent - 1)) / (100 + percent))


def may_share(a: str, b: str, percent: int) -> Column:
    """Size and positional bounds of two structs (v, n, pos) that share the token at pos."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = 1 + F.least(na - F.col(f"{a}.pos") - 1, nb - F.col(f"{b}.pos") - 1)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (rest >= _need(na, nb, percent))


def may_differ(na: str, nb: str, a: str, b: str, percent: int) -> Column:
    """Sketch bound: two sketches differ in no more bits than the sets may in shingles."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return bits <= F.col(na) + F.col(nb) - 2 * _need(F.col(na), F.col(nb), percent)


def may_link(a: str, b: str, percent: int) -> Column:
    """All bounds of two structs (v, n, pos, sketch)."""
    return may_share(a, b, percent) & may_differ(f"{a}.n", f"{b}.n", f"{a}.sketch", f"{b}.sketch", percent)


def verify(docs: DataFrame, pairs: DataFrame, size: int, percent: int, broadcast_ids: int = 1_000_000) -> DataFrame:
    """The (u, v) of ``pairs`` whose documents' whole sets are similar enough.

    Sets are made again from the texts of the documents in question only; up to ``broadcast_ids`` of their ids are
    broadcast (8 MB), more are joined by a shuffle.
    """
    asked = small(materialize(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "ids"), broadcast_ids)

    def make(batches):
        for b in batches:
            sets = [shingle_set(t, size).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["x", "set"])

    def compare(batches):
        for b in batches:
            good, left, right = [], b.column(2), b.column(3)
            for i in range(b.num_rows):  # without copies: a batch may hold many long sets
                a, c = np.frombuffer(left[i].as_buffer(), "u8"), np.frombuffer(right[i].as_buffer(), "u8")
                good.append(len(np.intersect1d(a, c, assume_unique=True)) >= least_overlap(len(a), len(c), percent))
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sets = materialize(map_batches(texts.join(asked, "doc_id", "left_semi"), make, "x long, set binary"), "sets")
    left, right = sets.select(F.col("x").alias("u"), F.col("set").alias("a")), sets.select(F.col("x").alias("v"), F.col("set").alias("b"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
    return materialize(map_batches(both, compare, "u long, v long"), "links")


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it has at most ``most`` rows; else joins shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def link_groups(docs: DataFrame, size: int = 5, percent: int = 80, list_size: int = 16, tries: int = 4, rounds: int = 1, most_prior: int = 32) -> DataFrame:
    """doc_id, n_shingles and component_id of each row: the smallest doc_id reachable by links, itself included.

    Two documents link when the Jaccard similarity of their sets of ``size``-word shingles is ``percent`` hundredths or
    more. Steps: equal sets collapse into one representative, representatives of equal size and prefix into one group;
    groups that share a prefix token, and pass the size, positional and sketch bounds, are candidates; members are
    verified on whole sets.

    Components are wanted, so pairs inside a known component needn't be looked at, and thousands of near copies
    don't make millions of pairs. First, in ``rounds`` rounds, each group meets the first of a salted part of each token's
    list (parts of about ``list_size``, dealt anew each round; ``tries`` candidates of other components for a document)
    and each member its group's first; the links of these are contracted. Then, exactly and without any cap, every candidate pair of different components is verified: a token's
    members outside its largest component meet all members of other components, a pair at its first common token (if that is
    among the first ``most_prior``; later ones may bring a pair again).

    Null and empty texts have no shingles, link with nothing and are their own component. Rows with one doc_id are one
    document. Rows with null doc_id make no links; their component is that of an equal set, or null. An empty table
    gives an empty one; other columns are ignored.
    """
    rows = materialize(prefixes(docs, size, percent), "prefixes")
    full = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    first = full.groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").cast("long").alias("v"), "n", "p1", "p2", "prefix", "sketch")).alias("r"))
    reps = materialize(first.select("d1", "d2", "r.*"), "representatives")
    groups = reps.groupBy("n", "p1", "p2").agg(F.min("v").alias("g"), F.count("*").alias("members"))
    several = materialize(groups.where("members > 1"), "groups")
    members = reps.join(several, ["n", "p1", "p2"]).select("g", "v", "sketch", "members")
    members = materialize(members, "members")

    # one posting for each prefix token of each group
    later = small(materialize(members.where("v != g").select("v"), "later"))
    sizes = small(materialize(members.where("v = g").select("v", "members"), "sizes"))
    heads = reps.join(later, "v", "left_anti").join(sizes, "v", "left")
    postings = heads.select(F.posexplode("prefix").alias("pos", "t"), "v", "n", F.coalesce("members", F.lit(1)).alias("members"))
    lists = postings.groupBy("t").agg(F.sum("members").alias("length")).where("length > 1")
    shared = materialize(postings.join(lists, "t").select("t", "v", "n", "pos", "length"), "postings")
    sketches = reps.select("v", "sketch")
    known = reps.select("v", F.col("v").alias("component")).limit(0)
    for k in range(rounds):
        # the first of a part of each list, by light rows; sketches join the pairs
        salt = F.pmod(F.xxhash64("v", "t", F.lit(k)), F.ceil(F.col("length") / list_size))
        part = Window.partitionBy("t", "salt").orderBy(F.xxhash64("t", "v", F.lit(k)), "v")
        row = shared.join(known, "v", "left").select("t", salt.alias("salt"), "v", "n", "pos", F.coalesce("component", "v").alias("c"))
        met = row.withColumn("b", F.first(F.struct("v", "n", "pos", "c")).over(part)).where(F.col("c") != F.col("b.c"))
        met = met.select(F.struct("v", "n", "pos").alias("a"), "b").where(may_share("a", "b", percent))
        met = met.select(F.col("a.v").alias("u"), F.col("b.v").alias("v"), F.col("a.n").alias("nu"), F.col("b.n").alias("nv")).distinct()
        left, right = (sketches.select(F.col("v").alias(x), F.struct("sketch").alias(f"s{x}")) for x in "uv")
        near = met.join(left, "u").join(right, "v").where(may_differ("nu", "nv", "su.sketch", "sv.sketch", percent))
        few = near.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "v"), "v"))).where(F.col("k") <= tries)
        tried = few.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        if k == 0:
            tried = tried.union(members.where("v != g").select(F.col("g").alias("u"), "v"))
        tried = materialize(tried.distinct(), "tried")
        links = verify(docs, tried, size, percent).union(known.select(F.col("component").alias("u"), "v"))
        known = small(materialize(connected_components(links), "known"))

    # members of the lists with their components, and the lists that hold several
    one = shared.join(members.select(F.col("g").alias("v"), F.col("v").alias("member")), "v", "left").select("t", F.coalesce("member", "v").alias("v"), "n", "pos")
    one = materialize(one.join(known, "v", "left").withColumn("component", F.coalesce("component", "v")), "placed")
    split = one.groupBy("t", "component").agg(F.count("*").alias("k")).groupBy("t").agg(
        F.count("*").alias("components"), F.max(F.struct("k", "component")).alias("most")
    )
    split = small(materialize(split.where("components > 1").select("t", F.col("most.component").alias("most")), "split"))
    both = one.join(split, "t")
    if not reps.groupBy("v").count().where("count > 1").isEmpty():  # texts that share a doc_id share tokens in no order
        most_prior = 0
    # the tokens before each, where they are few: a pair is met at its first common token only
    before = Window.partitionBy("v").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.when(F.row_number().over(Window.partitionBy("v").orderBy("pos")) <= most_prior, F.collect_list("t").over(before))
    both = both.withColumn("prior", F.coalesce(prior, F.array().cast("array<long>"))).join(sketches, "v")
    at = F.struct("v", "n", "pos", "sketch", "prior")
    both = materialize(both.select("t", "component", "most", at.alias("a")), "open")
    other = both.select("t", F.col("component").alias("c2"), F.col("a").alias("b"))
    pairs = (
        both.where("component != most")
        .join(other, "t")
        .where(
            (F.col("component") != F.col("c2"))
            & ((F.col("c2") == F.col("most")) | (F.col("a.v") < F.col("b.v")))
            & ~F.arrays_overlap("a.prior", "b.prior")
            & may_link("a", "b", percent)
        )
        .select(F.least("a.v", "b.v").alias("u"), F.greatest("a.v", "b.v").alias("v"))
    )
    pairs = materialize(pairs.distinct(), "pairs")
    links = known.select(F.col("component").alias("u"), "v").union(verify(docs, pairs, size, percent).select("u", "v"))
    linked = connected_components(links)
    named = reps.select("d1", "d2", "v").join(linked, "v", "left").select("d1", "d2", F.coalesce("component", "v").alias("component_id"))
    # equal sets share a key; AQE splits a key that holds many rows
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2").join(named, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id").cast("long")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_first(docs: DataFrame, broadcast_ids: int = 1_000_000, **options) -> DataFrame:
    """``docs`` with one document of each component: the one whose doc_id is the component's. Documents without shingles
    and rows of null doc_id stay; of repeated rows with one doc_id, one stays."""
    found = materialize(link_groups(docs, **options), "components")
    gone = found.where(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))).select("doc_id").distinct()
    gone = materialize(gone, "gone")
    kept = docs.join(small(gone, broadcast_ids), "doc_id", "left_anti")
    if not found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1").isEmpty():
        again = Window.partitionBy("doc_id").orderBy("text")
        kept = kept.withColumn("__k", F.when(F.col("doc_id").isNotNull(), F.row_number().over(again)).otherwise(1)).where("__k = 1").drop("__k")
    return kept
