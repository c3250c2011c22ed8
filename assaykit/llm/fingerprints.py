"""Document fingerprints by content-defined chunking."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_range, id_splits, longs, map_batches, small_batches, text_frame, text_partitions

#: Chunk sizes in bytes: none below the least but the last, the usual one, none above the most.
LEAST, NORMAL, MOST = 12, 32, 128
_GEAR = np.random.RandomState(20240229).randint(0, 1 << 32, 256, dtype=np.uint32)
#: Normalised chunking: boundaries are rarer (1 in 64) before the usual size, more frequent (1 in 8) after it.
_STRICT, _LOOSE = np.uint32(1 << 26), np.uint32(1 << 29)


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks. A gear hash of the last 16 bytes decides, so an edit moves near boundaries only."""
    n = len(data)
    h = _GEAR[np.frombuffer(data, "u1")]
    for s in (1, 2, 4, 8):
        g = h.copy()
        g[s:] += h[: n - s] << np.uint32(2 * s) if n > s else 0
        h = g
    at = np.flatnonzero(h < _LOOSE)
    ends, start = [], 0
    for p, strict in zip((at + 1).tolist(), (h[at] < _STRICT).tolist()):
        while p - start > MOST:
            start += MOST
            ends.append(start)
        if p - start >= NORMAL or strict and p - start >= LEAST:
            ends.append(p)
            start = p
    while n - start > MOST:
        start += MOST
        ends.append(start)
    return ends + [n] if start < n else ends


def fingerprint(data: bytes) -> dict[int, int]:
    """Digest of each distinct chunk -> bytes of text that it covers."""
    import xxhash

    digest, out, s = xxhash.xxh32_intdigest, {}, 0
    for e in boundaries(data) if data else []:
        d = digest(data[s:e])
        out[d] = out.get(d, 0) + e - s
        s = e
    return out


def render(found: dict[int, int]) -> str:
    """``digest.length`` in hexadecimal for each chunk, ascending; empty for an empty text."""
    return " ".join(["%08x.%x" % x for x in sorted(found.items())])


def parse(shown: str) -> dict[int, int]:
    return {int(d, 16): int(n, 16) for d, n in (x.split(".") for x in shown.split())}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Containment weighted by length: shared bytes over the bytes of the shorter one; 1 if both are empty, 0 if one is."""
    if not a or not b:
        return float(not a and not b)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    shared = sum(min(n, large[d]) for d, n in small.items() if d in large)
    return shared / min(sum(a.values()), sum(b.values()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (see ``render``) of each whole text; null is empty. Row by row, without a shuffle."""

    def run(batches):
        for b in batches:
            made = [render(fingerprint(t or b"")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(text_frame(docs), run, f"doc_id {kind}, fingerprint string")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, compared with each other and with the next document's.

    The next document follows in descending doc_id; after the last comes the first. The last third of the code points
    (rounded down) makes way for as many of the next document's first ones, or all where it has fewer.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are shuffled once, into ranges of doc_id; each range also gets the first row of the range that follows, so
    the walk needs no second shuffle and no single task for all rows. Memory: two texts at a time.
    Null text: empty. Null doc_ids come last; rows of one doc_id are ordered by text. A lone row is its own next one.
    """
    parts = text_partitions(docs)
    splits = id_splits(docs, parts)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    heads = {r.b: r.k for r in docs.groupBy(id_range(splits).alias("b")).agg(F.max(key).alias("k")).collect()}  # one row a range
    order = sorted(heads, reverse=True)
    # the head of each range also goes to the range before it, the first head to the last range
    size = max(order, default=0) + 1
    head, to = [0] * size, [-1] * size
    for i, b in enumerate(order):
        head[b], to[b] = heads[b], order[i - 1]
    part = id_range(splits).cast("int")
    place = F.struct(part.alias("part"), F.lit(0).alias("extra"))
    also = F.struct(F.get(longs(to), part).cast("int").alias("part"), F.lit(1).alias("extra"))
    targets = F.when(key == F.get(longs(head), part), F.array(place, also)).otherwise(F.array(place))
    rows = small_batches(docs).select("doc_id", key.alias("key"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), F.explode(targets).alias("to"))
    ordered = (
        rows.select("doc_id", "key", "text", "to.part", "to.extra")
        .repartitionById(max(parts, len(splits) + 1), F.col("part"))
        .sortWithinPartitions("extra", F.col("key").desc(), "text")
    )
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        last = None  # (doc_id, text, fingerprint)

        def finish(row, after):
            text, n = row[1], len(row[1])
            m = n // 3
            edited = (text[: n - m] + after[1][:m]).encode()
            made = fingerprint(edited)
            return (
                row[0], n, hashlib.sha256(edited).hexdigest(), render(row[2]), render(made),
                likeness(row[2], made), likeness(row[2], after[2]),
            )

        done = False
        for b in batches:
            out = []
            for doc, text, extra in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist()):
                if done:
                    break
                row = (doc, text.decode("utf-8", "replace"), fingerprint(text))
                if last is not None:
                    out.append(finish(last, row))
                last, done = row, bool(extra)
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        ordered, run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
