"""Benchmark decontamination by a prefix-filtered set join over item-sized windows."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, map_batches, materialize, small_batches

#: The operator's struct column.
RESULT = "contamination"


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct (item_id, words joined by blanks) of each run of ``window`` words; a shorter item is one window."""

    def run(batches):
        for b in batches:
            ids, keys = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = alnum_words(text)
                n = min(window, len(words))
                for i in range(len(words) - n + 1 if n else 0):
                    ids.append(item)
                    keys.append(b" ".join(words[i : i + n]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.binary())], ["item_id", "win"])

    items = benchmark.where(F.col("item_id").isNotNull())
    return map_batches(items.select(F.col("item_id").cast("string"), F.col("text").cast("binary")), run, "item_id string, win binary").distinct()


def _rarity(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """How often each of the (bounded) words stands in all documents."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        counts: dict[bytes, int] = defaultdict(int)
        want = held.value
        for b in batches:
            for text in b.column(0).to_pylist():
                for w in alnum_words(text):
                    if w in want:
                        counts[w] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    found = map_batches(small_batches(docs).select(F.col("text").cast("binary")), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in found.collect()}


def _index(windows: list[tuple[str, bytes]], rarity: dict[bytes, int]) -> dict:
    """rarest word -> {(place in the window, window length): {window words: [item_id]}}."""
    index: dict = {}
    for item, win in windows:
        words = win.split(b" ")
        at = min(range(len(words)), key=lambda i: (rarity.get(words[i], 0), words[i], i))
        index.setdefault(words[at], {}).setdefault((at, len(words)), {}).setdefault(tuple(words), []).append(item)
    return index


def find_windows(words: list[bytes], index: dict) -> tuple[bytearray, set[str]]:
    """A byte per word (1: inside an occurrence of a window) and the items whose windows occur."""
    hit, items, n = bytearray(len(words)), set(), len(words)
    for i in [i for i, w in enumerate(words) if w in index]:
        for (at, size), wins in index[words[i]].items():
            s = i - at
            if s >= 0 and s + size <= n and (who := wins.get(tuple(words[s : s + size]))):
                hit[s : s + size] = b"\x01" * size
                items.update(who)
    return hit, items


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slice_windows: int = 200_000) -> DataFrame:
    """``docs`` with a struct column ``contamination``: n_words, n_hit, item_ids (sorted strings), hits.

    A window is ``window`` consecutive words of an item (a shorter item: all its words). Containment of a window is
    exact, so the necessary prefix is a single word: the window's rarest one in ``docs``. That word is joined with
    the documents' words; its place in the window and the document's length bound where the window can stand, and the
    words there are compared. n_hit counts words inside any occurrence; hits has a byte for each word.

    Benchmarks are broadcast in slices of at most ``slice_windows`` windows (about 30 MB); where there are more, the
    documents pass once per slice and are written to the shared folder between. Documents aren't shuffled, so
    passages that many documents share don't meet in one task.

    Null texts and items have no words; items with null item_id are ignored; repeated items and rows count each by
    itself; an empty benchmark marks nothing. Another column named ``contamination`` is replaced.
    """
    sc = docs.sparkSession.sparkContext
    wins = item_windows(benchmark, window)
    n = (wins := materialize(wins, "windows")).count()
    slices = max(1, -(-n // slice_windows))
    part = F.pmod(F.xxhash64("win"), F.lit(slices))
    plain = [c for c in docs.columns if c != RESULT]
    kind = "struct<n_words:long,n_hit:long,item_ids:array<string>,hits:binary>"
    state = docs.select(*plain, F.lit(None).cast(kind).alias(RESULT))
    arrow = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("hits", pa.binary())])
    for k in range(slices):
        rows = [(r.item_id, bytes(r.win)) for r in wins.where(part == k).collect()]
        rarity = _rarity(docs, {w for _, win in rows for w in win.split(b" ")}) if rows else {}
        held = sc.broadcast(_index(rows, rarity))

        def run(batches, held=held):
            index = held.value
            for b in batches:
                out = []
                for text, old in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                    words = alnum_words(text)
                    hit, items = find_windows(words, index)
                    if old:
                        items.update(old["item_ids"])
                        hit = bytearray((np.frombuffer(hit, "u1") | np.frombuffer(old["hits"], "u1")).tobytes())
                    out.append({"n_words": len(words), "n_hit": hit.count(1), "item_ids": sorted(items), "hits": bytes(hit)})
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, arrow)], b.schema.names)

        state = map_batches(small_batches(state), run, T.StructType(state.schema.fields))
        if k < slices - 1:
            state = materialize(state, "marked")
    return state


def contamination_digest(marked: DataFrame) -> DataFrame:
    """The query's columns from the struct."""
    c = F.col(RESULT)
    return marked.select(
        "doc_id",
        c.n_words.alias("n_words"),
        c.n_hit.alias("n_hit"),
        F.size(c.item_ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", c.item_ids), 256).alias("items_sha256"),
        (c.n_hit > 0).alias("contaminated"),
    )
