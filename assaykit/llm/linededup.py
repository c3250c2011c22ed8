"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blank_words, map_batches, materialize, small_batches

#: The operator's struct column.
RESULT = "line_dedup"


def line_units(text: bytes | None) -> tuple[list[int], list[int]]:
    """Hash and number of words of each line with words; case and blanks within a line don't count."""
    import xxhash

    hashes, sizes = [], []
    for line in (text or b"").split(b"\n"):
        if words := blank_words(line):
            hashes.append(xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63))
            sizes.append(len(words))
    return hashes, sizes


def forward_windows(sizes: list[int], least: int) -> list[tuple[int, int]]:
    """For each first line, the shortest stretch (start, end) of at least ``least`` words, where there is one."""
    out, end, words = [], 0, 0
    for start in range(len(sizes)):
        while words < least and end < len(sizes):
            words += sizes[end]
            end += 1
        if words < least:
            break
        out.append((start, end))
        words -= sizes[start]
    return out


def windows_at(sizes: list[int], least: int, pos: int) -> set[tuple[int, int]]:
    """Shortest stretches of at least ``least`` words from a first line or up to a last line that hold line ``pos``."""
    n = len(sizes)
    back = {(n - e, n - s) for s, e in forward_windows(sizes[::-1], least)}
    return {(s, e) for s, e in back.union(forward_windows(sizes, least)) if s <= pos < e}


def select_minima(hashes: list[int], sizes: list[int], least: int) -> list[int]:
    """Winnowing: the last line of smallest hash in each window, each once."""
    found: dict[int, None] = {}
    for s, e in forward_windows(sizes, least):
        found[max(range(s, e), key=lambda i: (-hashes[i], i))] = None
    return list(found)


def context(sizes: list[int], least: int, pos: int) -> tuple[int, int]:
    """The lines around ``pos`` with at least ``least`` words on each side, or up to the text's ends."""
    first, words = pos, 0
    while first and words < least:
        first -= 1
        words += sizes[first]
    last, words = pos + 1, 0
    while last < len(sizes) and words < least:
        words += sizes[last]
        last += 1
    return first, last


def _identity(docs: DataFrame) -> DataFrame:
    """The order of documents: doc_id (null first), then a hash of the text."""
    return small_batches(docs).withColumns({"__k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__h": F.xxhash64("text")})


def repeated_runs(docs: DataFrame, least: int = 50) -> DataFrame:
    """__k, __h (a document) and spans, the (start, end) stretches of its lines that an earlier place has already.

    A place is earlier if its document, or its line in the same document, comes first. Rows of one doc_id with one text
    are one document. Steps: window minima are the fingerprints (a run of at least ``least`` words always holds one);
    fingerprints whose hash stands in one place only are dropped; the matches of the others are extended both ways to
    the stretches around them, and each stretch is joined with its first place. A passage in a third of all documents
    is one group of sums with map-side combining; no pairs within a group are made.
    """
    import xxhash

    def minima(batches):
        for b in batches:
            rows: list[tuple] = []
            for k, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                hashes, sizes = line_units(text)
                for p in select_minima(hashes, sizes, least):
                    s, e = context(sizes, least, p)
                    rows.append((hashes[p], k, h, p, s, hashes[s:e], sizes[s:e]))
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
            names = ["fp", "k", "h", "pos", "first", "hashes", "sizes"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    texts = _identity(docs).select("__k", "__h", F.col("text").cast("binary"))
    found = map_batches(texts, minima, "fp long, k long, h long, pos int, first int, hashes array<long>, sizes array<int>")
    found = materialize(found, "minima")
    # repeated: the hash stands in more than one place
    places = found.groupBy("fp").agg(F.min(F.struct("k", "h", "pos")).alias("a"), F.max(F.struct("k", "h", "pos")).alias("b"))
    places = materialize(places.where(F.col("a") != F.col("b")).select("fp"), "repeated")
    shared = found.join(places, "fp", "left_semi")  # a join of two written tables, of which AQE splits hot hashes

    def extend(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                first, hashes = r["first"], np.array(r["hashes"], "<i8").tobytes()
                for s, e in windows_at(r["sizes"], least, r["pos"] - first):
                    win = xxhash.xxh3_64_intdigest(hashes[8 * s : 8 * e]) - (1 << 63)
                    rows.append((r["fp"], win, r["k"], r["h"], first + s, first + e))
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], ["fp", "win", "k", "h", "start", "end"]
            )

    wins = materialize(map_batches(shared, extend, "fp long, win long, k long, h long, start int, end int"), "stretches")
    here = F.struct("k", "h", "start")
    firsts = wins.groupBy("fp", "win").agg(F.min(here).alias("src"), F.max(here).alias("last"))
    firsts = materialize(firsts.where(F.col("src") != F.col("last")).select("fp", "win", "src"), "firsts")
    later = wins.join(firsts, ["fp", "win"]).where(here > F.col("src")).select("k", "h", "start", "end")
    later = materialize(later, "later")
    return later.groupBy(F.col("k").alias("__k"), F.col("h").alias("__h")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def delete_spans(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the lines of the spans, its lines with words, and how many of them went."""
    gone = {i for s, e in spans for i in range(s, e)}
    out, unit = [], 0
    for line in text.split("\n"):
        if blank_words(line.encode()):
            if unit not in gone:
                out.append(line)
            unit += 1
        else:
            out.append(line)
    return "\n".join(out), unit, len(gone)


def dedup_lines(docs: DataFrame, least: int = 50) -> DataFrame:
    """``docs`` with a struct column ``line_dedup``: text (without later repeated runs), n_lines, n_deleted.

    A run is consecutive lines of at least ``least`` words altogether that stand, line for line, at an earlier place;
    the first place keeps them. Lines without words aren't part of runs and stay. Case and blanks don't tell lines apart.
    Null text stays null with 0 lines; a text below ``least`` words keeps all lines; repeated rows keep the same lines;
    null doc_ids come first; an empty table gives an empty one. Another column named ``line_dedup`` is replaced.

    Whole texts are shuffled once, to meet their spans by document, of which no two rows share a key but for repeated
    rows; AQE splits those.
    """
    docs = docs.drop(RESULT)
    spans = repeated_runs(docs, least)
    arrow = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_deleted", pa.int64())])

    def rewrite(batches):
        for b in batches:
            out = []
            for text, cut in zip(b.column("text").to_pylist(), b.column("__spans").to_pylist()):
                new, lines, gone = (None, 0, 0) if text is None else delete_spans(text, [(c["start"], c["end"]) for c in cut or []])
                out.append({"text": new, "n_lines": lines, "n_deleted": gone})
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, arrow)], [*b.schema.names[:-1], RESULT])

    schema = T.StructType([*docs.schema.fields, T.StructField(RESULT, T._parse_datatype_string("text string, n_lines long, n_deleted long"))])
    joined = _identity(docs).join(spans.withColumnRenamed("spans", "__spans"), ["__k", "__h"], "left")
    return map_batches(joined.select(*docs.columns, "__spans"), rewrite, schema)


def replace_text(deduped: DataFrame) -> DataFrame:
    """The documents' own columns with the new text (and n_chars, where there is one); emptied documents go."""
    r = F.col(RESULT)
    blank = F.length(F.trim(F.coalesce(r.text, F.lit("")))) == 0
    new = {"text": r.text}
    if "n_chars" in deduped.columns:
        new["n_chars"] = F.when(r.n_deleted > 0, F.length(r.text)).otherwise(F.col("n_chars")).cast(deduped.schema["n_chars"].dataType)
    return deduped.where(~((r.n_deleted > 0) & blank)).withColumns(new).drop(RESULT)
