"""Folds over the ordered rows of a key that needn't fit one task: rows are cut into pieces, and what pieces do is composed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import over_batches
from ..sources.storage import written


def in_pieces(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df``, dealt into ranges of (keys, order) and sorted in them, with ``__piece``, the range's number: a key's pieces ascend with its
    order, and a key with many rows has many pieces."""
    return df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__piece", F.spark_partition_id())


def moving_average(rows: DataFrame, key: str, order: str, value: str, share: float = 0.1) -> DataFrame:
    """key, n and moved: the moving average, from 0, that goes ``share`` of the way to each value in order. From a start s it is
    ``s * (1 - share) ** n + moved``.

    A piece's average is a sum in which each value has the weight of its distance from the end; those of a key's pieces are added with
    the weights of the rows behind them.
    """
    stay = 1 - share
    pieces = written(in_pieces(rows.select(key, order, value), [key], [order]), "pieces")
    back = F.row_number().over(Window.partitionBy(key, "__piece").orderBy(F.col(order).desc())) - 1
    one = pieces.withColumn("__w", F.col(value) * share * F.pow(F.lit(stay), back)).groupBy(key, "__piece").agg(F.count("*").alias("n"), F.sum("__w").alias("s"))
    behind = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(F.col("__piece").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return one.withColumn("__s", F.col("s") * F.pow(F.lit(stay), behind)).groupBy(key).agg(F.sum("n").alias("n"), F.sum("__s").alias("moved"))


def counted_choices(rows: DataFrame, key: str, order: list[str], choices: list[tuple[int, str]], start: DataFrame | None = None, also: list[str] | None = None) -> DataFrame:
    """key, order, ``also`` and ``kept`` of each row: a row is kept if its choice says so, the one of the greatest level up to the number of rows that
    the key has kept before. ``choices``: (level, boolean column), levels ascending from 0; ``start``: key, n, what was kept before all rows.

    Counts matter up to the last level only, so a piece is a map from the count that comes in to the count that goes out. In one pass
    each row gets its answer for every count that may come into its piece; the pieces' maps are composed, and each piece picks
    the answers for its own count. A task holds one row of counts, however many rows a key has.
    """
    top = choices[-1][0]
    level = np.array([max(k for k, (n, _) in enumerate(choices) if n <= c) for c in range(top + 1)])
    bits = sum((F.col(c).cast("int") * (1 << k) for k, (_, c) in enumerate(choices)), F.lit(0))
    names = [key, *order, *(also or [])]
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, last, state = 1 << np.arange(top + 1, dtype="i8"), None, None
        for b in batches:
            answers, after = [], []
            for k, piece, bit in zip(*(b.column(c).to_pylist() for c in (0, len(names), len(names) + 1)), strict=True):
                if (k, piece) != last:
                    last, state = (k, piece), np.arange(top + 1)
                yes = (bit >> level[state]) & 1
                state = np.minimum(state + yes, top)
                answers.append(int((yes * weight).sum()))
                after.append(state.tolist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(len(names) + 1)), pa.array(answers, pa.int64()), pa.array(after, pa.list_(pa.int32()))],
                                             [*names, "__piece", "answers", "after"])

    asked = in_pieces(rows.select(*names, bits.alias("__bits")), [key], order).select(*names, "__piece", "__bits")
    found = written(over_batches(asked, run, f"{', '.join(kinds)}, __piece int, answers long, after array<int>", rows=10_000), "answers")
    maps = found.groupBy(key, "__piece").agg(F.max_by("after", F.struct(*order)).alias("m"))
    if start is not None:
        maps = maps.join(start.select(F.col(key).alias("__k"), F.col("n").alias("__n")), F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k")
    else:
        maps = maps.withColumn("__n", F.lit(0))
    # a key has a piece in each task at most, so its list is short
    per = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__piece", "m"))).alias("ps"), F.first("__n", ignorenulls=True).alias("n"))
    begin = F.array(F.least(F.coalesce("n", F.lit(0)), F.lit(top)).cast("int"))
    counts = F.aggregate("ps", begin, lambda a, p: F.array_append(a, F.element_at(p["m"], F.element_at(a, -1) + 1)))
    into = per.select(F.col(key).alias("__k"), F.posexplode("ps.__piece").alias("i", "__p"), counts.alias("c")).select("__k", "__p", F.element_at("c", F.col("i") + 1).alias("__in"))
    both = found.join(into, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__piece") == F.col("__p")))
    return both.select(*names, (F.expr("shiftright(answers, __in) & 1L = 1L")).alias("kept"))

