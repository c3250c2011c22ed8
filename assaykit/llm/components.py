"""Connected components of a table of links, by contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize


#: Vertices that a task keeps in memory while it replaces links by stars, and links that one task finishes alone: they have fewer.
_MOST_VERTICES = 1_000_000
_ONE_TASK = 400_000


def _forest(batches):
    """Links of one partition to spanning stars: fewer links, the same connection. After so many vertices the stars so far are
    sent on and a new forest begins, so memory is bounded."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] = parent.setdefault(p, p)
        return x

    def stars():
        found = [(x, root(x)) for x in list(parent)]
        found = [(x, r) for x, r in found if x != r]
        parent.clear()
        for at in range(0, len(found), 100_000):
            some = found[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in some], pa.int64()) for k in (0, 1)], ["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if (ru := root(u)) != (rv := root(v)):
                parent[max(ru, rv)] = min(ru, rv)
        if len(parent) > _MOST_VERTICES:
            yield from stars()
    yield from stars()


def _moved(labels: DataFrame, hook: DataFrame) -> DataFrame:
    """The vertices with the roots that their roots hook to."""
    return labels.join(hook, labels.root == hook.x, "left").select("v", F.coalesce("hook", "root").alias("root"))


def connected_components(links: DataFrame, most_rounds: int = 60, one_task: int = _ONE_TASK) -> DataFrame:
    """(v, component) for each vertex that ``links`` (u, v: long) links with another; component is the smallest vertex it is connected with.

    Each round, partitions replace their links by spanning stars, every vertex hooks to its neighbour (or itself) that
    comes first in an order drawn anew, and the links between hooks go on. The order being random, a constant share of
    vertices vanishes each round, also from long chains and large stars. Once ``one_task`` links or fewer are left, one task makes stars
    of all of them, which ends the rounds. Null ends are ignored; loops and repeated links do no harm; without links the result is empty.
    """
    vertex = links.where(F.col("u").isNotNull() & F.col("v").isNotNull())
    edges = materialize(map_batches(vertex.select("u", "v").where("u != v"), _forest, "u long, v long").distinct(), "links")
    labels = None
    for k in range(most_rounds):
        left = edges.count()
        if not left:
            break
        if left <= one_task:
            stars = materialize(map_batches(edges.coalesce(1), _forest, "u long, v long"), "stars")
            hook = stars.select(F.col("u").alias("x"), F.col("v").alias("hook")).union(stars.select("v", "v").distinct())
            labels = hook.select(F.col("x").alias("v"), F.col("hook").alias("root")) if labels is None else _moved(labels, hook)
            break
        order = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min(order("v")).alias("m"))
        hook = hook.select(F.col("u").alias("x"), F.least("m", order("u")).alias("m")).select("x", F.col("m").getField("x").alias("hook"))
        hook = materialize(hook, "hooks")
        if labels is None:
            labels = hook.select(F.col("x").alias("v"), F.col("hook").alias("root"))
        else:
            labels = _moved(labels, hook)
        labels = materialize(labels, "labels")
        a, b = hook.select(F.col("x").alias("u"), F.col("hook").alias("hu")), hook.select(F.col("x").alias("v"), F.col("hook").alias("hv"))
        edges = edges.join(a, "u").join(b, "v").where("hu != hv").select(F.least("hu", "hv").alias("u"), F.greatest("hu", "hv").alias("v"))
        edges = materialize(map_batches(edges.distinct(), _forest, "u long, v long"), "links")
    else:
        raise RuntimeError("the links didn't contract")
    if labels is None:
        return edges.select("v", F.col("v").alias("component"))
    least = labels.groupBy("root").agg(F.min("v").alias("component"))
    return labels.join(least, "root").select("v", "component")
