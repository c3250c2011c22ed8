"""Folds in pieces against loops, with keys that hold most of the rows."""

import random

from pyspark.sql import functions as F

from assaykit.functions import texts
from assaykit.operators import documents, ordered, state


def test_choices_in_pieces_equal_a_loop(spark):
    rng = random.Random(6)
    levels = [(0, "a"), (2, "b"), (5, "c"), (20, "d")]
    rows = [(None if k == 3 else k, i, *(rng.random() < p for p in (0.6, 0.3, 0.2, 0.1))) for k, n in ((0, 3000), (1, 1), (2, 7), (3, 40)) for i in range(n)]
    before = {0: 1, 2: 30}
    want = {}
    for key in (0, 1, 2, None):
        n = before.get(key, 0)
        for r in sorted((x for x in rows if x[0] == key), key=lambda x: x[1]):
            yes = r[2 + max(k for k, (least, _) in enumerate(levels) if least <= n)]
            n += yes
            want[key, r[1]] = yes
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, "key int, i int, a boolean, b boolean, c boolean, d boolean").repartition(3)
        start = spark.createDataFrame(list(before.items()), "key int, n long")
        assert ordered.in_pieces(frame, ["key"], ["i"]).where("key = 0").select("__piece").distinct().count() > 1  # the long key is cut
        got = {(r.key, r.i): r.kept for r in ordered.counted_choices(frame, "key", ["i"], levels, start).collect()}
        assert got == want
        assert ordered.counted_choices(frame.limit(0), "key", ["i"], levels).isEmpty()
        values = [(k, i, rng.random()) for k, n in (("x", 2000), ("y", 3), (None, 5)) for i in range(n)]
        moved = {r.k: (r.n, r.moved) for r in ordered.moving_average(spark.createDataFrame(values, "k string, i int, v double"), "k", "i", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for key in ("x", "y", None):
        s = 0.0
        for _, _, v in [x for x in values if x[0] == key]:
            s = s * 0.9 + v * 0.1
        assert moved[key][0] == sum(x[0] == key for x in values) and abs(moved[key][1] - s) < 1e-9


def test_skipping_with_a_count_from_before(spark):
    """Chunks that only a report without measurements takes are skipped once twenty are known."""
    rows = [(r, i, t) for r in (1, 2) for i, t in enumerate(["glucose 95 mg/dl (70-99)"] * 3 + ["plain words without any figures here"] * 2)]
    df = spark.createDataFrame(rows, "report long, ord int, text string")
    s = df.select("report", "ord", *[texts.accepts(texts.screen(F.col("text")), n).alias(f"k{n}") for n, _ in texts.SCREEN_LEVELS]).collect()
    found = {r: {} for r in (1, 2)}
    for r in documents.skip_chunks(df, "report", ["ord"], found_before=spark.createDataFrame([(2, 25)], "report long, n long"), most_skipped=1.0).collect():
        found[r.report][r.ord] = r.kept
    top = f"k{texts.SCREEN_LEVELS[-1][0]}"
    assert found[2] == {r.ord: r[top] for r in s if r.report == 2} and found[1][0]


def test_variations_of_learnt_names(spark):
    seen = spark.createDataFrame([("LDL Cholesterol", "mg/dL", 90.0, 0.9, 1), ("Zinc", "", 0.0, 0.8, 2)], "name string, unit string, value double, confidence double, ord int")
    known = spark.createDataFrame([("fasting_glucose", "mg/dL", 3, 0.9, 70.0, 99.0, 0.9)], "name string, unit string, frequency int, success double, low double, high double, threshold double")
    got = {r.name: (r.variations, r.low) for r in state.learn_patterns(known, seen).collect()}
    assert got == {"ldl_cholesterol": (["chol", "cholest", "ldl cholesterol"], 45.0), "zinc": (["zinc"], None), "fasting_glucose": (["blood glucose", "fasting glucose", "glu"], 70.0)}
