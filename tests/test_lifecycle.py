"""Stateful streams: reports whose changes come out of order or never, and explanations that expire."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from assaykit.streaming import lifecycle
from assaykit.streaming.lifecycle import Lifecycle

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def model(changes, rules, now):
    """One report after the other, change by change."""
    out = []
    for report in {r for r, _, _ in changes}:
        status, since = rules.initial, None

        def late(t):
            nonlocal status, since
            if status == "processing" and t - since > dt.timedelta(minutes=rules.minutes):
                end = since + dt.timedelta(minutes=rules.minutes)
                out.append((report, end, status, rules.after_timeout, True, True))  # noqa: B023
                status, since = rules.after_timeout, end

        for _, t, new in sorted((x for x in changes if x[0] == report), key=lambda x: (x[1], x[2] or "")):
            late(t)
            good = new in rules.follows[status]
            out.append((report, t, status, new, good, False))
            if good:
                status, since = new, t
        late(now)
    return sorted(out, key=str)


def steps(rows):
    utc = lambda t: t.replace(tzinfo=dt.UTC) if t.tzinfo is None else t.astimezone(dt.UTC)
    return sorted(((r.report, utc(r.at), r.old, r.new, r.accepted, r.timed_out) for r in rows), key=str)


CHANGES = [
    ("a", at(0), "pending"), ("a", at(1), "processing"), ("a", at(5), "processed"), ("a", at(6), "processing"),  # in order; then refused
    ("b", at(2), "processing"), ("b", at(13), "processed"),  # too late by a minute: pending again, then processed
    ("c", at(3), "processing"),  # never ends
    ("d", at(1), "processing"), ("d", at(11), "error"),  # ten minutes are not too many
    ("e", at(4), None), ("e", at(4), "processing"), ("e", at(4), "processing"),
]


def test_transitions_equal_a_sequential_model(spark):
    rng = random.Random(2)
    many = [(f"r{rng.randrange(20)}", at(rng.randrange(3000) / 10), rng.choice(["pending", "processing", "processed", "error", None, "?"])) for _ in range(600)]
    again = Lifecycle({**lifecycle.FOLLOWS, "processed": ["pending"], "error": ["pending"]}, minutes=3, after_timeout="error")
    for changes, rules in ((CHANGES, Lifecycle()), (many, again)):
        frame = spark.createDataFrame(changes, "report string, at timestamp, status string").repartition(5)
        want = model(changes, rules, at(400))
        got = steps(spark.createDataFrame(lifecycle.state_transitions(frame, rules, "2024-01-01 06:40").collect(), lifecycle.STEP).collect())
        assert got == want and any(w[5] for w in want)
    assert lifecycle.state_transitions(frame.limit(0)).isEmpty()


def _stream(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_report_stream_with_late_changes_and_a_timeout(spark, tmp_path):
    lifecycle.use_state_store(spark)
    schema = "report string, at timestamp, status string"
    _stream(spark, tmp_path / "in", CHANGES[5:] + CHANGES[1:2], schema)  # b's start and a's first come after what follows them
    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = lifecycle.report_states(changes, late="30 minutes").writeStream.format("memory").queryName("steps").outputMode("append")
    q = made.option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        q.processAllAvailable()
        assert spark.table("steps").isEmpty()  # nothing is sure yet
        _stream(spark, tmp_path / "in", CHANGES[:1] + CHANGES[2:5], schema)
        q.processAllAvailable()
        _stream(spark, tmp_path / "in", [("z", at(60 * k), "pending") for k in (5, 6)], schema)  # time goes on
        q.processAllAvailable()
        _stream(spark, tmp_path / "in", [("z", at(60 * 7), "?")], schema)
        q.processAllAvailable()
        got = steps(spark.table("steps").where("report != 'z'").collect())
    finally:
        q.stop()
    assert got == model(CHANGES, Lifecycle(), at(400))
    assert ("c", at(13), "processing", "pending", True, True) in got


def test_explanations_expire(spark, tmp_path):
    lifecycle.use_state_store(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else batches without data follow for ever
    schema = "id long, name string, value double, status string, general string, specific string"
    folder, day = tmp_path / "in", 86_400

    def told(rows):
        """What the query answers to further rows; its state goes on from the run before."""
        _stream(spark, folder, rows, schema)
        made = lifecycle.explanation_cache(spark.readStream.schema(schema).parquet(str(folder)), general_days=600 / day, specific_days=20 / day)
        to = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append")
        assert to.trigger(availableNow=True).start().awaitTermination(100)
        return {r.id: (r.name, r.general, r.specific, r.from_cache) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    try:
        _ask(told)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def _ask(told):
    began = time.time()
    ask = [(1, "Zinc", 5.0, "normal", None, None), (2, "Zinc", 5.0, "abnormal", None, None), (3, "Iron", 5.0, "normal", None, None)]
    told([(0, "Zinc", 5.0, "normal", "zinc is a metal", "5 is fine")])
    stored = time.time()
    got = told(ask)
    quick = time.time() - began < 18
    assert got[1] == ("Zinc", "zinc is a metal", "5 is fine", True) or not quick
    assert got[2] == ("Zinc", "zinc is a metal", None, False) and got[3] == ("Iron", None, None, False)
    time.sleep(max(0, stored + 21 - time.time()))
    assert told([(4, "Zinc", 5.0, "normal", None, None)])[4] == ("Zinc", "zinc is a metal", None, False)  # the specific one is gone, the general one isn't
