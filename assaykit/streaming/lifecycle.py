"""Stateful streams: the states of reports with their timeout, and the cache of explanations whose entries expire.

Both run on ``transformWithState``: the session needs the RocksDB state store (``use_state_store``), workers need protobuf. The rules of the
report machine are one class, which the stream and its batch twin share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.batches import over_batches

# States of a report, and those that may come next; minutes after which processing counts as stuck.
INITIAL = "pending"
FOLLOWS = {"pending": ["processing", "processed", "error"], "processing": ["processed", "error", "pending"], "processed": [], "error": []}
STUCK_MINUTES = 10
# Days that explanations are kept, of a name and of a value.
GENERAL_DAYS, SPECIFIC_DAYS = 30, 7

STEP = "report string, at timestamp, old string, new string, accepted boolean, timed_out boolean"


def use_state_store(spark: SparkSession) -> None:
    """Keep the state of streams in RocksDB, which timers and expiring state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass(frozen=True)
class Lifecycle:
    """The machine: a change to a state that may not follow is refused and changes nothing. A report that has been processing for more
    than ``minutes`` is ``after_timeout`` from that moment on. Times are microseconds."""

    follows: dict[str, list[str]] = field(default_factory=lambda: dict(FOLLOWS))
    initial: str = INITIAL
    minutes: int = STUCK_MINUTES
    after_timeout: str = "pending"

    @property
    def limit(self) -> int:
        return self.minutes * 60_000_000

    def overdue(self, state: tuple[str, int], now: int) -> tuple[tuple[str, int], list[tuple]]:
        """The state at ``now``, and the timeout's row (at, old, new, accepted, timed_out) if there is one."""
        status, since = state
        if status != "processing" or now - since <= self.limit:
            return state, []
        end = since + self.limit
        return (self.after_timeout, end), [(end, status, self.after_timeout, True, True)]

    def change(self, state: tuple[str, int], at: int, status: str | None) -> tuple[tuple[str, int], list[tuple]]:
        """The state after a change, and its rows."""
        state, rows = self.overdue(state, at)
        accepted = status in self.follows.get(state[0], [])
        rows.append((at, state[0], status, accepted, False))
        return ((status, at) if accepted else state), rows


def _frame(report: str, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(report, *r) for r in rows], columns=["report", "at", "old", "new", "accepted", "timed_out"])
    out["at"] = pd.to_datetime(out["at"], unit="us", utc=True)
    return out


class ReportStates(StatefulProcessor):
    """Changes wait until the watermark has passed them, so they are applied in the order of their times, however they arrive; equal times
    by their names. A timer stands at each waiting change, and one at the end of the time that a report may be processing."""

    def __init__(self, rules: Lifecycle):
        self.rules = rules

    def init(self, handle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "status string, since long")
        self.waiting = handle.getMapState("waiting", "at long, status string", "n long")

    def _timer(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            micros = part["at"].astype("datetime64[us, UTC]" if getattr(part["at"].dtype, "tz", None) else "datetime64[us]").astype("int64")
            for at, status in zip(micros.tolist(), part["status"].tolist(), strict=True):
                place = (at, "" if status is None else status)
                known = self.waiting.getValue(place)
                self.waiting.updateValue(place, ((known[0] if known else 0) + 1,))
                self._timer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        state = tuple(self.current.get()) if self.current.exists() else (self.rules.initial, 0)
        before, rows = state, []
        ready = sorted(tuple(k) for k in self.waiting.keys() if k[0] <= now)
        for at, status in ready:
            for _ in range(self.waiting.getValue((at, status))[0]):
                state, made = self.rules.change(state, at, status or None)
                rows += made
            self.waiting.removeKey((at, status))
        state, made = self.rules.overdue(state, now)
        rows += made
        if state != before:
            self.current.update(state)
            if state[0] == "processing":
                self._timer(state[1] + self.rules.limit + 1)
        if rows:
            yield _frame(key[0], rows)


def report_states(changes: DataFrame, rules: Lifecycle = Lifecycle(), late: str = "1 hour") -> DataFrame:  # noqa: B008
    """A stream of changes (report string, at timestamp, status) as the steps that reports make: ``STEP``.

    Changes may come up to ``late`` after later ones and are applied in the order of their times; a report's state, and the
    changes that wait, are all that is kept. A timeout is told once the watermark has passed it.
    """
    keyed = changes.select("report", "at", "status").withWatermark("at", late).groupBy("report")
    return keyed.transformWithStateInPandas(ReportStates(rules), STEP, "Append", "EventTime")


def state_transitions(changes: DataFrame, rules: Lifecycle = Lifecycle(), now: str | None = None) -> DataFrame:  # noqa: B008
    """The batch twin of ``report_states``: all steps of the reports' changes (report, at, status), and the timeouts up to ``now`` (UTC).

    A report's changes pass through a task in order, one after the other; no report is held in memory, so one with any number of
    changes does no harm but to its own task's time. Null reports are one report, null states are refused, rows of null time are left
    out, repeated rows are steps of their own.
    """
    end = None if now is None else int(pd.Timestamp(now, tz="UTC").value // 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, state, begun = None, (rules.initial, 0), False

        def closed() -> list[tuple]:
            return [(report, *r) for r in rules.overdue(state, end)[1]] if begun and end is not None else []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["report", "at", "old", "new", "accepted", "timed_out"])

        for b in batches:
            out: list[tuple] = []
            for r, at, status in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if not begun or r != report:
                    out += closed()
                    report, state, begun = r, (rules.initial, 0), True
                state, rows = rules.change(state, at, status)
                out += [(r, *x) for x in rows]
            yield batch(out)
        yield batch(closed())

    rows = changes.where(F.col("at").isNotNull()).select(F.col("report").cast("string").alias("report"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "status")
    ordered = rows.repartition("report").sortWithinPartitions("report", "at", "status")
    return over_batches(ordered, run, STEP, rows=10_000)


class Explanations(StatefulProcessor):
    """What is known of a name: one general explanation and one for each value and status, each gone when its time is over."""

    def __init__(self, general_ms: int, specific_ms: int):
        self.general_ms, self.specific_ms = general_ms, specific_ms

    def init(self, handle) -> None:
        self.general = handle.getValueState("general", "text string", self.general_ms)
        self.specific = handle.getMapState("specific", "value string", "text string", self.specific_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            found = []
            for r in part.itertuples(index=False):
                place = (f"{r.value}:{r.status}",)
                if r.general is not None or r.specific is not None:  # what was made for an earlier question
                    if r.general is not None:
                        self.general.update((r.general,))
                    if r.specific is not None:
                        self.specific.updateValue(place, (r.specific,))
                    continue
                general = self.general.get()[0] if self.general.exists() else None
                specific = self.specific.getValue(place)[0] if self.specific.containsKey(place) else None
                found.append((r.id, key[0], general, specific, general is not None and specific is not None))
            if found:
                yield pd.DataFrame(found, columns=["id", "name", "general", "specific", "from_cache"])


def explanation_cache(rows: DataFrame, general_days: float = GENERAL_DAYS, specific_days: float = SPECIFIC_DAYS) -> DataFrame:
    """Answers to a stream of questions (id, name, value, status, general, specific): id, name, general, specific, from_cache.

    Rows that bring an explanation are stored, the others ask; an answer is from the cache where both parts are known and not expired.
    State goes by itself when its time is over, so it is bounded by what was made in the last ``general_days``. Times are those of
    processing; a query that ends once its input does needs ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    asked = rows.select("id", "name", F.col("value").cast("string").alias("value"), "status", "general", "specific").groupBy("name")
    kind = "id long, name string, general string, specific string, from_cache boolean"
    millis = [max(1, int(d * 86_400_000)) for d in (general_days, specific_days)]
    return asked.transformWithStateInPandas(Explanations(*millis), kind, "Append", "ProcessingTime")
