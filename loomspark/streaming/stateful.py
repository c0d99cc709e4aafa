"""State machines of keyed events as streams: circuit breakers, agent logs, job leases.

Events wait in a key's state until the watermark has passed them, then take their step in the order of time and id; so the
result is that of the batch twin whatever the order of arrival within the watermark's delay, and survives restarts.
Timers of event time bring the waiting events up, let leases run out and drop the state of keys that have gone quiet.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from loomspark.operators import temporal
from loomspark.sources import shared

#: Events that a backfill streams at once, and of a key that wait together.
SLICE, PACK = 1_000_000, 4096
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state with timers asks for."""
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER[0], before)


class Ordered(StatefulProcessor):
    """Steps of one key's events in the order of (time, id).

    start is a state's first value, step(state, event, at) gives the next one and rows to emit, due(state) the time at
    which wake(state, at) is asked for rows without an event, null for never. States are JSON values. idle_us after the
    last event a key's state goes.
    """

    def __init__(self, start: Any, step: Callable, columns: list[str], due: Callable | None = None, wake: Callable | None = None, idle_us: int | None = None) -> None:
        self.start, self.step, self.columns, self.due, self.wake, self.idle_us = start, step, columns, due, wake, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")  # PACK of them a row, as each row is a call to Spark
        self.value = handle.getValueState("value", "value string, last long")

    def _timers(self, times: list[int]) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if times:
            self.handle.registerTimer(min(times) // 1000 + 1)

    def _held(self) -> list[tuple]:
        return [event for (packed,) in self.waiting.get() for event in pickle.loads(packed)]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self._held()
        for part in rows:
            held += list(part[["at_us", "event_id", "event"]].itertuples(index=False, name=None))
        yield from self._go(key, held, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._go(key, self._held(), timerValues.getCurrentWatermarkInMs() * 1000)

    def _go(self, key: Any, held: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        state, last = self.start, None
        if self.value.exists():
            text, last = self.value.get()
            state = json.loads(text)
        out = []
        for at, _, event in sorted((h for h in held if h[0] <= now), key=lambda h: (h[0], h[1].zfill(20))):
            state, rows = self.step(state, json.loads(event), at)
            last = at
            out += rows
        if self.wake and (due := self.due(state)) is not None and due < now:
            state, rows = self.wake(state, now)
            out += rows
        later = [h for h in held if h[0] > now]
        times = [h[0] for h in later] + ([due] if self.due and (due := self.due(state)) is not None else [])
        if self.idle_us is not None and last is not None:
            if not later and last + self.idle_us <= now:
                self.value.clear()
                last = None
            elif last + self.idle_us > now:  # a timer that is set while it fires would go with the one that fired
                times.append(last + self.idle_us)
        if later:
            self.waiting.put([(pickle.dumps(later[i : i + PACK]),) for i in range(0, len(later), PACK)])
        else:
            self.waiting.clear()
        if last is not None:
            self.value.update((json.dumps(state), last))
        self._timers(times)
        yield pd.DataFrame([(key[0], *row) for row in out], columns=self.columns)

    def close(self) -> None:
        pass


def stepped(events: DataFrame, key: str, at: str, event_id: str, carry: list[str], output: str, processor: Callable[[list[str]], Ordered], delay: str) -> DataFrame:
    """A stream's rows of `output`, whose first field is the key, by a processor over its events (at, event_id, carry)."""
    rows = events.withWatermark(at, delay).select(
        F.col(key).alias("key"), F.col(at).alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"), F.col(event_id).cast("string").alias("event_id"),
        F.to_json(F.struct(*carry), {"ignoreNullFields": "false"}).alias("event"),
    )
    names = [f.split()[0] for f in output.split(", ")]
    return rows.groupBy("key").transformWithStateInPandas(processor(names), output, "Append", "EventTime")


def circuit(events: DataFrame, threshold: int = 2, delay: str = "10 minutes") -> DataFrame:
    """(host, reason, opened_at) of hosts whose circuit opens, once each; events (host, at, seq, status, event), as temporal.circuit reads them in the order of time and seq."""

    def step(state: list, e: dict, at: int) -> tuple[list, list]:
        denials, is_open = state
        why = e["event"] if e["event"] in ("captcha", "parser_drift") else None
        if e["status"] is not None:
            denials = 0 if 200 <= e["status"] < 400 else denials + (e["status"] in (403, 429))
            why = why or (f"repeated_{e['status']}" if e["status"] in (403, 429) and denials >= threshold else None)
        return [denials, is_open or bool(why)], [(why, e["seq"])] if why and not is_open else []

    kind = dict(events.dtypes)["host"]
    return stepped(events, "host", "at", "seq", ["seq", "status", "event"], f"host {kind}, reason string, opened_at long", lambda names: Ordered([0, False], step, names), delay)


def replay(steps: DataFrame, delay: str = "10 minutes", idle_seconds: int | None = None) -> DataFrame:
    """(run_id, step_id, step_index, repeated) of an agent's log (run_id, step_id, at, fingerprint), as temporal.replay numbers it.

    With idle_seconds a run that was quiet for so long is forgotten: what follows counts as a new run's.
    """

    def step(state: list, e: dict, at: int) -> tuple[list, list]:
        n, seen, last = state
        if idle_seconds is not None and last is not None and at - last > idle_seconds * 1_000_000:
            n, seen = 0, []
        again = e["fingerprint"] in seen
        return [n + 1, seen if again else [*seen, e["fingerprint"]], at], [(e["step_id"], n + 1, again)]

    kind = dict(steps.dtypes)["run_id"]
    idle = None if idle_seconds is None else idle_seconds * 1_000_000
    return stepped(steps, "run_id", "at", "step_id", ["step_id", "fingerprint"], f"run_id {kind}, step_id long, step_index int, repeated boolean", lambda names: Ordered([0, [], None], step, names, idle_us=idle), delay)


def jobs(events: DataFrame, rules: temporal.JobRules | None = None, delay: str = "10 minutes") -> DataFrame:
    """(job_id, at, state, attempts, owner): each change of a job's state, as temporal.job_history gives it.

    events (job_id, at, event_id, kind, owner, seconds); a lease that nobody settles runs out by a timer.
    """
    rules = rules or temporal.JobRules()
    kind = dict(events.dtypes)["job_id"]
    output = f"job_id {kind}, at_us long, state string, attempts int, owner string"
    found = stepped(events, "job_id", "at", "event_id", ["kind", "owner", "seconds"], output, lambda names: Ordered(None, rules.step, names, rules.due, rules.expired), delay)
    return found.select("job_id", F.timestamp_micros("at_us").alias("at"), "state", "attempts", "owner")


def appended(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream over what is there and appends its rows to a folder of Parquet, each once; returns the ended query."""
    with rocks(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def _slices(events: DataFrame, at: str, folder: str, files: int) -> list[str]:
    """Events written to folder in slices of about SLICE rows by time, later ones after earlier ones; the slices' paths."""
    n = -(-events.count() // SLICE) or 1
    us = F.unix_micros(F.col(at).cast("timestamp"))
    bounds = events.select(us.cast("double").alias("us")).approxQuantile("us", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    number = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]).cast("array<bigint>"), lambda b: b < us)).alias("_slice")
    events.select("*", number).repartition("_slice", F.pmod(F.xxhash64(at), F.lit(files))).write.partitionBy("_slice").parquet(folder)
    return [p for i in range(n) if shared.exists(events.sparkSession, p := f"{folder}/_slice={i}")]


def backfilled(events: DataFrame, machine: Callable[[DataFrame], DataFrame], key: str, at: str, folder: str, files: int = 8) -> DataFrame:
    """The rows that a stream's machine gives for a table of events, by the stream itself; what it writes goes to folder.

    The events are laid out as files, by slices of time, and streamed slice by slice: the query is started again from its
    checkpoint with each, so no more than two slices of events wait at once. The last start is with a tick: a row of a null
    key an hour after the last, which only moves the watermark on, so that no event waits any longer.
    """
    spark = events.sparkSession
    schema = events.schema
    last = events.agg(F.max(at).alias(at)).filter(F.col(at).isNotNull()).withColumn(at, (F.col(at) + F.expr("interval 1 hour")).cast(dict(events.dtypes)[at]))
    tick = last.select(*[F.col(at) if c == at else F.lit(None).cast(kind).alias(c) for c, kind in events.dtypes])
    slices = _slices(events, at, f"{folder}/slices", files)
    spark.createDataFrame([], schema).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(schema).parquet(f"{folder}/in")
    for i, path in enumerate(slices):
        shared.move(spark, path, f"{folder}/in", f"{i}-")
        appended(machine(source), f"{folder}/out", f"{folder}/checkpoint")
    tick.write.mode("append").parquet(f"{folder}/in")
    appended(machine(source), f"{folder}/out", f"{folder}/checkpoint")
    out = spark.read.schema(machine(source).schema).parquet(f"{folder}/out")
    return out.filter(F.col(out.columns[0]).isNotNull())
