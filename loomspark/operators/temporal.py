"""State machines over ordered events: limiter, sessions, lease queue, circuit breaker, crawl plan."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions.scalars import backoff_seconds


def allow(times: list[float], limit: int, window: float) -> list[bool]:
    """Sliding-window limiter over ordered times; an event as old as the window is forgotten, a rejected one never counts."""
    recent, out = deque(), []
    for t in times:
        while recent and recent[0] <= t - window:
            recent.popleft()
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out


def rate_limit(events: DataFrame, key: str, at: str, event_id: str, limit: int = 5, window_seconds: float = 60.0) -> DataFrame:
    """(key, event_id, accepted) of every event, keys in parallel.

    Whether an event counts depends on the decisions before it, so each key's events pass in order through one fold;
    rows are streamed sorted by key and time, so that a key of any size needs only `limit` times of memory.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, recent = None, deque()
        for batch in batches:
            out = []
            for k, t, e in batch.itertuples(index=False, name=None):
                if k != now:
                    now, recent = k, deque()
                while recent and recent[0] <= t - int(window_seconds * 1_000_000):
                    recent.popleft()
                ok = len(recent) < limit
                if ok:
                    recent.append(t)
                out.append((k, e, ok))
            yield pd.DataFrame(out, columns=["k", "e", "accepted"])

    kinds = dict(events.dtypes)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = events.select(F.col(key).alias("k"), micros.alias("t"), F.col(event_id).alias("e")).repartition("k").sortWithinPartitions("k", "t", "e")
    return rows.mapInPandas(fold, f"k {kinds[key]}, e {kinds[event_id]}, accepted boolean").select(F.col("k").alias(key), F.col("e").alias(event_id), "accepted")


def sessions(events: DataFrame, key: str, at: str, event_id: str, ttl_seconds: int = 3600) -> DataFrame:
    """events with `session`, numbered from 1 by key; a gap longer than the time to live starts a new one."""
    w = Window.partitionBy(key).orderBy(at, event_id)
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))) > ttl_seconds * 1_000_000
    return events.withColumn("_new", F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0)).withColumn("session", F.sum("_new").over(w)).drop("_new")


def last_turns(events: DataFrame, by: list[str], order: list[str], n: int = 5) -> DataFrame:
    """The last n events of each group."""
    return events.withColumn("back", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))).filter(F.col("back") <= n)


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """New jobs whose (job_type, dedupe_key) no queued or leased job has, each once."""
    live = jobs.filter(F.col("state").isin("queued", "leased")).select("job_type", "dedupe_key")
    return new.dropDuplicates(["job_type", "dedupe_key"]).join(live, ["job_type", "dedupe_key"], "left_anti")


def lease(jobs: DataFrame, owner: str, now: Column, n: int, seconds: int = 300) -> DataFrame:
    """jobs after leasing the n due ones of highest priority, ties by id; a lease counts as an attempt."""
    due = jobs.filter((F.col("state") == "queued") & (F.col("next_attempt_at") <= now)).orderBy(F.desc("priority"), "id").limit(n)
    picked = due.select("id", F.lit(True).alias("_picked"))
    out = jobs.join(F.broadcast(picked), "id", "left")
    hit = F.col("_picked").isNotNull()
    return out.select(*[
        F.when(hit, value).otherwise(F.col(c)).alias(c) if value is not None else F.col(c)
        for c in jobs.columns
        for value in [{"state": F.lit("leased"), "attempts": F.col("attempts") + 1, "lease_owner": F.lit(owner), "leased_until": now + F.make_dt_interval(secs=F.lit(seconds))}.get(c)]
    ])


def settle(jobs: DataFrame, results: DataFrame, now: Column, max_attempts: int = 5, base: int = 30, cap: int = 3600) -> DataFrame:
    """jobs after results (id, owner, ok): only the lease's owner counts; failures wait, or die after max_attempts."""
    r = results.select("id", F.col("owner").alias("_owner"), F.col("ok").alias("_ok"))
    j = jobs.join(r, "id", "left")
    mine = (F.col("state") == "leased") & (F.col("lease_owner") == F.col("_owner"))
    dead = F.col("attempts") >= max_attempts
    state = F.when(mine & F.col("_ok"), "succeeded").when(mine & dead, "dead_letter").when(mine, "queued").otherwise(F.col("state"))
    wait = now + F.make_dt_interval(secs=backoff_seconds(F.col("attempts"), base, cap))
    free = lambda c: F.when(mine, F.lit(None)).otherwise(F.col(c)).alias(c)
    return j.select(*[
        state.alias("state") if c == "state" else F.when(mine & ~F.col("_ok") & ~dead, wait).otherwise(F.col(c)).alias(c) if c == "next_attempt_at" else free(c) if c in ("lease_owner", "leased_until") else F.col(c)
        for c in jobs.columns
    ])


def reclaim(jobs: DataFrame, now: Column, max_attempts: int = 5) -> DataFrame:
    """jobs with expired leases back in the queue at once, or dead after max_attempts."""
    lost = (F.col("state") == "leased") & (F.col("leased_until") < now)
    state = F.when(lost & (F.col("attempts") >= max_attempts), "dead_letter").when(lost, "queued").otherwise(F.col("state"))
    free = lambda c: F.when(lost, F.lit(None)).otherwise(F.col(c)).alias(c)
    return jobs.select(*[state.alias("state") if c == "state" else free(c) if c in ("lease_owner", "leased_until") else F.col(c) for c in jobs.columns])


@dataclass(frozen=True)
class JobRules:
    """How a job's state follows its events; times are microseconds, a state is [state, attempts, owner, until, next] or null before the first.

    enqueue counts unless the job waits or is leased; lease if it waits and is due; succeed and fail by the lease's owner
    only. A failure waits, doubling from base up to cap seconds, and after max_attempts the job is dead. A lease that is
    not settled runs out: the job waits again at once, or is dead.
    """

    max_attempts: int = 5
    base: int = 30
    cap: int = 3600

    @staticmethod
    def due(state: list | None) -> int | None:
        return state[3] if state and state[0] == "leased" else None

    def expired(self, state: list | None, now: int) -> tuple[list | None, list]:
        """The state once a lease that ended before now has run out, and the change."""
        until = self.due(state)
        if until is None or until >= now:
            return state, []
        name = "dead_letter" if state[1] >= self.max_attempts else "queued"
        return [name, state[1], None, None, until], [(until, name, state[1], None)]

    def step(self, state: list | None, event: dict, at: int) -> tuple[list | None, list]:
        state, out = self.expired(state, at)
        kind, owner = event["kind"], event["owner"]
        name, attempts, holder, _, due = state or [None, 0, None, None, None]
        if kind == "enqueue" and name not in ("queued", "leased"):
            state = ["queued", 0, None, None, at]
        elif kind == "lease" and name == "queued" and due <= at:
            state = ["leased", attempts + 1, owner, at + (event["seconds"] or 300) * 1_000_000, None]
        elif kind == "succeed" and name == "leased" and holder == owner:
            state = ["succeeded", attempts, None, None, None]
        elif kind == "fail" and name == "leased" and holder == owner:
            wait = min(self.cap, self.base * 2 ** (attempts - 1)) * 1_000_000
            state = ["dead_letter", attempts, None, None, None] if attempts >= self.max_attempts else ["queued", attempts, None, None, at + wait]
        else:
            return state, out
        return state, [*out, (at, state[0], state[1], state[2])]


def job_history(events: DataFrame, now: Column | None = None, rules: JobRules | None = None) -> DataFrame:
    """(job_id, at, state, attempts, owner): each change of a job's state by its events (job_id, at, event_id, kind, owner, seconds).

    A job's events take their steps in the order of time and id, streamed through one fold; leases that end before now,
    where it is given, have run out. Rows without job_id are left out.
    """
    rules = rules or JobRules()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, state, until = None, None, None
        for batch in batches:
            out = []
            for k, at, _, kind, owner, seconds, now_us in batch.itertuples(index=False, name=None):
                if k != job:
                    out += [(job, *row) for row in (rules.expired(state, until)[1] if until is not None else [])]
                    job, state, until = k, None, None if pd.isna(now_us) else int(now_us)
                state, rows = rules.step(state, {"kind": kind, "owner": owner, "seconds": None if pd.isna(seconds) else int(seconds)}, at)
                out += [(k, *row) for row in rows]
            yield pd.DataFrame(out, columns=["job_id", "at_us", "state", "attempts", "owner"])
        if until is not None:
            yield pd.DataFrame([(job, *row) for row in rules.expired(state, until)[1]], columns=["job_id", "at_us", "state", "attempts", "owner"])

    until = F.lit(None).cast("long") if now is None else F.unix_micros(now.cast("timestamp"))
    rows = events.filter("job_id is not null").select("job_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "event_id", "kind", "owner", "seconds", until.alias("now"))
    rows = rows.repartition("job_id").sortWithinPartitions("job_id", "at", "event_id")
    found = rows.mapInPandas(fold, f"job_id {dict(events.dtypes)['job_id']}, at_us long, state string, attempts int, owner string")
    return found.select("job_id", F.timestamp_micros("at_us").alias("at"), "state", "attempts", "owner")


def circuit(statuses: DataFrame, host: str = "host", order: str = "seq", status: str = "status", threshold: int = 2) -> DataFrame:
    """Per host whether and why the circuit opened: (host, reason, opened_at).

    It opens at the threshold-th denial (403 or 429) without an answer of 200 to 399 between, or at a `captcha` or
    `parser_drift` event (column event), and stays open.
    """
    w = Window.partitionBy(host).orderBy(order)
    ok, denied = F.col(status).between(200, 399), F.col(status).isin(403, 429)
    runs = statuses.withColumn("_run", F.coalesce(F.sum(F.when(ok, 1).otherwise(0)).over(w), F.lit(0))).withColumn("_no", F.when(denied, 1).otherwise(0))
    runs = runs.withColumn("_count", F.sum("_no").over(Window.partitionBy(host, "_run").orderBy(order)))
    why = F.when(F.col("event").isin("captcha", "parser_drift"), F.col("event")).when(denied & (F.col("_count") >= threshold), F.concat(F.lit("repeated_"), F.col(status).cast("string")))
    first = runs.withColumn("_why", why).filter("_why is not null").groupBy(host).agg(F.min(F.struct(F.col(order).alias("at"), F.col("_why").alias("why"))).alias("f"))
    return statuses.select(host).distinct().join(first, host, "left").select(host, F.col("f.why").alias("reason"), F.col("f.at").alias("opened_at"))


def round_robin(boards: DataFrame, target: int = 200, batch: int = 10) -> DataFrame:
    """Page slices in rounds: (round, board_id, start, pages). boards (board_id, next_page, pos); a null next_page is done."""
    if target < 1 or not 1 <= batch <= target:
        raise ValueError("invalid target or batch")
    rounds = boards.filter("next_page is not null").withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(target), F.lit(batch))))
    end = F.least(F.lit(target), F.col("s") + batch - 1)
    start = F.greatest("next_page", "s")
    return rounds.filter(F.col("next_page") <= end).select(((F.col("s") - 1) / batch + 1).cast("int").alias("round"), "pos", "board_id", start.cast("int").alias("start"), (end - start + 1).cast("int").alias("pages"))


def replay(steps: DataFrame, run: str = "run_id", order: str = "at") -> DataFrame:
    """An agent run's log: steps numbered from 1, repeated calls marked by their fingerprint, the latest state last."""
    w = Window.partitionBy(run).orderBy(order, "step_id")
    again = F.row_number().over(Window.partitionBy(run, "fingerprint").orderBy(order, "step_id")) > 1
    return steps.withColumn("step_index", F.row_number().over(w)).withColumn("repeated", again).withColumn("latest", F.lead("step_id").over(w).isNull())
