import random

from pyspark.sql import functions as F

from loomspark.operators import temporal
from loomspark.streaming import stateful, streams


def events(spark, folder):
    df = spark.range(200).select((F.col("id") % 4).alias("key"), F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + (F.col("id") * 7919) % 600).alias("at"))
    df.coalesce(1).write.parquet(folder)
    return df


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_limiter_equals_batch(spark, tmp_path):
    df = events(spark, str(tmp_path / "e"))
    drain(streams.rate_limit(streams.source(spark, str(tmp_path / "e"), df.schema), 3, 30.0), "limited")
    batch = {(r["key"], r["event_id"]): r["accepted"] for r in temporal.rate_limit(df, "key", "at", "event_id", 3, 30.0).collect()}
    assert {(r["key"], r["event_id"]): r["accepted"] for r in spark.table("limited").collect()} == batch


def test_window_counts_equal_batch(spark, tmp_path):
    df = events(spark, str(tmp_path / "e")).withColumn("kind", F.col("key").cast("string")).withColumn("value", F.lit(1.0)).select("kind", "at", "value")
    df.write.parquet(str(tmp_path / "w"))
    drain(streams.window_counts(streams.source(spark, str(tmp_path / "w"), df.schema)), "counted", "complete")
    assert sum(r["n"] for r in spark.table("counted").collect()) == 200


def test_changes_are_appended(spark, tmp_path):
    schema = "k long, content_hash string, at timestamp"
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "ckpt")
    for n, digest in ((3, "'a'"), (4, "if(id = 1, 'b', 'a')")):
        spark.sql(f"select id k, {digest} content_hash, timestamp '2024-01-0{n}' at from range({n})").write.mode("append").parquet(str(tmp_path / "in"))
        streams.append_changes(streams.source(spark, str(tmp_path / "in"), schema), log, checkpoint, "k").awaitTermination()
    rows = spark.read.parquet(log)
    assert sorted(tuple(r) for r in streams.current(rows, "k").select("k", "content_hash").collect()) == [(0, "a"), (1, "b"), (2, "a"), (3, "a")]
    assert sorted((r["action"], r["dedupe_key"]) for r in streams.changes(rows, "k").collect()) == [("inserted", "0:a"), ("inserted", "1:a"), ("inserted", "2:a"), ("inserted", "3:a"), ("updated", "1:b")]


def batches(spark, folder, rows, schema, delay=600):
    """Rows in files that a stream reads one by one, in an order that strays from time by less than the delay."""
    rng = random.Random(4)
    order = sorted(rows, key=lambda r: r["at"].timestamp() + rng.random() * delay * 0.8)
    out, n = [], max(1, -(-len(order) // 3))
    for i in range(0, len(order), n):
        out.append(lambda part=order[i : i + n]: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder))
    return out


def streamed(spark, tmp_path, events, machine):
    """What a stream gives that is stopped and started again after each micro-batch, the last one a tick of a null key."""
    folder, schema = str(tmp_path / "in"), events.schema
    for write in batches(spark, folder, events.collect(), schema):
        write()
        stateful.appended(machine(spark.readStream.schema(schema).parquet(folder)), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    tick = events.agg(F.max("at").alias("at")).select(*[F.col("at") + F.expr("interval 1 hour") if c == "at" else F.lit(None).cast(kind).alias(c) for c, kind in events.dtypes])
    tick.toDF(*events.columns).write.mode("append").parquet(folder)
    stateful.appended(machine(spark.readStream.schema(schema).parquet(folder)), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    out = spark.read.parquet(str(tmp_path / "out"))
    return sorted(tuple(r) for r in out.collect() if r[0] is not None)


def at(seconds="id * 97"):
    return F.timestamp_seconds(F.lit(1_700_000_000) + F.expr(seconds)).alias("at")


def test_circuit_stream_equals_batch(spark, tmp_path):
    status = F.when(F.col("id") % 3 == 0, 403).when(F.col("id") % 7 == 0, 200).when(F.col("id") % 5 != 0, 500)
    calls = spark.range(120).select((F.col("id") % 4).alias("host"), at(), F.col("id").alias("seq"), status.alias("status"), F.when(F.col("id") == 9, "captcha").alias("event"))
    want = sorted(tuple(r) for r in temporal.circuit(calls, threshold=3).filter("reason is not null").collect())
    assert streamed(spark, tmp_path, calls, lambda e: stateful.circuit(e, 3)) == want and len(want) > 1


def test_log_stream_equals_batch_and_forgets(spark, tmp_path):
    log = spark.range(80).select((F.col("id") % 3).alias("run_id"), F.col("id").alias("step_id"), at("id * 61 + if(id > 50, 90000, 0)"), (F.col("id") % 7).cast("string").alias("fingerprint"))
    parts = [temporal.replay(log.filter(c)) for c in ("step_id <= 50", "step_id > 50")]
    want = sorted(tuple(r) for p in parts for r in p.select("run_id", "step_id", F.col("step_index").cast("int"), "repeated").collect())
    assert streamed(spark, tmp_path, log, lambda e: stateful.replay(e, idle_seconds=3600)) == want


def test_job_stream_equals_batch_and_tables(spark, tmp_path):
    rng, rules = random.Random(8), temporal.JobRules(max_attempts=2, base=60)
    rows = [(rng.randrange(5), i, rng.choice(["enqueue", "lease", "lease", "succeed", "fail"]), rng.choice(["a", "b"]), rng.choice([30, 200, None])) for i in range(150)]
    events = spark.createDataFrame(rows, "job_id long, event_id long, kind string, owner string, seconds long").select("job_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 83).alias("at"), "event_id", "kind", "owner", "seconds")
    now = events.agg(F.max("at") + F.expr("interval 50 minutes")).first()[0]
    want = sorted(tuple(r) for r in temporal.job_history(events, F.lit(now), rules).collect())
    assert streamed(spark, tmp_path, events, lambda e: stateful.jobs(e, rules)) == want
    assert {r[2] for r in want} == {"queued", "leased", "succeeded", "dead_letter"}


def test_job_steps_equal_the_table_functions(spark):
    """One job, step by step: what a lease, a failure and a lost lease do to its row and to its history."""
    row = spark.createDataFrame([(1, "queued", 0, 0)], "id long, state string, priority int, attempts int").select("*", F.lit(None).cast("string").alias("lease_owner"), F.lit(None).cast("timestamp").alias("leased_until"), F.timestamp_seconds(F.lit(0)).alias("next_attempt_at"))
    second = lambda n: F.timestamp_seconds(F.lit(n))
    leased = temporal.lease(row, "a", second(10), 1, 60)
    failed = temporal.settle(leased, spark.createDataFrame([(1, "a", False)], "id long, owner string, ok boolean"), second(20), base=30)
    lost = temporal.reclaim(temporal.lease(failed, "a", second(100), 1, 60), second(200))
    got = [tuple(df.select("state", "attempts", F.unix_seconds("next_attempt_at")).first()) for df in (leased, failed, lost)]
    rules, events = temporal.JobRules(base=30), [("enqueue", 0), ("lease", 10), ("fail", 20), ("lease", 100)]
    state, told = None, []
    for kind, s in events:
        state, rows = rules.step(state, {"kind": kind, "owner": "a", "seconds": 60}, s * 1_000_000)
        told += [(r[1], r[2]) for r in rows]
    state, rows = rules.expired(state, 200 * 1_000_000)
    assert told[1:] + [(rows[0][1], rows[0][2])] == [("leased", 1), ("queued", 1), ("leased", 2), ("queued", 2)] and [g[:2] for g in got] == [("leased", 1), ("queued", 1), ("queued", 2)]
    assert got[1][2] == 50 and state[4] == 160 * 1_000_000


def test_backfill_streams_slices_of_time(spark, tmp_path, monkeypatch):
    rng, took, run = random.Random(8), [], stateful.appended
    made = [(i % 2, i, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", rng.choice([200, 429, 500]), "captcha" if i == 1100 else None) for i in range(1200)]
    calls = spark.createDataFrame(made, "host long, seq long, at string, status int, event string").withColumn("at", F.to_timestamp("at"))
    monkeypatch.setattr(stateful, "SLICE", 400, raising=False)
    monkeypatch.setattr(stateful, "appended", lambda *a: took.extend(p["numInputRows"] for p in run(*a).recentProgress))
    got = stateful.backfilled(calls.orderBy(F.rand(3)), lambda e: stateful.circuit(e, 6), "host", "at", str(tmp_path / "b"), 2)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in temporal.circuit(calls, threshold=6).select("host", "reason", "opened_at").collect())
    assert sum(took) == 1201 and max(took) < 600  # all in one batch, before
