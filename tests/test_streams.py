"""Streams over several batches: timers without later events, rows behind the watermark, windows that it closes."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from colsense.streaming import events as X

SCHEMA = "event_id long, ts timestamp, run string, state string, value double"
BEGIN = datetime(2024, 1, 1)
WATCH = X.Watch(stall=120, slow=300, failed=3, slow_phase="SWEEP", failure="FAILED", terminal=("DONE", "ERROR"))


def at(s):
    return BEGIN + timedelta(seconds=s)


def us(s):
    return int((at(s) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def stream(spark, folder, batches, begin=0):
    """Files that come one after the other, each a batch."""
    for k, rows in enumerate(batches, begin):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/b{k:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def plain(rows, until, w):
    """A walk over each run's events and a clock."""
    out = []
    for run in {r[2] for r in rows}:
        phase, told, n, last, entered = None, set(), 0, 0, 0
        own = sorted((r[1], r[0], r[3]) for r in rows if r[2] == run and r[1] <= until)
        for t, _, s in [*own, (until + 1e-6, None, None)]:
            if phase is not None:
                for due, kind in sorted([(last + w.stall, "stall"), *([(entered + w.slow, "slow_phase")] if phase == w.slow_phase else [])]):
                    if due < t and kind not in told:
                        out.append((run, kind, us(due)))
                        told.add(kind)
            if s is None:
                break
            if s != phase:
                phase, entered = s, t
                told -= {"stall", "slow_phase"}
            last, n = t, n + (s == w.failure)
            if s in w.terminal:
                if s == w.error:
                    out.append((run, "error", us(t)))
                break
            if n >= w.failed and "failures" not in told:
                out.append((run, "failures", us(t)))
                told.add("failures")
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    rows = []
    for run in range(12):
        t = rng.randrange(100)
        for _ in range(rng.randrange(1, 30)):
            rows.append((len(rows), float(t), f"r{run}", rng.choices(["SWEEP", "OTHER", "FAILED", "DONE", "ERROR"], [8, 6, 4, 0.3, 0.3])[0]))
            t += rng.choice([0, 5, 30, 60, 119, 121, 200])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_triggers(spark, tmp_path, seed):
    """Batch and stream are the plain walk; rows of a run come out of order within the delay."""
    rows = made(seed)
    spark_rows = [(i, at(t), run, s, 0.0) for i, t, run, s in rows]
    by_time = sorted(spark_rows, key=lambda r: r[1])
    rng = random.Random(seed)
    size = max(1, len(by_time) // 5)
    parts = [by_time[k : k + size] for k in range(0, len(by_time), size)]
    for p in parts:
        rng.shuffle(p)
    horizon = max(r[1] for r in rows) - 60
    until = spark.createDataFrame([(us(horizon),)], "u long")
    want = plain(rows, horizon, WATCH)
    got = X.triggers(spark.createDataFrame(spark_rows, SCHEMA), "run", "state", WATCH, until)
    assert sorted(map(tuple, got.collect())) == want
    live = X.triggers_live(stream(spark, str(tmp_path / "in"), parts), "run", "state", WATCH, "60 seconds")
    out, told = X.run_counted(spark, live, str(tmp_path / "run"))
    assert sorted(map(tuple, out.collect())) == want and {k for _, k, _ in want} >= {"stall", "slow_phase", "failures"}
    assert told["batches"] >= len(parts)


def test_a_silence_is_told_without_a_later_event_of_its_run(spark, tmp_path):
    """Other runs move the clock; a restart from the checkpoint tells nothing twice; nothing follows a terminal state."""
    folder = str(tmp_path / "in")
    first = [[(1, at(0), "quiet", "OTHER", 0.0), (2, at(0), "ended", "DONE", 0.0)], [(3, at(100), "busy", "OTHER", 0.0)], [(4, at(300), "busy", "OTHER", 0.0)]]
    live = lambda s: X.triggers_live(s, "run", "state", WATCH, "10 seconds")
    out, _ = X.run_counted(spark, live(stream(spark, folder, first)), str(tmp_path / "run"))
    assert sorted(map(tuple, out.collect())) == [("busy", "stall", us(220)), ("quiet", "stall", us(120))]
    more = stream(spark, folder, [[(5, at(900), "ended", "FAILED", 0.0), (6, at(900), "third", "OTHER", 0.0)]], begin=3)
    out, _ = X.run_counted(spark, live(more), str(tmp_path / "run"))
    assert sorted(map(tuple, out.collect())) == [("busy", "stall", us(220)), ("quiet", "stall", us(120))]


def test_late_rows_are_left_out_and_counted(spark, tmp_path):
    """Two rows belong to a window that an earlier batch has closed (Spark judges rows by the watermark of one batch before); one is behind the watermark, but its window is open."""
    batches = [[(1, at(0), "a", "x", 1.0), (2, at(7200), "a", "x", 2.0)], [(7, at(7300), "a", "x", 6.0)], [(3, at(6500), "a", "x", 4.0), (4, at(100), "a", "x", 8.0), (5, at(200), "b", "y", 16.0)], [(6, at(12000), "a", "x", 32.0)]]
    rows = stream(spark, str(tmp_path / "in"), batches).withColumn("event_type", F.col("state"))
    out, told = X.run_counted(spark, X.resources(rows, "1 hour", "10 minutes"), str(tmp_path / "run"))
    assert sorted((r["start"], r["n"], r["mean"]) for r in out.collect()) == [(at(0), 1, 1.0), (at(3600), 1, 4.0), (at(7200), 2, 4.0)]
    assert told["late"] == 2 and told["batches"] >= 4


def test_sessions_that_the_watermark_closes(spark, tmp_path):
    """Sessions grow over batches; those that may still grow are not given out."""
    batches = [[(1, at(0), "a", "x", 0.0), (2, at(50), "b", "x", 0.0)], [(3, at(100), "a", "x", 0.0)], [(4, at(190), "a", "x", 0.0), (5, at(700), "b", "x", 0.0)], [(6, at(1500), "c", "x", 0.0)], [(7, at(5), "b", "x", 0.0), (8, at(1510), "c", "x", 0.0)]]
    out, told = X.run_counted(spark, X.sessions(stream(spark, str(tmp_path / "in"), batches), "run", "120 seconds", "60 seconds"), str(tmp_path / "run"))
    assert sorted((r["run"], r["start"], r["stop"], r["n"]) for r in out.collect()) == [("a", at(0), at(310), 3), ("b", at(50), at(170), 1), ("b", at(700), at(820), 1)]
    assert told["late"] == 1


@pytest.mark.parametrize("batches", [1, 6])
def test_illegal_steps_in_any_order(spark, tmp_path, batches):
    """A key's rows come shuffled, in several parts of a batch, and within the delay over several batches."""
    allowed = {("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")}
    rng = random.Random(batches)
    rows = [(k, at(rng.randrange(1500)), f"r{k % 4}", rng.choice(["a", "b", "c", None]), 0.0) for k in range(300)]
    by_time = sorted(rows, key=lambda r: r[1])
    parts = [by_time[k : k + 300 // batches] for k in range(0, 300, 300 // batches)]
    mixed = [[] for _ in parts]
    for k, p in enumerate(parts):  # a third of a batch's rows come one batch later
        for r in p:
            mixed[min(len(parts) - 1, k + (rng.random() < 1 / 3))].append(r)
    for p in mixed:
        rng.shuffle(p)
    want = {}
    for run in range(4):
        own = [r[3] for r in sorted(rows, key=lambda r: (r[1], r[0])) if r[2] == f"r{run}"]
        want[run] = sum(None not in s and s not in allowed for s in zip(own, own[1:]))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, 7)
    try:
        events = stream(spark, str(tmp_path / "in"), mixed).select(F.substring("run", 2, 1).cast("long").alias("user_id"), "ts", "event_id", F.col("state").alias("event_type"))
        out = X.run_available(spark, X.illegal_live(events, allowed), str(tmp_path / "run"), sink="batch")
        got = {r["user_id"]: r["n"] for r in out.groupBy("user_id").agg(F.sum("illegal").alias("n")).collect()}
    finally:
        spark.conf.unset(name)
    assert got == want
