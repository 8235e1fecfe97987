"""Operators over event time. Each works on a batch and, where it says so, on a stream as well."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _middle(values: Column) -> Column:
    """Median of a sorted array of at most a frame's rows."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def rolling_median(events: DataFrame, key: str, value: str, rows: int = 20) -> DataFrame:
    """events with the number, and the median of a value, of the last ``rows`` of each key; negatives count as 0. Batch."""
    w = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(-(rows - 1), 0)
    return events.withColumn("v", F.greatest(F.col(value), F.lit(0.0))).withColumn("n", F.count("v").over(w)).withColumn("last", F.array_sort(F.collect_list("v").over(w))).withColumn("median", _middle(F.col("last"))).drop("last")


def stalls(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """(key, since, gap): silences longer than a number of seconds. Batch."""
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts", "event_id"))
    gap = F.unix_micros("ts") - F.unix_micros(F.col("since"))
    return events.withColumn("since", before).withColumn("gap", gap / 1e6).where(F.col("gap") > seconds).select(key, "since", "gap")


def resources(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, mean, most) by tumbling window; batch or stream (with a watermark)."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    out = df.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "mean", "most")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, key: str, gap: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """(key, start, stop, n) of runs of events without a longer silence; batch or stream."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    out = df.groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def illegal(events: DataFrame, key: str, state: str, allowed: DataFrame) -> DataFrame:
    """(key, ts, from, to): steps between states that aren't allowed; a null state makes no step. Batch."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy("ts", "event_id"))
    steps = events.withColumn("from", before).where(F.col("from").isNotNull() & F.col(state).isNotNull()).select(key, "ts", "from", F.col(state).alias("to"))
    return steps.join(F.broadcast(allowed.select("from", "to")), ["from", "to"], "left_anti")


def illegal_live(events: DataFrame, allowed: set[tuple[str, str]], late: int = 600) -> DataFrame:
    """The same on a stream: rows (user_id, illegal) come out per batch of a key, and sum to its steps that aren't allowed.

    A batch's rows of a key come in any order and in several parts; they are gathered
    and looked at by (ts, event_id). Rows of later batches find their place as well, as
    long as they are not more than ``late`` seconds older than the key's latest row:
    these rows wait in its state with the number of steps already told, and what a batch
    puts between them is told as a difference, which may be negative. Older ones are left out.
    """

    def bad(states: list) -> int:
        return sum(a is not None and b is not None and (a, b) not in allowed for a, b in zip(states, states[1:]))

    def walk(key, batches: Iterator[pd.DataFrame], held):
        upto, last, told, waiting = held.get if held.exists else (None, None, 0, "[]")
        rows = [tuple(x) for x in json.loads(waiting)]
        for pdf in batches:
            rows += [(t, i, None if pd.isna(s) else s) for t, i, s in zip(pdf["t"].tolist(), pdf["event_id"].tolist(), pdf["event_type"].tolist()) if upto is None or t > upto]
        rows.sort(key=lambda x: x[:2])
        count = bad([last, *(x[2] for x in rows)])
        done = [x for x in rows if x[0] < rows[-1][0] - late * 1_000_000]
        rest = rows[len(done) :]
        settled = bad([last, *(x[2] for x in done)])
        if done:
            upto, last = done[-1][0], done[-1][2]
        held.update((upto, last, count - settled, json.dumps(rest)))
        yield pd.DataFrame({"user_id": [key[0]], "illegal": [count - told]})

    rows = events.select("user_id", F.unix_micros("ts").alias("t"), "event_id", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(walk, "user_id long, illegal long", "upto long, last string, told long, waiting string", "append", "NoTimeout")


#: Rows of a task of the triggers.
ROWS_OF_A_TASK = 250_000

#: Seconds of silence, seconds in the phase that may be slow, and failures that raise a trigger.
STALL, SLOW, FAILED = 120, 300, 10


class Watch(NamedTuple):
    """What is watched for: the columns ``ts``, ``event_id``, a key and a state.

    A phase is a run of like states of a key. A silence of more than ``stall`` seconds and
    more than ``slow`` seconds in the phase ``slow_phase`` raise a trigger once in each
    phase, ``failed`` events of state ``failure`` once in all, a state ``error`` at once.
    After a terminal state (``error`` is one) a key is no longer watched. Triggers have the
    time at which they are due, not that of the event that shows them.
    """

    stall: int = STALL
    slow: int = SLOW
    failed: int = FAILED
    slow_phase: str = "LLM_SWEEP"
    failure: str = "FAILED"
    error: str = "ERROR"
    terminal: tuple[str, ...] = ("IDLE", "CONVERGED", "ERROR")


def triggers(events: DataFrame, key: str, state: str, watch: Watch, until: DataFrame) -> DataFrame:
    """(key, trigger, at) in microseconds, of the events up to a time, and of silences that are due by then; until: one row, one column of microseconds. Batch."""
    us = 1_000_000
    # A chain of windows keeps a task's rows several times over; so the number of tasks follows from that of the rows.
    tasks = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-events.count() // ROWS_OF_A_TASK))
    rows = events.select(F.col(key).alias("key"), F.unix_micros("ts").alias("t"), "event_id", F.col(state).alias("state")).repartition(tasks, "key").crossJoin(F.broadcast(until.toDF("until"))).where(F.col("t") <= F.col("until"))
    order = Window.partitionBy("key").orderBy("t", "event_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    ended = F.col("state").isin(*watch.terminal)
    rows = rows.withColumn("over", F.sum(ended.cast("int")).over(so_far)).where((F.col("over") == 0) | (ended & (F.col("over") == 1)))
    rows = rows.withColumns({"next": F.lead("t").over(order), "new": F.coalesce((F.lag("state").over(order) != F.col("state")).cast("int"), F.lit(1)), "n": F.sum((F.col("state") == watch.failure).cast("int")).over(so_far)})
    rows = rows.withColumn("phase", F.sum("new").over(so_far)).withColumn("horizon", F.coalesce("next", F.col("until") + 1))
    live = rows.where(~ended)
    due = F.col("t") + watch.stall * us
    silent = live.where(due < F.col("horizon")).groupBy("key", "phase").agg(F.min(due).alias("at")).select("key", F.lit("stall").alias("trigger"), "at")
    spans = live.where(F.col("state") == watch.slow_phase).groupBy("key", "phase").agg((F.min("t") + watch.slow * us).alias("at"), F.max("horizon").alias("horizon"))
    long = spans.where(F.col("at") < F.col("horizon")).select("key", F.lit("slow_phase").alias("trigger"), "at")
    many = live.where(F.col("n") == watch.failed).groupBy("key").agg(F.min("t").alias("at")).select("key", F.lit("failures").alias("trigger"), "at")
    bad = rows.where(F.col("state") == watch.error).groupBy("key").agg(F.min("t").alias("at")).select("key", F.lit("error").alias("trigger"), "at")
    return silent.unionByName(long).unionByName(many).unionByName(bad).withColumnRenamed("key", key)


def triggers_live(events: DataFrame, key: str, state: str, watch: Watch, late: str = "10 minutes") -> DataFrame:
    """The same on a stream, as far as its watermark has come: a silence is told by a timer, without any later event of its key.

    Events wait in the key's state until the watermark has passed them, so that they are
    looked at in order of time however they come; the timer is set to the first of these
    and of what is due. A key that has ended keeps that alone.
    """
    us = 1_000_000

    def walk(name, batches: Iterator[pd.DataFrame], held):
        phase, entered, last, n, told, over, waiting = held.get if held.exists else (None, 0, 0, 0, "", False, "[]")
        told, queue, out = set(told.split()), [tuple(x) for x in json.loads(waiting)], []
        for pdf in batches:
            queue += [(int(t), int(i), s) for t, i, s in zip(pdf["t"], pdf["event_id"], pdf["state"])]
        if over:
            return iter(())
        mark = held.getCurrentWatermarkMs() * 1000
        queue.sort()

        def due() -> list[tuple[int, str]]:
            found = []
            if phase is not None and "stall" not in told:
                found.append((last + watch.stall * us, "stall"))
            if phase == watch.slow_phase and "slow_phase" not in told:
                found.append((entered + watch.slow * us, "slow_phase"))
            return found

        def ring(before: int) -> None:
            for at, kind in sorted(due()):
                if at < before:
                    out.append((kind, at))
                    told.add(kind)

        while queue and queue[0][0] <= mark and not over:
            t, _, s = queue.pop(0)
            ring(t)
            if s != phase:
                phase, entered = s, t
                told -= {"stall", "slow_phase"}
            last, n = t, n + (s == watch.failure)
            over = s in watch.terminal
            if s == watch.error:
                out.append(("error", t))
            elif not over and n >= watch.failed and "failures" not in told:
                out.append(("failures", t))
                told.add("failures")
        if not over:
            ring(mark + 1)
        if over:
            queue = []
        held.update((phase, entered, last, n, " ".join(sorted(told)), over, json.dumps(queue)))
        times = [] if over else [x[0] for x in due()] + [x[0] for x in queue[:1]]
        if times:
            held.setTimeoutTimestamp(max(min(times) // 1000 + 1, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [name[0]] * len(out), "trigger": [k for k, _ in out], "at": [a for _, a in out]}).astype({"at": "int64"})

    rows = events.withWatermark("ts", late).select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("t"), "event_id", F.col(state).alias("state"))
    kind = dict(events.dtypes)[key]
    out = rows.groupBy("key").applyInPandasWithState(walk, f"key {kind}, trigger string, at long", "phase string, entered long, last long, n long, told string, over boolean, waiting string", "append", "EventTimeTimeout")
    return out.withColumnRenamed("key", key)


def once(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once: what was done before a restart is left out; stream with a watermark, or batch."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def run_available(spark: SparkSession, stream: DataFrame, folder: str, mode: str = "append", sink: str = "parquet") -> DataFrame:
    """Runs a stream over what is there now, with its checkpoint in the shared folder, and reads the result back."""
    return run_counted(spark, stream, folder, mode, sink)[0]


def run_counted(spark: SparkSession, stream: DataFrame, folder: str, mode: str = "append", sink: str = "parquet") -> tuple[DataFrame, dict[str, int]]:
    """The same, with the number of batches that ran now and of rows that came too late and were left out (in an aggregation: of groups in a task)."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True)
    if mode == "append" and sink == "parquet":
        q = writer.format("parquet").option("path", f"{folder}/out").start()
    else:

        def put(df: DataFrame, epoch: int) -> None:
            df.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

        q = writer.foreachBatch(put).start()
    q.awaitTermination()
    told = [json.loads(p.json) for p in q.recentProgress]
    late = sum(o.get("numRowsDroppedByWatermark", 0) for p in told for o in p["stateOperators"])
    read = spark.read.schema(stream.schema) if mode == "append" and sink == "parquet" else spark.read
    return read.parquet(f"{folder}/out"), {"batches": len(told), "late": late}
