"""Queries over event time (X): batches with SQL, and streams that run over the same files."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsense.sources.sinks import shared_folder
from colsense.streaming import events as X

from . import query
from .inputs import read as table


def read(spark, d, name):
    """The events with their time in the session's zone."""
    return table(spark, d, name).withColumn("ts", F.col("ts").cast("timestamp"))


def stream(spark, d):
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{d.rstrip('/')}/events.parquet").schema
    # A pattern, as the table may be a file or a folder of files.
    rows = spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/event[s].parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def rnd(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("x01_rolling_median", "SELECT event_id, count(*) OVER w AS n, round(median(greatest(value, 0)) OVER w, 6) AS median FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def x01(spark, d):
    return rnd(X.rolling_median(read(spark, d, "events"), "user_id", "value").select("event_id", "n", "median"), "median")


@query("x02_stalls", "WITH g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events) SELECT user_id, count(*) AS n, round(max(gap), 6) AS longest FROM g WHERE gap > 7200 GROUP BY 1")
def x02(spark, d):
    return X.stalls(read(spark, d, "events"), "user_id", 7200).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("gap"), 6).alias("longest"))


@query("x02_sessions", "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, s.s")
def x02b(spark, d):
    return X.sessions(read(spark, d, "events"), "user_id", "7200 seconds").select("user_id", F.unix_micros("start").alias("start"), "n")


_WATCH = X.Watch(stall=7200, slow=14400, failed=4, slow_phase="view", failure="error", error="", terminal=("purchase",))
# The watermark of a stream over all events: the latest of them, in whole milliseconds, less ten minutes.
_UNTIL = "u AS (SELECT (epoch_us(max(ts)) // 1000 - 600000) * 1000 AS until FROM events)"
_TRIGGERS = f"""WITH {_UNTIL}, e AS (SELECT user_id, epoch_us(ts) AS t, event_id, event_type AS s, until FROM events, u WHERE epoch_us(ts) <= until),
 o AS (SELECT *, sum(CASE WHEN s = 'purchase' THEN 1 ELSE 0 END) OVER w AS over_ FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
 r AS (SELECT *, coalesce(lead(t) OVER w, until + 1) AS horizon, CASE WHEN lag(s) OVER w = s THEN 0 ELSE 1 END AS new, count(*) FILTER (WHERE s = 'error') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM o WHERE over_ = 0 OR (s = 'purchase' AND over_ = 1) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
 p AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS phase FROM r)
 SELECT user_id, 'stall' AS trigger, min(t) + 7200000000 AS at FROM p WHERE s <> 'purchase' AND t + 7200000000 < horizon GROUP BY user_id, phase
 UNION ALL SELECT user_id, 'slow_phase', min(t) + 14400000000 FROM p WHERE s = 'view' GROUP BY user_id, phase HAVING min(t) + 14400000000 < max(horizon)
 UNION ALL SELECT user_id, 'failures', min(t) FROM p WHERE s = 'error' AND n = 4 GROUP BY user_id"""


@query("x02_triggers", _TRIGGERS)
def x02c(spark, d):
    e = read(spark, d, "events")
    until = e.agg(((F.floor(F.max(F.unix_micros("ts")) / 1000) - 600_000) * 1000).alias("u"))
    return X.triggers(e, "user_id", "event_type", _WATCH, until)


@query("x02_triggers_stream", _TRIGGERS)
def x02d(spark, d):
    """The same from the stream, by timers, as far as its watermark comes."""
    return X.run_available(spark, X.triggers_live(stream(spark, d), "user_id", "event_type", _WATCH), shared_folder(spark))


@query("x08_sessions_stream", f"WITH {_UNTIL}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g), z AS (SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 7200000000 AS stop, count(*) AS n FROM s GROUP BY user_id, s.s) SELECT user_id, start, stop, n FROM z, u WHERE stop <= until")
def x08b(spark, d):
    """Sessions that the watermark has closed, from the stream."""
    out = X.run_available(spark, X.sessions(stream(spark, d), "user_id", "7200 seconds"), shared_folder(spark))
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "n")


@query("x03_resources", "SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY 1, 2")
def x03(spark, d):
    r = X.resources(read(spark, d, "events"))
    return rnd(r.select(F.unix_micros("start").alias("start"), "event_type", "n", "mean", "most"), "mean")


@query("x03_x08_resources_stream", f"WITH {_UNTIL}, w AS (SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY 1, 2) SELECT w.* FROM w, u WHERE start + 3600000000 <= until")
def x03b(spark, d):
    """Windows that the watermark has closed, from the stream."""
    out = X.run_available(spark, X.resources(stream(spark, d)), shared_folder(spark))
    return rnd(out.select(F.unix_micros("start").alias("start"), "event_type", "n", "mean", "most"), "mean")


_ALLOWED = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"), ("purchase", "view")]


@query("x04_illegal_steps", "WITH s AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, event_type AS t FROM events) SELECT user_id, count(*) AS n FROM s WHERE f IS NOT NULL AND f || '>' || t NOT IN (" + ", ".join(f"'{a}>{b}'" for a, b in _ALLOWED) + ") GROUP BY 1")
def x04(spark, d):
    allowed = spark.createDataFrame(_ALLOWED, "`from` string, `to` string")
    return X.illegal(read(spark, d, "events"), "user_id", "event_type", allowed).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("x04_illegal_steps_stream", "WITH s AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, event_type AS t FROM events) SELECT user_id, count(*) FILTER (WHERE f IS NOT NULL AND f || '>' || t NOT IN (" + ", ".join(f"'{a}>{b}'" for a, b in _ALLOWED) + ")) AS n FROM s GROUP BY 1")
def x04b(spark, d):
    out = X.run_available(spark, X.illegal_live(stream(spark, d), set(_ALLOWED)), shared_folder(spark), sink="batch")
    return out.groupBy("user_id").agg(F.sum("illegal").alias("n"))


@query("x05_incremental_scoring", "SELECT event_id, CASE WHEN value > 20 THEN 'high' ELSE 'low' END AS label FROM events")
def x05(spark, d):
    """Each new file is scored as it comes."""
    scored = stream(spark, d).select("event_id", F.when(F.col("value") > 20, "high").otherwise("low").alias("label"))
    return X.run_available(spark, scored, shared_folder(spark))


@query("x06_resume", "SELECT count(*) AS n FROM (SELECT DISTINCT event_id FROM events)")
def x06(spark, d):
    """The same stream runs twice from one checkpoint; nothing is done again."""
    folder = shared_folder(spark)
    for _ in range(2):
        out = X.run_available(spark, X.once(stream(spark, d).select("event_id", "ts"), "event_id"), folder)
    return out.agg(F.count(F.lit(1)).alias("n"))


@query("x07_cadence", "SELECT epoch_us(date_trunc('day', ts)) AS start, event_type, count(*) AS attempts, count(*) FILTER (WHERE value > 50) AS retries FROM events GROUP BY 1, 2")
def x07(spark, d):
    e = read(spark, d, "events")
    return e.groupBy(F.unix_micros(F.date_trunc("day", "ts")).alias("start"), "event_type").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.expr("value > 50")).alias("retries"))


@query("x08_sliding", "WITH w AS (SELECT unnest([0, 1800]) AS o), b AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b, value FROM events) SELECT epoch_us(b) - o * 1000000 AS start, count(*) AS n, round(sum(value), 6) AS total FROM b, w GROUP BY 1")
def x08(spark, d):
    return rnd(X.sliding(read(spark, d, "events")).select(F.unix_micros("start").alias("start"), "n", "total"), "total")
