"""Streaming queries: each processes what is there and is compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import rounded, sql, sql_round as rd
from checks.registry import query
from checks.score_queries import DCOLS, DESC
from motionframe.session import scratch_dir
from motionframe.streaming import incremental as inc


def _arriving(spark, sf, *cuts):
    """Track files of whole entities, or of their frames up to each cut and after it, in that order."""
    path = scratch_dir(spark, "arriving")
    t = fx.tracks(spark, sf)
    parts = [F.col("frame") < cuts[0], F.col("frame") >= cuts[0]] if cuts else [F.lit(True)]
    for part in parts:
        t.where(part).repartition(4, "entity_id").write.mode("append").parquet(path)
    return inc.track_stream(spark, path, t.schema, files_per_trigger=2)


@query("k2_incremental_descriptors", sql(
    "SELECT entity_id, class, grp, idx, row, n_valid_transitions, " + ", ".join(f"{rd(c)} AS {c}" for c in DCOLS) + " FROM dsc",
    "steps", extra=DESC))
def incremental_descriptors(spark, sf):
    out, state = scratch_dir(spark, "out"), scratch_dir(spark, "state")
    inc.incremental_descriptors(_arriving(spark, sf, 12), out, state).awaitTermination()
    return rounded(inc.read_descriptors(spark, out))


@query("k3_k4_causal_stream", sql(
    f"""SELECT entity_id, row, CAST(frame AS BIGINT) AS frame,
    {rd('CASE WHEN pf IS NULL THEN 0 WHEN pf = frame - 1 THEN x - px END')} AS dx,
    {rd('CASE WHEN pf IS NULL THEN 0 WHEN pf = frame - 1 THEN y - py END')} AS dy,
    {rd('stddev_pop(x) OVER (PARTITION BY entity_id, row ORDER BY frame ROWS UNBOUNDED PRECEDING)')} AS running_std,
    CAST(0 AS BIGINT) AS n_late
    FROM (SELECT *, lag(frame) OVER w AS pf, lag(x) OVER w AS px, lag(y) OVER w AS py FROM tracks
          WINDOW w AS (PARTITION BY entity_id, row ORDER BY frame))""", "tracks"))
def causal_stream(spark, sf):
    out, state = scratch_dir(spark, "out"), scratch_dir(spark, "state")
    inc.run_available(inc.causal_features(_arriving(spark, sf, 12)), out, state)
    return rounded(spark.read.parquet(out))


LIVE = """live AS (SELECT ts, event_type, CAST(value > 50 AS INTEGER) AS present FROM events)"""


def _live(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    e = inc.track_stream(spark, sf, schema, pattern="events.parquet")
    return _frames(e)


def _frames(events):
    return events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("value") > 50).alias("present"))


def _windows(spark, sf, **options):
    out, state = scratch_dir(spark, "out"), scratch_dir(spark, "state")
    stored = _frames(fx.table(spark, sf, "events"))
    inc.run_presence_to_end(_live(spark, sf), stored, ["event_type"], out, state, **options)
    df = inc.read_presence(spark, out)
    return rounded(df.withColumn("window_start", F.unix_timestamp("window_start")).withColumn(
        "window_end", F.unix_timestamp("window_end")))


@query("k5_live_presence", sql(
    f"""SELECT CAST(epoch(w) AS BIGINT) AS window_start, CAST(epoch(w) + 3600 AS BIGINT) AS window_end, event_type, count(*) AS n_frames, {rd('avg(present)')} AS rate
    FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, * FROM live) GROUP BY w, event_type""",
    extra=LIVE))
def live_presence(spark, sf):
    return _windows(spark, sf)


@query("k5_live_presence_sliding", sql(
    f"""SELECT CAST(epoch(w) AS BIGINT) AS window_start, CAST(epoch(w) + 86400 AS BIGINT) AS window_end, event_type, count(*) AS n_frames, {rd('avg(present)')} AS rate
    FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k.i * INTERVAL 6 HOUR AS w, * FROM live, range(4) k(i))
    GROUP BY w, event_type""", extra=LIVE))
def live_presence_sliding(spark, sf):
    return _windows(spark, sf, window="24 hours", slide="6 hours")
