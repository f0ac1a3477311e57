"""Incremental work on arriving track files and frames with Structured Streaming."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from motionframe.functions import track_summary
from motionframe.operators.descriptors import DESCRIPTORS, channel_descriptors
from motionframe.operators.series import ATTRS

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Calling Python for a state costs milliseconds, whatever it holds. So entities share a
# state by hash: calls do not grow with the entities, and a batch computes those of a
# state together. A batch writes the states of its entities as a whole; a checkpoint keeps
# its number of buckets, so raise it for stores of many millions of entities.
BUCKETS = 1024


def _bucket(buckets: int):
    """Bucket of an entity; rows without an entity have one of their own."""
    return F.when(F.col("entity_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("entity_id"), F.lit(buckets)))


def _numbered(entities, rows_known, rows):
    """Numbers of entities and channels, known ones first, and what they stand for."""
    import numpy as np
    import pandas as pd

    new = rows["entity_id"]
    if len(new) and new.isna().all():  # the bucket without an entity: pandas has NaN for it
        who, names = np.zeros(len(entities) + len(new), np.int64), np.array([None], object)
    else:
        who, names = pd.factorize(np.concatenate([np.asarray(entities, dtype=new.to_numpy().dtype), new.to_numpy()]))
    channels, what = np.unique(np.concatenate([np.asarray(rows_known, np.int64), rows["row"].to_numpy(np.int64)]), return_inverse=True)
    return who, names, what, channels


def track_stream(spark: SparkSession, path: str, schema: StructType | str, *,
                 files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """New parquet files of a folder, each exactly once."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def incremental_descriptors(tracks: DataFrame, out: str, checkpoint: str,
                            stored: Callable[[SparkSession], DataFrame] | None = None, *, buckets: int = BUCKETS) -> StreamingQuery:
    """Descriptors of all entities with frames that are new since the last run.

    An entity's frames may come in several files and batches. Its state is a summary of
    bounded size per channel (`functions.track_summary`), which new frames are merged
    into: a batch reads its own rows and the summaries of the entities in it, whatever
    came before. It writes these entities' descriptors below `batch=`; a retried batch
    overwrites its own folder. `read_descriptors` gives the latest rows of every entity.
    The stream checkpoint takes the place of a work manifest.

    Frames of a channel that do not come after all its earlier ones, repeats included,
    cannot be merged. Their entities are computed again, now and in all later batches,
    from `stored`, a function that gives all track rows so far; without it such a batch
    fails. The summaries of a bucket's entities share a state, see `BUCKETS`; their rows
    in one batch are held by one task.
    """
    types = {f.name: f.dataType.simpleString() for f in tracks.schema.fields}
    attrs = [c for c in ATTRS if c in types]
    names = ["entity_id", *attrs, "row", *DESCRIPTORS, "n_valid_transitions", "apart"]
    schema = ", ".join(f"`{c}` {types[c]}" for c in ["entity_id", *attrs, "row"]) + ", " + ", ".join(
        f"{c} double" for c in DESCRIPTORS) + ", n_valid_transitions long, apart boolean"

    def step(key, chunks, state):
        import numpy as np
        import pandas as pd

        rows = pd.concat(list(chunks))
        rows = rows[rows["row"].notna()].rename(columns={"row": "channel"})
        if not len(rows):
            return
        own = ["entity_id", "channel", *attrs]
        known, apart = track_summary.empty(rows.assign(row=0), own), []
        if state.exists:
            channels, points, apart = state.get
            known = track_summary.Summary.unpack(channels, points)
        nobody = rows["entity_id"].isna().all()
        new = np.array([None if nobody else v for v in rows["entity_id"].unique()], object)
        old = known.channels
        who = pd.factorize(np.concatenate([old["entity_id"].to_numpy(object), rows["entity_id"].to_numpy(object)]), use_na_sentinel=False)[0]
        what = pd.factorize(np.concatenate([old["channel"].to_numpy(np.int64), rows["channel"].to_numpy(np.int64)]))[0]
        # a number per channel of an entity; known ones keep their order
        number = pd.factorize(who.astype(np.int64) * (what.max() + 1) + what)[0]
        where = np.append(old["row"].to_numpy(np.int64), (old["row"].max() + 1 if len(old) else 0) + np.arange(len(rows)))
        rows = rows.assign(row=where[number[len(old):]])
        # entities with frames that cannot be merged
        back = rows["frame"].to_numpy(float) <= rows["row"].map(old.set_index("row")["hi"]).to_numpy(float)
        apart = set(apart) | ({None} if nobody and back.any() else set(rows["entity_id"][back]))
        gone = lambda t: np.array([(None if nobody else v) in apart for v in t["entity_id"]], bool)
        if apart:
            rows = rows[~gone(rows)]
            lost = old["row"][gone(old)]
            known = track_summary.Summary(old[~old["row"].isin(lost)], known.points[~known.points["row"].isin(lost)])
        if len(rows):
            known = track_summary.merge(known, rows, own)
        state.update((*known.pack(), sorted(apart) if None not in apart else [None]))
        out = []
        if lagging := [v for v in new if v in apart]:
            blank = {c: np.nan if c in DESCRIPTORS else None if types.get(c) == "string" else 0 for c in names}
            out.append(pd.DataFrame({**blank, "entity_id": lagging, "apart": True})[names])
        if len(rows):
            asked = known.channels[known.channels["entity_id"].isin(rows["entity_id"])]
            found = track_summary.Summary(asked, known.points[known.points["row"].isin(asked["row"])])
            found = track_summary.descriptors(found, own, "entity_id").assign(apart=False)
            found["row"] = found["channel"]
            if nobody:
                found["entity_id"] = None
            out.append(found[names])
        yield from out

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = f"{out}/descriptors/way=merged/batch={number}"
        batch.write.mode("overwrite").parquet(folder)
        apart = spark.read.parquet(folder).where("apart").select("entity_id")
        if apart.isEmpty():
            return
        if stored is None:
            raise ValueError("frames came after later ones of their channel; pass `stored` to compute their entities again")
        rows = stored(spark).join(apart, "entity_id", "left_semi")
        again = channel_descriptors(rows).withColumn("apart", F.lit(False))
        again.write.mode("overwrite").parquet(f"{out}/descriptors/way=again/batch={number}")

    # NULL is the missing value of the model; pandas has NaN for it
    rows = tracks.select("entity_id", *attrs, "row", F.col("frame").cast("long").alias("frame"),
                         *[F.col(a).cast("double").alias(a) for a in track_summary.AXES])
    found = rows.withColumn("part", _bucket(buckets)).groupBy("part").applyInPandasWithState(
        step, schema, f"channels binary, points binary, apart array<{types['entity_id']}>", "append", "NoTimeout")
    found = found.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in DESCRIPTORS else F.col(c) for c in names])
    return (found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_descriptors(spark: SparkSession, out: str) -> DataFrame:
    """The latest descriptors of every entity that `incremental_descriptors` has written."""
    rows = spark.read.parquet(f"{out}/descriptors").where("not apart")
    last = rows.groupBy("entity_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["entity_id", "batch"], "left_semi").drop("batch", "way", "apart")


CAUSAL_STATE = ("channels array<bigint>, last_frame array<bigint>, last_x array<double>, last_y array<double>, "
                "n array<bigint>, mean array<double>, m2 array<double>, late array<bigint>")


def causal_features(tracks: DataFrame, timeout_ms: int | None = None, *, buckets: int = BUCKETS) -> DataFrame:
    """Velocity and running deviation per frame as frames arrive, from past frames only.

    Keeps an element per channel: the last frame with its position, and count, mean and
    centred squares of x. The entities of a bucket share a state, see `BUCKETS`; with
    `timeout_ms` each entity has its own. A frame that arrives in a later
    batch than one after it is late: it is dropped, since what followed has been given
    out already, and `n_late` counts such frames of the channel so far. Within a batch
    order does not matter. With `timeout_ms`, idle entities are dropped after that time;
    use it for queries that keep running, since a timeout makes Spark plan batches
    without data and an available-now run would not end.
    """
    types = {f.name: f.dataType.simpleString() for f in tracks.schema.fields}
    out = (f"entity_id {types['entity_id']}, row {types['row']}, frame long, dx double, dy double, "
           "running_std double, n_late long")

    def step(key, chunks, state):
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(chunks))
        rows = rows[rows["row"].notna()]
        if not len(rows):
            return
        entities, *old = state.get if state.exists else ([],) * 9
        who, names, what, channels = _numbered(entities, old[0], rows)
        number = who * max(len(channels), 1) + what
        n = len(old[0])
        known, part = _causal_step(number[n:], *(rows[c].to_numpy() for c in ("frame", "x", "y")), (number[:n], *old[1:]))
        back = lambda v: (names[np.asarray(v, np.int64) // max(len(channels), 1)], channels[np.asarray(v, np.int64) % max(len(channels), 1)])
        of, row = back(known[0])
        state.update((of.tolist(), row.tolist(), *known[1:]))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        of, part["row"] = back(part["row"])
        yield pd.DataFrame({"entity_id": of, **part})

    key = F.col("entity_id") if timeout_ms else _bucket(buckets)
    return (tracks.select("entity_id", "row", "frame", "x", "y", key.alias("part")).groupBy("part")
            .applyInPandasWithState(step, out, f"entities array<{types['entity_id']}>, {CAUSAL_STATE}", "append",
                                    "ProcessingTimeTimeout" if timeout_ms else "NoTimeout"))


HELD_STATE = CAUSAL_STATE + ", held_row array<bigint>, held_frame array<bigint>, held_ts array<bigint>, held_x array<double>, held_y array<double>"


def causal_features_in_order(tracks: DataFrame, *, ts: str = "ts", wait: str = "1 minute", idle_ms: int | None = None) -> DataFrame:
    """As `causal_features`, with frames held until none before them can come.

    `ts` is a frame's time. Frames wait in the entity's state until the watermark, `wait`
    behind the latest time seen, has reached them, and are then given out in frame order:
    frames that come up to `wait` late, in whatever batch, change nothing. Spark drops
    frames behind the watermark and counts them in its progress. The state holds the
    frames of the last `wait` besides the running sums. With `idle_ms`, an entity without
    frames for that long in event time is forgotten. Times rise with frames; a frame that
    does not come after those given out is dropped and counted in `n_late`.
    """
    types = {f.name: f.dataType.simpleString() for f in tracks.schema.fields}
    out = (f"entity_id {types['entity_id']}, row {types['row']}, frame long, dx double, dy double, "
           "running_std double, n_late long")
    names = ["entity_id", "row", "frame", "dx", "dy", "running_std", "n_late"]
    held_columns = ["row", "frame", "ms", "x", "y"]

    def step(key, chunks, state):
        import pandas as pd

        running, held = ([],) * 8, pd.DataFrame(columns=held_columns)
        if state.exists:
            *running, rows, frames, times, xs, ys = state.get
            held = pd.DataFrame(dict(zip(held_columns, (rows, frames, times, xs, ys))))
        expired = state.hasTimedOut
        if not expired:
            held = pd.concat([held, *(c[held_columns] for c in chunks)], ignore_index=True) if len(held) else pd.concat(
                [c[held_columns] for c in chunks], ignore_index=True)
        now = state.getCurrentWatermarkMs()
        due = held["ms"].astype("int64") <= now
        ready, held = held[due], held[~due]
        part = None
        if len(ready):
            one = ready.astype({"x": float, "y": float}).groupby(["row", "frame"], sort=True)[["x", "y"]].max().reset_index()
            running, part = _causal_step(*(one[c].to_numpy() for c in ("row", "frame", "x", "y")), running)
        if expired and not len(ready) and not len(held):
            state.remove()
            return
        blank = lambda v: None if v != v else float(v)
        state.update((*running, *([int(v) for v in held[c]] for c in held_columns[:3]), *([blank(v) for v in held[c].astype(float)] for c in ("x", "y"))))
        if len(held):
            state.setTimeoutTimestamp(max(int(held["ms"].min()), now + 1))
        elif idle_ms:
            state.setTimeoutTimestamp(now + idle_ms)
        if part:
            yield pd.DataFrame({"entity_id": [key[0]] * len(part["row"]), **part})[names]

    rows = tracks.where(F.col(ts).isNotNull()).withWatermark(ts, wait).select(
        "entity_id", "row", "frame", "x", "y", ts, F.unix_millis(ts).alias("ms"))
    return rows.groupBy("entity_id").applyInPandasWithState(step, out, HELD_STATE, "append", "EventTimeTimeout")


def _causal_step(row, frame, x, y, state):
    """New state of an entity and its output columns, by channel and frame, from its rows of a batch.

    All channels of the entity are computed together. Rows without a channel are left out.
    """
    import numpy as np

    known = ~np.isnan(row.astype(float))
    order = np.lexsort((frame[known], row[known]))
    row, frame, x, y = (np.asarray(v[known][order], dtype=t) for v, t in ((row, np.int64), (frame, np.int64), (x, float), (y, float)))
    old = [np.array(v, dtype=t) for v, t in zip(state or ([],) * 8, (np.int64, np.int64, float, float, np.int64, float, float, np.int64))]
    channels = np.union1d(old[0], row)
    at = np.searchsorted(channels, old[0])
    has = np.zeros(len(channels), bool)
    has[at] = True
    last, lx, ly, n, mean, m2, late = (np.zeros(len(channels), v.dtype) for v in old[1:])
    for new, v in zip((last, lx, ly, n, mean, m2, late), old[1:]):
        new[at] = v

    group = np.searchsorted(channels, row)
    fresh = ~has[group] | (frame > last[group])
    late += np.bincount(group[~fresh], minlength=len(channels))
    group, row, frame, x, y = (v[fresh] for v in (group, row, frame, x, y))
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    ends = np.append(starts, len(group))[1:]
    first = group[starts]  # the channel of each stretch of rows
    out = {}
    for name, v, before in (("dx", x, lx), ("dy", y, ly)):
        step = np.full(len(v), np.nan)
        step[1:] = np.where(np.diff(frame) == 1, np.diff(v), np.nan)
        follows = np.where(frame[starts] == last[first] + 1, v[starts] - before[first], np.nan)
        step[starts] = np.where(has[first], follows, 0.0)
        out[name] = step
    # merge the running sums of this batch, centred on each channel's first value, with the state
    seen = ~np.isnan(x)
    centre, d, s, q, count = (np.zeros(len(x)) for _ in range(5))
    for a, b in zip(starts, ends):
        part = seen[a:b]
        if part.any():
            centre[a:b] = x[a + part.argmax()]
            d[a:b] = np.where(part, x[a:b] - centre[a], 0.0)
            np.cumsum(part, out=count[a:b])
            np.cumsum(d[a:b], out=s[a:b])
            np.cumsum(d[a:b] * d[a:b], out=q[a:b])
    shift, total = mean[group] - centre, n[group] + count
    safe = np.maximum(total, 1)
    sum_all, square_all = s + n[group] * shift, q + m2[group] + n[group] * shift * shift
    var = np.maximum(square_all / safe - (sum_all / safe) ** 2, 0.0)
    std = np.where(total > 0, np.sqrt(var), np.nan)
    end = ends - 1
    last[first], lx[first], ly[first], n[first] = frame[end], x[end], y[end], total[end].astype(np.int64)
    mean[first] = centre[end] + sum_all[end] / safe[end]
    m2[first] = var[end] * total[end]
    state = tuple(v.tolist() for v in (channels, last, lx, ly, n, mean, m2, late))
    return state, {"row": row, "frame": frame, **out, "running_std": std, "n_late": late[group]}


def live_presence(frames: DataFrame, keys: Sequence[str], *, ts: str = "ts", present: str = "present",
                  window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Presence rate per key and event-time window; frames of windows that end `late` before the latest frame are dropped."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (frames.withWatermark(ts, late).groupBy(w.alias("w"), *keys)
            .agg(F.count("*").alias("n_frames"), F.avg(F.col(present).cast("double")).alias("rate"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *keys, "n_frames", "rate"))


def run_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived into parquet, then stop; the query that ended."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def run_presence_to_end(frames: DataFrame, stored: DataFrame, keys: Sequence[str], out: str, checkpoint: str, *,
                        ts: str = "ts", window: str = "1 hour", slide: str | None = None, **options) -> StreamingQuery:
    """`live_presence` of all frames that have arrived, with the windows that are still open.

    Windows close behind the watermark: they are appended once to `closed`, their state
    goes, and frames that come for them later are dropped. Windows that are open in the
    end have had no frame dropped, so they are computed from `stored`, the same frames as
    a batch, of which only those since the watermark's window are read; they replace the
    `open` ones of the run before. A run that finds nothing new changes nothing.
    `read_presence` gives both.
    """
    options = dict(options, ts=ts, window=window, slide=slide)
    query = run_available(live_presence(frames, keys, **options), f"{out}/closed", checkpoint)
    marks = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in (p.get("eventTime") or {})]
    if not marks:
        return query
    mark = F.lit(marks[-1]).cast("timestamp")
    since = F.expr(f"timestamp '{marks[-1]}' - interval {window}")
    open_ = live_presence(stored.where(F.col(ts) >= since), keys, **options).where(F.col("window_end") > mark)
    open_.write.mode("overwrite").parquet(f"{out}/open")
    return query


def read_presence(spark: SparkSession, out: str) -> DataFrame:
    """All windows that `run_presence_to_end` has written, closed and open."""
    return spark.read.parquet(f"{out}/closed").unionByName(spark.read.parquet(f"{out}/open"))
