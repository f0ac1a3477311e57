"""Ordered series per (entity, channel): frame grid, gap filling, smoothing, speed.

A track is cut into segments of `segment_frames` frames, so no window partition
is larger than one segment plus its margins, however long one track is. What a
segment needs from outside travels as extra rows:

* rows close to a boundary are copied into the neighbouring segment,
* a boundary row marks where the segment's frame range starts,
* carry rows hold the nearest observed values before and after that range, taken
  from a per-segment summary that is one row per (entity, channel, segment).

Everything after that is one exchange and one sort on (entity, channel, segment).
Spark moves and sorts the rows; gap filling and smoothing then run on Arrow blocks
of whole segments, because window functions with one frame per neighbour took about
ten times as long in that stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from motionframe.functions import track_kernel
from motionframe.functions.smoothing import REACH
from motionframe.session import materialize

KEY = ["entity_id", "row"]
ATTRS = ["class", "grp", "idx"]
SEGMENT_FRAMES = 4096


def _over(keys: Sequence[str], order: Sequence[str]) -> str:
    return f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)})"


def _segment(frame: Column, size: int) -> Column:
    return F.floor(frame / F.lit(size)).cast("long")


def _attrs(df: DataFrame) -> list[str]:
    return [c for c in ATTRS if c in df.columns]


def _boundary_rows(tracks: DataFrame, axes: Sequence[str], extent: Sequence[str],
                   size: int, margin: int) -> DataFrame:
    """One boundary row per (entity, channel, segment), and carry rows for longer tracks."""
    keys = [*KEY, *_attrs(tracks)]
    whole = f"OVER (PARTITION BY {', '.join(extent)})"
    span = tracks.groupBy(*keys).agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    # one row per track; written once because both branches below read it
    span = materialize(span.selectExpr(*keys, f"min(lo) {whole} AS f0", f"max(hi) {whole} AS f1"))
    edges = span.selectExpr("*", f"explode(sequence(floor(f0 / {size}), floor(f1 / {size}))) AS seg")
    edges = edges.selectExpr(
        *keys, "seg", f"greatest(f0, seg * {size} - {margin}) AS frame",
        *[f"CAST(NULL AS DOUBLE) AS {a}" for a in axes], "f0", "f1", "false AS real")
    longer = span.where(f"floor(f0 / {size}) < floor(f1 / {size})").select(*KEY, "f0", "f1")
    return edges.unionByName(_carry_rows(tracks, longer, axes, size, margin))


def _carry_rows(tracks: DataFrame, longer: DataFrame, axes: Sequence[str], size: int,
                margin: int) -> DataFrame:
    """Nearest observed values before and after each segment, for tracks of several segments."""
    keys = [*KEY, *_attrs(tracks)]
    tracks = tracks.join(longer.select(*KEY), KEY, "left_semi").selectExpr(
        *keys, f"floor(frame / {size}) AS seg", "frame", *axes)
    pos = f"(frame - seg * {size})"
    # first and last observed value; "in" variants leave out the rows that the
    # neighbouring segment gets as copies anyway
    variants = [("first", "min", "true"), ("firstin", "min", f"{pos} >= {margin}"),
                ("last", "max", "true"), ("lastin", "max", f"{pos} < {size - margin}")]
    aggs = []
    for a in axes:
        for name, fn, cond in variants:
            at = f"CASE WHEN {a} IS NOT NULL AND {cond} THEN frame END"
            aggs += [F.expr(f"{fn}({at}) AS {name}_{a}_f"), F.expr(f"{fn}_by({a}, {at}) AS {name}_{a}_v")]
    parts = tracks.groupBy(*keys, "seg").agg(*aggs).join(longer, KEY)
    parts = parts.selectExpr(
        *keys, "seg", "f0", "f1",
        *[f"CASE WHEN {n}_{a}_f IS NOT NULL THEN named_struct('f', {n}_{a}_f, 'v', {n}_{a}_v) END AS {n}_{a}"
          for a in axes for n, _, _ in variants])

    over = _over(KEY, ["seg"])
    parts = parts.selectExpr(
        "*", f"lag(seg) {over} AS prev_seg", f"lead(seg) {over} AS next_seg",
        *[f"lag(last_{a}) IGNORE NULLS {over} AS past_{a}" for a in axes],
        *[f"lead(first_{a}) IGNORE NULLS {over} AS later_{a}" for a in axes])

    def points(names: Sequence[tuple[str, str]]) -> str:
        out = []
        for a in axes:
            values = ", ".join(f"'{b}', {'p.v' if a == b else 'CAST(NULL AS DOUBLE)'}" for b in axes)
            items = ", ".join(f"coalesce({n}_{a}, {e}_{a})" for n, e in names)
            out.append(f"transform(filter(array({items}), p -> p IS NOT NULL), "
                       f"p -> named_struct('frame', p.f, {values}))")
        return f"concat({', '.join(out)})"

    parts = parts.selectExpr(
        *keys, "seg", "f0", "f1", "prev_seg", "next_seg",
        points([("lastin", "past"), ("last", "past")]) + " AS forward",
        points([("firstin", "later"), ("first", "later")]) + " AS backward")
    # segments without any row of the channel are filled in between its neighbours
    parts = parts.selectExpr(
        "*",
        f"coalesce(lag(forward) {over}, slice(forward, 1, 0)) AS from_past",
        f"coalesce(lead(backward) {over}, slice(forward, 1, 0)) AS from_later")
    # a step of its own: neighbours must be taken before rows are multiplied
    parts = parts.selectExpr(
        "*", f"""explode(sequence(
              CASE WHEN prev_seg IS NULL THEN floor(f0 / {size}) ELSE seg END,
              CASE WHEN next_seg IS NULL THEN floor(f1 / {size}) ELSE next_seg - 1 END)) AS at""")
    parts = parts.selectExpr(
        *keys, "at AS seg", """explode(CASE WHEN at < seg THEN backward
            WHEN at = seg THEN concat(from_past, from_later) ELSE concat(forward, from_later) END) AS p""")
    return parts.selectExpr(
        *keys, "seg", "p.frame AS frame", *[f"p.{a} AS {a}" for a in axes],
        *[f"CAST(NULL AS BIGINT) AS {c}" for c in ("f0", "f1")], "false AS real")


def _segment_rows(tracks: DataFrame, axes: Sequence[str], extent: Sequence[str], margin: int,
                  size: int) -> DataFrame:
    """Track rows plus boundary and carry rows, partitioned and sorted by segment."""
    if size < 2 * margin:
        raise ValueError("segment_frames must be at least twice the margin")
    keys = [*KEY, *_attrs(tracks)]
    tracks = tracks.selectExpr(*keys, "CAST(frame AS BIGINT) AS frame",
                               *[f"CAST({a} AS DOUBLE) AS {a}" for a in axes])
    edges = _boundary_rows(tracks, axes, extent, size, margin)
    seg = f"floor(frame / {size})"
    if margin:  # rows near a boundary also go to the neighbouring segment
        pos = f"(frame - floor(frame / {size}) * {size})"
        seg = f"""explode(CASE WHEN {pos} < {margin} THEN array({seg} - 1, {seg})
            WHEN {pos} >= {size - margin} THEN array({seg}, {seg} + 1) ELSE array({seg}) END)"""
    # attributes travel on the boundary rows only
    types = {f.name: f.dataType.simpleString() for f in tracks.schema.fields}
    data = tracks.selectExpr(
        *KEY, *[f"CAST(NULL AS {types[c]}) AS {c}" for c in _attrs(tracks)], f"{seg} AS seg", "frame", *axes,
        *[f"CAST(NULL AS BIGINT) AS {c}" for c in ("f0", "f1")], "true AS real")
    rows = data.unionByName(edges)
    part = [*KEY, "seg"]
    # a hash in front lets the sort settle most comparisons on its 8-byte prefix
    rows = rows.repartition(*part).withColumn("_h", F.xxhash64(*part))
    return rows.sortWithinPartitions("_h", *part, "frame", "real").drop("_h")


def _fields(df: DataFrame, names: Sequence[str]) -> list[str]:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f"`{n}` {types[n]}" for n in names]


def _rows(tracks: DataFrame, axes: Sequence[str], extent: Sequence[str], margin: int, size: int,
          whole_entities: bool) -> tuple[DataFrame, list[str], int]:
    """Rows for the kernel, the keys that must not be split, and the segment size (0: none)."""
    if not whole_entities:
        return _segment_rows(tracks, axes, extent, margin, size), [*KEY, "seg"], size
    return tracks.selectExpr(*KEY, *_attrs(tracks), "CAST(frame AS BIGINT) AS frame",
                             *[f"CAST({a} AS DOUBLE) AS {a}" for a in axes]), ["entity_id"], 0


def _only_whole(result: DataFrame, tracks: DataFrame, whole_entities: bool) -> DataFrame:
    """The result, or an error if an entity that was declared whole is read by several tasks.

    Which tasks read an entity is a scan of its id alone, combined within each task: one
    row per entity and task is moved. The verdict is one row, sent to all tasks. That a
    task meets an entity's rows in one go is checked where it reads them.
    """
    if not whole_entities:
        return result
    tasks = tracks.select("entity_id", F.spark_partition_id().alias("task")).distinct()
    most = tasks.groupBy("entity_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
    apart = F.raise_error(F.lit("entities are not whole in their files")).cast("boolean")
    return result.crossJoin(F.broadcast(most.select(F.when(F.col("n") > 1, apart).otherwise(True).alias("_whole")))).where(
        "_whole").drop("_whole")


def _frames(tracks: DataFrame, axes: Sequence[str], size: int, smooth: bool,
            window: int = 7, order: int = 2, whole_entities: bool = False) -> DataFrame:
    rows, keys, size = _rows(tracks, axes, ("entity_id",), REACH if smooth else 0, size, whole_entities)
    carry = [*KEY, *_attrs(tracks)]
    schema = _fields(rows, carry) + ["frame bigint", "f0 bigint", "f1 bigint"]
    schema += [f"{a} double" for a in axes] + [f"{a}_out double" for a in axes] + ["seen boolean"]
    return _only_whole(rows.mapInArrow(
        track_kernel.frames(keys, carry, list(axes), size, window, order, smooth),
        ", ".join(schema)), tracks, whole_entities)


def frame_grid(tracks: DataFrame, axes: Sequence[str] = ("x", "y", "z"), *,
               segment_frames: int = SEGMENT_FRAMES, whole_entities: bool = False) -> DataFrame:
    """Each channel on every frame of its entity's range; missing frames are NULL rows."""
    grid = _frames(tracks, axes, segment_frames, smooth=False, whole_entities=whole_entities)
    return grid.select("entity_id", *_attrs(tracks), "row", "frame", *axes)


def interpolate_gaps(tracks: DataFrame, axes: Sequence[str] = ("x", "y", "z"), *,
                     segment_frames: int = SEGMENT_FRAMES, whole_entities: bool = False) -> DataFrame:
    """The frame grid with gaps filled: linear between observed frames, nearest value beyond.

    A channel that was never observed stays NULL; `seen` marks observed frames.
    """
    grid = _frames(tracks, axes, segment_frames, smooth=False, whole_entities=whole_entities)
    return grid.select("entity_id", *_attrs(tracks), "row", "frame",
                       *[F.col(f"{a}_out").alias(a) for a in axes], "seen")


def savgol_smooth(tracks: DataFrame, axes: Sequence[str] = ("x", "y", "z"), *,
                  window: int = 7, order: int = 2,
                  segment_frames: int = SEGMENT_FRAMES, whole_entities: bool = False) -> DataFrame:
    """Gap-filled and smoothed coordinates on the frame grid."""
    grid = _frames(tracks, axes, segment_frames, smooth=True, window=window, order=order,
                   whole_entities=whole_entities)
    return grid.select("entity_id", *_attrs(tracks), "row", "frame",
                       *[F.col(f"{a}_out").alias(a) for a in axes], "seen")


def track_sums(tracks: DataFrame, axes: Sequence[str], *, window: int = 7, order: int = 2,
               extent: Sequence[str] = ("entity_id",),
               segment_frames: int = SEGMENT_FRAMES, whole_entities: bool = False, plain: bool = False) -> DataFrame:
    """Partial sums per (entity, channel, segment); the shared input of every speed measure.

    `whole_entities` says that each file, and so each task, holds all rows of its
    entities one after the other, as track files do. Then nothing is moved or sorted by
    Spark, and tracks are not cut into segments. It is an error if an entity is read by
    several tasks, as with a file that Spark splits, or comes twice in one.
    `plain` numbers each channel's rows by frame and takes the numbers for frames; only
    with `whole_entities`.
    """
    rows, keys, segment_frames = _rows(tracks, axes, extent, REACH, segment_frames, whole_entities)
    carry = [*KEY, *_attrs(tracks)]
    schema = _fields(rows, carry) + [f"{n} {t}" for n, t in track_kernel.sum_fields(axes)]
    return _only_whole(rows.mapInArrow(
        track_kernel.sums(keys, carry, list(axes), segment_frames, window, order, plain),
        ", ".join(schema)), tracks, whole_entities)


def rms_of(axes: Sequence[str], kind: str = "valid") -> Column:
    """Aggregate over partial sums: root mean squared step, NULL without any transition."""
    total = F.sum(F.expr(" + ".join(f"{a}_{kind}" for a in axes)))
    count = F.sum(f"n_{kind}")
    return F.when(count > 0, F.sqrt(total / count))


def rms_speed(tracks: DataFrame, axes: Sequence[str] = ("x", "y", "z"), *, window: int = 7,
              order: int = 2, segment_frames: int = SEGMENT_FRAMES, whole_entities: bool = False) -> DataFrame:
    """RMS speed per (entity, channel); a step counts only if both ends were observed.

    With `whole_entities`, an entity that is read by several tasks is an error.
    """
    parts = track_sums(tracks, axes, window=window, order=order, segment_frames=segment_frames, whole_entities=whole_entities)
    return parts.groupBy("entity_id", *_attrs(tracks), "row").agg(
        rms_of(axes).alias("rms_speed"), F.sum("n_valid").alias("n_valid_transitions"))


def _positions(tracks: DataFrame, size: int) -> DataFrame:
    """0-based position of each row within its channel, by frame; two-level row number."""
    seg = _segment(F.col("frame"), size)
    rows = tracks.withColumn("seg", seg)
    counts = rows.groupBy(*KEY, "seg").agg(F.count("*").alias("n"))
    before = counts.select(*KEY, "seg", F.coalesce(
        F.sum("n").over(W.partitionBy(*KEY).orderBy("seg").rowsBetween(W.unboundedPreceding, -1)),
        F.lit(0)).alias("before"))
    local = F.row_number().over(W.partitionBy(*KEY, "seg").orderBy("frame")) - 1
    return (rows.withColumn("local", local).join(before, [*KEY, "seg"])
            .withColumn("frame", F.col("local") + F.col("before")).drop("local", "before", "seg"))


def rms_speed_plain(tracks: DataFrame, axes: Sequence[str] = ("x", "y", "z"), *, window: int = 7,
                    order: int = 2, segment_frames: int = SEGMENT_FRAMES, whole_entities: bool = False) -> DataFrame:
    """RMS speed without a frame grid: rows in order, every transition counts.

    NULL when the channel has fewer rows than the window or an axis was never observed.
    With `whole_entities`, an entity that is read by several tasks is an error.
    """
    rows = tracks if whole_entities else _positions(tracks, segment_frames)
    parts = track_sums(rows, axes, window=window, order=order, extent=KEY,
                       segment_frames=segment_frames, whole_entities=whole_entities, plain=whole_entities)
    unknown = F.sum(F.expr(" + ".join(f"{a}_unknown" for a in axes)))
    return parts.groupBy("entity_id", *_attrs(tracks), "row").agg(
        F.when((F.sum("n_frames") >= window) & (unknown == 0), rms_of(axes, "linked"))
        .alias("motion_energy"))


def pivot_frames(tracks: DataFrame, rows: Sequence[int], axes: Sequence[str] = ("x",)) -> DataFrame:
    """One row per frame with a column per (axis, channel)."""
    out = tracks.groupBy("entity_id", "frame").pivot("row", list(rows)).agg(
        *[F.first(a, ignorenulls=True).alias(a) for a in axes])
    if len(axes) == 1:
        out = out.select("entity_id", "frame", *[F.col(str(r)).alias(f"{axes[0]}_{r}") for r in rows])
    else:
        out = out.select("entity_id", "frame",
                         *[F.col(f"{r}_{a}").alias(f"{a}_{r}") for a in axes for r in rows])
    return out


def unpivot_frames(wide: DataFrame, rows: Sequence[int], axes: Sequence[str] = ("x",)) -> DataFrame:
    """The reverse of `pivot_frames`: one row per (entity, frame, channel)."""
    cells = F.array(*[F.struct(F.lit(r).alias("row"), *[F.col(f"{a}_{r}").alias(a) for a in axes])
                      for r in rows])
    return wide.select("entity_id", "frame", F.inline(cells))


def causal_velocity(tracks: DataFrame, axes: Sequence[str] = ("x", "y"), *,
                    segment_frames: int = SEGMENT_FRAMES) -> DataFrame:
    """Step from the previous frame; first row of a channel 0, NULL where that frame is absent."""
    size = segment_frames
    seg = _segment(F.col("frame"), size)
    last_of_segment = (F.col("frame") - seg * size) == size - 1
    here = F.array_compact(F.array(seg, F.when(last_of_segment, seg + 1)))
    first = tracks.groupBy(*KEY).agg(F.min("frame").alias("first_frame"))
    rows = (tracks.join(first, KEY).select("*", F.explode(here).alias("seg"))
            .repartition(*KEY, "seg"))
    over = _over([*KEY, "seg"], ["frame"])
    rows = rows.select("*", F.expr(f"lag(frame) {over}").alias("prev_frame"),
                       *[F.expr(f"lag({a}) {over}").alias(f"prev_{a}") for a in axes])
    rows = rows.where(_segment(F.col("frame"), size) == F.col("seg"))
    at_first = F.col("frame") == F.col("first_frame")
    step = F.col("prev_frame") == F.col("frame") - 1
    return rows.select(
        "entity_id", *_attrs(tracks), "row", "frame",
        *[F.when(at_first, F.lit(0.0)).when(step, F.col(a) - F.col(f"prev_{a}")).alias(f"d{a}")
          for a in axes])


def causal_running_std(tracks: DataFrame, axis: str = "x", *,
                       segment_frames: int = SEGMENT_FRAMES) -> DataFrame:
    """Population standard deviation of the observed values up to each frame.

    Counts, means and centred squares of the earlier segments are merged with the
    running ones inside the segment.
    """
    seg = _segment(F.col("frame"), segment_frames)
    rows = tracks.withColumn("seg", seg)
    parts = rows.groupBy(*KEY, "seg").agg(
        F.count(axis).alias("n"), F.avg(axis).alias("m"), F.var_pop(axis).alias("v"))
    by_channel = W.partitionBy(*KEY)
    centre = F.sum(F.col("n") * F.col("m")).over(by_channel) / F.sum("n").over(by_channel)
    parts = parts.withColumn("c", centre)
    off = F.col("m") - F.col("c")
    earlier = by_channel.orderBy("seg").rowsBetween(W.unboundedPreceding, -1)

    def carried(value: Column) -> Column:
        return F.coalesce(F.sum(value).over(earlier), F.lit(0.0))

    before = parts.select(
        *KEY, "seg", "c", carried(F.col("n").cast("double")).alias("n0"),
        carried(F.col("n") * off).alias("s0"),
        carried(F.col("n") * (F.col("v") + off * off)).alias("q0"))
    running = W.partitionBy(*KEY, "seg").orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    joined = rows.join(before, [*KEY, "seg"])
    dev = F.col(axis) - F.col("c")
    n = F.col("n0") + F.count(axis).over(running)
    s = F.col("s0") + F.coalesce(F.sum(dev).over(running), F.lit(0.0))
    q = F.col("q0") + F.coalesce(F.sum(dev * dev).over(running), F.lit(0.0))
    var = q / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    return (joined.select("*", n.alias("n"), s.alias("s"), q.alias("q"))
            .select("entity_id", *_attrs(tracks), "row", "frame",
                    F.when(F.col("n") > 0, F.sqrt(F.greatest(var, F.lit(0.0))))
                    .alias("running_std")))
