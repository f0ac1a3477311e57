"""Quality proxies per entity and their weighted composite."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from motionframe.functions.columns import nan_mean
from motionframe.operators import presence as pr
from motionframe.operators.series import KEY, SEGMENT_FRAMES
from motionframe.plans.ranking import attach, exact_quantiles, ordered_prefix
from motionframe.session import materialize

# Default weights of the composite, and the metric behind each one.
DEFAULT_WEIGHTS = {"hand_rate": 3.0, "pose_rate": 1.0, "face_rate": 0.5,
                   "jitter": -2.0, "bone_cv": -1.5, "gap": -1.0}
METRICS = {"hand_rate": "hand_rate", "pose_rate": "pose_rate", "face_rate": "face_rate",
           "jitter": "jitter_hand", "bone_cv": "bone_cv", "gap": "longest_gap_frac"}
# Shoulder and elbow rows of the 543-channel layout, left and right.
ARM_SEGMENTS = {"left": (500, 502), "right": (501, 503)}


def frame_displacements(tracks: DataFrame, groups: Sequence[str], *,
                        segment_frames: int = SEGMENT_FRAMES) -> DataFrame:
    """xy distance between adjacent observed frames of each channel."""
    size = segment_frames
    rows = tracks.where(F.col("grp").isin(list(groups)) & F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = rows.selectExpr(
        *KEY, "grp", "CAST(frame AS BIGINT) AS frame", "x", "y",
        f"""explode(array_compact(array(floor(frame / {size}),
            CASE WHEN frame - floor(frame / {size}) * {size} = {size - 1}
                 THEN floor(frame / {size}) + 1 END))) AS seg""")
    over = f"OVER (PARTITION BY {', '.join(KEY)}, seg ORDER BY frame)"
    rows = rows.repartition(*KEY, "seg").selectExpr(
        "entity_id", "grp", "frame", "x", "y", f"lag(frame) {over} AS pf",
        f"lag(x) {over} AS px", f"lag(y) {over} AS py")
    return rows.where("pf = frame - 1").selectExpr(
        "entity_id", "grp", "sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS step")


def jitter(tracks: DataFrame, groups: Sequence[str], *,
           segment_frames: int = SEGMENT_FRAMES) -> DataFrame:
    """Exact median displacement over all frames and channels of a group, pooled."""
    steps = frame_displacements(tracks, groups, segment_frames=segment_frames)
    return exact_quantiles(steps, ["entity_id", "grp"], "step", {"jitter": 0.5})


def segment_cv(tracks: DataFrame, segments: Mapping[str, tuple[int, int]] = ARM_SEGMENTS) -> DataFrame:
    """Population deviation over mean of the distance between two channels.

    Zero distances are dropped; NULL below two frames. `bone_cv` is the mean of all
    segments that have a value.
    """
    wanted = {r for pair in segments.values() for r in pair}
    return _cv_of_frames(tracks.where(F.col("row").isin(*wanted)).groupBy("entity_id", "frame").agg(*_ends(segments)), segments)


def _ends(segments: Mapping[str, tuple[int, int]]) -> list[Column]:
    """Positions of the segments' ends, as aggregates over a frame's rows."""
    wanted = sorted({r for pair in segments.values() for r in pair})
    return [F.max(F.when(F.col("row") == r, F.col(a))).alias(f"{a}{r}") for r in wanted for a in "xy"]


def _cv_of_frames(per: DataFrame, segments: Mapping[str, tuple[int, int]]) -> DataFrame:
    aggs = []
    for name, (a, b) in segments.items():
        d = F.sqrt((F.col(f"x{a}") - F.col(f"x{b}")) ** 2 + (F.col(f"y{a}") - F.col(f"y{b}")) ** 2)
        d = F.when(d > 0, d)
        aggs.append(F.when(F.count(d) >= 2, F.stddev_pop(d) / F.avg(d)).alias(f"{name}_cv"))
    out = per.groupBy("entity_id").agg(*aggs)
    names = [f"{n}_cv" for n in segments]
    total = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names), F.lit(0.0))
    known = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    return out.select("*", F.when(known > 0, total / known).alias("bone_cv"))


def entity_quality(catalog: DataFrame, tracks: DataFrame, n_channels: int,
                   roles: Mapping[str, str] = pr.IDENTITY,
                   segments: Mapping[str, tuple[int, int]] = ARM_SEGMENTS) -> DataFrame:
    """Every proxy per catalog entity; entities without frames get the defined defaults.

    Rates, gaps and segments start from one row per frame, which is written once.
    """
    frames = materialize(pr.frame_flags(tracks, roles, _ends(segments)))
    rates = pr.rates_of_flags(frames, n_channels)
    gaps = pr.longest_gap(frames).drop("n_frames")
    jit = jitter(tracks, [roles[r] for r in ("left_hand", "right_hand", "pose")]).groupBy(
        "entity_id").agg(*[F.max(F.when(F.col("grp") == roles[r], F.col("jitter"))).alias(f"j_{r}")
                           for r in ("left_hand", "right_hand", "pose")])
    jit = jit.select("entity_id", nan_mean("j_left_hand", "j_right_hand").alias("jitter_hand"),
                     F.col("j_pose").alias("jitter_pose"))
    cv = _cv_of_frames(frames, segments).select("entity_id", "bone_cv")
    out = catalog.join(rates, "entity_id", "left").join(gaps, "entity_id", "left").join(
        jit, "entity_id", "left").join(cv, "entity_id", "left")

    def default(c: str, v) -> object:
        return F.coalesce(F.col(c), F.lit(v)).alias(c)

    return out.select(
        *catalog.columns, F.coalesce(F.col("n_frames"), F.lit(0).cast("long")).alias("n_frames"),
        *[default(c, 0.0) for c in ("face_rate", "pose_rate", "left_hand_rate", "right_hand_rate",
                                    "hand_rate", "any_hand_rate")],
        "jitter_hand", "jitter_pose", "bone_cv",
        F.coalesce(F.col("longest_gap_frames"), F.lit(0).cast("long")).alias("longest_gap_frames"),
        default("longest_gap_frac", 1.0), default("nan_frac", 1.0))


def zscore_composite(df: DataFrame, weights: Mapping[str, float] | None = None,
                     metrics: Mapping[str, str] = METRICS) -> DataFrame:
    """Adds a z-score per component and their weighted sum, relative to the whole table.

    NULL takes the median; a component without spread contributes nothing.
    """
    weights = {**DEFAULT_WEIGHTS, **(weights or {})}
    df = materialize(df)  # read three times below
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("v")) for n, c in metrics.items()])))
    medians = exact_quantiles(long, ["name"], "v", {"median": 0.5}).agg(
        F.map_from_entries(F.collect_list(F.struct("name", "median"))).alias("m")).scalar()
    filled = df.withColumn("_m", medians)
    for name, c in metrics.items():
        filled = filled.withColumn(f"_{name}", F.coalesce(F.col(c).cast("double"), F.col("_m")[name]))
    filled = filled.drop("_m")
    stats = filled.agg(F.struct(*[
        F.struct(F.avg(f"_{n}").alias("mean"), F.stddev_pop(f"_{n}").alias("std")).alias(n)
        for n in metrics]).alias("s")).scalar()
    out = filled.withColumn("_s", stats)
    total = F.lit(0.0)
    for name in metrics:
        mean, std = F.col(f"_s.{name}.mean"), F.col(f"_s.{name}.std")
        # a spread at rounding level of the mean is no spread
        flat = std.isNull() | (std <= F.abs(mean) * 1e-12)
        out = out.withColumn(f"z_{name}", F.when(flat, F.lit(0.0)).otherwise((F.col(f"_{name}") - mean) / std))
        total = total + F.lit(float(weights[name])) * F.col(f"z_{name}")
    return out.withColumn("quality_score", total).drop("_s", *[f"_{n}" for n in metrics])


def pick_extremes(frames: DataFrame, n_worst: int = 80, n_best: int = 10,
                  n_median: int = 10) -> DataFrame:
    """Worst, best and middle frames in the order (quality, entity, frame).

    The ends are limits. For the middle, counts per quality tell which values stand
    there, and only frames of these are put in order.
    """
    order = ["quality", "entity_id", "frame"]
    frames = materialize(frames.select(*order))  # read four times below
    n = frames.count()
    worst = ordered_prefix(frames.orderBy(*order).limit(n_worst), order)
    best = ordered_prefix(frames.orderBy(*[F.desc(c) for c in order]).limit(n_best), order)
    start, stop = max(0, n // 2 - n_median // 2), n // 2 + (n_median + 1) // 2
    values = ordered_prefix(frames.groupBy("quality").agg(F.count("*").alias("c")), ["quality"], "c")
    values = values.where((F.col("before") < stop) & (F.col("before") + F.col("c") > start))
    near = attach(frames, values, ["quality"], [], "left_semi")
    ahead = F.coalesce(values.agg(F.min("before")).scalar(), F.lit(0))
    middle = ordered_prefix(near, order).withColumn("before", F.col("before") + ahead).where(
        (F.col("before") >= start) & (F.col("before") < stop))
    best = best.withColumn("before", F.col("before") + max(0, n - n_best))
    parts = [rows.select(F.lit(kind).alias("kind"), F.col("before").alias("position"), *order)
             for kind, rows in (("worst", worst), ("best", best), ("median", middle))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def config_scores(scored: DataFrame) -> DataFrame:
    """Mean of the composite and every proxy per configuration, best first."""
    cols = ["quality_score", "hand_rate", "any_hand_rate", "pose_rate", "face_rate", "jitter_hand",
            "bone_cv", "longest_gap_frac", "nan_frac"]
    return (scored.groupBy("config")
            .agg(*[F.avg(c).alias(c) for c in cols], F.count("entity_id").alias("n_entities"))
            .orderBy(F.desc("quality_score"), "config"))
