"""Presence of channel groups per frame, gaps, and the active part of a track."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from motionframe.plans.ranking import exact_quantiles, spearman

SEGMENT_FRAMES = 4096
ROLES = ("face", "pose", "left_hand", "right_hand")
IDENTITY = {r: r for r in ROLES}


def group_presence(tracks: DataFrame) -> DataFrame:
    """Per (entity, frame, group): whether any channel of the group was observed."""
    return tracks.groupBy("entity_id", "frame", "grp").agg(
        F.bool_or(F.col("x").isNotNull()).alias("present"))


def frame_flags(tracks: DataFrame, roles: Mapping[str, str] = IDENTITY, more: Sequence[Column] = ()) -> DataFrame:
    """One row per (entity, frame): presence of each role, of either and of both hands; `more` aggregates beside them."""
    seen = F.col("x").isNotNull()
    flags = tracks.groupBy("entity_id", "frame").agg(
        *[F.coalesce(F.bool_or(seen & (F.col("grp") == roles[r])), F.lit(False)).alias(r) for r in ROLES],
        F.count("x").alias("n_seen"), *more)
    return flags.select("*", (F.col("left_hand") | F.col("right_hand")).alias("any_hand"),
                        (F.col("left_hand") & F.col("right_hand")).alias("both_hands"))


def extents(flags: DataFrame) -> DataFrame:
    """Frame range of each entity."""
    return flags.groupBy("entity_id").agg(
        F.min("frame").cast("long").alias("f0"), F.max("frame").cast("long").alias("f1"))


def frame_spine(flags: DataFrame) -> DataFrame:
    """Every frame of every entity's range, generated in bounded pieces."""
    size = SEGMENT_FRAMES
    return (extents(flags)
            .selectExpr("*", f"explode(sequence(floor(f0 / {size}), floor(f1 / {size}))) AS seg")
            .selectExpr("entity_id", "f0", "f1",
                        f"""explode(sequence(greatest(f0, seg * {size}),
                            least(f1, seg * {size} + {size - 1}))) AS frame"""))


def _rate(flag: str, n: Column) -> Column:
    return F.count_if(F.col(flag)) / n


def detection_rates(tracks: DataFrame, n_channels: int,
                    roles: Mapping[str, str] = IDENTITY) -> DataFrame:
    """Share of frames with each group, either hand and both hands, and of missing values.

    Frames without any row count as frames without presence.
    """
    return rates_of_flags(frame_flags(tracks, roles), n_channels)


def rates_of_flags(flags: DataFrame, n_channels: int) -> DataFrame:
    """The detection rates from per-frame flags."""
    n = F.max("frame") - F.min("frame") + 1
    return flags.groupBy("entity_id").agg(
        n.cast("long").alias("n_frames"),
        *[_rate(r, n).alias(f"{r}_rate") for r in ROLES],
        ((F.count_if(F.col("left_hand")) + F.count_if(F.col("right_hand"))) / (2 * n)).alias("hand_rate"),
        _rate("any_hand", n).alias("any_hand_rate"), _rate("both_hands", n).alias("both_hands_rate"),
        (1 - F.sum("n_seen") / (n * n_channels)).alias("nan_frac"))


def frame_quality_value(left: Column, right: Column, pose: Column, face: Column) -> Column:
    """Hand-weighted share of detected groups, between 0 and 1."""
    def num(c: Column) -> Column:
        return F.coalesce(c.cast("int").cast("double"), F.lit(0.0))

    return (3 * (num(left) + num(right)) / 2 + num(pose) + 0.5 * num(face)) / 4.5


def frame_quality(tracks: DataFrame, roles: Mapping[str, str] = IDENTITY) -> DataFrame:
    """Quality of every frame in the entity's range; frames without rows score 0."""
    flags = frame_flags(tracks, roles)
    rows = frame_spine(flags).join(
        flags.withColumn("frame", F.col("frame").cast("long")), ["entity_id", "frame"], "left")
    return rows.select("entity_id", "frame", frame_quality_value(
        F.col("left_hand"), F.col("right_hand"), F.col("pose"), F.col("face")).alias("quality"))


def longest_gap(flags: DataFrame, flag: str = "any_hand", *,
                segment_frames: int = SEGMENT_FRAMES) -> DataFrame:
    """Longest run of frames without presence, in frames and as a share of the range.

    Gaps inside a segment come from neighbouring present frames; gaps across segments
    from the first and last present frame of each segment.
    """
    present = flags.where(F.col(flag)).select(
        "entity_id", F.col("frame").cast("long").alias("frame"),
        F.floor(F.col("frame") / segment_frames).alias("seg"))
    after = F.lead("frame").over(W.partitionBy("entity_id", "seg").orderBy("frame"))
    parts = (present.withColumn("gap", after - F.col("frame") - 1)
             .groupBy("entity_id", "seg").agg(
                 F.min("frame").alias("first"), F.max("frame").alias("last"),
                 F.coalesce(F.max("gap"), F.lit(0)).alias("gap")))
    nxt = F.lead("first").over(W.partitionBy("entity_id").orderBy("seg"))
    inner = (parts.withColumn("between", nxt - F.col("last") - 1)
             .groupBy("entity_id").agg(
                 F.min("first").alias("first"), F.max("last").alias("last"),
                 F.greatest(F.max("gap"), F.coalesce(F.max("between"), F.lit(0))).alias("inner")))
    joined = extents(flags).join(inner, "entity_id", "left")
    n = F.col("f1") - F.col("f0") + 1
    gap = F.when(F.col("first").isNull(), n).otherwise(
        F.greatest(F.col("inner"), F.col("first") - F.col("f0"), F.col("f1") - F.col("last")))
    return joined.select("entity_id", n.alias("n_frames"), gap.alias("longest_gap_frames"),
                         (gap / n).alias("longest_gap_frac"))


def presence_profile(flags: DataFrame, bins: int = 20, flag: str = "any_hand") -> DataFrame:
    """Presence rate by normalized position in the clip, pooled over all frames."""
    ext = extents(flags).withColumn("n", F.col("f1") - F.col("f0") + 1)
    frames = (ext.selectExpr("n", f"explode(sequence(0L, {bins - 1}L)) AS bin")
              .groupBy("bin").agg(F.sum(F.expr(
                  f"((bin + 1) * n + {bins - 1}) div {bins} - (bin * n + {bins - 1}) div {bins}")).alias("n_frames")))
    hits = (flags.where(F.col(flag)).select("entity_id", F.col("frame").cast("long").alias("frame"))
            .join(ext, "entity_id")
            .groupBy(F.expr(f"({bins} * (frame - f0)) div n").alias("bin")).agg(F.count("*").alias("hits")))
    rate = F.coalesce(F.col("hits"), F.lit(0)) / F.col("n_frames")
    return frames.where("n_frames > 0").join(hits, "bin", "left").select("bin", "n_frames", rate.alias("rate"))


def active_span(flags: DataFrame) -> DataFrame:
    """First and last frame with a hand, their place in the clip, and rates inside the span.

    A frame with a hand always lies inside the span, so the whole-clip counts serve.
    """
    def at(fn) -> Column:
        return fn(F.when(F.col("any_hand"), F.col("frame")))

    per = flags.groupBy("entity_id").agg(
        F.min("frame").cast("long").alias("f0"), F.max("frame").cast("long").alias("f1"),
        at(F.min).cast("long").alias("first_frame"), at(F.max).cast("long").alias("last_frame"),
        *[F.count_if(F.col(c)).alias(c) for c in ("any_hand", "left_hand", "right_hand")])
    n = F.col("f1") - F.col("f0") + 1
    span = F.col("last_frame") - F.col("first_frame") + 1
    return per.select(
        "entity_id", n.alias("n_frames"), "first_frame", "last_frame",
        ((F.col("first_frame") - F.col("f0")) / n).alias("first_share"),
        ((F.col("last_frame") - F.col("f0")) / n).alias("last_share"),
        (span / n).alias("span_share"), (F.col("any_hand") / span).alias("any_hand_rate_in_span"),
        ((F.col("left_hand") + F.col("right_hand")) / (2 * span)).alias("hand_rate_in_span"))


def overlap_test(flags: DataFrame) -> DataFrame:
    """Median place of the first and last presence, and rank correlation of gap with length."""
    span = active_span(flags)
    shares = span.select(F.expr("inline(array(named_struct('m', 'first', 'v', first_share),"
                                " named_struct('m', 'last', 'v', last_share)))"))
    medians = exact_quantiles(shares, ["m"], "v", {"median": 0.5}).agg(
        F.max(F.when(F.col("m") == "first", F.col("median"))).alias("median_first_share"),
        F.max(F.when(F.col("m") == "last", F.col("median"))).alias("median_last_share"))
    rho = spearman(longest_gap(flags), "longest_gap_frames", "n_frames")
    one = F.lit(1).alias("one")  # both sides are single rows
    return medians.select("*", one).join(rho.select("*", one), "one").drop("one")
