"""Descriptors per (entity, channel) and feature vectors built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from motionframe.operators.series import ATTRS, SEGMENT_FRAMES, rms_of, track_sums

# Descriptor names in feature order.
DESCRIPTORS = ("rms_speed_xy", "x_mean", "y_mean", "x_std", "y_std", "detection_rate")


def _mean(a: str) -> Column:
    return F.when(F.sum(f"{a}_n") > 0, F.sum(F.col(f"{a}_n") * F.col(f"{a}_mean")) / F.sum(f"{a}_n"))


def _std_pop(a: str) -> Column:
    """Population deviation merged from segment parts; one part needs no merging."""
    n, m = F.col(f"{a}_n"), F.col(f"{a}_mean")
    total = F.sum(n)
    mean = F.sum(n * m) / total
    merged = F.sum(F.col(f"{a}_m2") + n * m * m) - total * mean * mean
    squares = F.when(F.count_if(n > 0) == 1, F.max(F.col(f"{a}_m2"))).otherwise(merged)
    return F.when(total > 0, F.sqrt(F.greatest(squares, F.lit(0.0)) / total))


def channel_descriptors(tracks: DataFrame, *, window: int = 7, order: int = 2,
                        segment_frames: int = SEGMENT_FRAMES, whole_entities: bool = False) -> DataFrame:
    """Six descriptors per (entity, channel) and the number of valid transitions.

    Speed uses smoothed xy; means and deviations use raw values; the detection rate
    is observed frames over the entity's frame range. With `whole_entities`, an entity
    that is read by several tasks is an error.
    """
    parts = track_sums(tracks, ("x", "y"), window=window, order=order, segment_frames=segment_frames,
                       whole_entities=whole_entities)
    attrs = [c for c in ATTRS if c in tracks.columns]
    return parts.groupBy("entity_id", *attrs, "row").agg(
        rms_of(("x", "y")).alias("rms_speed_xy"),
        _mean("x").alias("x_mean"), _mean("y").alias("y_mean"),
        _std_pop("x").alias("x_std"), _std_pop("y").alias("y_std"),
        (F.sum("x_n") / F.sum("n_frames")).alias("detection_rate"),
        F.sum("n_valid").alias("n_valid_transitions"))


def long_descriptors(desc: DataFrame) -> DataFrame:
    """(entity, class, row, descriptor, value) with descriptors numbered in feature order."""
    cells = F.array(*[F.struct(F.lit(i).alias("descriptor"), F.col(c).alias("value"))
                      for i, c in enumerate(DESCRIPTORS)])
    return desc.select("entity_id", "class", "row", F.inline(cells))


def assemble_features(desc: DataFrame, n_rows: int, n_descriptors: int) -> DataFrame:
    """One dense feature array per entity, ordered by (row, descriptor); absent values are 0.

    An entity's array holds n_rows * n_descriptors values, whatever the data size.
    """
    pos = F.col("row") * n_descriptors + F.col("descriptor")
    packed = desc.groupBy("entity_id", "class").agg(F.array_sort(F.collect_list(
        F.struct(pos.cast("int").alias("p"), F.coalesce(F.col("value"), F.lit(0.0)).alias("v")))).alias("cells"))
    width = n_rows * n_descriptors
    return packed.selectExpr("entity_id", "class", f"""
        concat(flatten(transform(cells, (e, i) -> concat(
                 array_repeat(0.0D, e.p - if(i = 0, -1, cells[i - 1].p) - 1), array(e.v)))),
               array_repeat(0.0D, {width} - 1 - cells[size(cells) - 1].p)) AS features""")
