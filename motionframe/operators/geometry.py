"""Positions relative to the body, and second differences of smoothed tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from motionframe.operators.series import KEY, SEGMENT_FRAMES, savgol_smooth


def reference_reliability(tracks: DataFrame, rows: Sequence[int]) -> DataFrame:
    """Per candidate channel: entities with it, and its observed share of all frames of all entities.

    A channel an entity never shows counts as missing in all its frames.
    """
    frames = tracks.groupBy("entity_id").agg((F.max("frame") - F.min("frame") + 1).alias("t"))
    total = frames.agg(F.sum("t")).scalar()
    seen = tracks.where(F.col("row").isin(*rows) & F.col("x").isNotNull())
    found = seen.groupBy("row").agg(F.count_distinct("entity_id").alias("n_entities"), F.count("*").alias("n_observed"))
    every = tracks.sparkSession.createDataFrame([(int(r),) for r in rows], "row int")
    return every.join(found, "row", "left").select(
        "row", F.coalesce("n_entities", F.lit(0)).alias("n_entities"),
        (F.coalesce("n_observed", F.lit(0)) / total).alias("reliability"))


def normalize_frames(tracks: DataFrame, left: int, right: int, axes: Sequence[str] = ("x", "y"),
                     floor: float = 1e-6) -> DataFrame:
    """Positions relative to the midpoint of two channels, in units of their distance, frame by frame.

    Uses nothing but the frame itself, so it works on frames as they arrive. Values stay
    NULL where they are NULL, and are NULL in frames that lack either channel. Distances
    below `floor` count as `floor`.
    """
    of = {side: F.col("row") == r for side, r in (("l", left), ("r", right))}
    ref = tracks.where(F.col("row").isin(left, right)).groupBy("entity_id", "frame").agg(*[
        F.max(F.when(is_side, F.col(a))).alias(f"{side}_{a}") for side, is_side in of.items() for a in axes])
    gap = sum((F.col(f"l_{a}") - F.col(f"r_{a}")) * (F.col(f"l_{a}") - F.col(f"r_{a}")) for a in axes)
    ref = ref.withColumn("scale", F.greatest(F.sqrt(gap), F.when(gap.isNotNull(), F.lit(floor))))
    out = tracks.join(ref, ["entity_id", "frame"], "left")
    moved = {a: (F.col(a) - (F.col(f"l_{a}") + F.col(f"r_{a}")) / 2) / F.col("scale") for a in axes}
    return out.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in tracks.columns])


def acceleration(tracks: DataFrame, axes: Sequence[str] = ("x", "y"), *, segment_frames: int = SEGMENT_FRAMES,
                 whole_entities: bool = False) -> DataFrame:
    """Second difference of the smoothed positions at each frame and the two before it.

    NULL in a channel's first two frames and where it was not observed in all three.
    Windows are cut into segments, with the two frames before each copied into it.
    """
    smooth = savgol_smooth(tracks, axes, segment_frames=segment_frames, whole_entities=whole_entities)
    seg = F.floor(F.col("frame") / segment_frames)
    tail = F.col("frame") - seg * segment_frames >= segment_frames - 2
    rows = smooth.select("*", F.explode(F.array_compact(F.array(seg, F.when(tail, seg + 1)))).alias("seg"))
    w = W.partitionBy(*KEY, "seg").orderBy("frame")
    ok = F.col("seen") & F.lag("seen", 1).over(w) & F.lag("seen", 2).over(w)
    rows = rows.select("*", F.coalesce(ok, F.lit(False)).alias("ok"), *[
        (F.col(a) - 2 * F.lag(a, 1).over(w) + F.lag(a, 2).over(w)).alias(f"d2{a}") for a in axes])
    rows = rows.where(seg == F.col("seg"))
    keep = [c for c in ("entity_id", "class", "grp", "idx", "row", "frame") if c in rows.columns]
    return rows.select(*keep, *[F.when(F.col("ok"), F.col(f"d2{a}")).alias(f"d2{a}") for a in axes])


def infer_handedness(tracks: DataFrame, left: str = "left_hand", right: str = "right_hand") -> DataFrame:
    """Per entity the hand that is observed more often, with both counts; the right one on a tie."""
    seen = F.col("x").isNotNull()
    out = tracks.groupBy("entity_id").agg(
        F.count_if(seen & (F.col("grp") == left)).alias("n_left"), F.count_if(seen & (F.col("grp") == right)).alias("n_right"))
    return out.withColumn("hand", F.when(F.col("n_left") > F.col("n_right"), "left").otherwise("right"))


def mirror(tracks: DataFrame, swap: DataFrame, width: float = 1.0) -> DataFrame:
    """Mirrored tracks: x counts from the other side of `width`, and paired channels change places.

    `swap` has row, to_row, to_grp and to_idx for channels that have a counterpart; the
    others keep their place. One row per channel, so it is small whatever the tracks.
    """
    out = tracks.join(F.broadcast(swap), "row", "left")
    place = {"row": "to_row", "grp": "to_grp", "idx": "to_idx"}
    return out.select(*[
        F.coalesce(place[c], c).cast(tracks.schema[c].dataType).alias(c) if c in place
        else (F.lit(float(width)) - F.col("x")).alias("x") if c == "x" else F.col(c) for c in tracks.columns])


def _draw(seed: int, *parts) -> Column:
    """A number from 0 to 1 from a seed and columns, the same on every run and partitioning."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)


def augment(tracks: DataFrame, seed: int, *, angle: float = 0.2, scale: float = 0.1, shift: float = 0.05,
            dropout: float = 0.1) -> DataFrame:
    """Each entity rotated about the origin, scaled and moved as a whole, and some of its frames dropped.

    One draw per entity, so that motion stays coherent: rotation up to `angle` radians
    and scaling up to `scale` either way, moves up to `shift` along x and y. A dropped
    frame's values are NULL in all channels, for gap filling. Nothing is moved or joined.
    """
    def both(i: int, most: float) -> Column:
        return (2 * _draw(seed, F.lit(i), F.col("entity_id")) - 1) * most

    turn, size = both(0, angle), 1 + both(1, scale)
    kept = _draw(seed, F.lit("frame"), F.col("entity_id"), F.col("frame")) >= dropout
    x = size * (F.col("x") * F.cos(turn) - F.col("y") * F.sin(turn)) + both(2, shift)
    y = size * (F.col("x") * F.sin(turn) + F.col("y") * F.cos(turn)) + both(3, shift)
    moved = {"x": x, "y": y, "z": size * F.col("z")}
    return tracks.select(*[F.when(kept, moved[c]).alias(c) if c in moved else F.col(c) for c in tracks.columns])
