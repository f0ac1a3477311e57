"""Seeded selection by hash order, with a threshold per group instead of a full sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from motionframe.functions.columns import hash_order
from motionframe.plans.ranking import attach

PREFIX = 3                 # hex digits that a level adds: 4096 even buckets per group
ROWS_PER_BUCKET = 100_000  # rows that one task ranks, about


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement; the same rows for any partitioning, left where they are."""
    quota = df.sparkSession.range(1).select(F.lit(n).alias("take"))
    return mark_first(df, [], quota, seed, key).where("selected").drop("selected")


def mark_first(df: DataFrame, group: Sequence[str], quota: DataFrame, seed: int, key: str,
               out: str = "selected", *, prefix: int = PREFIX, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Marks the first `quota` rows of every group in hash order; a NULL group is a group.

    `quota` has the group columns and `take`. Counting hash prefixes finds the bucket
    where a group's quota ends; within that bucket longer prefixes are counted, until
    buckets hold `rows_per_bucket` rows or so, whatever the group's size. Only the last
    one is ranked, which gives the last hash to take. The rows themselves are then
    compared with it and never sorted.
    """
    group = list(group)
    rows = df.withColumn("h", hash_order(seed, key))
    n_rows, levels = df.count(), 1
    while n_rows >> (4 * prefix * levels) > rows_per_bucket and prefix * (levels + 1) <= 32:
        levels += 1
    near, wanted, sizes = rows.select(*group, F.col(key).alias("k"), "h"), quota, None
    for level in range(levels):
        near = near.withColumn("hb", F.substring("h", 1 + prefix * level, prefix))
        counts = near.groupBy(*group, "hb").agg(F.count("*").alias("c"))
        if sizes is None:
            sizes = counts.groupBy(*group).agg(F.sum("c").alias("size"))
        own = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))  # one row per hash prefix
        counts = counts.withColumn("upto", F.sum("c").over(own.orderBy("hb").rowsBetween(W.unboundedPreceding, 0)))
        reach = attach(counts, wanted, group, ["take"])
        edge = reach.where((F.col("upto") - F.col("c") < F.col("take")) & (F.col("take") <= F.col("upto"))).select(
            *group, "hb", (F.col("take") - F.col("upto") + F.col("c")).alias("take"))
        near = attach(near, edge, [*group, "hb"], ["take"] if level + 1 == levels else [], "inner" if level + 1 == levels else "left_semi")
        wanted = edge.drop("hb")
        near = near if level + 1 == levels else near.drop("hb")
    ranked = (near.withColumn("rn", F.row_number().over(W.partitionBy(*group, "hb").orderBy("h", "k")))
              .where(F.col("rn") == F.col("take"))
              .select(*group, F.struct("h", "k").alias("cutoff"), F.lit(False).alias("all_rows")))
    # a quota of the whole group or more has no edge bucket beyond the last one
    whole = attach(sizes, quota, group, ["take"]).where(F.col("take") >= F.col("size")).select(
        *group, F.lit(None).cast(ranked.schema["cutoff"].dataType).alias("cutoff"), F.lit(True).alias("all_rows"))
    limits = ranked.unionByName(whole).groupBy(*group).agg(
        F.max("cutoff").alias("cutoff"), F.max("all_rows").alias("all_rows"))
    joined = attach(rows, limits, group, ["cutoff", "all_rows"], "left")
    inside = F.coalesce(F.col("all_rows"), F.lit(False)) | F.coalesce(
        F.struct(F.col("h"), F.col(key).alias("k")) <= F.col("cutoff"), F.lit(False))
    return joined.select(*df.columns, inside.alias(out))
