"""Scores of channels and subsets, and comparisons between score tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from motionframe.functions.columns import digamma
from motionframe.plans.ranking import ROWS_PER_PART, exact_quantiles, group_ranks, running_weight, spearman


def paired_compare(df: DataFrame, unit: str, treatment: str, a: str, b: str,
                   metrics: Mapping[str, bool]) -> DataFrame:
    """Two treatments on the same units, one row per metric (True: higher is better).

    Only units with a value under both treatments count.
    """
    long = df.where(F.col(treatment).isin(a, b)).select(unit, treatment, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(up).alias("up"), F.col(m).cast("double").alias("v"))
        for m, up in metrics.items()])))
    per = long.groupBy("metric", "up", unit).agg(
        F.max(F.when(F.col(treatment) == a, F.col("v"))).alias("a"),
        F.max(F.when(F.col(treatment) == b, F.col("v"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    # summation order may differ between two evaluations: rounding noise is no change
    noise = F.greatest(F.abs("a"), F.abs("b")) * 1e-9
    diff = F.when(F.abs(F.col("b") - F.col("a")) <= noise, F.lit(0.0)).otherwise(F.col("b") - F.col("a"))
    gain = F.when(F.col("up"), diff).otherwise(-diff)
    return per.groupBy("metric").agg(
        F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"),
        F.avg(F.col("b") - F.col("a")).alias("mean_diff"),
        F.count_if(gain > 0).alias("n_better"), F.count_if(gain < 0).alias("n_worse"),
        F.count_if(gain == 0).alias("n_unchanged"), F.count("*").alias("n_units"))


def align_summaries(summaries: Mapping[str, tuple[DataFrame, str]],
                    keys: Sequence[str] = ("grp", "idx")) -> DataFrame:
    """Outer alignment of several summaries; one value column per name."""
    parts = [df.groupBy(*keys).agg(F.avg(col).alias(name)) for name, (df, col) in summaries.items()]
    return reduce(lambda x, y: x.join(y, list(keys), "full_outer"), parts)


def merge_scores(tables: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Inner join of score tables on their common key."""
    return reduce(lambda x, y: x.join(y, list(on)), tables)


def channel_rank(energy: DataFrame) -> DataFrame:
    """Mean, exact median, deviation and count of speed per channel, fastest first."""
    stats = energy.groupBy("grp", "idx").agg(
        F.avg("rms_speed").alias("mean"), F.stddev_samp("rms_speed").alias("std"),
        F.count("rms_speed").alias("count"))
    med = exact_quantiles(energy.select("grp", "idx", "rms_speed"), ["grp", "idx"], "rms_speed",
                          {"median": 0.5})
    return (stats.join(med, ["grp", "idx"], "left").select("grp", "idx", "mean", "median", "std", "count")
            .orderBy(F.desc_nulls_last("mean"), "grp", "idx"))


def describe_by(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles and max per group."""
    stats = df.groupBy(*group).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    q = exact_quantiles(df.select(*group, value), group, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return stats.join(q, list(group), "left").select(
        *group, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def class_consistency(desc: DataFrame, cls: str) -> DataFrame:
    """Within one class, per channel: variation of speed, spread of position, mean detection."""
    d = desc.where(F.col("class") == cls)
    return d.groupBy("row").agg(
        F.when(F.abs(F.avg("rms_speed_xy")) > 0,
               F.stddev_samp("rms_speed_xy") / F.abs(F.avg("rms_speed_xy"))).alias("cv_speed"),
        F.sqrt(F.var_samp("x_mean") + F.var_samp("y_mean")).alias("pos_spread"),
        F.avg("detection_rate").alias("det_mean"))


def _class_sizes(desc: DataFrame) -> DataFrame:
    return desc.groupBy("entity_id", "class").agg(F.lit(1).alias("one")).groupBy("class").agg(
        F.count("*").alias("size"))


def f_ratio(desc: DataFrame, class_sizes: DataFrame | None = None) -> DataFrame:
    """One-way ANOVA F per (channel, descriptor); NULL and absent values count as 0.

    Works from count, mean and centred squares per (feature, class), so a large class
    is combined before the shuffle. Features without spread, and infinite F, give 0.
    """
    sizes = _class_sizes(desc) if class_sizes is None else class_sizes
    v = F.coalesce(F.col("value"), F.lit(0.0))
    cells = desc.groupBy("row", "descriptor", "class").agg(
        F.count("*").alias("c"), F.avg(v).alias("m"), F.var_pop(v).alias("v"))
    cells = cells.join(sizes.select("class", F.col("size").cast("double").alias("n")), "class")
    total = sizes.agg(F.struct(F.sum("size").cast("double").alias("n"), F.count("*").alias("k"))).scalar()
    # absent values of a class that has some are zeros
    c, m, var, n = (F.col(x) for x in ("c", "m", "v", "n"))
    cells = cells.select("row", "descriptor", "n", (c * m / n).alias("mean"), (c * var + c * (n - c) / n * m * m).alias("m2"))
    # a class without any is all zeros: it adds its size times the squared grand mean
    dev = F.col("mean") - F.col("grand")
    grand = cells.groupBy("row", "descriptor").agg((F.sum(F.col("n") * F.col("mean"))).alias("sum"))
    grand = grand.select("row", "descriptor", (F.col("sum") / total["n"]).alias("grand"))
    agg = cells.join(grand, ["row", "descriptor"]).groupBy("row", "descriptor").agg(
        F.sum(F.col("n") * dev * dev).alias("ssb"), F.sum("m2").alias("ssw"), F.sum("n").alias("present"),
        F.max("grand").alias("grand"))
    ssb = F.col("ssb") + (total["n"] - F.col("present")) * F.col("grand") * F.col("grand")
    f = (ssb / (total["k"] - 1)) / (F.col("ssw") / (total["n"] - total["k"]))
    ok = (F.col("ssw") > 0) & (total["k"] > 1) & (total["n"] > total["k"])
    return agg.select("row", "descriptor", F.when(ok, f).otherwise(F.lit(0.0)).alias("f"))


def max_per_channel(scores: DataFrame, value: str, out: str) -> DataFrame:
    """Channel score: the largest value over its descriptors."""
    return scores.groupBy("row").agg(F.max(value).alias(out))


def mutual_info_binned(desc: DataFrame, bins: int = 10) -> DataFrame:
    """Plug-in mutual information (nats) of each quantile-binned feature with the class."""
    d = desc.withColumn("value", F.coalesce(F.col("value"), F.lit(0.0)))
    ranked = group_ranks(d.select("row", "descriptor", "entity_id", "class", "value"),
                         ["row", "descriptor"], "value", ["entity_id"])
    n, k = F.col("n"), F.lit(bins)
    base, extra = F.floor(n / k), n % k
    pos = F.col("rn") - 1
    # the first n % bins bins hold one row more
    tile = F.when(pos < extra * (base + 1), F.floor(pos / (base + 1))).otherwise(
        extra + F.floor((pos - extra * (base + 1)) / F.greatest(base, F.lit(1))))
    joint = ranked.groupBy("row", "descriptor", tile.alias("bin"), "class").agg(F.count("*").alias("c"))
    feature = W.partitionBy("row", "descriptor")
    joint = joint.select(
        "row", "descriptor", "c", F.sum("c").over(feature).alias("n"),
        F.sum("c").over(W.partitionBy("row", "descriptor", "bin")).alias("cb"),
        F.sum("c").over(W.partitionBy("row", "descriptor", "class")).alias("cc"))
    term = F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cb") * F.col("cc")))
    return joint.groupBy("row", "descriptor").agg(F.sum(term).alias("mi"))


def subset_median(membership: DataFrame, scores: DataFrame, value: str, out: str) -> DataFrame:
    """Median of a channel score over each subset's members (at most one row per channel)."""
    return membership.join(scores, "row").groupBy("subset").agg(F.median(value).alias(out))


def subset_consistency(membership: DataFrame, consistency: DataFrame) -> DataFrame:
    """Per subset: size, median variation and spread, mean detection; steadiest first."""
    return (membership.join(consistency, "row", "left").groupBy("subset").agg(
        F.count("*").alias("n_channels"), F.median("cv_speed").alias("median_cv_speed"),
        F.median("pos_spread").alias("median_pos_spread"), F.avg("det_mean").alias("mean_detection"))
        .orderBy(F.asc_nulls_last("median_cv_speed"), "subset"))


def winner(board: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Best row of a leaderboard."""
    return board.orderBy(*order).limit(1)


def agreement_report(pairs: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Rank agreement of named score pairs, one row each."""
    parts = [spearman(df, a, b).select(F.lit(name).alias("pair"), "rho", "n")
             for name, (df, a, b) in pairs.items()]
    return reduce(DataFrame.unionByName, parts)


def external_validation(recall: DataFrame, accuracy: DataFrame, on: str = "class") -> DataFrame:
    """Rank agreement of one model's per-class recall with another's per-class accuracy."""
    return spearman(recall.join(accuracy, on), "recall", "accuracy")


def mutual_info_knn(desc: DataFrame, k: int = 3, *, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Mutual information of each feature with the class by nearest neighbours.

    For a point with its k-th neighbour inside the class at distance r, m counts the
    points of any class closer than r; MI = psi(N) + mean psi(k) - mean psi(N_class)
    - mean psi(m). Features stand on one axis, so both steps are rank lookups: the k
    neighbours lie within k ranks on either side, and m is a difference of two ranks.
    """
    feature = ["row", "descriptor"]
    d = desc.select(*feature, "entity_id", "class", F.coalesce(F.col("value"), F.lit(0.0)).alias("value"))
    ranked = group_ranks(d, [*feature, "class"], "value", ["entity_id"], rows_per_part=rows_per_part).where("n > 1")
    # each point also appears in the blocks that need it as a neighbour
    block = 4096
    rows = ranked.selectExpr(
        "*", f"""explode(array_compact(array(floor((rn - 1) / {block}),
            CASE WHEN (rn - 1) % {block} < {k} AND rn > {block} THEN floor((rn - 1) / {block}) - 1 END,
            CASE WHEN (rn - 1) % {block} >= {block - k} THEN floor((rn - 1) / {block}) + 1 END))) AS blk""")
    over = "OVER (PARTITION BY row, descriptor, class, blk ORDER BY rn)"
    near = ", ".join(f"abs(value - lag(value, {j}) {over}), abs(value - lead(value, {j}) {over})"
                     for j in range(1, k + 1))
    rows = rows.selectExpr("*", f"sort_array(array_compact(array({near}))) AS dist")
    rows = rows.where(f"blk = floor((rn - 1) / {block})")
    radius = F.element_at("dist", F.least(F.lit(k), (F.col("n") - 1).cast("int")))
    rows = rows.select(*feature, "class", "value", "entity_id", F.col("n").alias("size"), radius.alias("r"))
    # lower bound exclusive, upper bound exclusive, unless r is 0: then ties of the value
    low = F.when(F.col("r") > 0, F.col("value") - F.col("r")).otherwise(F.col("value"))
    high = F.when(F.col("r") > 0, F.col("value") + F.col("r")).otherwise(F.col("value"))
    closed = F.col("r") == 0
    side = [*feature, "entity_id"]
    points = rows.select(*side, F.col("value").alias("at"), F.lit(1).alias("w"),
                         F.lit(1).alias("turn"), F.lit(0).alias("sign"))
    # at equal positions, turn 0 counts the points strictly below and turn 2 the point itself too
    lows = rows.select(*side, low.alias("at"), F.lit(0).alias("w"),
                       F.when(closed, 0).otherwise(2).alias("turn"), F.lit(-1).alias("sign"))
    highs = rows.select(*side, high.alias("at"), F.lit(0).alias("w"),
                        F.when(closed, 2).otherwise(0).alias("turn"), F.lit(1).alias("sign"))
    line = running_weight(points.unionByName(lows).unionByName(highs), feature, "at", "turn", "w", ["entity_id"],
                          rows_per_part=rows_per_part)
    m = line.groupBy(*side).agg(F.sum(F.col("sign") * F.col("upto")).alias("m"))
    kk = F.least(F.lit(k), F.col("size") - 1)
    own = rows.groupBy(*feature).agg(
        F.count("*").alias("total"), F.avg(digamma(kk)).alias("psi_k"),
        F.avg(digamma("size")).alias("psi_size"))
    near_m = m.groupBy(*feature).agg(F.avg(digamma("m")).alias("psi_m"))
    mi = digamma("total") + F.col("psi_k") - F.col("psi_size") - F.col("psi_m")
    return own.join(near_m, feature).select(*feature, F.greatest(mi, F.lit(0.0)).alias("mi"))


def with_worst_classes(best: DataFrame, worst: DataFrame) -> DataFrame:
    """The winning row next to each of its n worst classes (both sides are small by limit)."""
    one = F.lit(1).alias("one")
    return best.select("*", one).join(worst.select("*", one), "one").drop("one")
