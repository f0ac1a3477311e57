"""Exact ranks, prefix sums and quantiles without ever sorting one group in one task.

Rows are written once in the global order of their keys: a range exchange, then a sort
within each partition. Keys include ties, so a group and even one of its values may
span partitions. How many rows and how much weight a group has in each partition is a
small table; its prefix sums turn positions in a partition into exact ranks. The number
of partitions follows the number of rows. NULLs come first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from motionframe.session import materialize

ROWS_PER_PART = 1_000_000  # rows that one task sorts

_ROW_BITS = 33  # a row's place within its partition, in the ids Spark gives


def in_order(df: DataFrame, order: Sequence[str], rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Rows in global order with `part` and `pos`, their partition and place in it; written once."""
    df = materialize(df)
    parts = max(1, -(-df.count() // rows_per_part))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = materialize(rows.withColumn("at", F.monotonically_increasing_id()))
    place = F.col("at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return rows.select(*df.columns, F.shiftright("at", _ROW_BITS).alias("part"), place.alias("pos"))


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Adds columns of a table with one row per key; keys may be NULL, and there may be none."""
    table = table.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *cols)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return rows.join(table, cond, how).select(*rows.columns, *(cols if how != "left_semi" else []))


def _group_parts(rows: DataFrame, group: Sequence[str], weight: str | None) -> DataFrame:
    """Per group and partition: `first` place, `size`, the weight `ahead` in earlier partitions, the group's `n`."""
    size = F.sum(weight) if weight else F.count("*")
    parts = rows.groupBy(*group, "part").agg(size.alias("size"), F.min("pos").alias("first"))
    own = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))  # one row per partition that holds the group
    before = own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("ahead", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn(
        "n", F.sum("size").over(own))


def _before(rows: DataFrame, group: Sequence[str], weight: str) -> DataFrame:
    """Adds `before`, the weight of the group's rows ahead of each row, and the group's `n`."""
    local = W.partitionBy("part", *group).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    parts = _group_parts(rows, group, weight)
    rows = rows.withColumn("local", F.coalesce(F.sum(weight).over(local), F.lit(0)))
    return attach(rows, parts, [*group, "part"], ["ahead", "n"]).withColumn("before", F.col("ahead") + F.col("local")).drop(
        "ahead", "local")


def group_ranks(df: DataFrame, group: Sequence[str], value: str, ties: Sequence[str] = (), *,
                rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Adds `rn`, the 1-based row number by (value, ties) in the group, and its size `n`."""
    rows = in_order(df, [*group, value, *ties], rows_per_part)
    parts = _group_parts(rows, group, None)
    out = attach(rows, parts, [*group, "part"], ["first", "ahead", "n"])
    return out.withColumn("rn", F.col("ahead") + F.col("pos") - F.col("first") + 1).drop("first", "ahead", "part", "pos")


def running_weight(df: DataFrame, group: Sequence[str], value: str, turn: str, weight: str, ties: Sequence[str] = (), *,
                   rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Adds `upto`, the weight of the group's rows up to each row in the order (value, turn, ties)."""
    rows = _before(in_order(df, [*group, value, turn, *ties], rows_per_part), group, weight)
    return rows.withColumn("upto", F.col("before") + F.col(weight)).drop("before", "n", "part", "pos")


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float], *,
                    rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Linearly interpolated quantiles per group, exact for groups of any size.

    Equal values are counted first; then only partitions that hold a wanted rank are
    looked into. NULL values are ignored; a group without values gives no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    rows = in_order(counts, [*group, value], rows_per_part)
    parts = _group_parts(rows, group, "c")

    def rank(p: float, fn, n: Column) -> Column:
        return fn(F.lit(float(p)) * (n - 1))

    wanted = F.lit(False)
    for p in probs.values():
        for fn in (F.floor, F.ceil):
            at = rank(p, fn, F.col("n"))
            wanted = wanted | ((at >= F.col("ahead")) & (at < F.col("ahead") + F.col("size")))
    rows = attach(rows, parts.where(wanted), [*group, "part"], ["ahead", "n"])
    local = W.partitionBy("part", *group).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.col("ahead") + F.sum("c").over(local))
    start = F.col("stop") - F.col("c")

    def at(p: float, fn) -> Column:
        r = rank(p, fn, F.col("n"))
        return F.max(F.when((r >= start) & (r < F.col("stop")), F.col(value)))

    aggs = [F.max("n").alias("n")]
    for name, p in probs.items():
        aggs += [at(p, F.floor).alias(f"{name}_lo"), at(p, F.ceil).alias(f"{name}_hi")]
    out = rows.groupBy(*group).agg(*aggs)
    return out.select(*group, *[
        (F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo"))
         * (rank(p, lambda c: c, F.col("n")) - rank(p, F.floor, F.col("n")))).alias(name) for name, p in probs.items()])


def ordered_prefix(df: DataFrame, order: Sequence[str], weight: str | None = None, *,
                   rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Adds `before`, the total weight (or row count) ahead of each row in a global order."""
    rows = in_order(df, order, rows_per_part)
    if weight:
        return _before(rows, [], weight).drop("n", "part", "pos").withColumn("before", F.col("before").cast("long"))
    parts = _group_parts(rows, [], None)
    out = attach(rows, parts, ["part"], ["ahead"])
    return out.withColumn("before", (F.col("ahead") + F.col("pos")).cast("long")).drop("ahead", "part", "pos")


def spearman(df: DataFrame, a: str, b: str, *, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Rank correlation with average ranks for ties; rows with a NULL in either are dropped."""
    pairs = materialize(df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
                        .groupBy(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
                        .agg(F.count("*").alias("w")))

    def ranks(c: str) -> DataFrame:
        totals = in_order(pairs.groupBy(c).agg(F.sum("w").alias("c")), [c], rows_per_part)
        rows = _before(totals, [], "c")
        mid = F.col("before") + (F.col("c") + 1) / 2 - (F.col("n") + 1) / 2
        return rows.select(c, mid.alias(f"r{c}"))

    joined = pairs.join(ranks("a"), "a").join(ranks("b"), "b")
    cov = F.sum(F.col("w") * F.col("ra") * F.col("rb"))
    va, vb = (F.sum(F.col("w") * F.col(r) * F.col(r)) for r in ("ra", "rb"))
    return joined.agg(F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("rho"),
                      F.coalesce(F.sum("w"), F.lit(0)).alias("n"))
