"""Mixing datasets to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from motionframe.session import materialize

WEIGHTS = (5, 2, 1)         # weights of the datasets in name order, repeating
MAX_REPEATS = 3             # copies of one entity at most
ROWS_PER_BUCKET = 4_000    # rows that one task orders; the number of buckets follows the input


def dataset_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS,
                    max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds `target` to one row (dataset, dataset_size) per dataset.

    The targets share the sum of all sizes by weight. No target exceeds `max_repeats`
    times its dataset; what is above is shared again among the others. With datasets
    ordered by cap over weight that is one pass: the capped ones come first, and all
    later ones share what these leave. One row per dataset stands in one window.
    """
    turn = F.row_number().over(W.orderBy(F.asc_nulls_last("dataset")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(turn - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("dataset_size") * max_repeats)
    ratio = F.col("cap").cast("double") / F.col("weight")
    rows = rows.withColumn("ratio", ratio)
    order = [F.col("ratio"), F.asc_nulls_last("dataset")]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    left = (F.sum("dataset_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
    rows = rows.withColumn("left", left).withColumn("weights", F.sum("weight").over(after).cast("double"))
    # the share per weight as it stands when the first uncapped dataset is met
    free = (F.col("left") / F.col("weights")) <= F.col("ratio")
    rows = rows.withColumn("level", F.min(F.when(free, F.struct("ratio", F.col("dataset").isNull().alias("last"), "dataset",
                                                                "left", "weights"))).over(every))
    shared = F.col("weight") * F.col("level.left") / F.col("level.weights")
    target = F.when(F.col("ratio") <= F.col("level.left") / F.col("level.weights"), F.col("cap").cast("double")).otherwise(shared)
    return rows.select("dataset", "dataset_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _upto(rows: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column], size: str) -> DataFrame:
    """Adds `upto`: the size of the group's rows up to each row, buckets in order, rows in order within."""
    parts = rows.groupBy(*group, bucket).agg(F.sum(size).alias("part"))
    earlier = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part").over(earlier), F.lit(0))).drop("part")
    local = F.sum(size).over(W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("local", local)
    same = F.lit(True)
    for c in [*group, bucket]:
        same = same & rows[c].eqNullSafe(parts[c])
    return rows.join(parts, same).select(*[rows[c] for c in rows.columns if c != "local"],
                                         (F.col("local") + F.col("ahead")).alias("upto"))


def mix_datasets(entities: DataFrame, *, key: str = "entity_id", dataset: str = "dataset", size: str = "n_frames",
                 weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """How often a training mix takes each entity of the catalog.

    Weighted fair queueing: entities of a dataset are shuffled by md5(seed|key) and
    offered up to `max_repeats` times over. A copy's virtual finish time is its
    dataset's cumulative size divided by the dataset's target. Copies are ordered by
    that time over all datasets and taken until the sum of all sizes is reached.

    Returns one row (key, size, dataset_size, target, taken, copies) per input row; `taken`
    is the size of the copies taken. NULL sizes count as 0. A NULL dataset is a dataset of
    its own, last in order. Repeated rows are separate entities. Ties in time are broken
    by dataset (NULL first), key, size and copy. Other columns are ignored. An empty
    table gives no rows.

    Large datasets are cut by hash prefix and by time into buckets of bounded size;
    virtual time is even by construction, so its buckets are equal. Only the narrow
    rows are moved and written.
    """
    e = F.coalesce(F.col(size), F.lit(0)).cast("long")
    rows = entities.select(F.col(key).alias("k"), F.col(dataset).alias("dataset"), e.alias("size"),
                           F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))).alias("h"))
    rows = materialize(rows)
    sizes = rows.groupBy("dataset").agg(F.sum("size").alias("dataset_size"))
    buckets = rows.agg(F.ceil(F.count("*") / ROWS_PER_BUCKET).cast("long")).scalar()
    prefix = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    spread = rows.withColumn("bucket", F.floor(prefix * buckets / F.lit(2**32)).cast("long"))
    queued = _upto(spread, ["dataset"], "bucket", [F.col("h"), F.col("k"), F.col("size")], "size")
    targets = dataset_targets(sizes, weights, max_repeats).withColumnRenamed("dataset", "d")
    queued = materialize(queued.join(targets, F.col("dataset").eqNullSafe(F.col("d"))).select(
        "k", "dataset", "size", "upto", "dataset_size", "target"))

    # cast before dividing: exact integers on both sides of one division
    finish = F.when(F.col("target") > 0,
                    (F.col("upto") + F.col("copy") * F.col("dataset_size")).cast("double") / F.col("target"))
    copies = (queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
              .withColumn("finish", finish).where(F.col("finish").isNotNull())
              .withColumn("slot", F.floor(F.col("finish") * buckets).cast("long")))
    turn = F.struct("finish", "dataset", "k", "size", "copy")
    budget = rows.agg(F.sum("size")).scalar()
    # slots are few per dataset and even in time; only the one in which the budget ends is ordered
    slots = copies.groupBy("slot").agg(F.sum("size").alias("part"))
    slots = slots.withColumn("upto_slot", F.sum("part").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, 0)))
    edge = slots.where(F.col("upto_slot") > budget).agg(
        F.min_by(F.struct("slot", (F.col("upto_slot") - F.col("part")).alias("ahead")), "slot").alias("edge"))
    inside = copies.crossJoin(F.broadcast(edge)).where(F.col("slot") == F.col("edge.slot"))  # one row
    run = F.sum("size").over(W.partitionBy("slot").orderBy(*[F.col(f"turn.{c}") for c in ("finish", "dataset", "k", "size", "copy")])
                             .rowsBetween(W.unboundedPreceding, 0))
    cut = (inside.withColumn("turn", turn).withColumn("upto_copy", F.col("edge.ahead") + run)
           .where(F.col("upto_copy") > budget).agg(F.min("turn").alias("cut")))
    n_taken = F.lit(0)
    for copy in range(max_repeats):
        at = F.struct(*[(F.when(F.col("target") > 0, (F.col("upto") + copy * F.col("dataset_size")).cast("double")
                                / F.col("target"))).alias("finish"), F.col("dataset"), F.col("k"), F.col("size"),
                        F.lit(copy).alias("copy")])
        n_taken = n_taken + F.when(F.col("target") > 0, F.when(F.col("cut").isNull() | (at < F.col("cut")), 1).otherwise(0)).otherwise(0)
    return queued.crossJoin(F.broadcast(cut)).select(  # one row
        F.col("k").alias(key), F.col("size").alias(size), "dataset_size", "target",
        (F.col("size") * n_taken).cast("long").alias("taken"), n_taken.cast("int").alias("copies"))
