"""Evaluation of predictions: `preds` has run_id, entity_id, label and pred.

Every measure starts from counts per (label, pred), which combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from motionframe.functions.columns import ratio_or_zero
from motionframe.plans.ranking import spearman


def per_class_accuracy(preds: DataFrame, names: DataFrame | None = None,
                       group: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support per true class, worst first; `names` maps label to class."""
    correct = (F.col("label") == F.col("pred")).cast("double")
    out = preds.groupBy(*group, "label").agg(F.avg(correct).alias("accuracy"), F.count("*").alias("n_val"))
    if names is not None:
        out = out.join(names, "label", "left")
    return out.orderBy(*group, "accuracy", "label")


def eval_summary(preds: DataFrame, ends: int = 5) -> DataFrame:
    """One row: overall, macro and median class accuracy, weak classes, worst and best ones."""
    per = per_class_accuracy(preds)
    out = per.agg(
        (F.sum(F.col("accuracy") * F.col("n_val")) / F.sum("n_val")).alias("overall_accuracy"),
        F.avg("accuracy").alias("macro_accuracy"), F.median("accuracy").alias("median_class_accuracy"),
        F.count_if(F.col("accuracy") < 0.5).alias("n_classes_below_50pct"), F.sum("n_val").alias("n_val"))

    def end(name: str, *order) -> DataFrame:
        rows = per.orderBy(*order).limit(ends)  # `ends` rows
        return rows.agg(F.array_sort(F.collect_list(F.struct("accuracy", "label"))).alias(name))

    return out.crossJoin(end("worst", "accuracy", "label")).crossJoin(end("best", F.desc("accuracy"), F.desc("label")))


def balanced_accuracy(preds: DataFrame) -> DataFrame:
    """Mean per-class recall."""
    return per_class_accuracy(preds).agg(F.avg("accuracy").alias("balanced_accuracy"))


def confusion_counts(preds: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return preds.groupBy(*group, "label", "pred").agg(F.count("*").alias("n"))


def classification_report(preds: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted averages."""
    cells = confusion_counts(preds)
    true = cells.groupBy(F.col("label").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n"))).alias("tp"))
    predicted = cells.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    zero = F.lit(0).cast("long")
    per = true.join(predicted, "class", "full_outer").select(
        "class", *[F.coalesce(F.col(c), zero).alias(c) for c in ("support", "tp", "predicted")])
    per = per.withColumn("precision", ratio_or_zero("tp", "predicted")).withColumn(
        "recall", ratio_or_zero("tp", "support"))
    per = per.withColumn("f1", ratio_or_zero(2 * F.col("precision") * F.col("recall"),
                                             F.col("precision") + F.col("recall")))
    cols = ["precision", "recall", "f1"]
    macro = per.agg(*[F.avg(c).alias(c) for c in cols], F.sum("support").alias("support"))
    weighted = per.agg(*[ratio_or_zero(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)
                         for c in cols], F.sum("support").alias("support"))
    rows = per.select(F.col("class").cast("string").alias("name"), *cols, "support")
    for name, part in (("macro avg", macro), ("weighted avg", weighted)):
        rows = rows.unionByName(part.select(F.lit(name).alias("name"), *cols, "support"))
    return rows


def normalized_confusion(preds: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Observed cells with their share of the true class."""
    cells = confusion_counts(preds, group)
    return cells.withColumn("rate", F.col("n") / F.sum("n").over(W.partitionBy(*group, "label")))


def confusion_matrix(preds: DataFrame, n_classes: int, normalize: bool = True) -> DataFrame:
    """Dense true x predicted matrix; classes without samples are rows of zeros."""
    grid = preds.sparkSession.range(n_classes).selectExpr(
        "CAST(id AS INT) AS label", f"explode(sequence(0, {n_classes - 1})) AS pred")
    cells = normalized_confusion(preds)
    value = F.coalesce(F.col("rate"), F.lit(0.0)) if normalize else F.coalesce(F.col("n"), F.lit(0)).cast("double")
    return grid.join(cells, ["label", "pred"], "left").select("label", "pred", value.alias("value"))


def mean_confusion(preds: DataFrame) -> DataFrame:
    """Mean of the runs' row-normalized matrices; each run weighs the same, absent cells are 0."""
    n_runs = preds.agg(F.count_distinct("run_id")).scalar()
    cells = normalized_confusion(preds, ["run_id"])
    return cells.groupBy("label", "pred").agg((F.sum("rate") / F.max(n_runs)).alias("mean_rate"))


def confused_pairs(preds: DataFrame, k: int = 20) -> DataFrame:
    """Top-k ordered pairs by mean rate, with the true class's recall and the reverse rate."""
    cells = mean_confusion(preds)
    diag = cells.where("label = pred").select("label", F.col("mean_rate").alias("true_recall"))
    back = cells.select(F.col("pred").alias("label"), F.col("label").alias("pred"),
                        F.col("mean_rate").alias("symmetric_rate"))
    out = (cells.where("label <> pred").join(diag, "label", "left")
           .join(back, ["label", "pred"], "left"))
    return (out.select("label", "pred", "mean_rate", F.coalesce("true_recall", F.lit(0.0)).alias("true_recall"),
                       F.coalesce("symmetric_rate", F.lit(0.0)).alias("symmetric_rate"))
            .orderBy(F.desc("mean_rate"), "label", "pred").limit(k))


def confused_pairs_count(preds: DataFrame, n: int = 20) -> DataFrame:
    """Top-n confused pairs by raw count."""
    return (confusion_counts(preds).where("label <> pred")
            .orderBy(F.desc("n"), "label", "pred").limit(n))


def top_n_per_side(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n lowest and the n highest rows by a metric."""
    low = df.orderBy(value, key).limit(n).withColumn("side", F.lit("worst"))
    high = df.orderBy(F.desc(value), key).limit(n).withColumn("side", F.lit("best"))
    return low.unionByName(high)


def running_plateau(hist: DataFrame, delta: float = 0.001, patience: int = 15) -> DataFrame:
    """Per epoch: best so far, epochs since a gain above delta, and whether patience is reached.

    The best follows every improvement; only a gain above delta resets the counter.
    A run's epochs are the elements of one record, so a run is a small partition.
    """
    w = W.partitionBy("run_id").orderBy("epoch")
    before = F.greatest(F.lit(0.0), F.coalesce(
        F.max("val_acc").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    h = hist.select("run_id", "epoch", "val_acc", before.alias("before"))
    h = h.withColumn("gain_at", F.when(F.col("val_acc") > F.col("before") + delta, F.col("epoch")))
    last = F.coalesce(F.max("gain_at").over(w), F.lit(0))
    return h.select("run_id", "epoch", "val_acc",
                    F.greatest("before", "val_acc").alias("best"),
                    (F.col("epoch") - last).alias("since_gain"),
                    (F.col("epoch") - last >= patience).alias("stop"))


def plateau(hist: DataFrame, delta: float = 0.001, patience: int = 15) -> DataFrame:
    """First epoch at which training would stop, NULL if it never does."""
    return running_plateau(hist, delta, patience).groupBy("run_id").agg(
        F.min(F.when(F.col("stop"), F.col("epoch"))).alias("stop_epoch"),
        F.max("epoch").alias("last_epoch"), F.max("best").alias("best_val_acc"))


def best_epoch_gap(hist: DataFrame) -> DataFrame:
    """First epoch of the maximum, both accuracies there and their gap, best run first."""
    best = hist.groupBy("run_id").agg(F.max_by(
        F.struct("epoch", "train_acc", "val_acc"), F.struct(F.col("val_acc"), -F.col("epoch"))).alias("b"))
    return best.select("run_id", F.col("b.epoch").alias("best_epoch"), F.col("b.train_acc").alias("train_acc"),
                       F.col("b.val_acc").alias("val_acc"),
                       (F.col("b.train_acc") - F.col("b.val_acc")).alias("train_val_gap")).orderBy(
        F.desc("val_acc"), "run_id")


def support_vs_accuracy(preds: DataFrame) -> DataFrame:
    """Rank correlation of a class's number of samples with its accuracy: imbalance shows as a high one."""
    return spearman(per_class_accuracy(preds), "n_val", "accuracy")


def weak_class_overlap(preds: DataFrame, k: int = 20, weakest: int = 20) -> DataFrame:
    """How many of the top k confused pairs start from one of the weakest classes.

    One row: pairs found, pairs from a weak class, their share, and the weak classes hit.
    """
    pairs = confused_pairs(preds, k).select("label")
    weak = per_class_accuracy(preds).orderBy("accuracy", "label").limit(weakest).select("label", F.lit(True).alias("weak"))
    return pairs.join(F.broadcast(weak), "label", "left").agg(  # `weakest` rows
        F.count("*").alias("n_pairs"), F.count("weak").alias("n_from_weak"),
        ratio_or_zero(F.count("weak"), F.count("*")).alias("share"),
        F.count_distinct(F.when(F.col("weak"), F.col("label"))).alias("n_weak_classes"))
