"""Standardization, linear probes and scoring with a caller's function."""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from motionframe.operators.datasets import stratified_split
from motionframe.session import materialize, scratch_dir

# executors get the task functions with the task instead of importing them
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def standardize(train: DataFrame, data: DataFrame) -> DataFrame:
    """Long features scaled with mean and population deviation of `train` only.

    A constant feature is centred but not scaled.
    """
    stats = train.groupBy("row", "descriptor").agg(
        F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    flat = F.col("sd") <= F.abs(F.col("mu")) * 1e-12
    scale = F.when(F.col("sd").isNull() | flat, F.lit(1.0)).otherwise(F.col("sd"))
    return data.join(stats, ["row", "descriptor"]).withColumn(
        "value", (F.col("value") - F.col("mu")) / scale).drop("mu", "sd")


class _Minimizer:
    """Limited-memory BFGS for one convex function whose value and gradient are computed elsewhere.

    `trial` is the point to evaluate next; `tell` takes what was found there. Steps are
    halved until the value falls enough. Done when no component of the gradient exceeds
    `tol`, after `max_iter` steps, or when the value cannot fall any more.
    """

    KEPT = 10  # pairs of steps and gradient changes

    def __init__(self, size: int, max_iter: int, tol: float):
        self.x = self.trial = np.zeros(size)
        self.max_iter, self.tol = max_iter, tol
        self.value, self.gradient, self.pairs = None, None, []
        self.n_iter, self.done = 0, False

    def tell(self, value: float, gradient: np.ndarray) -> None:
        if self.value is not None:
            fall = self.step * float(self.gradient @ self.direction)
            if not value <= self.value + 1e-4 * fall:
                self.step /= 2
                self.done = self.step < 1e-12
                self.trial = self.x + self.step * self.direction
                return
            moved, change = self.trial - self.x, gradient - self.gradient
            if moved @ change > 0:
                self.pairs = [*self.pairs, (moved, change)][-self.KEPT:]
            self.n_iter += 1
        self.x, self.value, self.gradient = self.trial, value, gradient
        if np.abs(gradient).max(initial=0.0) <= self.tol or self.n_iter >= self.max_iter:
            self.done = True
            return
        self.direction = -self._scaled(gradient)
        self.step = 1.0 if self.pairs else min(1.0, 1.0 / float(np.abs(gradient).sum()))
        self.trial = self.x + self.step * self.direction

    def _scaled(self, gradient: np.ndarray) -> np.ndarray:
        q, used = gradient.copy(), []
        for moved, change in reversed(self.pairs):
            a = (moved @ q) / (moved @ change)
            q -= a * change
            used.append(a)
        if self.pairs:
            moved, change = self.pairs[-1]
            q *= (moved @ change) / (change @ change)
        for (moved, change), a in zip(self.pairs, reversed(used)):
            q += (a - (change @ q) / (moved @ change)) * moved
        return q


BLOCK_BYTES = 8 << 20   # of features that a task multiplies at once
PIECE = 1 << 18         # numbers of a gradient that travel together
_BLOCK = "val boolean, n int, labels binary, x binary"


def _blocks(data: DataFrame, columns: Sequence[int], mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """Rows as blocks of scaled features, read once per step of the fit; written to the shared folder."""
    per_block = max(1, BLOCK_BYTES // (8 * max(1, len(columns))))
    width, picked = len(mean), np.asarray(columns, np.int64)

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, per_block):
                part = batch.slice(at, per_block)
                rows = part.column(2).flatten().fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(part), -1)
                if rows.shape[1] != width:
                    raise ValueError(f"feature arrays of {rows.shape[1]} values where others have {width}")
                x = (rows[:, picked] - mean[picked]) / scale[picked]
                labels = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                val = part.column(0).to_numpy(zero_copy_only=False)
                for which in (False, True):
                    own = val == which
                    if own.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([which]), pa.array([int(own.sum())], pa.int32()), pa.array([labels[own].tobytes()]),
                             pa.array([np.ascontiguousarray(x[own]).tobytes()])], ["val", "n", "labels", "x"])

    path = scratch_dir(data.sparkSession, "probe-blocks")
    data.select((F.col("split") == "val").alias("val"), "label", "raw").mapInArrow(pack, _BLOCK).write.option(
        "parquet.block.size", 2 * BLOCK_BYTES).parquet(path)
    return data.sparkSession.read.parquet(path)


def _read(batches, n_features):
    for batch in batches:
        for n, labels, x in zip(*(batch.column(c).to_pylist() for c in ("n", "labels", "x"))):
            yield np.frombuffer(labels, np.int64), np.frombuffer(x, np.float64).reshape(n, n_features)


def _class_odds(x: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the classes, the largest one 0, and their log sum per row."""
    z = x @ weights[:, :-1].T + weights[:, -1]
    z -= z.max(axis=1, keepdims=True)
    return z, np.log(np.exp(z).sum(axis=1))


def _losses(train: DataFrame, points: Mapping[str, np.ndarray], places: Mapping[str, np.ndarray], classes: np.ndarray,
            n_features: int) -> dict[str, np.ndarray]:
    """Sums over the training rows, for all probes in one pass: the log loss, then its gradient.

    Each task adds up its blocks; pieces of the sums are added over the tasks by piece, so
    the driver gets each once: as many numbers as the probes have weights.
    """
    sent = train.sparkSession.sparkContext.broadcast(dict(points))
    places = {name: np.asarray(p) for name, p in places.items() if name in points}

    def task(batches):
        total = None
        for labels, x in _read(batches, n_features):
            parts, place = [], np.searchsorted(classes, labels)
            for name, own in places.items():
                weights = sent.value[name].reshape(len(classes), -1)
                mine = x[:, own]
                z, log_sum = _class_odds(mine, weights)
                rows = np.arange(len(labels))
                loss = float((log_sum - z[rows, place]).sum())
                share = np.exp(z - log_sum[:, None])
                share[rows, place] -= 1
                parts += [np.array([loss]), np.concatenate([share.T @ mine, share.sum(axis=0)[:, None]], axis=1).ravel()]
            flat = np.concatenate(parts)
            total = flat if total is None else total + flat
        if total is not None:
            pieces = [total[at:at + PIECE].tobytes() for at in range(0, len(total), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["piece", "sums"])

    def add(table):
        sums = sum(np.frombuffer(v, np.float64) for v in table["sums"].to_pylist())
        return pa.table({"piece": table["piece"].slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})

    shape = "piece int, sums binary"
    found = train.mapInArrow(task, shape).groupBy("piece").applyInArrow(add, shape).collect()
    sent.destroy()
    flat = np.concatenate([np.frombuffer(r.sums, np.float64) for r in sorted(found)])
    out, at = {}, 0
    for name in places:
        size = 1 + len(points[name])
        out[name] = flat[at:at + size]
        at += size
    return out


def fit_probes(features: DataFrame, subsets: Mapping[str, Sequence[int]], n_descriptors: int, *, frac: float = 0.1,
               seed: int = 42, max_iter: int = 200, tol: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Multinomial logistic probes on the features of several channel subsets, fitted together.

    `features` has entity_id, class (an integer label) and the full feature array, which
    holds `n_descriptors` values per row of the layout. Rows without class or features
    take no part, NULL values count as 0. A stratified split by `frac` and `seed` leaves
    validation rows out; features are scaled with mean and population deviation of the
    training rows. The loss is the mean log loss plus half the squared weights over the
    number of training rows; intercepts are free.

    Returns per subset (subset, n_channels, probe_acc, probe_macro, n_val, majority,
    n_classes, n_iter, loss, gradient_norm), and (subset, label, recall, n_val) per class of the
    validation rows. `majority` is the share of their commonest class; `gradient_norm`
    the largest component of the gradient over all training rows at the weights found,
    `tol` at most unless `max_iter` steps were made. A class without training rows has
    recall 0. No training rows are an error.

    All subsets share their passes over the training rows: scaled rows are written once as
    blocks, and each pass computes loss and gradient of every probe that is not done.
    Weights and gradients of all probes, classes times features, are what driver and tasks
    hold at once.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    spark = features.sparkSession
    data = features.select("entity_id", F.col("class").alias("label"), F.transform(
        "features", lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias("raw")).where("label is not null and raw is not null")
    data = materialize(stratified_split(data, frac, seed, cls="label", key="entity_id"))
    train = data.where("split = 'train'")
    n_train = train.count()
    if not n_train:
        raise ValueError("no training rows")
    stats = train.select(Summarizer.metrics("mean", "variance").summary(array_to_vector("raw")).alias("s")).first().s
    mean = stats["mean"].toArray()
    var = stats["variance"].toArray() * (n_train - 1) / n_train
    scale = np.where(var <= (np.abs(mean) * 1e-12) ** 2, 1.0, np.sqrt(var))
    classes = np.array([r[0] for r in train.select("label").distinct().orderBy("label").collect()], np.int64)  # one row per class
    columns = sorted({r * n_descriptors + d for rows in subsets.values() for r in rows for d in range(n_descriptors)})
    places = {name: np.searchsorted(columns, [r * n_descriptors + d for r in sorted(rows) for d in range(n_descriptors)])
              for name, rows in subsets.items()}
    blocks = _blocks(data, columns, mean, scale)
    train_blocks = blocks.where("not val").select("n", "labels", "x")
    n_classes, n_features = len(classes), len(columns)

    fits = {name: _Minimizer(n_classes * (len(p) + 1), max_iter, tol) for name, p in places.items()}
    while True:
        points = {name: m.trial for name, m in fits.items() if not m.done}
        if not points:
            break
        for name, sums in _losses(train_blocks, points, places, classes, n_features).items():
            weights = points[name].reshape(n_classes, -1).copy()
            weights[:, -1] = 0.0  # intercepts are not shrunk
            flat = weights.ravel()
            fits[name].tell((sums[0] + 0.5 * float(flat @ flat)) / n_train, (sums[1:] + flat) / n_train)

    found = {name: m.x.reshape(n_classes, -1) for name, m in fits.items()}
    sent = spark.sparkContext.broadcast(found)

    def count(batches):
        for labels, x in _read(batches, n_features):
            for name, own in places.items():
                best = classes[_class_odds(x[:, own], sent.value[name])[0].argmax(axis=1)]
                values, at, n = np.unique(labels, return_inverse=True, return_counts=True)
                right = np.bincount(at, best == labels, len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values)), pa.array(values), pa.array(n, pa.int64()),
                                                  pa.array(right, pa.int64())], ["subset", "label", "n", "right"])

    val = blocks.where("val").select("n", "labels", "x").mapInArrow(count, "subset string, label long, n long, right long")
    val = val.groupBy("subset", "label").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    per_class = materialize(val.select("subset", F.col("label").cast(features.schema["class"].dataType).alias("label"),
                                       (F.col("right") / F.col("n")).alias("recall"), F.col("n").alias("n_val")))
    fit = spark.createDataFrame(
        [(name, len(subsets[name]), n_classes, m.n_iter, float(m.value), float(np.abs(m.gradient).max(initial=0.0)))
         for name, m in fits.items()],
        "subset string, n_channels int, n_classes int, n_iter int, loss double, gradient_norm double")
    board = per_class.groupBy("subset").agg(
        (F.sum(F.col("recall") * F.col("n_val")) / F.sum("n_val")).alias("probe_acc"), F.avg("recall").alias("probe_macro"),
        F.sum("n_val").alias("n_val"), (F.max("n_val") / F.sum("n_val")).alias("majority"))
    board = fit.join(board, "subset", "left").select(
        "subset", "n_channels", "probe_acc", "probe_macro", F.coalesce("n_val", F.lit(0)).alias("n_val"), "majority", "n_classes",
        "n_iter", "loss", "gradient_norm")
    return board, per_class


def probe_subset(features: DataFrame, rows: Sequence[int], n_descriptors: int, **options) -> tuple[DataFrame, DataFrame]:
    """The probe of one channel subset: `fit_probes` without the name."""
    board, per_class = fit_probes(features, {"": rows}, n_descriptors, **options)
    return board.drop("subset"), per_class.drop("subset")


def probe_leaderboard(features: DataFrame, subsets: Mapping[str, Sequence[int]], n_descriptors: int,
                      scores: DataFrame | None = None, **options) -> DataFrame:
    """Probes of all subsets, best balanced accuracy first; joined with subset scores."""
    board, _ = fit_probes(features, subsets, n_descriptors, **options)
    if scores is not None:
        board = board.join(scores, "subset", "left")
    return board.orderBy(F.desc("probe_macro"), "subset")


def score_entities(sequences: DataFrame, load: Callable[[], Callable], pred_type: str = "int") -> DataFrame:
    """Apply a caller's model to entity arrays in Arrow batches.

    `load` runs once per task and returns a function from a list of arrays to
    predictions. Input columns: entity_id, label, features.
    """
    types = {f.name: f.dataType.simpleString() for f in sequences.schema.fields}

    def run(batches):
        model = load()
        for pdf in batches:
            if len(pdf):
                out = pdf[["entity_id", "label"]].copy()
                out["pred"] = model(list(pdf["features"]))
                yield out

    return sequences.select("entity_id", "label", "features").mapInPandas(
        run, f"entity_id {types['entity_id']}, label {types['label']}, pred {pred_type}")
