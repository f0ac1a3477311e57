"""Toxicity of notes by a chain of linear classifiers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from motionframe.llm.language import LETTERS, letter_runs
from motionframe.llm.words import hash_share
from motionframe.session import materialize, ship_package

CATEGORIES = ("low_quality", "toxic")  # order of the chain
SAMPLE_ROWS = 8_000                    # labelled notes that the chain is fitted on (about; by hash of the key)
WORDS_PER_CATEGORY = 300               # most telling words kept per category
LEAST_NOTES = 4                        # notes a word must stand in
FOLDS = 5
RIDGE = 1.0
STEPS = 12


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of ridge logistic regression, the bias last; Newton steps on all rows."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(STEPS):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - y) + penalty * w
        weight = np.maximum(p * (1 - p), 1e-4)
        step = np.linalg.solve((x * weight[:, None]).T @ x + np.diag(penalty), grad)
        w = w - step
        if np.abs(step).max() < 1e-5:
            break
    return w


class ChainModel:
    """One linear model per category over words present, and over the earlier categories' probabilities."""

    def __init__(self, categories: Sequence[str], words: list[str], weights: list[np.ndarray], limits: list[float]):
        self.categories, self.limits = list(categories), limits
        self.at = {w: i for i, w in enumerate(words)}
        self.weights = weights

    def score(self, text: str | None) -> list[float]:
        """Probabilities in chain order; NULL is an empty note."""
        get = self.at.get
        present = [i for i in map(get, letter_runs(text) if text else ()) if i is not None]
        out: list[float] = []
        n = len(self.at)
        for w in self.weights:
            z = w[-1] + w[present].sum() + sum(p * v for p, v in zip(out, w[n:-1]))
            out.append(float(_sigmoid(z)))
        return out


def fit_chain(x: np.ndarray, y: np.ndarray, folds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights per category, and out-of-fold probabilities.

    Category c sees the words and, for every earlier category, the probability that models
    fitted on the other folds give a row: what it meets later is as uncertain as that.
    """
    n, k = y.shape
    outside = np.zeros((n, k))
    weights = []
    for c in range(k):
        features = np.concatenate([x, outside[:, :c].astype(x.dtype)], 1)
        for fold in np.unique(folds):
            inside = folds != fold
            w = fit_logistic(features[inside], y[inside, c])
            outside[~inside, c] = _sigmoid(features[~inside] @ w[:-1] + w[-1])
        weights.append(fit_logistic(features, y[:, c]))
    return weights, outside


def best_limit(p: np.ndarray, y: np.ndarray) -> float:
    """Probability limit with the best F1 on out-of-fold probabilities; the middle of a gap, lowest on ties."""
    if not y.any():
        return 1.1  # nothing of the kind was ever seen: never flagged
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    ends = np.append(p[order][1:] != p[order][:-1], True)
    at = np.flatnonzero(ends)[f1[ends].argmax()]
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + below) / 2)


def train_chain(runs: DataFrame, reviews: DataFrame, categories: Sequence[str] = CATEGORIES, *, key: str = "run_id",
                notes: str = "notes", sample: int = SAMPLE_ROWS, words: int = WORDS_PER_CATEGORY,
                folds: int = FOLDS) -> ChainModel:
    """Fits the chain on about `sample` reviewed notes, drawn by hash of the key.

    `reviews` has the key and one 0/1 column per category; rows with a NULL among them
    are left out. Words are chosen by the chi-squared statistic of their presence. What
    reaches the driver is bounded: sample rows of indexes into at most
    words * categories words. Without any usable review all probabilities are 0.
    """
    labelled = reviews.where(F.col(key).isNotNull())
    for c in categories:
        labelled = labelled.where(F.col(c).isNotNull())
    labels = [F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(categories)]
    ys = [f"y{i}" for i in range(len(categories))]
    labelled = labelled.select(F.col(key).alias("k"), *labels).groupBy("k").agg(*[F.max(y).alias(y) for y in ys])
    notes_of = runs.where(F.col(notes).isNotNull()).select(F.col(key).alias("k"), F.col(notes).alias("notes"))
    # keys are drawn before any text is read; about `sample` of them are sent to the scan of the notes
    known = materialize(labelled.join(notes_of.select("k"), "k", "left_semi"))
    rate = sample / max(1, known.count())
    chosen = known.where(hash_share("k") < rate)
    rows = notes_of.join(F.broadcast(chosen), "k").dropDuplicates(["k"])
    present = F.array_distinct(F.regexp_extract_all(F.lower("notes"), F.lit(LETTERS), F.lit(0)))
    rows = rows.select("k", *ys, present.alias("words"))
    rows = materialize(rows)
    sizes = rows.agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).first()
    n = sizes["n"]
    if not n:
        return ChainModel(categories, [], [np.array([0.0] * i + [-35.0]) for i in range(len(categories))], [1.1] * len(categories))
    found = rows.select(F.explode("words").alias("word"), *ys).groupBy("word").agg(
        F.count("*").cast("double").alias("df"), *[F.sum(f"y{i}").alias(f"a{i}") for i in range(len(categories))])
    found = found.where(F.col("df") >= LEAST_NOTES)
    vocabulary: set[str] = set()
    for i in range(len(categories)):
        pos = float(sizes[f"y{i}"] or 0)
        a, df = F.col(f"a{i}"), F.col("df")
        cross = a * (n - pos) - (df - a) * pos
        chi = cross * cross / (df * (n - df + 1e-9) * F.lit(max(pos * (n - pos), 1e-9)))
        vocabulary |= {r.word for r in found.orderBy(F.desc(chi), "word").limit(words).collect()}
    names = sorted(vocabulary)
    index = rows.sparkSession.createDataFrame([(w, i) for i, w in enumerate(names)], "word string, i int")
    pairs = rows.select("k", F.explode("words").alias("word")).join(F.broadcast(index), "word").groupBy("k").agg(
        F.collect_list("i").alias("at"))
    table = rows.drop("words").join(pairs, "k", "left").orderBy(F.xxhash64("k"), "k").collect()
    x = np.zeros((len(table), len(names)), np.float32)
    for r, row in enumerate(table):
        x[r, row["at"] or []] = 1
    y = np.array([[row[f"y{i}"] for i in range(len(categories))] for row in table])
    weights, outside = fit_chain(x, y, np.arange(len(table)) % folds)
    return ChainModel(categories, names, weights, [best_limit(outside[:, c], y[:, c]) for c in range(len(categories))])


def moderate_notes(runs: DataFrame, model: ChainModel, *, key: str = "run_id", notes: str = "notes") -> DataFrame:
    """Probabilities and flags of every category for the whole notes of every run.

    Returns (key, p_<category>, <category>, ...) per input row: the probability, and
    whether it reaches the limit that was best out of fold. NULL notes count as empty
    ones, repeated rows are kept, other columns ignored, an empty table gives no rows.
    The model has a bounded number of words and is sent to all tasks.
    """
    ship_package(runs.sparkSession)
    sent = runs.sparkSession.sparkContext.broadcast(model)
    names = [key, *[n for c in model.categories for n in (f"p_{c}", c)]]
    schema = runs.select(key, *[f for c in model.categories for f in (F.lit(0.0).alias(f"p_{c}"), F.lit(True).alias(c))]).schema

    def tasks(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                p = np.array([sent.value.score(t) for t in part.column(1).to_pylist()])
                columns = [c for i, limit in enumerate(sent.value.limits) for c in (pa.array(p[:, i]), pa.array(p[:, i] >= limit))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    return runs.select(key, F.col(notes).alias("_notes")).mapInArrow(tasks, schema)
