"""Classifier chain: held-out accuracy, the chain's out-of-fold inputs, awkward input."""

import numpy as np
import pytest

from motionframe.llm import moderation as md

REVIEWS = "run_id long, low_quality int, toxic int, k string"


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.RandomState(8)
    plain, poor, rude = [f"word{i}" for i in range(300)], ["junk", "spam", "blah"], ["vile", "scum", "dolt", "oaf"]
    letters = str.maketrans("0123456789", "abcdefghij")
    rows = []
    for i in range(900):
        low = rng.rand() < 0.3
        bad = rng.rand() < (0.35 if low else 0.1)
        words = list(rng.choice(plain, rng.randint(10, 60)))
        words += list(rng.choice(poor, 2)) * low + list(rng.choice(rude, 2)) * bad
        rng.shuffle(words)
        rows.append((i, " ".join(words).translate(letters), int(low), int(bad)))
    return rows


def frames(spark, rows):
    runs = spark.createDataFrame([(r[0], r[1], "x", 0.5, True) for r in rows], "run_id long, notes string, k string, p_toxic double, toxic boolean")
    return runs, spark.createDataFrame([(r[0], r[2], r[3], "y") for r in rows], REVIEWS)


def test_held_out_accuracy(spark, corpus):
    runs, reviews = frames(spark, corpus)
    model = md.train_chain(runs, reviews.where("run_id < 600"))
    got = {r.run_id: r for r in md.moderate_notes(runs, model).collect()}
    late = [r for r in corpus if r[0] >= 600]
    assert len(got) == 900
    assert np.mean([got[r[0]].toxic == bool(r[3]) for r in late]) > 0.97
    assert np.mean([got[r[0]].low_quality == bool(r[2]) for r in late]) > 0.97
    assert all(0 <= got[r[0]].p_toxic <= 1 for r in late)


def test_later_models_see_out_of_fold_probabilities():
    rng = np.random.RandomState(1)
    x = (rng.rand(300, 12) < 0.3).astype(np.float32)
    y = np.stack([x[:, 0] > 0, (x[:, 0] > 0) ^ (rng.rand(300) < 0.05)], 1).astype(float)
    weights, outside = md.fit_chain(x, y, np.arange(300) % 5)
    assert [len(w) for w in weights] == [13, 14]
    for fold in range(5):
        inside = np.arange(300) % 5 != fold
        w = md.fit_logistic(x[inside], y[inside, 0])
        assert np.allclose(outside[~inside, 0], md._sigmoid(x[~inside] @ w[:-1] + w[-1]))


def test_newton_reaches_the_minimum():
    rng = np.random.RandomState(3)
    x, y = rng.normal(size=(200, 4)), (rng.rand(200) < 0.4).astype(float)
    w = md.fit_logistic(x, y)
    p = md._sigmoid(x @ w[:-1] + w[-1])
    assert np.abs(x.T @ (p - y) + md.RIDGE * w[:-1]).max() < 1e-4


def test_best_limit():
    assert md.best_limit(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0.0])) == pytest.approx(0.5)
    assert md.best_limit(np.array([0.9, 0.1]), np.zeros(2)) > 1


def test_awkward_notes_and_reviews(spark, corpus, awkward, make):
    runs, reviews = frames(spark, corpus)
    odd = reviews.union(spark.createDataFrame([(1, None, 1, ""), (None, 1, 1, ""), (10**6, 1, 1, ""), (2, 0, 0, "")], REVIEWS))
    model = md.train_chain(runs, odd)
    got = md.moderate_notes(awkward, model).collect()
    assert len(got) == awkward.count() and not any(r.toxic for r in got)
    assert md.moderate_notes(make([]), model).count() == 0
    none = md.train_chain(runs, reviews.limit(0))
    assert not any(r.toxic or r.p_toxic > 1e-9 for r in md.moderate_notes(awkward, none).collect())


def test_whole_table_against_a_plain_version(spark):
    """op9 over all documents of the smallest tables: word choice, folds, chain and limits written out anew."""
    from motionframe.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: (1 - r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in docs}
    words = {d: set(md.letter_runs(t)) if t else set() for d, t in docs.items()}
    from pyspark.sql import functions as F

    order = [r[0] for r in spark.createDataFrame([(d,) for d in labels], "k long").orderBy(F.xxhash64("k"), "k").collect()]
    y = np.array([labels[d] for d in order], float)
    n = len(order)
    df = {}
    for d in order:
        for w in words[d]:
            df.setdefault(w, []).append(d)
    chosen = set()
    for c in range(2):
        pos = y[:, c].sum()

        def chi(w):
            a, m = sum(labels[d][c] for d in df[w]), len(df[w])
            return (a * (n - pos) - (m - a) * pos) ** 2 / (m * (n - m + 1e-9) * max(pos * (n - pos), 1e-9))

        chosen |= set(sorted((w for w in df if len(df[w]) >= md.LEAST_NOTES), key=lambda w: (-chi(w), w))[:md.WORDS_PER_CATEGORY])
    names = sorted(chosen)
    matrix = lambda ids: np.array([[w in words[d] for w in names] for d in ids], float)

    def solve(x, t):
        """Minimum of the ridge log loss by damped Newton steps."""
        x = np.c_[x, np.ones(len(x))]
        w, pen = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, md.RIDGE), 1e-6]
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
            step = np.linalg.lstsq((x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x + np.diag(pen), x.T @ (p - t) + pen * w, rcond=None)[0]
            w -= step
            if abs(step).max() < 1e-9:
                break
        return w

    give = lambda x, w: 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    x, folds = matrix(order), np.arange(n) % md.FOLDS
    first_out = np.zeros(n)
    for f in range(md.FOLDS):
        first_out[folds == f] = give(x[folds == f], solve(x[folds != f], y[folds != f, 0]))
    first, second = solve(x, y[:, 0]), solve(np.c_[x, first_out], y[:, 1])
    got = {r.doc_id: r for r in queries.QUERIES["op9_moderate_notes"](spark, sf).collect()}
    assert sorted(got) == sorted(docs)
    ids = sorted(docs)
    p0 = give(matrix(ids), first)
    p1 = give(np.c_[matrix(ids), p0], second)
    assert np.abs(p0 - [got[d].p_low_quality for d in ids]).max() < 5e-3
    assert np.abs(p1 - [got[d].p_toxic for d in ids]).max() < 5e-3
    second_out = np.zeros(n)
    chain = np.c_[x, first_out]
    for f in range(md.FOLDS):
        second_out[folds == f] = give(chain[folds == f], solve(chain[folds != f], y[folds != f, 1]))
    for p, out, c, name in ((p0, first_out, 0, "low_quality"), (p1, second_out, 1, "toxic")):
        def f1(limit):
            return 2 * y[out >= limit, c].sum() / ((out >= limit).sum() + y[:, c].sum())

        at = max(sorted(set(out), reverse=True), key=f1)
        limit = (at + max((v for v in out if v < at), default=0.0)) / 2
        clear = [i for i, v in enumerate(p) if abs(v - limit) > 1e-2]
        assert len(clear) >= 0.8 * len(ids) and all(got[ids[i]][name] == (p[i] >= limit) for i in clear)
