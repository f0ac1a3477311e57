"""Ranks, quantiles and selections on skewed groups against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motionframe.operators import datasets as ds
from motionframe.operators.scoring import f_ratio, mutual_info_knn
from motionframe.plans import ranking as rk


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    n = 4000
    pdf = pd.DataFrame({
        "k": np.arange(n), "g": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcdefg"), n)),
        # a third of the values are equal, the rest has a heavy tail
        "v": np.where(rng.random(n) < 0.34, 1.0, np.round(rng.lognormal(sigma=3, size=n), 3))})
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("rows", [150, 10**6])
def test_exact_quantiles(frame, rows):
    pdf, df = frame
    probs = {"q05": 0.05, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    got = {r.g: r for r in rk.exact_quantiles(df, ["g"], "v", probs, rows_per_part=rows).collect()}
    for g, part in pdf.groupby("g"):
        for name, p in probs.items():
            assert abs(got[g][name] - part.v.quantile(p)) < 1e-9
    one = rk.exact_quantiles(df, [], "v", probs, rows_per_part=rows).first()
    assert abs(one.q50 - pdf.v.median()) < 1e-9


@pytest.mark.parametrize("rows", [150, 10**6])
def test_group_ranks(frame, rows):
    pdf, df = frame
    got = rk.group_ranks(df, ["g"], "v", ["k"], rows_per_part=rows).toPandas().set_index("k").sort_index()
    want = pdf.sort_values(["v", "k"]).groupby("g").cumcount() + 1
    assert (got.rn == want.sort_index()).all()
    assert (got.n == pdf.groupby("g").k.transform("size")).all()


@pytest.mark.parametrize("rows", [10**6, 600, 100])
def test_ordered_prefix(frame, rows):
    pdf, df = frame
    got = rk.ordered_prefix(df.withColumn("w", F.col("k") % 5), ["g", "v", "k"], "w", rows_per_part=rows).toPandas()
    want = pdf.sort_values(["g", "v", "k"])
    before = (want.k % 5).cumsum() - want.k % 5
    assert (got.set_index("k").before.sort_index() == before.set_axis(want.k).sort_index()).all()


@pytest.mark.parametrize("rows", [150, 10**6])
def test_spearman(frame, rows):
    pdf, df = frame
    r = rk.spearman(df, "v", "k", rows_per_part=rows).first()
    want = pdf.v.rank().corr(pdf.k.rank())
    assert abs(r.rho - want) < 1e-9 and r.n == len(pdf)


def test_split_is_exact_and_independent_of_partitions(frame):
    pdf, df = frame
    def split(d):
        return {r.k: r.split for r in ds.stratified_split(d, 0.1, 42, cls="g", key="k").collect()}
    a = split(df.repartition(1))
    b = split(df.repartition(13, "v"))
    assert a == b and len(a) == len(pdf)
    val = pdf[[a[k] == "val" for k in pdf.k]]
    assert len(val) == int(np.ceil(0.1 * len(pdf)))
    share = val.groupby("g").size() - pdf.groupby("g").size() * 0.1
    assert share.abs().max() < 1.0


def test_three_way_split_and_full_quota(frame):
    pdf, df = frame
    parts = ds.split_three_way(df, 1, cls="g", key="k").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": 3200, "test": 400, "val": 400}
    assert ds.stratified_split(df, 1.0, 1, cls="g", key="k").where("split = 'val'").count() == len(pdf)


def test_too_few_units_fail(frame):
    _, df = frame
    with pytest.raises(ValueError):
        ds.disjoint_slices(df, "k", 3000, 2)
    with pytest.raises(ValueError):
        ds.sample_two_stage(df, 5, 1500, 1, cls="g", key="k")


def test_f_ratio_edges(spark):
    rows = []
    for e in range(12):
        c = e % 3
        rows += [(e, c, 0, 0, float(e)), (e, c, 1, 0, 5.0), (e, c, 2, 0, float(c)),
                 (e, c, 3, 0, None if e % 2 else 2.0)]
        if c:
            rows.append((e, c, 4, 0, float(e + 1)))  # class 0 has no rows: counts as zeros
    df = spark.createDataFrame(rows, "entity_id int, class int, row int, descriptor int, value double")
    got = {r.row: r.f for r in f_ratio(df).collect()}
    assert got[1] == 0.0 and got[2] == 0.0  # constant, and infinite F

    def anova(values):
        groups = [np.array(v, float) for v in values]
        allv = np.concatenate(groups)
        ssb = sum(len(g) * (g.mean() - allv.mean()) ** 2 for g in groups)
        ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
        return (ssb / 2) / (ssw / 9)

    assert abs(got[0] - anova([[e for e in range(12) if e % 3 == c] for c in range(3)])) < 1e-9
    assert abs(got[3] - anova([[0.0 if e % 2 else 2.0 for e in range(12) if e % 3 == c] for c in range(3)])) < 1e-9
    assert abs(got[4] - anova([[0] * 4] + [[e + 1 for e in range(12) if e % 3 == c] for c in (1, 2)])) < 1e-9


@pytest.mark.parametrize("rows", [60, 10**6])
def test_mutual_info_knn_with_ties(spark, rows):
    rng = np.random.default_rng(2)
    n = 150
    cls = rng.integers(0, 3, n)
    v = np.where(rng.random(n) < 0.3, 0.5, np.round(rng.normal(size=n) + cls, 2).astype(np.float32).astype(float))
    df = spark.createDataFrame([(int(i), int(c), 0, 0, float(x)) for i, (c, x) in enumerate(zip(cls, v))],
                               "entity_id int, class int, row int, descriptor int, value double")
    got = mutual_info_knn(df, 3, rows_per_part=rows).first().mi

    def psi(k):
        return -0.5772156649015329 + sum(1 / j for j in range(1, int(k)))

    m, ks, sizes = [], [], []
    for i in range(n):
        same = np.flatnonzero((cls == cls[i]) & (np.arange(n) != i))
        k = min(3, len(same))
        r = np.sort(np.abs(v[same] - v[i]))[k - 1]
        d = np.abs(v - v[i])
        m.append((d < r).sum() if r > 0 else (d == 0).sum())
        ks.append(k)
        sizes.append(len(same) + 1)
    want = psi(n) + np.mean([psi(k) for k in ks]) - np.mean([psi(s) for s in sizes]) - np.mean([psi(x) for x in m])
    assert abs(got - max(want, 0)) < 1e-6


def test_hot_ties_are_split(spark):
    """Nine of ten values are equal: no partition is above twice the mean, ranks stay exact."""
    n = 20_000
    df = spark.range(n).selectExpr("id", "'g' AS g", "CASE WHEN id % 10 = 0 THEN id / 7.0D ELSE 1.0D END AS v")
    rows = rk.in_order(df, ["g", "v", "id"], rows_per_part=1000)
    sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert len(sizes) > 15 and max(sizes) <= 2 * n / len(sizes)
    got = rk.group_ranks(df, ["g"], "v", ["id"], rows_per_part=1000).toPandas().sort_values(["v", "id"])
    assert (got.rn.values == np.arange(1, n + 1)).all() and (got.n == n).all()


def test_null_keys_and_groups(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), (None, 3), ("b", 4)], "k string, v int")
    got = {r.v: r.before for r in rk.ordered_prefix(df, ["k", "v"], rows_per_part=1).collect()}
    assert got == {1: 0, 3: 1, 2: 2, 4: 3}
    q = {r.k: r.m for r in rk.exact_quantiles(df, ["k"], "v", {"m": 0.5}, rows_per_part=1).collect()}
    assert q == {None: 2.0, "a": 2.0, "b": 4.0}
    assert rk.exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_probe_equals_a_plain_solver(spark):
    """Accuracy of the probe against gradient descent on population-scaled features."""
    from motionframe.operators import learning as ln

    rng = np.random.default_rng(9)
    n, k, d = 600, 3, 4
    cls = rng.integers(0, k, n)
    x = rng.normal(size=(n, d)) * [1, 5, 0.1, 2] + np.eye(k, d)[cls] * [1.5, 8, 0.1, 2]
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(cls, x))],
                               "entity_id int, class int, features array<double>")
    summary, per_class = ln.probe_subset(df, [0, 1], 2, tol=1e-7)
    split = {r.entity_id: r.split for r in ds.stratified_split(df, 0.1, 42, cls="class", key="entity_id").collect()}
    train = np.array([split[i] == "train" for i in range(n)])
    z = (x - x[train].mean(0)) / x[train].std(0)
    w, b, y = np.zeros((d, k)), np.zeros(k), np.eye(k)[cls]
    for _ in range(3000):
        p = np.exp(z[train] @ w + b)
        g = (p / p.sum(1, keepdims=True) - y[train]) / train.sum()
        w -= 0.5 * (z[train].T @ g + w / train.sum())
        b -= 0.5 * g.sum(0)
    right = (z[~train] @ w + b).argmax(1) == cls[~train]
    assert abs(summary.first().probe_acc - right.mean()) < 1e-9
    assert {r.label: r.recall for r in per_class.collect()} == {c: right[cls[~train] == c].mean() for c in range(k)}
    got = summary.first()
    p = np.exp(z[train] @ w + b)
    p /= p.sum(1, keepdims=True)
    loss = -np.log(p[np.arange(train.sum()), cls[train]]).mean() + 0.5 * (w ** 2).sum() / train.sum()
    assert abs(got.loss - loss) < 1e-6 and got.gradient_norm <= 1e-7 and got.n_channels == 2
    assert abs(got.majority - np.bincount(cls[~train]).max() / (~train).sum()) < 1e-12


def test_probes_fitted_together_equal_those_fitted_alone(spark):
    from motionframe.operators import learning as ln

    rng = np.random.default_rng(4)
    cls = rng.integers(0, 4, 300) * 10 - 10
    x = rng.normal(size=(300, 12)) + cls[:, None] * rng.normal(size=12) / 20
    x[:, 5] = 3.0  # constant
    rows = [(i, int(c), [None if i == 7 and j == 2 else float(t) for j, t in enumerate(v)], "x") for i, (c, v) in enumerate(zip(cls, x))]
    rows += [(900, None, [0.0] * 12, "x"), (901, 20, None, "x")]
    df = spark.createDataFrame(rows, "entity_id int, class int, features array<double>, label string").repartition(5)
    subsets = {"few": [1], "some": [0, 2, 3], "all": range(6)}
    board, per_class = ln.fit_probes(df, subsets, 2, tol=1e-6)
    together = {r.subset: r for r in board.collect()}
    for name, own in subsets.items():
        alone, recalls = ln.probe_subset(df, own, 2, tol=1e-6)
        a, b = alone.first(), together[name]
        assert a.probe_acc == b.probe_acc and a.n_channels == b.n_channels == len(own) and abs(a.loss - b.loss) < 1e-9
        assert sorted(map(tuple, recalls.collect())) == sorted(tuple(r)[1:] for r in per_class.collect() if r.subset == name)
    assert together["all"].loss < together["some"].loss < np.log(4) and all(r.gradient_norm <= 1e-6 for r in together.values())
    ranked = ln.probe_leaderboard(df, subsets, 2, spark.createDataFrame([("few", 1.0)], "subset string, s double")).collect()
    assert [r.probe_macro for r in ranked] == sorted((r.probe_macro for r in ranked), reverse=True)
    with pytest.raises(ValueError, match="no training rows"):
        ln.fit_probes(df.limit(0), subsets, 2)
    stopped = ln.probe_subset(df, range(6), 2, tol=1e-12, max_iter=3)[0].first()
    assert stopped.n_iter == 3 and stopped.gradient_norm > 1e-12


def test_labels_of_rows_without_a_class(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "class string")
    assert sorted(map(str, (tuple(r) for r in ds.encode_sorted(df).collect()))) == sorted(
        map(str, [("a", 0), ("b", 1), ("b", 1), (None, None)]))


@pytest.mark.parametrize("prefix, per_bucket", [(1, 5), (1, 1), (2, 40), (3, 100_000)])
def test_selection_refines_its_thresholds(spark, prefix, per_bucket):
    """The same rows for any depth; only the last, small bucket of each group is ranked."""
    from motionframe.plans import selection

    df = spark.range(3_000).selectExpr("id AS key", "CASE WHEN id % 5 < 3 THEN 'big' WHEN id % 5 = 3 THEN 'mid' END AS class", "1 AS hb", "2 AS k")
    quota = spark.createDataFrame([("big", 700), ("mid", 600), (None, 0)], "class string, take long")
    got = selection.mark_first(df, ["class"], quota, 3, "key", prefix=prefix, rows_per_bucket=per_bucket)
    order = {}
    for r in df.withColumn("h", selection.hash_order(3, "key")).collect():
        order.setdefault(r["class"], []).append((r.h, r.key))
    want = {k for c, n in (("big", 700), ("mid", 600)) for _, k in sorted(order[c])[:n]}
    assert got.columns == [*df.columns, "selected"] and got.count() == 3_000
    assert {r.key for r in got.where("selected").collect()} == want
    whole = selection.sample_n(df, 1_234, 9, "key")
    assert {r.key for r in whole.collect()} == {r.key for r in selection.sample_n(df.repartition(7), 1_234, 9, "key").collect()}


def test_selection_with_null_groups_and_empty_quota(spark):
    df = spark.range(200).selectExpr("id AS key", "CASE WHEN id % 6 = 0 THEN NULL ELSE concat('c', id % 3) END AS class")
    got = ds.stratified_split(df, 0.1, 3)
    assert got.where("split = 'val'").count() == 20 and got.count() == 200
    from motionframe.plans.selection import sample_n
    assert sample_n(df, 17, 1, "key").count() == 17 and sample_n(df, 500, 1, "key").count() == 200


def test_single_frame_sequences(spark):
    seq = spark.range(5).selectExpr("1 AS entity_id", "CAST(id AS INT) AS pos", "5 AS n_frames", "id * 1.0 AS x")
    for fn in (ds.subsample_uniform, ds.resample_uniform):
        rows = fn(seq, 1).collect()
        assert [(r.pos, r.n_frames, float(r.x)) for r in rows] == [(0, 1, 0.0)]


def test_f_ratio_is_linear_in_classes(spark):
    import time

    def took(k):
        df = spark.range(4 * k).selectExpr("id AS entity_id", f"id % {k} AS class", "0 AS row", "0 AS descriptor", "rand(1) AS value")
        start = time.perf_counter()
        f_ratio(df).collect()
        return time.perf_counter() - start

    took(100)
    assert took(8000) < 5 + 3 * took(2000)


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from types import SimpleNamespace

    from motionframe import session

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d),
                           sparkContext=SimpleNamespace(master="spark://h:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(fake)
