"""Graph search: recall against brute force, exact scores, copies and unusable vectors."""

import numpy as np
import pytest

from motionframe.llm import neighbours as nb

SCHEMA = "entity_id long, features array<double>, shard int, dim string"


def brute(ids, x, q, own, k):
    score = x @ q
    keep = ids != own
    order = np.lexsort((ids[keep], -score[keep]))[:k]
    return list(zip(ids[keep][order].tolist(), score[keep][order].tolist()))


def test_recall_and_order(spark):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(3000, 24)) * rng.lognormal(sigma=0.5, size=(3000, 1))
    ids = rng.permutation(9000)[:3000] - 4000
    df = spark.createDataFrame([(int(i), v.tolist(), 1, "d") for i, v in zip(ids, x)], SCHEMA)
    got = nb.nearest_entities(df, df.where("entity_id % 20 = 0"), 20, shards=4).toPandas()
    hits = []
    for q, rows in got.groupby("query_id"):
        rows = rows.sort_values("rank")
        want = brute(ids, x, x[ids == q][0], q, 20)
        assert rows["rank"].tolist() == list(range(1, 21)) and q not in rows.entity_id.values
        assert np.allclose(rows.score, [x[ids == i][0] @ x[ids == q][0] for i in rows.entity_id], rtol=1e-12)
        assert (np.diff(rows.score) <= 0).all()
        hits.append(len({i for i, _ in want} & set(rows.entity_id)) / 20)
    assert len(hits) == (ids % 20 == 0).sum() and np.mean(hits) >= 0.95


def test_copies_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [1.0, 0.0, 0.5]) for i in range(40)] + [(100, [0.0, 1.0, 0.0]), (101, [1.0, -0.0, 0.5])]
    bad = [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, nan, 0.0]), (203, [inf, 0.0, 0.0]), (204, [1.0, None, 0.0]), (None, [1.0, 1.0, 1.0])]
    other = [(300, [2.0, 1.0]), (301, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "d") for i, v in good + bad + other], SCHEMA)
    got = nb.nearest_entities(df, df, 5, shards=3).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.entity_id, r.score))
    assert set(by) == {i for i, _ in good + other}
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    for i, v in good:
        assert by[i] == brute(ids, x, np.array(v), i, 5)
    assert by[300] == [(301, 3.0)] and by[301] == [(300, 3.0)]  # fewer candidates than k


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert nb.nearest_entities(df, df, 3).count() == 0


def test_pruning_keeps_diverse_edges():
    x = np.array([[0, 0], [1, 0], [1.05, 0], [0, 2]], np.float32)
    edges = nb.robust_prune(x, np.array([0]), np.array([[1, 2, 3, -1]], np.int32), 3, 1.2)
    assert edges.tolist() == [[1, 3, -1]]  # 2 is far closer to 1 than to 0


@pytest.mark.parametrize("n", [1, 2, 40, 500])
def test_graph_is_well_formed(n):
    x = np.random.RandomState(n).normal(size=(n, 8)).astype(np.float32)
    edges, starts = nb.build_graph(x)
    assert edges.shape == (n, nb.DEGREE) and edges.max() < n and len(starts)
    assert not (edges == np.arange(n)[:, None]).any()
