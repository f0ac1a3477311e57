"""Targets and copies of a mix against a plain loop."""

import hashlib

import pytest

from motionframe.llm.mixing import MAX_REPEATS, WEIGHTS, mix_datasets

SCHEMA = "entity_id long, dataset string, n_frames long, target double, slot int"


def brute(rows, seed=17):
    total = sum(n or 0 for _, _, n in rows)
    names = sorted({d for _, d, _ in rows}, key=lambda d: (d is None, d or ""))
    size = {d: sum(n or 0 for _, e, n in rows if e == d) for d in names}
    weight = {d: WEIGHTS[i % len(WEIGHTS)] for i, d in enumerate(names)}
    target, free, left = {}, set(names), total
    while True:
        w = sum(weight[d] for d in free)
        over = {d for d in free if left * weight[d] / w > MAX_REPEATS * size[d] + 1e-9}
        if not over:
            break
        for d in over:
            target[d] = float(MAX_REPEATS * size[d])
            left -= MAX_REPEATS * size[d]
        free -= over
    target.update({d: left * weight[d] / w for d in free})
    copies = []
    for d in names:
        own = sorted((r for r in rows if r[1] == d), key=lambda r: (hashlib.md5(
            "|".join([str(seed)] + ([str(r[0])] if r[0] is not None else [])).encode()).hexdigest(), r[0] is not None, r[0] or 0))
        upto = 0
        for k, _, n in own:
            upto += n or 0
            for c in range(MAX_REPEATS):
                if target[d] > 0:
                    copies.append(((upto + c * size[d]) / target[d], d is not None, d or "", k is not None, k or 0, n or 0, c, (k, d)))
    copies.sort(key=lambda x: x[:7])
    taken, spent = {}, 0
    for x in copies:
        spent += x[5]
        if spent > total:
            break
        taken[x[7]] = taken.get(x[7], 0) + x[5]
    return target, {(k, d): taken.get((k, d), 0) for k, d, _ in rows}


@pytest.mark.parametrize("shape", ["skewed", "awkward", "one"])
def test_mix_equals_loop(spark, shape):
    if shape == "skewed":
        rows = [(i, "abcde"[0 if i % 3 else i % 5], (i * 37) % 50 + 1) for i in range(400)]
    elif shape == "awkward":
        rows = [(1, "a", None), (2, None, 5), (3, "b", 0), (None, "a", 4), (4, "c", 100), (5, "", 7)]
    else:
        rows = [(1, "a", 3)]
    df = spark.createDataFrame([(*r, 0.5, 1) for r in rows], SCHEMA)
    got = mix_datasets(df).collect()
    target, taken = brute(rows)
    assert len(got) == len(rows)
    by = {(k, n): d for k, d, n in [(k, d, n or 0) for k, d, n in rows]}
    for r in got:
        d = by[(r.entity_id, r.n_frames)]
        assert abs(r.target - target[d]) < 1e-6 * max(1, target[d])
        assert r.taken == taken[(r.entity_id, d)] <= 3 * r.n_frames
        assert r.copies * r.n_frames == r.taken


def test_reruns_agree_and_targets_are_met(spark):
    rows = [(i, f"s{i % 7}" if i % 3 else "s0", i % 11 + 1, 0.0, 1) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = mix_datasets(df).toPandas(), mix_datasets(df.repartition(5)).toPandas()
    assert a.sort_values("entity_id").reset_index(drop=True).equals(b.sort_values("entity_id").reset_index(drop=True))
    a["dataset"] = a.entity_id.map({r[0]: r[1] for r in rows})
    for _, g in a.groupby("dataset"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 25


def test_empty_and_repeated_rows(spark):
    assert mix_datasets(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mix_datasets(spark.createDataFrame([(1, "a", 2, 0.0, 1)] * 4, SCHEMA)).collect()
    assert len(got) == 4 and sum(r.taken for r in got) == 8
