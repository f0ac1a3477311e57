"""Gap filling, smoothing and speed against a plain numpy version, whole and in segments."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionframe.functions.smoothing import hat_matrix
from motionframe.operators import series as se
from motionframe.operators.descriptors import channel_descriptors
from motionframe.operators.presence import frame_flags, longest_gap
from motionframe.operators.quality import jitter

AXES = ("x", "y", "z")


def make_tracks():
    """{(entity, row): {frame: (x, y, z)}} with every short length, gaps and odd cases."""
    rng = np.random.default_rng(3)
    data = {}
    for t in list(range(1, 10)) + [13, 25, 61, 100]:
        for row in range(3):
            frames = range(5, 5 + t)
            data[t, row] = {f: tuple(float(v) for v in rng.normal(size=3)) for f in frames if row == 0 or rng.random() > 0.45}
        data[t, 0][5] = data[t, 0].get(5, (0.0, 0.0, 0.0))
    data[25, 3] = {f: (None, None, None) for f in (6, 9)}          # never observed
    data[61, 3] = {30: (1.0, 2.0, 3.0)}                             # observed once
    data[61, 4] = {5: (1.0, 1.0, 1.0), 60: (3.0, None, 2.0), 65: (4.0, 2.0, 2.0)}  # one long gap
    data[100, 4] = {6: (1.0, None, 1.0), 7: (None, 5.0, 2.0), 90: (2.0, 6.0, None)}  # axes differ
    return {k: v for k, v in data.items() if v}


def expected(data):
    out = {}
    extent = {}
    for (e, _), rows in data.items():
        f0, f1 = extent.get(e, (10**9, -1))
        extent[e] = (min(f0, *rows), max(f1, *rows))
    for (e, row), rows in data.items():
        f0, f1 = extent[e]
        n = f1 - f0 + 1
        raw = np.full((n, 3), np.nan)
        for f, v in rows.items():
            raw[f - f0] = [np.nan if a is None else a for a in v]
        filled = raw.copy()
        for a in range(3):
            known = np.flatnonzero(~np.isnan(raw[:, a]))
            if len(known):
                filled[:, a] = np.interp(np.arange(n), known, raw[known, a])
        smooth = filled.copy()
        if n >= 3:
            w = min(7, n if n % 2 else n - 1)
            hat, half = hat_matrix(w, min(2, w - 1)), w // 2
            for i in range(n):
                start = min(max(i - half, 0), n - w)
                smooth[i] = hat[i - start] @ filled[start:start + w]
        seen = ~np.isnan(raw[:, 0])
        valid = seen[1:] & seen[:-1]
        step2 = (np.diff(smooth, axis=0) ** 2).sum(axis=1)
        rms = math.sqrt(step2[valid].mean()) if valid.any() else None
        out[e, row] = dict(f0=f0, raw=raw, filled=filled, smooth=smooth, rms=rms, valid=int(valid.sum()), seen=seen)
    return out


@pytest.fixture(scope="module")
def data():
    return make_tracks()


@pytest.fixture(scope="module")
def want(data):
    return expected(data)


@pytest.fixture(scope="module")
def tracks(spark, data):
    rows = [(e, f"c{e % 2}", f"g{r % 2}", r, r, f, *v) for (e, r), fs in data.items() for f, v in fs.items()]
    return spark.createDataFrame(
        rows, "entity_id long, class string, grp string, idx int, row int, frame int, x double, y double, z double").cache()


def close(a, b):
    if a is None or (isinstance(b, float) and math.isnan(b)):
        return (a is None) and (b is None or math.isnan(b))
    return abs(a - b) < 1e-9


@pytest.mark.parametrize("size", [12, 16, 4096])
def test_smoothing_and_filling(tracks, want, size):
    for fn, key in ((se.interpolate_gaps, "filled"), (se.savgol_smooth, "smooth")):
        got = fn(tracks, segment_frames=size).collect()
        assert len(got) == sum(len(w["raw"]) for w in want.values())
        for r in got:
            w = want[r.entity_id, r.row]
            i = r.frame - w["f0"]
            assert r.seen == bool(w["seen"][i])
            for k, a in enumerate(AXES):
                assert close(r[a], float(w[key][i][k])), (key, size, r)


@pytest.mark.parametrize("size", [12, 4096])
def test_speed_and_descriptors(tracks, want, size):
    for r in se.rms_speed(tracks, segment_frames=size).collect():
        w = want[r.entity_id, r.row]
        assert r.n_valid_transitions == w["valid"]
        assert (r.rms_speed is None) == (w["rms"] is None)
        assert w["rms"] is None or abs(r.rms_speed - w["rms"]) < 1e-9
    for r in channel_descriptors(tracks, segment_frames=size).collect():
        raw = want[r.entity_id, r.row]["raw"]
        x = raw[:, 0][~np.isnan(raw[:, 0])]
        assert abs(r.detection_rate - len(x) / len(raw)) < 1e-12
        assert r.x_mean is None if not len(x) else abs(r.x_mean - x.mean()) < 1e-9
        assert r.x_std is None if not len(x) else abs(r.x_std - x.std()) < 1e-9


def test_segments_do_not_change_other_series(tracks):
    def rows(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())

    def key(rows_):
        return [tuple(str(v) for v in r) for r in rows_]

    for fn in (se.frame_grid, se.causal_velocity, se.causal_running_std, se.rms_speed_plain):
        a = sorted(key([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in fn(tracks, segment_frames=12).collect()]))
        b = sorted(key([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in fn(tracks).collect()]))
        assert a == b, fn.__name__
    flags = frame_flags(tracks, {"face": "g0", "pose": "g1", "left_hand": "g0", "right_hand": "none"})
    assert rows(longest_gap(flags, segment_frames=7)) == rows(longest_gap(flags))
    assert rows(jitter(tracks, ["g0", "g1"], segment_frames=7)) == rows(jitter(tracks, ["g0", "g1"]))


def test_one_exchange_after_the_union(tracks):
    plan = se.rms_speed(tracks)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Union")]
    assert above.count("Exchange") == 2  # segments, then the final small aggregate
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_running_std_matches_numpy(tracks, want):
    for r in se.causal_running_std(tracks, segment_frames=12).collect():
        w = want[r.entity_id, r.row]
        past = w["raw"][: r.frame - w["f0"] + 1, 0]
        past = past[~np.isnan(past)]
        assert (r.running_std is None) == (len(past) == 0)
        assert not len(past) or abs(r.running_std - past.std()) < 1e-7


def test_pivot_roundtrip(tracks):
    wide = se.pivot_frames(tracks, range(5), ("x", "y"))
    back = se.unpivot_frames(wide, range(5), ("x", "y")).where("x IS NOT NULL OR y IS NOT NULL")
    assert back.count() == tracks.where(F.col("x").isNotNull() | F.col("y").isNotNull()).count()


def _values(df):
    return sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.collect())


def _whole_functions():
    from motionframe.operators.energy import axis_energy_share
    from motionframe.operators.geometry import acceleration

    return (se.rms_speed, channel_descriptors, se.interpolate_gaps, se.savgol_smooth, se.frame_grid, se.rms_speed_plain,
            axis_energy_share, acceleration)


def test_whole_entities_straight_from_their_tasks(spark, tracks):
    """No exchange of rows; frames in any order, below zero too."""
    moved = tracks.withColumn("frame", F.col("frame") - 20)
    own = moved.repartition(3, "entity_id").sortWithinPartitions("entity_id", F.xxhash64("row", "frame"))
    for fn in _whole_functions():
        assert _values(fn(own, whole_entities=True)) == _values(fn(moved)), fn.__name__
    stored = spark.createDataFrame(moved.limit(0).collect(), moved.schema)
    plan = se.savgol_smooth(stored, whole_entities=True)._jdf.queryExecution().executedPlan().toString()
    rows = plan[plan.index("MapInArrow"):plan.index("BroadcastExchange")]
    assert "Exchange" not in rows and "Sort" not in rows


def test_entities_in_several_tasks_are_an_error(spark, tracks):
    """By frames, and by channels, where no (entity, channel) comes twice."""
    one = "cast(1 as long) as entity_id", "'c' as class", "'g0' as grp"
    places = "1.0D as x", "1.0D as y", "1.0D as z"
    by_frame = spark.range(0, 6, 1, 2).selectExpr(*one, "0 as idx", "0 as row", "cast(id + if(id < 3, 0, 5) as int) as frame", *places)
    by_channel = spark.range(0, 6, 1, 2).selectExpr(
        *one, "cast(id div 3 as int) as idx", "cast(id div 3 as int) as row", "cast(id % 3 + 5 * (id div 5) as int) as frame", *places)
    for fn in _whole_functions():
        for split in (by_frame, by_channel):
            assert split.rdd.getNumPartitions() == 2
            with pytest.raises(Exception, match="not whole"):
                fn(split, whole_entities=True).collect()


def test_entities_that_come_twice_in_a_task_are_an_error(spark, tracks):
    from motionframe.functions import track_kernel

    n = track_kernel.BLOCK_ROWS + 1
    rows = spark.range(3 * n).selectExpr(
        f"case when id < {n} then 1 when id < {2 * n} then 2 else 1 end as entity_id", "'c' as class", "'g' as grp", "0 as idx", "0 as row",
        "cast(id as int) as frame", "1.0D as x", "1.0D as y", "1.0D as z").coalesce(1)
    for fn in _whole_functions():
        with pytest.raises(Exception, match="not whole"):
            fn(rows, whole_entities=True).count()


def test_a_file_that_spark_splits_is_an_error(spark, tmp_path):
    rows = spark.range(60_000).selectExpr(
        "cast(1 as long) as entity_id", "'c' as class", "'g' as grp", "cast(id % 3 as int) as idx", "cast(id % 3 as int) as row",
        "cast(id div 3 as int) as frame", "rand(1) as x", "rand(2) as y", "rand(3) as z").coalesce(1)
    rows.write.option("parquet.block.size", 200_000).parquet(str(tmp_path / "t"))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        spark.conf.set(names[2], "1")  # one task reads the file
        assert se.frame_grid(spark.read.parquet(str(tmp_path / "t")), whole_entities=True).count() == 60_000
        for k in names[:2]:
            spark.conf.set(k, "100000")
        split = spark.read.parquet(str(tmp_path / "t"))
        assert split.rdd.getNumPartitions() > 1
        for fn in (se.frame_grid, se.savgol_smooth, channel_descriptors):
            with pytest.raises(Exception, match="not whole"):
                fn(split, whole_entities=True).count()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_repeated_frames_take_the_larger_value(spark):
    rows = [(1, 0, f, float(v)) for f, v in ((0, 1), (1, 5), (1, 2), (2, 3))] + [(1, 0, 1, None)]
    df = spark.createDataFrame(rows, "entity_id long, row int, frame int, x double")
    for kw in ({}, {"whole_entities": True}):
        got = se.frame_grid(df.coalesce(1), ("x",), **kw).orderBy("frame").collect()
        assert [r.x for r in got] == [1.0, 5.0, 3.0]


def test_a_block_without_any_transition(spark):
    rows = [(1, 0, f, 1.0, 2.0, 3.0) for f in (0, 2, 4)]
    df = spark.createDataFrame(rows, "entity_id long, row int, frame int, x double, y double, z double").coalesce(1)
    for kw in ({}, {"whole_entities": True}):
        got = se.rms_speed(df, **kw).first()
        assert got.rms_speed is None and got.n_valid_transitions == 0
