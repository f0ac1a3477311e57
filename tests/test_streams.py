"""Streams: summaries that merge, and what their state and reads depend on."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motionframe.functions import track_summary as ts
from motionframe.operators.descriptors import DESCRIPTORS, channel_descriptors
from motionframe.streaming import incremental as inc
from tests.test_series import expected

TRACK = "entity_id long, class string, grp string, idx int, row int, frame int, x double, y double"


def random_channels(rng, n_frames):
    """{row: {frame: (x, y)}} with gaps, axes that differ, channels that come late or hardly at all."""
    out = {}
    for row in range(6):
        start = int(rng.integers(0, n_frames)) if row == 4 else 0
        keep = (1.0, 0.9, 0.5, 0.1, 0.8, 0.7)[row]
        frames = [f for f in range(start, n_frames) if rng.random() < keep]
        if row == 5:
            frames = [f for f in frames if not n_frames // 4 < f < n_frames // 2]
        out[row] = {f: tuple(None if rng.random() < (0.0, 0.1, 0.3, 0.3, 0.0, 0.2)[row] else float(v) for v in rng.normal(size=2))
                    for f in frames}
    return {r: v for r, v in out.items() if v}


def frame_of(channels):
    return pd.DataFrame([(r, f, np.nan if x is None else x, np.nan if y is None else y) for r, fs in channels.items() for f, (x, y) in fs.items()],
                        columns=["row", "frame", "x", "y"])


def check(got, channels):
    data = {(1, r): {f: (x, y, 0.0) for f, (x, y) in fs.items()} for r, fs in channels.items()}
    want = expected(data)
    assert sorted(got["row"]) == sorted(channels)
    for r in got.itertuples():
        w = want[1, r.row]
        step2 = (np.diff(w["smooth"][:, :2], axis=0) ** 2).sum(axis=1)
        valid = w["seen"][1:] & w["seen"][:-1]
        assert r.n_valid_transitions == valid.sum()
        rms = np.sqrt(step2[valid].mean()) if valid.any() else np.nan
        assert r.rms_speed_xy == pytest.approx(rms, abs=1e-9, nan_ok=True)
        assert r.detection_rate == pytest.approx(w["seen"].mean())
        for a, v in zip("xy", w["raw"].T):
            v = v[~np.isnan(v)]
            assert getattr(r, f"{a}_mean") == pytest.approx(v.mean() if len(v) else np.nan, abs=1e-9, nan_ok=True)
            assert getattr(r, f"{a}_std") == pytest.approx(v.std() if len(v) else np.nan, abs=1e-9, nan_ok=True)


@pytest.mark.parametrize("seed", range(40))
def test_merged_summaries_equal_whole_tracks(seed):
    """Cut anywhere, even into single frames, and asked for after every part."""
    rng = np.random.default_rng(seed)
    channels = random_channels(rng, int(rng.choice([1, 2, 3, 5, 7, 9, 20, 60, 150])))
    rows = frame_of(channels)
    last = int(rows["frame"].max())
    cuts = sorted(set(rng.integers(0, last + 1, int(rng.integers(0, 12))).tolist()))
    summary = ts.empty(rows, [])
    for lo, hi in zip([-1, *cuts], [*cuts, last]):
        part = rows[(rows["frame"] > lo) & (rows["frame"] <= hi)]
        if not len(part):
            continue
        summary = ts.Summary.unpack(*ts.merge(summary, part.sample(frac=1, random_state=seed), []).pack())
        so_far = {r: {f: v for f, v in fs.items() if f <= hi} for r, fs in channels.items()}
        check(ts.descriptors(summary, []), {r: v for r, v in so_far.items() if v})


def test_summaries_do_not_grow_and_refuse_earlier_frames():
    rng = np.random.default_rng(1)
    sizes, summary = [], None
    for part in range(40):
        rows = pd.DataFrame([(r, f, *rng.normal(size=2)) for r in range(3) for f in range(50 * part, 50 * part + 50)],
                            columns=["row", "frame", "x", "y"])
        summary = ts.merge(summary or ts.empty(rows, []), rows, [])
        sizes.append(len(summary.points))
    assert max(sizes) <= 3 * 24 and len(set(sizes)) == 1
    assert ts.merge(summary, rows.iloc[:1], []) is None


def _arrive(spark, src, rows):
    spark.createDataFrame(rows, TRACK).coalesce(1).write.mode("append").parquet(src)


def _track(entity, frames, row=0):
    return [(entity, "c", "g", row, row, f, float(f * f % 7) if f % 5 else None, float(f % 3) if f % 5 else None) for f in frames]


def _same(a, b):
    key = lambda df: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r))
                            for r in df.select("entity_id", "class", "grp", "idx", "row", *DESCRIPTORS, "n_valid_transitions").collect())
    assert key(a) == key(b)


def test_a_batch_reads_its_own_rows_whatever_came_before(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    read, kept = [], []
    for n in range(5):
        _arrive(spark, src, _track(1, range(20 * n, 20 * n + 20)) + _track(1, range(20 * n, 20 * n + 20), 3) + _track(10 + n, range(15)))
        query = inc.incremental_descriptors(inc.track_stream(spark, src, TRACK), out, state)
        query.awaitTermination()
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
        kept.append(spark.read.parquet(f"{out}/descriptors/way=merged/batch={n}").count())
        _same(inc.read_descriptors(spark, out), channel_descriptors(spark.read.schema(TRACK).parquet(src)))
    assert read == [55] * 5 and kept == [3] * 5


def test_frames_out_of_order_are_computed_again_from_the_stored_rows(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    stored = lambda s: s.read.schema(TRACK).parquet(src)
    for frames in (range(0, 30, 2), range(1, 30, 2), range(30, 40)):
        _arrive(spark, src, _track(1, frames) + _track(2, frames if frames[0] != 1 else [50]))
        inc.incremental_descriptors(inc.track_stream(spark, src, TRACK), out, state, stored).awaitTermination()
        _same(inc.read_descriptors(spark, out), channel_descriptors(stored(spark)))
    fresh = [str(tmp_path / n) for n in ("src2", "out2", "state2")]
    _arrive(spark, fresh[0], _track(1, [5]))
    inc.incremental_descriptors(inc.track_stream(spark, fresh[0], TRACK), *fresh[1:]).awaitTermination()
    _arrive(spark, fresh[0], _track(1, [4]))
    with pytest.raises(Exception, match="stored"):
        inc.incremental_descriptors(inc.track_stream(spark, fresh[0], TRACK), *fresh[1:]).awaitTermination()


def test_awkward_rows(spark, tmp_path):
    """NULL ids, coordinates and frames of a channel that repeat within a batch."""
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    rows = _track(None, range(4)) + [(3, "c", "g", 0, 0, 1, None, None)] + [(4, None, "g", 0, 0, 1, v, None) for v in (1.0, 2.0, None)]
    _arrive(spark, src, rows)
    inc.incremental_descriptors(inc.track_stream(spark, src, TRACK), out, state).awaitTermination()
    got = {r.entity_id: r for r in spark.read.parquet(f"{out}/descriptors").collect()}
    assert set(got) == {None, 3, 4} and got[3].x_mean is None and got[3].detection_rate == 0 and got[4].x_mean == 2 and got[4].y_std is None


def test_entities_share_states_and_keep_their_numbers(spark, tmp_path):
    """States do not grow with the entities; those of one state, NULL and one out of order among them, stay apart."""
    src, out, state, causal, causal_state = (str(tmp_path / n) for n in ("src", "out", "state", "causal", "causal_state"))
    stored = lambda s: s.read.schema(TRACK).parquet(src)
    entities = [None, *range(60)]
    for start in (0, 20):
        rows = [r for e in entities for c in (0, 3) for r in _track(e, range(start + (e or 0) % 5, start + 20 - (e or 0) % 3), c)]
        _arrive(spark, src, rows + (_track(7, [3, 4], 0) if start else []))
        kept = inc.incremental_descriptors(inc.track_stream(spark, src, TRACK), out, state, stored, buckets=4)
        kept.awaitTermination()
        features = inc.run_available(inc.causal_features(inc.track_stream(spark, src, TRACK), buckets=4), causal, causal_state)
        for query in (kept, features):
            assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 5
    _same(inc.read_descriptors(spark, out).where("entity_id IS NOT NULL"), channel_descriptors(stored(spark).where("entity_id IS NOT NULL")))
    assert {r.entity_id for r in spark.read.parquet(f"{out}/descriptors").where("apart").collect()} == {7}
    got = {(r.entity_id, r.row, r.frame): (r.dx, r.dy, r.running_std, r.n_late) for r in spark.read.parquet(causal).collect()}
    for e in entities:
        for c in (0, 3):
            frames = [f for s in (0, 20) for f in range(s + (e or 0) % 5, s + 20 - (e or 0) % 3)]
            value = {f: float(f * f % 7) if f % 5 else None for f in frames}
            for n, f in enumerate(frames):
                seen = [value[g] for g in frames[:n + 1] if value[g] is not None]
                before = value.get(f - 1)
                dx = 0.0 if n == 0 else None if value[f] is None or before is None else value[f] - before
                r = got.pop((e, c, f))
                assert r[0] == dx and r[2] == (pytest.approx(np.std(seen), abs=1e-9) if seen else None)
                assert r[3] == (2 if (e, c) == (7, 0) and f >= 20 else 0)
    assert not got


FRAMES = "entity_id long, row int, frame int, ts timestamp, x double, y double"


def _timed(order, rows=(0, 3)):
    """Frames one second apart, in some order of arrival."""
    start = pd.Timestamp("2024-01-01")
    return [(1, r, f, (start + pd.Timedelta(seconds=f)).to_pydatetime(), float(f * f % 11) if f % 4 else None, float(f + r)) for f in order for r in rows]


def test_frames_within_the_wait_come_out_in_order(spark, tmp_path):
    """Shuffled over batches within the watermark: the same rows as in order, all but the last wait."""
    rng = np.random.default_rng(5)
    order = sorted(range(120), key=lambda f: f + rng.uniform(0, 9))
    given = {}
    for name, frames in (("shuffled", order), ("sorted", range(120))):
        src, out, state = (str(tmp_path / f"{name}-{n}") for n in ("src", "out", "state"))
        for at in range(0, 120, 20):
            spark.createDataFrame(_timed(list(frames)[at:at + 20]), FRAMES).coalesce(1).write.mode("append").parquet(src)
            inc.run_available(inc.causal_features_in_order(inc.track_stream(spark, src, FRAMES), wait="10 seconds"), out, state)
        given[name] = sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in spark.read.parquet(out).collect())
    assert given["shuffled"] == given["sorted"]
    rows = spark.read.parquet(out).where("row = 3").orderBy("frame").collect()
    assert [r.frame for r in rows] == list(range(110)) and all(r.n_late == 0 for r in rows)
    assert rows[7].dy == 1.0 and rows[0].dx == 0.0 and rows[4].dx is None


def test_idle_entities_are_forgotten_and_late_frames_dropped(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    other = lambda f: [(2, *r[1:]) for r in _timed([f], rows=(0,))]
    for rows in (_timed([0, 1, 2], rows=(0,)), other(30), other(31), _timed([3], rows=(0,)) + other(100), other(101), _timed([200], rows=(0,)), other(300)):
        spark.createDataFrame(rows, FRAMES).coalesce(1).write.mode("append").parquet(src)
        query = inc.run_available(inc.causal_features_in_order(inc.track_stream(spark, src, FRAMES), wait="5 seconds", idle_ms=20_000), out, state)
    got = sorted((r.frame, r.dx) for r in spark.read.parquet(out).where("entity_id = 1").collect())
    assert [f for f, _ in got] == [0, 1, 2, 200]  # frame 3 came behind the watermark
    assert got[-1][1] == 0.0                      # known no longer: starts anew
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


EVENTS = "ts timestamp, who string, present boolean"


def _events(hours):
    start = pd.Timestamp("2024-01-01")
    return [((start + pd.Timedelta(hours=h)).to_pydatetime(), "a" if i % 2 else "b", i % 3 == 0) for i, h in enumerate(hours)]


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_windows_close_and_late_frames_are_dropped(spark, tmp_path, slide):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    arrived, totals = [], []
    for n, hours in enumerate(([0.1, 0.2, 0.6, 1.2], [5.1, 5.4, 4.2], [0.3, 9.9, 9.1], [30.5, 30.1, 9.2], [60.0, 2.0], [])):
        if hours:
            spark.createDataFrame(_events(hours), EVENTS).coalesce(1).write.mode("append").parquet(src)
        stored = spark.read.schema(EVENTS).parquet(src)
        query = inc.run_presence_to_end(inc.track_stream(spark, src, EVENTS), stored, ["who"], out, state, ts="ts", window="1 hour", slide=slide,
                                        late="2 hours")
        # late: the window has closed behind the latest frame of the batches before
        seen = max((h for h, _ in arrived), default=-10)
        arrived += [(h, r) for h, r in zip(hours, _events(hours)) if not _late(h, seen, slide)]
        if query.lastProgress and query.lastProgress["stateOperators"]:
            totals.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        got = sorted((r.window_start, r.who, r.n_frames, r.rate) for r in inc.read_presence(spark, out).collect())
        rows = spark.createDataFrame([r for _, r in arrived], EVENTS)
        want = sorted((r.window_start, r.who, r.n_frames, r.rate) for r in inc.live_presence(rows, ["who"], ts="ts", window="1 hour", slide=slide).collect())
        assert got == want, n
    assert max(totals) <= 8


def _late(h, seen, slide):
    """Whether all windows that hold hour h have ended two hours before the latest frame (whole windows: tests avoid mixed ones)."""
    first_end = np.floor(h) + 1 if slide is None else np.floor(h * 2) / 2 + 0.5
    ends = [first_end] if slide is None else [first_end, first_end + 0.5]
    flags = {e <= seen - 2 for e in ends}
    assert len(flags) == 1
    return flags.pop()
