"""Mergeable summaries of an entity's channels: sums of what is settled, and the few rows at its borders.

A step between two frames is settled once both axes are observed four frames before and
three after it: no later frame can change its gap filling or smoothing. A summary adds up
settled steps and keeps only the observed rows around its first and its last unsettled
step, so it does not grow with the track. What remains is computed from these rows when
descriptors are asked for, since it depends on the entity's first and last frame.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

from motionframe.functions import smoothing, track_kernel

WINDOW, ORDER = 7, 2
AXES = ("x", "y")
NEVER = np.iinfo(np.int64).min >> 2

# executors get these helpers with the task instead of importing them
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Summary:
    """`channels`: one row per channel; `points`: observed rows kept, by channel and frame."""

    channels: pd.DataFrame
    points: pd.DataFrame

    def pack(self) -> tuple[bytes, bytes]:
        return tuple(pa.ipc.serialize_pandas(t, preserve_index=False).to_pybytes() for t in (self.channels, self.points))

    @staticmethod
    def unpack(channels: bytes, points: bytes) -> "Summary":
        return Summary(*(pa.ipc.deserialize_pandas(t) for t in (channels, points)))


SUMS = ("lo", "hi", "last_seen", "n_valid", "head_to", "settled_to", "steps", *[f"{a}_{s}" for a in AXES for s in ("n", "mean", "m2")])


def empty(rows: pd.DataFrame, attrs: list[str]) -> Summary:
    channels = pd.DataFrame({**{c: rows[c].iloc[:0] for c in ["row", *attrs]},
                             **{c: pd.Series(dtype="float64" if c == "steps" or c.endswith(("mean", "m2")) else "int64") for c in SUMS}})
    return Summary(channels, rows[["row", "frame", *AXES]].iloc[:0].reset_index(drop=True))


def _smoothed(group, frame, points_group, points_frame, values, f0, f1):
    """Gap-filled and smoothed values of one axis at some frames, each of a series from its f0 to its f1."""
    n = f1 - f0 + 1
    windows = np.minimum(WINDOW, n - 1 + n % 2)
    known = ~np.isnan(values)
    first = min(int(frame.min()) - WINDOW, int(points_frame.min()))
    fill = lambda g, f: track_kernel._fill(g, f, points_group[known], points_frame[known], values[known], first)
    out = np.empty(len(frame))
    for window in np.unique(windows):
        at = np.flatnonzero(windows == window)
        if window < 3:
            out[at] = fill(group[at], frame[at])
            continue
        start = np.clip(frame[at] - window // 2, f0[at], f1[at] - window + 1)
        around = (start[:, None] + np.arange(window)).ravel()
        filled = fill(np.repeat(group[at], window), around).reshape(-1, window)
        out[at] = (smoothing.hat_matrix(int(window), min(ORDER, int(window) - 1))[frame[at] - start] * filled).sum(axis=1)
    return out


def _squared_steps(group, at, points_group, points, f0, f1, n_groups):
    """Per channel, whose series goes from f0 to f1, the squared steps that end at some frames, added up over both axes."""
    if not len(at):
        return np.zeros(n_groups)
    total = np.zeros(len(at))
    twice = np.concatenate([group, group])
    for a in AXES:
        both = _smoothed(twice, np.concatenate([at, at - 1]), points_group,
                         points["frame"].to_numpy(np.int64), points[a].to_numpy(float), f0[twice], f1[twice])
        total += (both[:len(at)] - both[len(at):]) ** 2
    return np.bincount(group, total, n_groups)


def _valid(group, points):
    """Which kept rows end a step: x observed here and one frame before."""
    frame, seen = points["frame"].to_numpy(np.int64), ~np.isnan(points["x"].to_numpy(float))
    ok = np.zeros(len(points), bool)
    ok[1:] = (group[1:] == group[:-1]) & (np.diff(frame) == 1) & seen[1:] & seen[:-1]
    return ok


def merge(summary: Summary, rows: pd.DataFrame, attrs: list[str]) -> Summary | None:
    """The summary with rows that come after all earlier ones of their channel; None if some do not.

    Rows of one channel and frame count as one, with the larger known value of each axis.
    """
    rows = rows.sort_values(["row", "frame"], kind="stable")
    known = rows.groupby(["row", "frame"], sort=True)[list(AXES)].max().reset_index()
    first = rows.groupby("row", sort=True)[attrs].first().reset_index() if attrs else known[["row"]].drop_duplicates()
    old = summary.channels
    fresh = first[~first["row"].isin(old["row"])]
    if len(fresh):
        start = {c: 0.0 if c == "steps" or c.endswith(("mean", "m2")) else 0 for c in SUMS}
        start.update(lo=-NEVER, hi=NEVER, last_seen=NEVER, head_to=NEVER, settled_to=NEVER)
        old = pd.concat([old, fresh.assign(**start)], ignore_index=True) if len(old) else fresh.assign(**start)
    channels = old.sort_values("row").reset_index(drop=True)
    n = len(channels)
    order = channels["row"].to_numpy()
    group, frame = np.searchsorted(order, known["row"].to_numpy()), known["frame"].to_numpy(np.int64)
    hi = channels["hi"].to_numpy(np.int64).copy()
    if (frame <= hi[group]).any():
        return None
    lo = channels["lo"].to_numpy(np.int64).copy()
    np.maximum.at(hi, group, frame)
    np.minimum.at(lo, group, frame)
    channels["lo"], channels["hi"] = lo, hi
    for a in AXES:  # moments of the new rows, merged with the old ones
        v = known[a].to_numpy(float)
        seen = ~np.isnan(v)
        m = np.bincount(group[seen], minlength=n)
        mean = np.bincount(group[seen], v[seen], n) / np.maximum(m, 1)
        m2 = np.bincount(group[seen], (v[seen] - mean[group[seen]]) ** 2, n)
        n0, mean0 = channels[f"{a}_n"].to_numpy(), channels[f"{a}_mean"].to_numpy()
        total, gap = np.maximum(n0 + m, 1), mean - mean0
        channels[f"{a}_m2"] = channels[f"{a}_m2"] + m2 + gap * gap * n0 * m / total
        channels[f"{a}_mean"] = np.where(m > 0, mean0 + gap * m / total, mean0)
        channels[f"{a}_n"] = n0 + m
    # transitions: also the one from the last frame seen before
    seen = ~np.isnan(known["x"].to_numpy(float))
    last = channels["last_seen"].to_numpy(np.int64).copy()
    after = seen & (frame == last[group] + 1)
    ends = _valid(group, known) | after
    channels["n_valid"] = channels["n_valid"] + np.bincount(group[ends], minlength=n)
    np.maximum.at(last, group[seen], frame[seen])
    channels["last_seen"] = last

    points = pd.concat([summary.points, known.dropna(subset=list(AXES), how="all")], ignore_index=True) if len(summary.points) else (
        known.dropna(subset=list(AXES), how="all"))
    points = points.sort_values(["row", "frame"]).reset_index(drop=True)
    group, frame = np.searchsorted(order, points["row"].to_numpy()), points["frame"].to_numpy(np.int64)
    head_to, ready = np.full(n, NEVER), np.full(n, -NEVER)
    observed = {}
    for a in AXES:
        yes = ~np.isnan(points[a].to_numpy(float))
        low, high = np.full(n, -NEVER), np.full(n, NEVER)
        np.minimum.at(low, group[yes], frame[yes])
        np.maximum.at(high, group[yes], frame[yes])
        head_to, ready = np.maximum(head_to, low + 3), np.minimum(ready, high - 3)
        observed[a] = yes
    settled = channels["settled_to"].to_numpy(np.int64)
    can = (ready > head_to) & (ready > settled)
    known_head = channels["head_to"].to_numpy(np.int64)
    head_to = np.where(known_head > NEVER, known_head, head_to)
    due = _valid(group, points) & can[group] & (frame > np.maximum(settled, head_to)[group]) & (frame <= ready[group])
    far = np.full(n, 1 << 40)
    channels["steps"] = channels["steps"] + _squared_steps(group[due], frame[due], group, points, -far, far, n)
    channels["head_to"] = np.where(can, head_to, known_head)
    settled = np.where(can, ready, settled)
    channels["settled_to"] = settled

    # around both borders all rows within reach stay, and the nearest observation of each axis beyond
    done = settled[group] > NEVER
    keep = ~done | (frame <= head_to[group] + 3) | (frame >= settled[group] - 3)
    for a, yes in observed.items():
        for side, border, best, fn in ((yes & (frame >= head_to[group] + 3), head_to, np.full(n, -NEVER), np.minimum),
                                       (yes & (frame <= settled[group] - 3), settled, np.full(n, NEVER), np.maximum)):
            fn.at(best, group[side], frame[side])
            keep |= side & (frame == best[group])
    return Summary(channels, points[keep].reset_index(drop=True))


def descriptors(summary: Summary, attrs: list[str], entity: str | None = None) -> pd.DataFrame:
    """Descriptors of all channels as they are now; `entity` is the column that tells entities apart, if there are several."""
    channels, points = summary.channels, summary.points
    n = len(channels)
    by = channels.groupby(entity if entity else np.zeros(n, int), dropna=False)
    f0, f1 = by["lo"].transform("min").to_numpy(np.int64), by["hi"].transform("max").to_numpy(np.int64)
    group, frame = np.searchsorted(channels["row"].to_numpy(), points["row"].to_numpy()), points["frame"].to_numpy(np.int64)
    settled, head_to = (channels[c].to_numpy(np.int64)[group] for c in ("settled_to", "head_to"))
    valid = _valid(group, points)
    total = channels["steps"].to_numpy().copy()
    for part in (valid & ((settled == NEVER) | (frame <= head_to)), valid & (settled > NEVER) & (frame > settled)):
        total += _squared_steps(group[part], frame[part], group, points, f0, f1, n)
    count = channels["n_valid"].to_numpy()
    out = channels[["row", *attrs]].copy()
    out["rms_speed_xy"] = np.where(count > 0, np.sqrt(total / np.maximum(count, 1)), np.nan)
    for a in AXES:
        seen = channels[f"{a}_n"].to_numpy()
        out[f"{a}_mean"] = np.where(seen > 0, channels[f"{a}_mean"], np.nan)
        out[f"{a}_std"] = np.where(seen > 0, np.sqrt(channels[f"{a}_m2"].to_numpy() / np.maximum(seen, 1)), np.nan)
    out["detection_rate"] = channels["x_n"].to_numpy() / (f1 - f0 + 1)
    out["n_valid_transitions"] = count
    return out
