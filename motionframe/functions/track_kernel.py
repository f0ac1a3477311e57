"""Vectorized gap filling and smoothing over a block of whole track segments.

Spark does the partitioning and sorting; a task hands over Arrow blocks of sorted
rows and gets frames or per-segment sums back. Nothing loops over rows or tracks:
every step is one numpy call over all segments of the block.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from motionframe.functions import smoothing

BLOCK_ROWS = 20_000  # small enough for the processor caches
NO_FRAME = np.iinfo(np.int64).min

# executors get these helpers with the task instead of importing them
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(smoothing)


def whole_groups(batches, keys):
    """Re-cut a sorted stream so that no group of equal keys is split between tables."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(group_starts(table, keys)[-1])
            if cut:
                yield table.slice(0, cut)
                table = table.slice(cut)
            held, rows = table.to_batches(), table.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def whole_once(tables, key):
    """Tables of whole groups; a group whose rows come back later in the same task is an error."""
    done = set()
    for table in tables:
        met = table.column(key).unique().to_pylist()
        if not done.isdisjoint(met):
            raise ValueError("entities are not whole in their files: rows of one come apart")
        done.update(met)
        yield table


def group_starts(table, keys):
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for k in keys:
        col = table.column(k)
        differs = pc.not_equal(col.slice(1), col.slice(0, table.num_rows - 1))
        change[1:] |= np.asarray(differs.fill_null(True))
    return np.flatnonzero(change)


def _ints(table, name):
    return np.asarray(pc.fill_null(table.column(name), int(NO_FRAME)), dtype=np.int64)


def _doubles(table, name):
    return np.asarray(pc.fill_null(table.column(name), float("nan")), dtype=np.float64)


def _fill(group, frame, known_group, known_frame, known_value, first_frame):
    """Linear between the nearest known values of the group, nearest one beyond its ends."""
    if len(known_value) == 0:
        return np.full(len(frame), np.nan)
    known = (known_group << 42) + (known_frame - first_frame)
    right = np.searchsorted(known, (group << 42) + (frame - first_frame), side="right")
    left = right - 1
    has_left = (left >= 0) & (known_group[left] == group)
    right = np.minimum(right, len(known) - 1)
    has_right = (known_group[right] == group) & (known_frame[right] > frame)
    lf, lv, rf, rv = known_frame[left], known_value[left], known_frame[right], known_value[right]
    gap = np.where(has_left & has_right, rf - lf, 1)
    between = lv + (rv - lv) * (frame - lf) / gap
    between = np.where(frame == lf, lv, between)
    return np.where(has_left & has_right, between,
                    np.where(has_left, lv, np.where(has_right, rv, np.nan)))


def _smooth(values, group, base, length, at_start, at_end, n_frames, window, order):
    """Savitzky-Golay with the window each series length allows."""
    out = values.copy()
    for w in range(3, window + 1, 2):
        fits = (n_frames >= w) & ((n_frames < w + 2) | (w == window)) & (length >= w)
        if not fits.any():
            continue
        half, hat = w // 2, smoothing.hat_matrix(w, min(order, w - 1))
        padded = np.concatenate([np.full(half, np.nan), values, np.full(half, np.nan)])
        centre = sum(hat[half][j] * padded[j:j + len(values)] for j in range(w))
        rows = fits[group]
        out[rows] = centre[rows]
        for i in range(half):
            heads, tails = np.flatnonzero(fits & at_start), np.flatnonzero(fits & at_end)
            first, last = base[heads], base[tails] + length[tails] - w
            out[first + i] = sum(hat[i][j] * values[first + j] for j in range(w))
            out[last + w - 1 - i] = sum(hat[w - 1 - i][j] * values[last + j] for j in range(w))
    return out


def _merge_repeats(row_group, frame, real, values):
    """Rows of one channel and frame become one, with the larger value of each axis that is known."""
    same = (row_group[1:] == row_group[:-1]) & (frame[1:] == frame[:-1]) & real[1:] & real[:-1]
    if not same.any():
        return row_group, frame, real, values
    at = np.flatnonzero(np.concatenate([[True], ~same]))
    values = {a: np.fmax.reduceat(v, at) for a, v in values.items()}
    return row_group[at], frame[at], real[at], values


class Block:
    """The dense frames of every group (a segment of a channel) of a table.

    `source` is, per group, the table row that holds its attributes, -1 for groups to
    leave out; `f0` and `f1` are the group's frame range, `offset` is added to frames
    that are given out.
    """

    def __init__(self, row_group, frame, real, values, source, seg, f0, f1, offset, size, window, order, smooth):
        margin = smoothing.REACH if smooth else 0
        row_group, frame, real, values = _merge_repeats(row_group, frame, real, values)
        self.source, self.seg, self.offset = source, seg, offset
        self.keep = source >= 0
        self.f0, self.f1 = np.where(self.keep, f0, 0), np.where(self.keep, f1, -1)
        self.lo = np.where(self.keep, np.maximum(self.f0, seg * size - margin), 0)
        last = np.minimum(self.f1, seg * size + size - 1 + margin)
        self.length = np.where(self.keep, last - self.lo + 1, 0)
        self.base = np.cumsum(self.length) - self.length
        self.group = np.repeat(np.arange(len(source)), self.length)
        self.frame = np.arange(len(self.group)) - self.base[self.group] + self.lo[self.group]
        at = self.frame - seg[self.group] * size
        self.core = (at >= 0) & (at < size)

        inside = (real & self.keep[row_group] & (frame >= self.lo[row_group])
                  & (frame < (self.lo + self.length)[row_group]))
        target = self.base[row_group[inside]] + frame[inside] - self.lo[row_group[inside]]
        first_frame = int(frame.min()) if len(frame) else 0
        self.raw, self.fill, self.smooth = {}, {}, {}
        series_length = np.where(self.keep, self.f1 - self.f0 + 1, 0)
        for a, v in values.items():
            self.raw[a] = np.full(len(self.group), np.nan)
            self.raw[a][target] = v[inside]
            known = ~np.isnan(v) & self.keep[row_group]
            self.fill[a] = _fill(self.group, self.frame, row_group[known], frame[known], v[known], first_frame)
            if smooth:
                self.smooth[a] = _smooth(
                    self.fill[a], self.group, self.base, self.length,
                    self.lo == self.f0, self.lo + self.length - 1 == self.f1,
                    series_length, window, order)
        self.seen = ~np.isnan(self.raw[next(iter(values))])

    def steps(self, a):
        step = np.zeros(len(self.group))
        step[1:] = np.diff(self.smooth[a])
        return step


def segment_block(table, keys, axes, size, window, order, smooth):
    """Block of a table sorted by segment and frame, with boundary and carry rows."""
    starts = group_starts(table, keys)
    row_group = np.zeros(table.num_rows, dtype=np.int64)
    row_group[starts[1:]] = 1
    row_group = np.cumsum(row_group)
    # the boundary row of a segment has the frame range and the channel's attributes;
    # copies in a segment the entity never reaches have none
    edges = np.flatnonzero(np.asarray(table.column("f0").is_valid()))
    edge = np.full(len(starts), -1)
    edge[row_group[edges]] = edges
    seg = np.asarray(table.column("seg"), dtype=np.int64)[starts]
    return Block(row_group, _ints(table, "frame"), np.asarray(table.column("real")), {a: _doubles(table, a) for a in axes},
                 edge, seg, _ints(table, "f0")[edge], _ints(table, "f1")[edge], np.zeros(len(starts), np.int64),
                 size, window, order, smooth)


def entity_block(table, axes, window, order, smooth, plain=False):
    """Block of a table of whole entities in any row order; every channel is one segment.

    `plain` takes the place of a row within its channel for its frame.
    """
    code = np.asarray(pc.rank(table.column("entity_id"), tiebreaker="dense"), dtype=np.int64)
    channel, frame = np.asarray(table.column("row"), dtype=np.int64), _ints(table, "frame")
    by = np.lexsort((frame, channel, code))
    code, channel, frame = code[by], channel[by], frame[by]
    starts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (channel[1:] != channel[:-1])]))
    row_group = np.zeros(len(by), dtype=np.int64)
    row_group[starts[1:]] = 1
    row_group = np.cumsum(row_group)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    entity = np.searchsorted(first, starts, "right") - 1  # of each group
    f0, f1 = np.minimum.reduceat(frame, first), np.maximum.reduceat(frame, first)
    rel, last = frame - f0[np.searchsorted(first, np.arange(len(by)), "right") - 1], (f1 - f0)[entity]
    if plain:
        rel, last = np.arange(len(by)) - starts[row_group], np.diff(np.append(starts, len(by))) - 1
    values = {a: _doubles(table, a)[by] for a in axes}
    zero = np.zeros(len(starts), np.int64)
    return Block(row_group, rel, np.ones(len(by), bool), values, by[starts], zero, zero, last, f0[entity],
                 1 << 40, window, order, smooth)


def _column(values):
    return pa.array(values, from_pandas=True)


def frames(keys, carry, axes, size, window, order, smooth):
    """Task function: one row per segment frame, without the margins. Without a size, tables hold whole entities."""
    def run(batches):
        tables = whole_groups(batches, keys)
        for table in tables if size else whole_once(tables, keys[0]):
            b = (segment_block(table, keys, axes, size, window, order, smooth) if size
                 else entity_block(table, axes, window, order, smooth))
            pick = np.flatnonzero(b.core)
            group = b.group[pick]
            cols = [table.column(c).take(pa.array(b.source[group])) for c in carry]
            cols += [pa.array(v) for v in (b.frame[pick] + b.offset[group], b.f0[group] + b.offset[group], b.f1[group] + b.offset[group])]
            cols += [_column(b.raw[a][pick]) for a in axes]
            cols += [_column((b.smooth if smooth else b.fill)[a][pick]) for a in axes]
            cols += [pa.array(b.seen[pick])]
            names = [*carry, "frame", "f0", "f1", *axes, *[f"{a}_out" for a in axes], "seen"]
            yield from pa.table(cols, names=names).to_batches(max_chunksize=BLOCK_ROWS)
    return run


def sums(keys, carry, axes, size, window, order, plain=False):
    """Task function: one row of partial sums per (entity, channel, segment). Without a size, tables hold whole entities."""
    def run(batches):
        tables = whole_groups(batches, keys)
        for table in tables if size else whole_once(tables, keys[0]):
            b = (segment_block(table, keys, axes, size, window, order, True) if size
                 else entity_block(table, axes, window, order, True, plain))
            groups = len(b.source)

            def total(mask, weights=None):
                if weights is None:
                    return np.bincount(b.group[mask], None, groups)
                return np.bincount(b.group[mask], weights[mask], groups).astype(float)  # integers where the mask is empty

            linked = np.zeros(len(b.group), dtype=bool)
            linked[1:] = b.group[1:] == b.group[:-1]
            linked &= b.core
            valid = linked & b.seen
            valid[1:] &= b.seen[:-1]
            out = {"n_frames": total(b.core), "n_valid": total(valid), "n_linked": total(linked)}
            for a in axes:
                step2 = b.steps(a) ** 2
                raw, seen = b.raw[a], b.core & ~np.isnan(b.raw[a])
                count = total(seen)
                mean = total(seen, raw) / np.maximum(count, 1)
                centred = raw - mean[b.group]
                out[f"{a}_valid"] = total(valid, step2)
                out[f"{a}_linked"] = total(linked, step2)
                out[f"{a}_unknown"] = total(b.core & np.isnan(b.fill[a]))
                out[f"{a}_n"] = count
                out[f"{a}_mean"] = mean
                out[f"{a}_m2"] = total(seen, centred * centred)
            pick = np.flatnonzero(b.keep)
            cols = [table.column(c).take(pa.array(b.source[pick])) for c in carry]
            cols += [pa.array(v[pick]) for v in out.values()]
            yield from pa.table(cols, names=[*carry, *out]).to_batches(max_chunksize=BLOCK_ROWS)
    return run


def sum_fields(axes):
    """Names and Spark types of the columns `sums` adds, in order."""
    out = [("n_frames", "bigint"), ("n_valid", "bigint"), ("n_linked", "bigint")]
    for a in axes:
        out += [(f"{a}_valid", "double"), (f"{a}_linked", "double"), (f"{a}_unknown", "bigint"),
                (f"{a}_n", "bigint"), (f"{a}_mean", "double"), (f"{a}_m2", "double")]
    return out
