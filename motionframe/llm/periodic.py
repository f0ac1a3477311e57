"""Periodic runs of words in the notes of runs, from an enhanced suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from motionframe.llm.words import hash_words, slices, split_words, text_bytes
from motionframe.session import ship_package

LEAST_WORDS = 6       # of a run
LEAST_PERIODS = 4     # periods that fit into a run; two at least, as squares are searched
BATCH_BYTES = 2 << 20

NO_RUN = np.zeros((0, 4), np.int64)


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of integers, equal ones alike."""
    by = np.argsort(keys, kind="stable")
    new = np.zeros(len(keys), np.int64)
    new[by[1:]] = keys[by[1:]] != keys[by[:-1]]
    out = np.empty(len(keys), np.int64)
    out[by] = np.cumsum(new[by])
    return out


class SuffixArray:
    """Suffixes of several notes at once: sorted within each note, with ranks of all power-of-two lengths.

    `levels[k]` gives places the same number if the same 2**k words of the same note's text
    follow; a suffix that ends earlier shares its number with none.
    """

    def __init__(self, words: np.ndarray, note: np.ndarray, stop: np.ndarray):
        """words: hashes; note: the note of each word; stop: where that note ends."""
        n = len(words)
        by = np.lexsort((words, note))
        new = np.ones(n, bool)
        new[1:] = (words[by][1:] != words[by][:-1]) | (note[by][1:] != note[by][:-1])
        # a rank is the first place of its group in the order, so that groups split without moving others
        place = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank = np.empty(n, np.int64)
        rank[by] = place
        self.levels = [rank]
        order, length = by, 1
        size = np.bincount(place, minlength=n)
        open_ = np.flatnonzero(size[place] > 1)  # places in the order that are not settled
        while len(open_):
            own = order[open_]
            ahead = own + length
            inside = ahead < stop[own]
            # a suffix that ends sorts before all that go on
            behind = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
            group = rank[own]
            turn = np.lexsort((behind, group))
            own, behind, group = own[turn], behind[turn], group[turn]
            order = order.copy()
            order[open_] = own
            new = np.ones(len(own), bool)
            new[1:] = (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])
            first = open_[np.flatnonzero(new)[np.cumsum(new) - 1]]
            rank = rank.copy()
            rank[own] = first
            self.levels.append(rank)
            length *= 2
            size = np.bincount(first, minlength=n)
            open_ = open_[size[first] > 1]
        self.order, self.rank = order, rank
        self.lcp = np.zeros(n, np.int64)
        a, b = order[:-1].copy(), order[1:].copy()
        pair = np.flatnonzero(self.levels[0][a] == self.levels[0][b])
        a, b = a[pair], b[pair]
        total = np.zeros(len(pair), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            inside = np.maximum(a, b) < stop[b] if len(b) else np.zeros(0, bool)
            inside &= (a < n) & (b < n)
            level = self.levels[k]
            same = inside.copy()
            same[inside] = level[a[inside]] == level[b[inside]]
            step = same.astype(np.int64) << k
            a, b, total = a + step, b + step, total + step
            # both stay in their note: equal numbers mean that 2**k words follow
        self.lcp[pair + 1] = total


def _nearest_smaller(values: np.ndarray, strict: bool) -> np.ndarray:
    """For every place the nearest one to the left with a smaller (strict) or no greater value; -1 if none.

    Windows of minima double until they hold such a value, then halve onto it.
    """
    n = len(values)
    tables = [values]
    while 2 << (len(tables) - 1) <= n:
        last, span = tables[-1], 1 << (len(tables) - 1)
        grown = last.copy()
        grown[span:] = np.minimum(last[span:], last[:-span])  # minimum of the 2 * span values that end here
        tables.append(grown)
    at = np.arange(n) - 1
    reach = (lambda low, v: low >= v) if strict else (lambda low, v: low > v)
    for k in range(len(tables) - 1, -1, -1):
        skip = (at >= (1 << k) - 1) & reach(tables[k][np.maximum(at, 0)], values)
        at = np.where(skip, at - (1 << k), at)
    # what is left of the note is shorter than the smallest window tried
    return at


def _squares(sa: SuffixArray, stop: np.ndarray, least_periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Branching tandems (start, period): squares that the word behind them does not go on.

    Every place of the LCP array cuts its interval in two, the suffixes on both sides
    sharing exactly `depth` words. For each suffix i of the smaller side, i + depth or
    i - depth is looked up by its rank: on the other side it makes a square of that
    period, of which the next word differs. Intervals with fewer suffixes than
    `least_periods` hold no run that long and are skipped.
    """
    n = len(sa.order)
    some = np.flatnonzero(sa.lcp > 0)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(some):
        return none
    # left: nearest with no greater value, so that equal depths split off one child each; right: nearest smaller
    left = _nearest_smaller(sa.lcp, strict=False)
    right = n - 1 - _nearest_smaller(sa.lcp[::-1], strict=True)[::-1]
    whole = _nearest_smaller(sa.lcp, strict=True)
    low, mid, high = left[some], some, right[some]  # sides: [low, mid) and [mid, high)
    big = high - np.maximum(whole[some], 0) >= least_periods
    low, mid, high, depth = np.maximum(low, 0)[big], mid[big], high[big], sa.lcp[some][big]
    if not len(mid):
        return none
    small_left = mid - low <= high - mid
    start, size = np.where(small_left, low, mid), np.where(small_left, mid - low, high - mid)
    other, other_end = np.where(small_left, mid, low), np.where(small_left, high, mid)
    cut = np.repeat(np.arange(len(mid)), size)
    ends = np.cumsum(size)
    suffix = sa.order[np.arange(ends[-1]) - np.repeat(ends - size, size) + start[cut]]
    starts, periods = [], []
    for sign in (1, -1):
        partner = suffix + sign * depth[cut]
        ok = (partner >= 0) & (partner < n)
        at = sa.rank[np.clip(partner, 0, n - 1)]
        ok &= (at >= other[cut]) & (at < other_end[cut])
        starts.append(np.minimum(suffix, partner)[ok])
        periods.append(depth[cut][ok])
    return np.concatenate(starts), np.concatenate(periods)


def runs_of(words: np.ndarray, bounds: np.ndarray, least_words: int = LEAST_WORDS,
            least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (note, start, length, period) of the periodic runs of notes, by note, start and period.

    words: hashes of all words; bounds: the first word of every note, one more at the end.
    A run's squares are its branching one, turned left as long as the word that comes in
    equals the one that goes out; blocks of 2**k words are turned at once. Squares of the
    same stretch are one run, that of the smallest period.
    """
    if not len(words):
        return NO_RUN
    sizes = np.diff(bounds)
    note = np.repeat(np.arange(len(sizes)), sizes)
    first, stop = bounds[:-1][note], bounds[1:][note]
    sa = SuffixArray(words, note, stop)
    start, period = _squares(sa, stop, least_periods)
    if not len(start):
        return NO_RUN
    end = start + 2 * period
    floor = first[start]
    for k in range(len(sa.levels) - 1, -1, -1):
        level = sa.levels[k]
        while True:
            to = start - (1 << k)
            turn = to >= floor
            turn[turn] = level[to[turn]] == level[to[turn] + period[turn]]
            if not turn.any():
                break
            start = np.where(turn, to, start)
    length = end - start
    long = length >= np.maximum(least_words, least_periods * period)
    rows = np.unique(np.stack([note[start], start - first[start], length, period], axis=1)[long], axis=0)
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        rows = rows[new]  # the smallest period of a stretch comes first
        rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return rows


def _report(notes: pa.Array, keys: pa.Array, names: list[str], least_words: int, least_periods: int) -> pa.RecordBatch:
    raw, bounds = text_bytes(notes)
    starts, ends, firsts = split_words(raw, bounds)
    found = runs_of(hash_words(raw, starts, ends), firsts, least_words, least_periods)
    whole = raw.tobytes()
    n_notes = len(bounds) - 1
    cuts = np.searchsorted(found[:, 0], np.arange(n_notes + 1))
    n_runs, best, digests, kept = np.diff(cuts), [[], [], [], []], [], []
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        words = whole[bounds[i]:bounds[i + 1]].split()
        if a == b:
            for column in best:
                column.append(None)
            digests.append(hashlib.sha256(b"").hexdigest())
        else:
            own = found[a:b]
            _, start, length, period = own[np.lexsort((own[:, 3], own[:, 1], -own[:, 2]))[0]].tolist()
            for column, value in zip(best, (start, length, period, 1000 * length // period)):
                column.append(value)
            lines = "".join(f"{s},{n},{q}\n" for _, s, n, q in own.tolist())
            digests.append(hashlib.sha256(lines.encode()).hexdigest())
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, own[:, 1] + own[:, 3], 1)
            np.add.at(cover, own[:, 1] + own[:, 2], -1)
            words = compress(words, (np.cumsum(cover[:-1]) == 0).tolist())
        kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return pa.RecordBatch.from_arrays(
        [keys, pa.array(n_runs, pa.int64()), *(pa.array(c, pa.int64()) for c in best),
         pa.array(digests, pa.string()), pa.array(kept, pa.string())], names)


def periodic_runs(runs: DataFrame, *, key: str = "run_id", notes: str = "notes", least_words: int = LEAST_WORDS,
                  least_periods: int = LEAST_PERIODS) -> DataFrame:
    """Stretches of the notes of runs that repeat a few words over and over, and the notes without them.

    A periodic run is a stretch of consecutive words with smallest period q (words q apart
    are the same) of at least `least_words` words and `least_periods` periods that neither
    neighbouring word extends keeping the period. Words are numbered from 0. Returns per
    input row (key, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256): the longest run (the first of equals, then that of the smallest
    period; four NULLs if there is none), 1000 * length / period rounded down, the digest
    of the lines `start,length,period` of all runs by start and period, and that of the
    words left, joined by one space, when each run keeps its first period only.

    NULL and blank notes have no words and no runs. Words are compared as they stand, case
    included. NULL keys and repeated rows are kept, other columns ignored, whatever their
    names. An empty table gives no rows.

    A note is looked at by itself, so rows stay in their tasks and nothing is moved. A
    task sorts the suffixes of some megabytes of notes at once, each within its note; a
    note above that is a batch of its own. Memory is the batch times the logarithm of
    the longest repeat. Words are told apart by 64-bit hashes.
    """
    ship_package(runs.sparkSession)
    names = [key, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    shape = runs.select(key).schema
    for name in names[1:6]:
        shape = shape.add(name, "long")
    shape = shape.add(names[6], "string").add(names[7], "string")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, keys in slices(batch.column(1), batch.column(0), BATCH_BYTES):
                yield _report(texts, keys, names, least_words, least_periods)

    return runs.select(F.col(key), F.col(notes).alias("_text")).mapInArrow(tasks, shape)
