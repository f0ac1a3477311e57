"""Repeated passages of notes: a count-min prefilter, then exact groups of what may repeat."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from motionframe.llm.words import hash_runs, hash_words, mix64, split_words, text_bytes
from motionframe.session import ship_package

WINDOW = 50                    # words
GRAM = 25                      # words of the run that stands for a window in the sketch
PART_BYTES = 4 << 20           # notes per task; the number of tasks follows the input
BYTES_PER_WORD = 6             # for sizing only
CELLS_PER_GRAM = 4             # sketch width per selected gram
DEPTH = 2                      # sketch rows
BLOCK_BITS = 20                # cells that one task merges
WINDOWS_PER_TASK = 1_500_000   # windows that one exact task groups

_NO_KEY = np.iinfo(np.int64).max


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of every run of `width` values."""
    best, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        later = best[step:] < best[:len(best) - step]
        at = np.where(later, at[step:], at[:len(at) - step])
        best = np.where(later, best[step:], best[:len(best) - step])
        span += step
    return at


@dataclass
class Windows:
    """All windows of a part's notes: where they start, whose they are, and their hashes."""

    raw: bytes
    bounds: np.ndarray    # first byte of each note, one more at the end
    firsts: np.ndarray    # first word of each note, one more at the end
    start: np.ndarray     # word at which a window starts
    doc: np.ndarray       # key of its note
    own: np.ndarray       # hash of its words
    gram: np.ndarray      # hash of its smallest run of GRAM words: equal windows have equal ones
    place: np.ndarray     # word at which that run starts


def windows_of(keys: pa.ChunkedArray, notes: pa.ChunkedArray) -> Windows:
    ids = keys.combine_chunks().fill_null(_NO_KEY).to_numpy()
    raw, bounds = text_bytes(notes.combine_chunks())
    starts, ends, firsts = split_words(raw, bounds)
    words = hash_words(raw, starts, ends)
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return Windows(raw.tobytes(), bounds, firsts, none, none, none.view(np.uint64), none.view(np.uint64), none)
    row = np.repeat(np.arange(len(ids)), np.diff(firsts))
    start = np.flatnonzero(firsts[row + 1] - np.arange(n) >= WINDOW)
    grams = hash_runs(words, GRAM)
    place = sliding_argmin(grams, WINDOW - GRAM + 1)[start]
    return Windows(raw.tobytes(), bounds, firsts, start, ids[row[start]], hash_runs(words, WINDOW)[start], grams[place], place)


def _cells(gram: np.ndarray, row: int, width: int) -> np.ndarray:
    return mix64(gram ^ np.uint64(0xA0761D6478BD642F >> row)) % np.uint64(width)


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _sketch(part: int, table: pa.Table, width: int) -> pa.Table:
    """The part's own sketch, sparse: per row and block the cells hit, twice where hit more often.

    A run of GRAM words counts once per place. Each place of a window holds one of its
    run, so the count of the run is never below the count of the window.
    """
    w = windows_of(table["k"], table["notes"])
    gram = w.gram[np.unique(w.place, return_index=True)[1]]
    out = {"depth": [], "block": [], "part": [], "cells": []}
    for row in range(DEPTH):
        cells, count = np.unique(_cells(gram, row, width), return_counts=True)
        cells = np.repeat(cells, np.minimum(count, 2))
        blocks, at = np.unique(cells >> np.uint64(BLOCK_BITS), return_index=True)
        for block, own in zip(blocks.tolist(), np.split(cells, at[1:])):
            out["depth"].append(row)
            out["block"].append(block)
            out["part"].append(part)
            out["cells"].append(_blob((own & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32)))
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))})


def _merge(depth: int, block: int, table: pa.Table) -> pa.Table:
    """Merges one block of all sketches and tells every part which of its cells count two or more."""
    sent = [np.frombuffer(c, np.uint32) for c in table["cells"].to_pylist()]
    total = np.zeros(1 << BLOCK_BITS, np.uint32)
    for cells in sent:
        np.add.at(total, cells, 1) if len(cells) < 1000 else np.add(total, np.bincount(cells, minlength=len(total)).astype(np.uint32), out=total)
    base = np.uint64(block) << np.uint64(BLOCK_BITS)
    answers = []
    for cells in sent:
        again = np.unique(cells[total[cells] > 1])
        answers.append(_blob(again.astype(np.uint64) + base))
    return pa.table({"part": table["part"], "depth": pa.array([depth] * len(answers), pa.int32()),
                     "cells": pa.array(answers, pa.binary())})


def _candidates(w: Windows, replies: pa.Table, width: int) -> np.ndarray:
    """Windows that the merged sketch counts at least twice: the minimum of its rows decides."""
    again = np.ones(len(w.start), bool)
    depth = replies["depth"].to_numpy()
    cells = replies["cells"].to_pylist()
    for row in range(DEPTH):
        own = [np.frombuffer(c, np.uint64) for c, d in zip(cells, depth) if d == row]
        again &= np.isin(_cells(w.gram, row, width), np.concatenate(own) if own else np.zeros(0, np.uint64))
    return np.flatnonzero(again)


def _ask(part: int, table: pa.Table, replies: pa.Table, width: int, buckets: int) -> pa.Table:
    """The part's candidate windows, each distinct one once with its smallest key, packed by bucket of their run."""
    out = {"bucket": [], "part": [], "grams": [], "docs": [], "sizes": [], "hashes": []}
    if len(table):
        w = windows_of(table["k"], table["notes"])
        some = _candidates(w, replies, width)
        # distinct windows, the smallest key first
        by = some[np.lexsort((w.doc[some], w.own[some]))]
        first = by[np.concatenate([[True], w.own[by][1:] != w.own[by][:-1]])] if len(by) else by
        bucket = (mix64(w.gram[first]) % np.uint64(buckets)).astype(np.int64)
        first = first[np.lexsort((first, bucket))]
        bucket = (mix64(w.gram[first]) % np.uint64(buckets)).astype(np.int64)
        names, at = np.unique(bucket, return_index=True)
        for name, own in zip(names.tolist(), np.split(first, at[1:])):
            # neighbours share run and note: these are sent once
            gram, doc = w.gram[own], w.doc[own]
            cut = np.concatenate([[0], np.flatnonzero((gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])) + 1])
            out["bucket"].append(name)
            out["part"].append(part)
            out["grams"].append(_blob(gram[cut]))
            out["docs"].append(_blob(doc[cut]))
            out["sizes"].append(_blob(np.diff(np.append(cut, len(own))).astype(np.int32)))
            out["hashes"].append(_blob(w.own[own]))
    types = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})


def _resolve(table: pa.Table) -> pa.Table:
    """Groups one bucket's windows exactly; tells each part which of its windows start in a smaller key elsewhere."""
    rows = table.to_pylist()
    sizes = [np.frombuffer(r["sizes"], np.int32) for r in rows]
    gram = np.concatenate([np.repeat(np.frombuffer(r["grams"], np.uint64), s) for r, s in zip(rows, sizes)])
    doc = np.concatenate([np.repeat(np.frombuffer(r["docs"], np.int64), s) for r, s in zip(rows, sizes)])
    own = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
    by = np.lexsort((gram, own))
    new = np.concatenate([[True], (own[by][1:] != own[by][:-1]) | (gram[by][1:] != gram[by][:-1])])
    least = np.minimum.reduceat(doc[by], np.flatnonzero(new))
    later = np.zeros(len(own), bool)
    later[by] = doc[by] > least[np.cumsum(new) - 1]
    ends = np.cumsum([s.sum() for s in sizes])
    found = [own[a:b][later[a:b]] for a, b in zip(np.append(0, ends[:-1]), ends)]
    return pa.table({"part": table["part"], "hashes": pa.array([_blob(f) for f in found], pa.binary())})


def _cut(table: pa.Table, answers: pa.Table, name: str) -> pa.Table:
    """Takes the removed windows out of a part's notes."""
    w = windows_of(table["k"], table["notes"])
    gone = np.zeros(len(w.start), bool)
    if len(w.start):
        by = np.argsort(w.own, kind="stable")
        new = np.concatenate([[True], w.own[by][1:] != w.own[by][:-1]])
        least = np.minimum.reduceat(w.doc[by], np.flatnonzero(new))
        within = np.zeros(len(by), bool)
        within[by] = w.doc[by] > least[np.cumsum(new) - 1]
        found = [np.frombuffer(h, np.uint64) for h in answers["hashes"].to_pylist()]
        gone = within | np.isin(w.own, np.concatenate(found) if found else np.zeros(0, np.uint64))
    cover = np.zeros(int(w.firsts[-1]) + 1, np.int32)
    cover[w.start[gone]] += 1
    cover[w.start[gone] + WINDOW] -= 1
    left = np.cumsum(cover)[:-1] == 0
    removed, digest = [], []
    for at in range(len(table)):
        words = w.raw[w.bounds[at]:w.bounds[at + 1]].split()
        own = left[w.firsts[at]:w.firsts[at + 1]]
        removed.append(len(words) - int(own.sum()))
        digest.append(hashlib.sha256(b" ".join(words if not removed[-1] else compress(words, own.tolist()))).hexdigest())
    return pa.table({name: table["k"], "n_words": pa.array(np.diff(w.firsts).astype(np.int64)),
                     "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})


def cut_repeated_passages(runs: DataFrame, *, key: str = "run_id", notes: str = "notes") -> DataFrame:
    """Removes from the notes of runs what stands word for word in the notes of an earlier run.

    A window is 50 consecutive words of one note. Every word under a window that also
    starts in a note with a smaller key is removed; windows are judged on the input.
    Returns (key, n_words, n_removed, kept_sha256) per input row, the digest being that of
    the kept words joined by one space. NULL notes have no words. NULL keys count as the
    largest; equal keys never remove from each other. Repeated rows are kept, other
    columns ignored, an empty table gives no rows.

    First pass: each part of the notes counts its windows in a sparse count-min sketch,
    and the merged sketch tells the parts which cells count two or more. A window counts
    through its smallest run of 25 words, which all its copies share, so thirteen windows
    cost one count. Second pass: windows estimated repeated, each once per part, are
    grouped exactly by a 64-bit hash within their run's 64-bit hash. Last pass: notes are
    cut. Parts, blocks and buckets follow the input's size, a passage that all notes
    share is one entry per part, and nothing is broadcast.
    """
    spark = runs.sparkSession
    ship_package(spark)
    rows = runs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(notes), F.lit("")).alias("notes"))
    size = rows.agg(F.sum(F.octet_length("notes"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    words = size // BYTES_PER_WORD
    blocks = max(1, -(-words * 2 * CELLS_PER_GRAM // (WINDOW - GRAM + 2) >> BLOCK_BITS))
    width, buckets = blocks << BLOCK_BITS, max(1, -(-words // WINDOWS_PER_TASK))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("k", "notes"), F.lit(parts)).cast("int"))
    rows = rows.repartition(parts, "part")  # the notes move once; Spark reuses this exchange in all passes

    sketch = rows.groupBy("part").applyInArrow(lambda key, t: _sketch(key[0].as_py(), t, width),
                                               "depth int, block long, part int, cells binary")
    replies = sketch.groupBy("depth", "block").applyInArrow(lambda key, t: _merge(key[0].as_py(), key[1].as_py(), t),
                                                            "part int, depth int, cells binary")
    asked = rows.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(
        lambda key, t, r: _ask(key[0].as_py(), t, r, width, buckets),
        "bucket long, part int, grams binary, docs binary, sizes binary, hashes binary")
    answers = asked.groupBy("bucket").applyInArrow(_resolve, "part int, hashes binary")
    schema = runs.select(F.col(key).cast("long").alias(key)).schema.add("n_words", "long").add(
        "n_removed", "long").add("kept_sha256", "string")
    return rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        lambda t, a: _cut(t, a, key), schema)
