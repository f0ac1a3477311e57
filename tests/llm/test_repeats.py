"""Repeated passages against a plain dictionary of windows."""

import hashlib

import numpy as np
import pytest

from motionframe.llm import repeats


def brute(rows):
    """rows: (key, text). NULL keys count as the largest."""
    order = lambda k: (k is None, k or 0)
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (k, _), w in zip(rows, words):
        for a in range(len(w) - 49):
            g = tuple(w[a:a + 50])
            first[g] = min(first.get(g, (True, 1 << 62)), order(k))
    out = []
    for (k, _), w in zip(rows, words):
        gone = np.zeros(len(w), bool)
        for a in range(len(w) - 49):
            if first[tuple(w[a:a + 50])] < order(k):
                gone[a:a + 50] = True
        out.append((k, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def check(df, rows):
    got = [tuple(r)[:4] for r in repeats.cut_repeated_passages(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_planted_passages(spark, make):
    rng = np.random.RandomState(4)
    own = lambda n: [f"w{x}" for x in rng.randint(0, 10**6, n)]
    shared = own(120)
    notes = []
    for i in range(60):
        w = own(rng.randint(0, 150))
        if i % 3 == 0:  # a passage, cut at different places, 49 words at least
            a = rng.randint(0, 60)
            w[len(w) // 2:len(w) // 2] = shared[a:a + rng.randint(49, 62)]
        notes.append(" \n".join(w) if i % 2 else "\t ".join(w))
    notes += notes[:10]  # copies
    notes.append(" ".join(shared[:80] * 3))  # repeats within one note stay unless seen earlier
    df = make(notes)
    check(df, list(enumerate(notes)))


def test_awkward_notes(spark, awkward):
    check(awkward, [(r.run_id, r.notes) for r in awkward.select("run_id", "notes").collect()])


def test_empty_table(spark, make):
    assert repeats.cut_repeated_passages(make([])).count() == 0


@pytest.mark.parametrize("width", [1, 5, 26])
def test_sliding_argmin(width):
    v = np.random.RandomState(0).randint(0, 9, 100).astype(np.uint64)
    want = [i + int(v[i:i + width].argmin()) for i in range(101 - width)]
    assert repeats.sliding_argmin(v, width).tolist() == want
