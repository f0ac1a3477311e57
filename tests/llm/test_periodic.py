"""Periodic runs against plain comparison of all periods."""

import hashlib
import random

import numpy as np
import pytest

from motionframe.llm import periodic, queries


def brute(words, least_words=6, least_periods=4):
    """(start, length, period) of all runs."""
    n, out = len(words), {}
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least_words, least_periods * q):
                out.setdefault((i, size), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def report(text, runs):
    words = (text or "").encode().split()
    gone = [False] * len(words)
    for s, n, q in runs:
        gone[s + q:s + n] = [True] * (n - q)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2]))).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest())


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_random_notes(seed):
    rng = random.Random(seed)
    for _ in range(120):
        notes = []
        for _ in range(rng.randint(0, 6)):
            n, kinds = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5])
            w = [rng.randint(1, kinds) for _ in range(n)]
            if rng.random() < .4 and n:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            notes.append(w)
        periods = rng.choice([2, 3, 4])
        got = periodic.runs_of(np.array(sum(notes, []), np.uint64), np.cumsum([0] + [len(w) for w in notes]), 6, periods)
        want = [(d, *r) for d, w in enumerate(notes) for r in brute(w, 6, periods)]
        assert [tuple(r) for r in got.tolist()] == sorted(want, key=lambda r: (r[0], r[1], r[3]))


def test_long_notes(make):
    """Periods of thousands of words, runs within runs, and one word over and over."""
    unit = [f"w{i}" for i in range(3_000)]
    notes = [" ".join(unit * 4 + ["z"]), " ".join((["a", "b"] * 5 + ["c"]) * 9), " ".join(["x"] * 30_000), " ".join(unit)]
    got = {r[0]: tuple(r)[1:] for r in periodic.periodic_runs(make(notes)).collect()}
    assert got[0][:5] == (1, 0, 12_000, 3_000, 4_000) and got[2][:5] == (1, 0, 30_000, 1, 30_000_000) and got[3][0] == 0
    assert got[1] == report(notes[1], brute(notes[1].split()))


def test_awkward_notes(awkward):
    rows = awkward.select("run_id", "notes").collect()
    got = sorted(map(str, (tuple(r) for r in periodic.periodic_runs(awkward).collect())))
    want = sorted(str((k, *report(t, brute((t or "").encode().split()) if len(t or "") < 1000 else [(0, 60_000, 977)]))) for k, t in rows)
    assert got == want


def test_empty_table_and_clashing_names(make):
    assert periodic.periodic_runs(make([])).count() == 0
    again = make(["a a a a a a b"]).selectExpr("run_id", "notes", "1 as start", "2 as _text", "3 as n_runs", "4 as period")
    assert tuple(periodic.periodic_runs(again).first())[:6] == (0, 1, 0, 6, 1, 6000)


def test_query_plants_and_finds(spark):
    """The whole smallest table against the contract in plain Python."""
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d, text in docs:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(d).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert got[d] == report(" ".join(w.decode() for w in words), brute(words)), d
