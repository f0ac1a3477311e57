"""Phrases against plain counts, and the graph's paths against the words they stand for."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from motionframe.llm import phrases


def brute(rows, least, top=None):
    """rows: (dataset, text)."""
    f, n = defaultdict(Counter), Counter()
    for d, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[d] += len(w)
            for k in (1, 2, 3, 4):
                for i in range(len(w) - k + 1):
                    f[d][tuple(w[i:i + k])] += 1
    out = []
    for d, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in some.items():
            longer = [b for q, b in some.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, at = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:at]], c[p[at:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((d, rank, p.decode(), -a, left, right, n[d], -score))
    return out


def check(df, rows, least, top=None):
    got = [tuple(r) for r in phrases.mine_phrases(df, least=least, top=top).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows, least, top)))


@pytest.fixture
def prose():
    """Few words, many repeated passages, pieces of all lengths, case and odd white space."""
    rng = np.random.RandomState(11)
    passage = [f"p{i}" for i in range(25)]
    rows = []
    for i in range(120):
        w = [f"w{x}" for x in np.minimum(rng.geometric(0.3, rng.randint(0, 40)), 20)]
        if i % 2:
            at, size = rng.randint(0, 20), rng.randint(1, 25)
            w[len(w) // 2:len(w) // 2] = passage[at:at + size]
        text = ""
        for x in w:
            text += (x.upper() if rng.rand() < .1 else x) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ", ", "\r\n"])
        rows.append((["en", "de", None][i % 3], text))
    return rows


@pytest.mark.parametrize("least, top", [(1, None), (3, None), (8, 5), (1000, None)])
def test_prose(spark, prose, least, top):
    df = spark.createDataFrame([(i, t, d, 1, "x") for i, (d, t) in enumerate(prose)], "run_id long, notes string, dataset string, n long, w string")
    check(df, prose, least, top)


def test_periodic_and_shared_notes(spark):
    """Cycles of the graph, copies, and a third of all notes being one passage."""
    texts = ["a b " * 40, "x " * 30, "a b a c " * 9 + "d"] + ["one two three four five six"] * 40
    rows = [("s", t) for t in texts]
    check(spark.createDataFrame([(i, t, d) for i, (d, t) in enumerate(rows)], "run_id long, notes string, dataset string"), rows, 2)


def test_awkward_notes(awkward):
    rows = [(r.dataset, r.notes) for r in awkward.select("dataset", "notes").collect()]
    check(awkward, rows, 2, 50)


def test_empty_table(make):
    assert phrases.mine_phrases(make([])).count() == 0
    assert phrases.mine_phrases(make([None, "", " .,; "])).count() == 0


def test_unary_paths_are_compacted():
    """A passage without branches is one path; every edge of the part is in one path, with its weight."""
    passage = " ".join(f"p{i}" for i in range(50))
    notes = [passage, passage, "q " + passage + " r", "p1 p2 p3 p9"]
    pieces = phrases.Pieces(pa.table({"notes": pa.chunked_array([notes]), "dataset": pa.chunked_array([["a"] * 4])}))
    out = phrases._paths_of(pieces, np.minimum(pieces.left, 4))
    paths = [(w.split(), n) for w, p, n in zip(out["words"], out["path"], out["n"]) if p]
    edges = Counter()
    for w, n in paths:
        for i in range(len(w) - 3):
            assert tuple(w[i:i + 4]) not in edges
            edges[tuple(w[i:i + 4])] = n
    want = Counter(tuple(t.split()[i:i + 4]) for t in notes for i in range(len(t.split()) - 3))
    assert edges == want
    assert max(len(w) for w, _ in paths) > 40 and len(paths) < 8
