"""The language model against plain dictionaries, and what it gains on notes it has not seen."""

import math
from collections import Counter

import numpy as np
import pytest

from motionframe.llm import grams, interpolation, queries


def brute(rows, drawn):
    """rows: (key, text, learns) in order; drawn: places of the tuning notes."""
    def tokens(text):
        return [w.lower() for w in (text or "").encode().split()] + ["end"]

    def count(places):
        c = {1: Counter(), 2: Counter(), 3: Counter()}
        for i in places:
            t = ["begin", "begin", *tokens(rows[i][1])]
            for at in range(2, len(t)):
                for w in (1, 2, 3):
                    c[w][tuple(t[at - w + 1:at + 1])] += 1
            c[2][("begin", "begin")] += 1
            c[1][("begin",)] += 1
        return c

    learns = [i for i, r in enumerate(rows) if r[2]]
    whole, kept = count(learns), count([i for i in learns if i not in drawn])
    n = sum(c for g, c in whole[1].items() if g != ("begin",))
    v = sum(1 for g in whole[1] if g != ("begin",))
    n_kept = sum(c for g, c in kept[1].items() if g != ("begin",))

    def parts(c, total, text):
        t = ["begin", "begin", *tokens(text)]
        for at in range(2, len(t)):
            x2, x3 = c[1][(t[at - 1],)], c[2][tuple(t[at - 2:at])]
            yield c[1][(t[at],)], c[2][tuple(t[at - 1:at + 1])], c[3][tuple(t[at - 2:at + 1])], x2, x3, total

    bucket = lambda x: x.bit_length() - 1
    l1, l2, l3, reached = 0.5, [0.5] * 48, [0.5] * 48, set()
    for _ in range(interpolation.ROUNDS):
        got, of = Counter(), Counter()
        for i in drawn:
            for c1, c2, c3, x2, x3, total in parts(kept, n_kept, rows[i][1]):
                a3 = l3[bucket(x3)] if x3 else 0
                a2 = l2[bucket(x2)] if x2 else 0
                w3 = a3 * c3 / x3 if x3 else 0
                w2 = (1 - a3) * a2 * c2 / x2 if x2 else 0
                w1 = (1 - a3) * (1 - a2) * l1 * c1 / max(total, 1)
                w0 = (1 - a3) * (1 - a2) * (1 - l1) / (v + 1)
                s = w3 + w2 + w1 + w0
                if x3:
                    got[3, bucket(x3)] += w3 / s
                    of[3, bucket(x3)] += 1
                if x2:
                    got[2, bucket(x2)] += w2 / s
                    of[2, bucket(x2)] += (w2 + w1 + w0) / s
                got[1, 0] += w1 / s
                of[1, 0] += (w1 + w0) / s
        moved = 0
        for (w, b), o in of.items():
            new = round(got[w, b] / o, 6)
            table = {2: l2, 3: l3}.get(w)
            moved = max(moved, abs(new - (l1 if w == 1 else table[b])))
            reached.add((w, b))
            if w == 1:
                l1 = new
            else:
                table[b] = new
        if moved < interpolation.CHANGE:
            break
    for w, table in ((2, l2), (3, l3)):
        for b in range(1, 48):
            if (w, b) not in reached:
                table[b] = table[b - 1]
    out = []
    for _, text, _ in rows:
        base = score = known = size = 0
        for c1, c2, c3, x2, x3, total in parts(whole, n, text):
            p = l1 * c1 / n + (1 - l1) / (v + 1) if n else 1.0
            if x2:
                p = l2[bucket(x2)] * c2 / x2 + (1 - l2[bucket(x2)]) * p
            if x3:
                p = l3[bucket(x3)] * c3 / x3 + (1 - l3[bucket(x3)]) * p
            base += math.log10(c1 + 1) - math.log10(n + v + 1)
            score += math.log10(p)
            known += c1 > 0
            size += 1
        out.append((size, known, n, base, score))
    return out


def check(df, rows, spark, share=interpolation.TUNING_SHARE):
    from pyspark.sql import functions as F

    keys = spark.createDataFrame([(k,) for k, _, _ in rows], "k long")
    draw = [r[0] for r in keys.select(F.pmod(F.xxhash64("k", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))).collect()]
    drawn = {i for i, d in enumerate(draw) if d and rows[i][2]}
    want = [(r[0], *b) for r, b in zip(rows, brute(rows, drawn=drawn))]
    got = [tuple(r) for r in interpolation.note_scores(df, tuning_share=share).collect()]
    assert len(got) == len(want)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    for a, b in zip(sorted(got, key=order), sorted(want, key=order)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-10, abs=1e-9) and a[5] == pytest.approx(b[5], rel=2e-5, abs=1e-9), (a, b)
    return drawn


def with_learn(df, every=5):
    from pyspark.sql import functions as F

    return df.withColumn("learn", F.coalesce(F.col("run_id") % every != 2, F.lit(True)))


def test_random_notes(spark, make):
    rng = np.random.RandomState(3)
    notes = [" ".join(f"W{x}" for x in np.minimum(rng.geometric(0.2, rng.randint(0, 60)), 30)) for _ in range(150)]
    notes[7] = notes[8] = notes[9]
    rows = [(i, t, i % 5 != 2) for i, t in enumerate(notes)]
    assert len(check(with_learn(make(notes)), rows, spark, 1 / 8)) > 5


def test_awkward_notes(spark, awkward):
    df = with_learn(awkward)
    check(df, [tuple(r) for r in df.select("run_id", "notes", "learn").collect()], spark)


@pytest.mark.parametrize("learn", ["false", "cast(null as boolean)"])
def test_nothing_to_learn_from(make, learn):
    got = interpolation.note_scores(make(["a b", None]).selectExpr("*", f"{learn} as learn")).orderBy("run_id").collect()
    assert [tuple(r) for r in got] == [(0, 3, 0, 0, 0.0, 0.0), (1, 1, 0, 0, 0.0, 0.0)]


def test_empty_table_and_clashing_names(make):
    empty = make([]).selectExpr("run_id", "notes", "true as learn", "1 as fold", "2 as seen", "3 as n_tokens", "4 as k", "5 as part")
    assert interpolation.note_scores(empty).count() == 0
    again = make(["a b a"]).selectExpr("run_id", "notes", "true as learn", "1 as fold", "2 as seen", "3 as score", "4 as c1")
    assert interpolation.note_scores(again).columns == ["run_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert interpolation.note_scores(again).first().n_tokens == 4


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_words_hash_alike_in_any_slices(size):
    from motionframe.llm.words import hash_words, split_words

    raw = np.frombuffer(b" one two  one three\n" * 9 + b"two", np.uint8)
    starts, ends, _ = split_words(raw, np.array([0, len(raw)]))
    assert (grams.word_hashes(raw, starts, ends, size) == hash_words(raw, starts, ends)).all()


def test_packing_round_trip():
    rng = np.random.RandomState(0)
    for values in ([], [0], [0, 0], [255, 256], rng.randint(0, 1 << 62, 1000), [2**64 - 1]):
        values = np.array(values, np.uint64)
        assert grams.unpack(grams.pack(values), len(values)).tolist() == values.tolist()


def test_held_out_notes_are_likelier_than_under_the_base(spark):
    found = queries.QUERIES["op13_note_scores"](spark, "/root/testdata/sf0.01").toPandas()
    held = found[found.held_out]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    assert sorted(found.doc_id) == sorted(docs.doc_id)
    assert held.score.sum() > 0.85 * held.base_score.sum() and (found.score <= 1e-9).all()
    counts = Counter()
    learn = set(found[~found.held_out].doc_id)
    for d, t in zip(docs.doc_id, docs.text):
        if d in learn:
            counts.update([*(w.lower() for w in t.encode().split()), "end"])
    n, v = sum(counts.values()), len(counts)
    row = found.set_index("doc_id")
    for d, t in list(zip(docs.doc_id, docs.text))[:200]:
        tokens = [*(w.lower() for w in t.encode().split()), "end"]
        want = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        assert row.base_score[d] == pytest.approx(want, rel=1e-9) and row.n_tokens[d] == len(tokens) and row.train_tokens[d] == n
