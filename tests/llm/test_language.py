"""Language of notes: backoff by hand, held-out accuracy, awkward input."""

import numpy as np
import pytest

from motionframe.llm import language


@pytest.fixture(scope="module")
def speech():
    rng = np.random.RandomState(2)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ei"], "cc": ["eau", "tion", "ré"]}
    def note(lang):
        return " ".join("".join(rng.choice(parts[lang], rng.randint(1, 5))) for _ in range(rng.randint(3, 30)))
    return [(lang, note(lang)) for lang in sorted(parts) for _ in range(80)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0.0, 9) for i, (lang, t) in enumerate(rows)],
                                 "run_id long, notes string, lang string, lang_pred string, score double, n int")


def test_held_out_accuracy(spark, speech):
    df = frame(spark, speech).withColumn("held_out", language.held_out("run_id"))
    counts = language.language_counts(df.where("NOT held_out"))
    got = language.detect_language(df, counts, keep=("held_out",)).where("held_out").collect()
    assert len(got) > 30
    assert np.mean([r.lang_pred == speech[r.run_id][0] for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_backoff_takes_the_longest_known_piece():
    model = language.BackoffModel([("x", 0, "known", 3), ("y", 0, "known", 1), ("x", 1, "k", 5), ("x", 3, " kn", 2),
                                   ("y", 2, "ow", 2), ("y", 1, "s", 1)])
    assert model.word("known") == (model.rows[0]["known"],)
    assert model.word("knows") == (model.rows[3][" kn"], model.rows[2]["ow"], model.rows[1]["s"], model.unseen)
    assert model.note("known")[0] == "x" and model.note("owowow")[0] == "y"


def test_counts_equal_a_plain_count(spark):
    rows = [("a", "One one two"), ("a", "ÜBER zwei2drei"), (None, "left out"), ("b", None), ("b", "one")]
    got = {(r.language, r.n, r.item): r["count"] for r in language.language_counts(frame(spark, rows)).collect()}
    words = {"a": {"one": 2, "two": 1, "über": 1, "zwei": 1, "drei": 1}, "b": {"one": 1}}
    want = {}
    for lang, ws in words.items():
        for w, c in ws.items():
            want[lang, 0, w] = c
            t = f" {w} "
            for n in range(1, language.LONGEST_GRAM + 1):
                for i in range(len(t) - n + 1):
                    want[lang, n, t[i:i + n]] = want.get((lang, n, t[i:i + n]), 0) + c
    assert got == want


def test_awkward_notes(spark, awkward, speech):
    counts = language.language_counts(frame(spark, speech))
    got = language.detect_language(awkward, counts, keep=("k", "notes")).collect()
    assert len(got) == awkward.count()
    for r in got:
        und = not any(c.isalpha() for c in r.notes or "")
        assert (r.lang_pred == "und") == und and (r.score == 0) == und
    for odd in ("½ ² ٣ 123 _", "\U0001f600"):
        assert language.BackoffModel([("x", 0, "a", 1)]).note(odd) == ("und", 0.0)


def test_nothing_learnt_and_empty(spark, make):
    none = language.language_counts(make(["some words"]))  # no labels
    assert none.count() == 0
    assert [tuple(r) for r in language.detect_language(make(["some words"]), none).collect()] == [(0, "und", 0.0)]
    assert language.detect_language(make([]), none).count() == 0


def test_held_out_is_a_quarter_and_never_null(spark):
    import zlib
    got = spark.range(500).select("id", language.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
    assert spark.sql("SELECT cast(NULL AS long) AS id").select(language.held_out("id").alias("h")).first().h is False


def test_longest_grams_are_kept(spark):
    words = ["".join("abcdefghij"[int(d)] for d in f"{i:05d}") for i in range(6_000)]
    rows = [("aa", " ".join(words[i::50])) for i in range(50)]
    kept, every = (language.language_counts(frame(spark, rows), **own).where("n = 5").count() for own in ({}, {"grams": 10**6}))
    assert kept == every > 12_000


def test_whole_table_against_a_plain_version(spark):
    """op5 over all documents of the smallest tables: counts, backoff and shares written out anew."""
    import math
    import unicodedata
    import zlib
    from collections import Counter, defaultdict

    from motionframe.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()

    def words(text):
        out, run = Counter(), ""
        for c in (text or "").lower() + " ":
            if unicodedata.category(c).startswith("L"):
                run += c
            elif run:
                out[run] += 1
                run = ""
        return out

    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in docs}
    counts = [defaultdict(Counter) for _ in range(6)]
    for d, text, lang in docs:
        if lang is not None and text is not None and not held[d]:
            for w, n in words(text).items():
                counts[0][lang][w] += n
                for size in range(1, 6):
                    for i in range(len(w) + 2 - size + 1):
                        counts[size][lang][f" {w} "[i:i + size]] += n
    assert max(len(c) for table in counts for c in table.values()) <= 20_000  # below the documented bounds
    langs = sorted(counts[0])
    known = [set().union(*table.values()) for table in counts]

    def log(size, lang, item):
        total = sum(counts[size][lang].values()) + 0.5 * (len(known[size]) + 1)
        return math.log((counts[size][lang][item] + 0.5) / total)

    totals = {}

    def note(text):
        own = words(text)
        if not own:
            return "und", 0.0
        score = dict.fromkeys(langs, 0.0)
        for w, n in own.items():
            if w not in totals:
                parts = []
                if w in known[0]:
                    parts = [(0, w)]
                else:
                    rest = f" {w} "
                    while rest:
                        size = next((s for s in range(min(5, len(rest)), 0, -1) if rest[:s] in known[s]), 0)
                        parts.append((size or 1, rest[:size or 1]))
                        rest = rest[size or 1:]
                totals[w] = {lang: sum(log(s, lang, p) for s, p in parts) for lang in langs}
            for lang in langs:
                score[lang] += n * totals[w][lang]
        best = max(langs, key=lambda x: score[x])
        return best, 1 / sum(math.exp(min(score[x] - score[best], 0)) for x in langs)

    got = {r.doc_id: r for r in queries.QUERIES["op5_detect_language"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d, text, _ in docs:
        lang, share = note(text)
        assert got[d].held_out == held[d] and got[d].lang_pred == lang and abs(got[d].score - share) < 1e-6, d
