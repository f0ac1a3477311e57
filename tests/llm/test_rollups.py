"""Rollups kept by signed batches against a recount."""

import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motionframe.llm import rollups

SCHEMA = "run_id long, dataset string, lang string, notes string, d_tokens long, tokenizer_version string"
VERSIONS = {"words-1": rollups.pattern_counter(rollups.WORDS_1), "pieces-1": rollups.pattern_counter(rollups.PIECES_1)}


def recount(notes):
    out = {}
    for d, lang, t in notes:
        for v, pattern in (("words-1", r"[^\x20\x09-\x0D]+"), ("pieces-1", r"[^\W\d_]+|\d+|[^\s\w]|_")):
            n, c = out.get((d, lang, v), (0, 0))
            out[d, lang, v] = (n + 1, c + len(re.findall(pattern, t or "")))
    return out


def totals(spark, ledger):
    return {(r.dataset, r.lang, r.tokenizer_version): (r.n_notes, r.n_tokens) for r in rollups.token_totals(spark, ledger).collect()}


def test_batches_add_up_and_repeat_safely(spark, tmp_path):
    notes = [(i, f"s{i % 3}" if i % 5 else None, "en" if i % 2 else None, t) for i, t in enumerate(
        ["one two", None, "", "a, b; c!", "x1 y22", "ünï çödé", "a b\tc\nd", "last one here", "w " * 5000, "same", "same"])]
    df = spark.createDataFrame([(*r, 7, "v") for r in notes], SCHEMA)
    ledger = str(tmp_path / "ledger")
    rollups.commit_batch(rollups.inserts(df, VERSIONS), ledger, 1)
    assert totals(spark, ledger) == recount([r[1:] for r in notes])
    revised = [(*r[:3], (r[3] or "") + " more words") if r[0] % 2 else r for r in notes]
    changed = df.where("run_id % 2 = 1").select("dataset", "lang", F.col("notes").alias("notes_before"),
                                                F.concat(F.coalesce("notes", F.lit("")), F.lit(" more words")).alias("notes"))
    for _ in range(3):  # a batch that is committed again replaces itself
        rollups.commit_batch(rollups.revisions(changed, VERSIONS), ledger, 2)
    assert totals(spark, ledger) == recount([r[1:] for r in revised])
    gone = spark.createDataFrame([(*r, 7, "v") for r in revised if r[0] >= 8], SCHEMA)
    rollups.commit_batch(rollups.deletes(gone, VERSIONS), ledger, 3)
    left = recount([r[1:] for r in revised if r[0] < 8])
    assert {k: v for k, v in totals(spark, ledger).items() if v[0]} == left
    assert all(v == (0, 0) for k, v in totals(spark, ledger).items() if k not in left)
    rollups.compact(spark, ledger, str(tmp_path / "small"))
    assert totals(spark, str(tmp_path / "small")) == totals(spark, ledger)


def test_a_compacted_ledger_knows_its_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, "s", "en", "one two", 7, "v")], SCHEMA)
    ledger, small, smaller = (str(tmp_path / n) for n in ("ledger", "small", "smaller"))
    assert totals(spark, ledger) == {}  # nothing committed yet
    for batch in (1, 2):
        rollups.commit_batch(rollups.inserts(df, VERSIONS), ledger, batch)
    rollups.compact(spark, ledger, small)
    want = {("s", "en", "words-1"): (2, 4), ("s", "en", "pieces-1"): (2, 4)}
    for batch in (1, 2, 1):
        rollups.commit_batch(rollups.inserts(df, VERSIONS), small, batch)
        assert totals(spark, small) == want
    for _ in range(2):
        rollups.commit_batch(rollups.inserts(df, VERSIONS), small, 3)
    rollups.compact(spark, small, smaller)
    for batch in (1, 3, 2):
        rollups.commit_batch(rollups.inserts(df, VERSIONS), smaller, batch)
    assert totals(spark, smaller) == {k: (3, 6) for k in want}
    assert sorted(r[0] for r in rollups.compacted_batches(spark, smaller).collect()) == [1, 2, 3]


def test_empty_batch(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    rollups.commit_batch(rollups.inserts(spark.createDataFrame([], SCHEMA), VERSIONS), ledger, 1)
    assert totals(spark, ledger) == {}


def test_counts_of_a_tokenizer_file(spark, awkward, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ledger = str(tmp_path / "ledger")
    rollups.commit_batch(rollups.inserts(awkward, {"bpe-50k": rollups.file_counter(path)}), ledger, 1)
    plain = Tokenizer.from_file(path)
    want = sum(len(plain.encode(r.notes or "", add_special_tokens=False).ids) for r in awkward.select("notes").collect())
    assert totals(spark, ledger) == {(None, None, "bpe-50k"): (awkward.count(), want)}
