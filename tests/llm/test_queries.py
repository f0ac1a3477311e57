"""Registered queries: SQL where there is one, contracts and the pipeline on the smallest tables."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from checks.compare import compare
from motionframe.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    result, _ = compare(spark, SMALL, queries.QUERIES[name], queries.SQL[name])
    assert result.startswith("ok"), result


def test_totals_of_repeated_rows_and_doc_ids(spark, tmp_path):
    docs = [(1, "one two"), (2, "one two"), (2, "one two"), (3, "one two"), (3, "three"), (4, "three"), (4, "one two"), (4, "one two"),
            (5, None), (6, ""), (6, ""), (None, "one two"), (None, "three"), (None, "own"), (7, "a\na\nb"), (7, "a\na\nb"), (7, "a\nb")]
    for i, rows in enumerate([docs[:3], [(1, "a"), (2, "a"), (2, "b")], docs]):
        columns = {"doc_id": pa.array([k for k, _ in rows], pa.int64()), "source": ["s" if k != 6 else None for k, _ in rows],
                   "lang": ["en" if k != 3 else None for k, _ in rows], "text": [t for _, t in rows]}
        (tmp_path / str(i)).mkdir()
        pq.write_table(pa.table(columns), tmp_path / str(i) / "documents.parquet")
        result, _ = compare(spark, str(tmp_path / str(i)), queries.QUERIES["op10_token_totals"], queries.SQL["op10_token_totals"])
        assert result.startswith("ok"), (rows, result)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name, columns", [
    ("op2_cut_repeated_passages", ["doc_id", "n_words", "n_removed", "kept_sha256"]),
    ("op4_near_duplicate_notes", ["doc_id", "fingerprint", "component_id"]),
    ("op5_detect_language", ["doc_id", "held_out", "lang_pred", "score"]),
    ("op8_token_ids", ["doc_id", "start", "n_tokens", "ids_crc32"]),
    ("op9_moderate_notes", ["doc_id", "p_low_quality", "low_quality", "p_toxic", "toxic"])])
def test_one_row_per_document(spark, name, columns):
    got = queries.QUERIES[name](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id")
    assert got.columns == columns
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in docs.collect())


def test_pipeline_equals_its_stages_by_hand(spark):
    """Each stage's decision is recomputed from the operators' own results on that stage's input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    from tests.llm.test_fingerprints import brute_components, brute_print
    from tests.llm.test_leaks import brute
    from tests.llm.test_mixing import brute as brute_mix
    from motionframe.llm import leaks

    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = frame.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["identify_language", "drop_near_duplicates", "drop_leaks", "mix_sources", "write_tokens"]
    step = stages["identify_language"](spark, frame, SMALL)
    keep = docs[docs.text.fillna("").map(lambda t: any(c.isalpha() for c in t))]
    assert step.columns == columns and sorted(step.toPandas().doc_id) == sorted(keep.doc_id)
    step = stages["drop_near_duplicates"](spark, step, SMALL)
    comps = brute_components([brute_print(t) for t in keep.text], keep.doc_id.tolist())
    assert step.columns == columns and sorted(step.toPandas().doc_id) == sorted(set(comps))
    kept = keep[keep.doc_id.isin(comps)]
    items = [(i, leaks.plain(t)) for i, t in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    step = stages["drop_leaks"](spark, step, SMALL)
    clean = set(step.toPandas().doc_id)
    for d, t in zip(kept.doc_id, kept.text):
        exact = any(i in leaks.plain(t) for _, i in items)
        assert not (exact and d in clean)
        if d not in clean and not exact:
            assert any(brute(i, leaks.plain(t)) <= int(len(i) * leaks.ERROR_SHARE) for _, i in items)
    mixed = stages["mix_sources"](spark, step, SMALL)
    assert mixed.columns == columns
    count = mixed.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    rows = step.toPandas()
    assert set(count.index) <= clean and count.max() <= 3
    words = rows.set_index("doc_id").text.map(lambda t: len(t.split()))
    target, _ = brute_mix([(d, s, int(words[d])) for d, s in zip(rows.doc_id, rows.source)])
    took = (mixed.toPandas().assign(n=lambda f: f.doc_id.map(words)).groupby("source").n.sum())
    for s, t in target.items():
        own = words[rows[rows.source == s].doc_id]
        assert abs(took.get(s, 0) - t) <= own.max()
    last = stages["write_tokens"](spark, mixed, SMALL).toPandas().sort_values("start")
    assert len(last) == mixed.count() and last.start.iloc[0] == 0
    assert (last.start.values[1:] == (last.start + last.n_tokens).values[:-1]).all()
    assert corpus_pipeline.run(spark, SMALL).count() == len(last)


CLASHING = ("score", "lang_pred", "_row", "leaks", "_copies", "_copy", "k", "part", "fp", "LEAKS_")


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Documents with columns named as what the stages use inside; NULLs, blanks, repeats, a NULL id."""
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    texts = ["plain words of some length here", None, "", "1 2 3", "plain words of some length here", f"x {item} y", "ein ganz anderer Text mit Wörtern"]
    rows = [(i, t, "en" if i % 2 else None, "a" if i % 3 else None, len(t or ""), *[f"{c}{i}" for c in CLASHING]) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "no id at all in this one", "en", "b", 1, *CLASHING)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_clashing_columns(spark, odd_docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd_docs, SMALL)
    assert got.columns == odd_docs.columns
    rows = [tuple(r) for r in got.collect()]
    known = [tuple(r) for r in odd_docs.collect()]
    langless = lambda r: (*r[:2], *r[3:])
    assert rows and {langless(r) for r in rows} <= {langless(r) for r in known}
    ids = sorted((r[0] is None, r[0] or 0) for r in rows)
    if name == "identify_language":
        assert ids == [(False, 0), (False, 0), (False, 4), (False, 5), (False, 6), (True, 0)]
        assert all(r[2] for r in rows)
    if name == "drop_near_duplicates":
        assert ids == [(False, 0), (False, 1), (False, 3), (False, 5), (False, 6), (True, 0)]
    if name == "drop_leaks":
        assert [i for i in ids if i == (False, 5)] == [] and len(ids) == len(known) - 1
    assert stage(spark, odd_docs.limit(0), SMALL).collect() == [] and stage(spark, odd_docs.limit(0), SMALL).columns == odd_docs.columns


def test_last_stage_on_odd_documents(spark, odd_docs):
    got = corpus_pipeline.write_tokens(spark, odd_docs, SMALL).orderBy("start").collect()
    assert len(got) == odd_docs.count() and got[0].doc_id is None and got[0].start == 0
    assert [r.n_tokens for r in got if r.doc_id in (1, 2)] == [1, 1]
    assert corpus_pipeline.write_tokens(spark, odd_docs.limit(0), SMALL).count() == 0
