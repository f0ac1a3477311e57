"""One registered query per operator: the given tables mapped to the operator and its results back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from motionframe.llm import (
    archives, fingerprints, interpolation, language, leaks, mixing, moderation, neighbours, periodic, phrases, repeats, rollups,
    tokens)
from motionframe.llm.words import WORD, word_count
from motionframe.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORD_SQL = r"[^\x20\x09-\x0D]+"

MIX_SQL = f"""
WITH d AS (
    SELECT doc_id, source, md5(concat_ws('|', '17', doc_id::VARCHAR)) AS h,
           coalesce(len(regexp_extract_all(text, '{WORD_SQL}')), 0)::BIGINT AS size
    FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
    SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::BIGINT AS weight,
           3 * source_size AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / weight AS ratio FROM w),
l AS (
    SELECT *,
        (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS unspent,
        sum(weight) OVER (ORDER BY ratio, source NULLS LAST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS weights FROM r),
f AS (SELECT unspent, weights FROM l WHERE unspent / weights <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (
    SELECT l.source, l.source_size,
        CASE WHEN ratio <= f.unspent / f.weights THEN cap::DOUBLE ELSE weight * f.unspent / f.weights END AS target
    FROM l, f),
q AS (
    SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
        sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
    SELECT *, (upto + copy * source_size)::DOUBLE / target AS finish
    FROM q, (SELECT unnest([0, 1, 2]) AS copy) WHERE target > 0),
g AS (
    SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, doc_id NULLS FIRST, size, copy
                              ROWS UNBOUNDED PRECEDING) AS spent FROM c),
k AS (SELECT doc_id, source, count(*) AS n FROM g WHERE spent <= (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(k.n, 0))::BIGINT AS taken
FROM q LEFT JOIN k ON q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.source IS NOT DISTINCT FROM k.source
"""


@query("op6_mix_datasets", MIX_SQL)
def mix(spark, sf_dir):
    entities = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("entity_id"), F.col("source").alias("dataset"), word_count("text").alias("n_frames"))
    return mixing.mix_datasets(entities).select(
        F.col("entity_id").alias("doc_id"), F.col("n_frames").alias("size"),
        F.col("dataset_size").alias("source_size"), "target", "taken")


@query("op4_near_duplicate_notes")
def near_duplicates(spark, sf_dir):
    runs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.col("text").alias("notes"))
    return fingerprints.near_duplicate_notes(runs).withColumnRenamed("run_id", "doc_id")


@query("op8_token_ids")
def token_ids(spark, sf_dir):
    import public_tokenizers

    runs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.col("text").alias("notes"))
    return tokens.token_ids(runs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("run_id", "doc_id")


ARCHIVE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first,
             row_number() OVER (PARTITION BY payload_digest, page_id) AS n FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR (page_id = first AND n = 1) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 100 OR (page_id = first AND n = 1) THEN NULL ELSE first END AS refers_to
FROM f
"""


@query("op7_archive_round_trip", ARCHIVE_SQL)
def archive_round_trip(spark, sf_dir):
    return archives.archive_round_trip(table(spark, sf_dir, "pages"))


@query("op5_detect_language")
def detect_language(spark, sf_dir):
    runs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("run_id"), F.col("text").alias("notes"), "lang", language.held_out("doc_id").alias("held_out"))
    counts = language.language_counts(runs.where(~F.col("held_out")))
    return language.detect_language(runs, counts, keep=("held_out",)).withColumnRenamed("run_id", "doc_id")


@query("op3_nearest_entities")
def nearest_entities(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("entity_id"), F.col("embedding").alias("features"))
    found = neighbours.nearest_entities(vectors, vectors.where(F.col("entity_id") % 20 == 0), 20)
    return found.withColumnRenamed("entity_id", "vec_id")


@query("op2_cut_repeated_passages")
def cut_repeated_passages(spark, sf_dir):
    runs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.col("text").alias("notes"))
    return repeats.cut_repeated_passages(runs).withColumnRenamed("run_id", "doc_id")


ROLLUP_SQL = rf"""
WITH d AS (
    SELECT doc_id, source, lang, text, array_to_string(list_distinct(string_split(text, chr(10))), chr(10)) AS revised,
           coalesce(doc_id > min(doc_id) OVER (PARTITION BY md5(coalesce(text, ''))), false) AS again FROM documents),
c AS (
    SELECT source, lang, again,
        coalesce(len(regexp_extract_all(revised, '{WORD_SQL}')), 0) AS words,
        coalesce(len(regexp_extract_all(revised, '\p{{L}}+|\p{{N}}+|[^\s\p{{L}}\p{{N}}]')), 0) AS pieces FROM d)
SELECT source AS dataset, lang, v.name AS tokenizer_version, count(*) FILTER (NOT again)::BIGINT AS n_notes,
       coalesce(sum(CASE v.name WHEN 'words-1' THEN words ELSE pieces END) FILTER (NOT again), 0)::BIGINT AS n_tokens
FROM c, (SELECT unnest(['words-1', 'pieces-1']) AS name) v GROUP BY ALL
"""


@query("op10_token_totals", ROLLUP_SQL)
def token_totals(spark, sf_dir):
    """All documents come in; then lines that repeat within one go; then exact copies are deleted.

    The second batch is committed twice, which changes nothing.
    """
    versions = {"words-1": rollups.pattern_counter(rollups.WORDS_1), "pieces-1": rollups.pattern_counter(rollups.PIECES_1)}
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("dataset"), "lang", F.col("text").alias("notes_before"),
        F.array_join(F.array_distinct(F.split("text", "\n")), "\n").alias("notes"))
    digest = F.md5(F.coalesce("notes_before", F.lit("")))
    first = docs.groupBy(digest.alias("digest")).agg(F.min("doc_id").alias("first"))
    # counts instead of texts: each row is moved once, flagged by its own digest and doc_id
    counts = docs.select("doc_id", "dataset", "lang", digest.alias("digest"), *[c("notes").alias(v) for v, c in versions.items()])
    gone = counts.join(first, "digest").where("doc_id > first")
    counted = {v: lambda _, v=v: F.col(v) for v in versions}
    ledger = scratch_dir(spark, "token-totals")
    rollups.commit_batch(rollups.inserts(docs, versions, notes="notes_before"), ledger, 1)
    for _ in range(2):
        rollups.commit_batch(rollups.revisions(docs.where(~F.col("notes_before").eqNullSafe(F.col("notes"))), versions), ledger, 2)
    rollups.commit_batch(rollups.deletes(gone, counted, notes="digest"), ledger, 3)
    return rollups.token_totals(spark, ledger)


@query("op1_mark_leaks")
def mark_leaks(spark, sf_dir):
    runs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.col("text").alias("notes"))
    marked = leaks.mark_leaks(runs, table(spark, sf_dir, "benchmark"))
    return marked.select(F.col("run_id").alias("doc_id"), F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query("op9_moderate_notes")
def moderate_notes(spark, sf_dir):
    runs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.col("text").alias("notes"))
    reviews = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("run_id"), (1 - F.col("quality")).alias("low_quality"), "toxic")
    model = moderation.train_chain(runs, reviews)
    return moderation.moderate_notes(runs, model).withColumnRenamed("run_id", "doc_id")


PHRASE_SQL = r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS c
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
    GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT * FROM g WHERE c >= 30),
x AS (SELECT lang, phrase, k, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (
    SELECT x.lang, x.phrase, x.k, x.a, x.first_words, l.c AS l, r.c AS r, ((2000000::HUGEINT * x.a) // (l.c + r.c))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, k)) AS first_words FROM x) x
    JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.first_words], ' ')
    JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.first_words + 1:x.k], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, first_words) = 1),
inside AS (
    SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT lang, w, a, s, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM x)) GROUP BY ALL),
kept AS (
    SELECT low.* FROM low LEFT JOIN inside ON inside.lang = low.lang AND inside.phrase = low.phrase
    WHERE inside.longer IS NULL OR 100 * inside.longer < 80 * low.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank,
       phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n, score
FROM kept JOIN n ON n.lang = kept.lang
QUALIFY row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


@query("op11_mine_phrases", PHRASE_SQL)
def mine_phrases(spark, sf_dir):
    runs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("run_id"), F.coalesce("lang", F.lit("und")).alias("dataset"), F.col("text").alias("notes"))
    return phrases.mine_phrases(runs).withColumnRenamed("dataset", "lang")


@query("op12_periodic_runs")
def periodic_runs(spark, sf_dir):
    """A tenth of the documents, by crc32 of the id, go on from a word with that word and those behind it over and over."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    n = word_count("text")
    docs = docs.withColumn("words", F.when((F.col("h") % 10 == 0) & (n > 0), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    a = F.col("g") % F.size("words")
    docs = docs.withColumn("a", F.when(F.col("words").isNotNull(), a))
    docs = docs.withColumn("p", 1 + F.floor((F.size("words") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    notes = F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(again, " "))
    return periodic.periodic_runs(docs.select(F.col("doc_id").alias("run_id"), notes.alias("notes"))).withColumnRenamed("run_id", "doc_id")


@query("op13_note_scores")
def note_scores(spark, sf_dir):
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))
    runs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("run_id"), F.col("text").alias("notes"), learn.alias("learn"))
    found = interpolation.note_scores(runs).withColumnRenamed("run_id", "doc_id")
    return found.select("doc_id", (~learn).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
