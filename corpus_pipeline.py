"""The corpus pipeline: stages over a documents table, each one operator of motionframe.llm.

A stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of
documents; the last returns what it wrote. `run` writes each stage's rows as Parquet and
reads them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from motionframe.llm import fingerprints, language, leaks, mixing, tokens
from motionframe.llm.words import free_name, row_id, word_count
from motionframe.session import scratch_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognizable language; a missing language is filled with the predicted one.

    That is documents whose text is NULL or has no letter, and all documents where none
    has both a text and a language to learn from. Repeated rows are kept. Other columns
    pass unchanged, whatever their names. An empty table stays empty.
    """
    pred, score = free_name(docs.columns, "lang_pred"), free_name(docs.columns, "score")
    counts = language.language_counts(docs, key="doc_id", notes="text")
    found = language.detect_language(docs, counts, key="doc_id", notes="text", keep=docs.columns, pred=pred, score=score)
    lang = F.coalesce("lang", pred).alias("lang")
    return found.where(F.col(pred) != language.UNKNOWN).select(*[lang if c == "lang" else c for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each near-duplicate group.

    Documents without words are one group, whether their text is NULL or blank. A NULL
    doc_id stays only where its group has no other. Rows equal in all columns are one; of
    rows with one doc_id and different columns one stays, the same in every run. Other
    columns pass unchanged, whatever their names. An empty table stays empty.
    """
    return fingerprints.one_note_of_each_group(docs, key="doc_id", notes="text")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Documents with NULL or empty text stay, as do all where the benchmark is empty.
    Repeated rows are judged each. Other columns pass unchanged, whatever their names. An
    empty table stays empty.
    """
    found = free_name(docs.columns, "leaks")
    marked = leaks.mark_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), notes="text", out=found)
    return marked.where(F.size(found) == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near their target weights.

    A NULL source is a source of its own. Documents without words, their text NULL
    included, have size 0 and come once for each of the source's passes that they fall
    into. Repeated rows are documents of their own. Other columns pass unchanged, whatever
    their names. An empty table stays empty.
    """
    row, times, one = (free_name(docs.columns, n) for n in ("_row", "_copies", "_copy"))
    rows = docs.withColumn(row, row_id(docs.columns))
    entities = rows.select(F.col(row).alias("entity_id"), F.col("source").alias("dataset"), word_count("text").alias("n_frames"))
    # equal rows share an id: their copies are added up, and one of them stands for all
    copies = mixing.mix_datasets(entities).groupBy(F.col("entity_id").alias(row)).agg(F.sum("copies").alias(times))
    taken = rows.dropDuplicates([row]).join(copies.where(F.col(times) > 0), row)
    return taken.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token ids and returns (doc_id, start, n_tokens, ids_crc32) read back from the files.

    A NULL text is an empty one, with the end id alone. Repeated rows are documents of
    their own, and a NULL doc_id comes first. Other columns are ignored. An empty table
    gives no rows.
    """
    return tokens.token_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), key="doc_id", notes="text")


STAGES = [
    ("identify_language", identify_language),
    ("drop_near_duplicates", drop_near_duplicates),
    ("drop_leaks", drop_leaks),
    ("mix_sources", mix_sources),
    ("write_tokens", write_tokens),
]

ORACLE_SQL = None  # no stage but the mix can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
