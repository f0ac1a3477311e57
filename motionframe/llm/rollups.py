"""Token counts as delta-maintained rollups over datasets, languages and tokenizer versions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import lru_cache

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from motionframe.llm.words import WORD

GROUP = ("dataset", "lang", "tokenizer_version")

# Fixed: what the pattern tokenizers count.
WORDS_1 = WORD
PIECES_1 = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"


def pattern_counter(pattern: str):
    """Counts matches of a pattern in JVM code; NULL notes count 0."""
    return lambda notes: F.coalesce(F.regexp_count(notes, F.lit(pattern)), F.lit(0)).cast("long")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def file_counter(path: str):
    """Counts ids of a tokenizers file over whole notes, without special tokens; NULL notes count 0.

    Call `ship_package` first where the executors cannot import this package.
    """

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            sizes = []
            for at in range(0, len(part), 256):
                texts = part.iloc[at:at + 256].fillna("").tolist()
                sizes += [len(e.ids) for e in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
            yield pd.Series(sizes, dtype="int64")

    return count


def note_changes(before: Column | str | None, after: Column | str | None, versions: Mapping[str, object]) -> Column:
    """Array of (tokenizer_version, d_notes, d_tokens): what one changed note adds to its totals.

    An insert has no `before` (None), a delete no `after`; a revision has both and leaves
    the number of notes as it is.
    """
    out = []
    for name, counter in versions.items():
        new = counter(F.col(after) if isinstance(after, str) else after) if after is not None else F.lit(0)
        old = counter(F.col(before) if isinstance(before, str) else before) if before is not None else F.lit(0)
        notes = (after is not None) - (before is not None)
        out.append(F.struct(F.lit(name).alias("tokenizer_version"), F.lit(notes).cast("long").alias("d_notes"),
                            (new - old).cast("long").alias("d_tokens")))
    return F.array(*out)


def inserts(runs: DataFrame, versions: Mapping[str, object], *, dataset="dataset", lang="lang", notes="notes") -> DataFrame:
    """Signed changes (dataset, lang, tokenizer_version, d_notes, d_tokens) of new notes."""
    return _signed(runs, note_changes(None, notes, versions), dataset, lang)


def deletes(runs: DataFrame, versions: Mapping[str, object], *, dataset="dataset", lang="lang", notes="notes") -> DataFrame:
    """Signed changes of notes that go."""
    return _signed(runs, note_changes(notes, None, versions), dataset, lang)


def revisions(runs: DataFrame, versions: Mapping[str, object], *, dataset="dataset", lang="lang",
              before="notes_before", after="notes") -> DataFrame:
    """Signed changes of notes whose text was revised."""
    return _signed(runs, note_changes(before, after, versions), dataset, lang)


def _signed(runs: DataFrame, changes: Column, dataset: str, lang: str) -> DataFrame:
    return runs.select(F.col(dataset).alias("dataset"), F.col(lang).alias("lang"), F.explode(changes).alias("c")).select(
        "dataset", "lang", "c.*")


def commit_batch(changes: DataFrame, ledger: str, batch_id: int) -> None:
    """Adds up one batch of signed changes and commits it under its number.

    Changes combine before the shuffle, so one hot dataset is one row per task. The
    batch's own folder of the ledger is overwritten as a whole when the job commits:
    committing a batch again, after a lost driver or a repeated trigger, replaces what it
    wrote and adds nothing twice. A batch that is part of a compacted ledger is left out
    for the same reason. An empty batch commits no rows.
    """
    again = compacted_batches(changes.sparkSession, ledger).where(F.col("batch_id") == int(batch_id))
    if not again.isEmpty():
        return
    totals = changes.groupBy(*GROUP).agg(F.sum("d_notes").alias("d_notes"), F.sum("d_tokens").alias("d_tokens"))
    totals.write.mode("overwrite").parquet(f"{ledger}/batch_id={int(batch_id)}")


_ROWS = "dataset string, lang string, tokenizer_version string, d_notes long, d_tokens long, batch_id int"
_COMPACTED = "_compacted"  # beside the batches; readers of the ledger pass over such folders


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """The table, or no rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def compacted_batches(spark: SparkSession, ledger: str) -> DataFrame:
    """Numbers (batch_id) of the batches whose changes a compacted ledger began with."""
    return _read(spark, "batch_id int", f"{ledger}/{_COMPACTED}")


def token_totals(spark: SparkSession, ledger: str) -> DataFrame:
    """Totals (dataset, lang, tokenizer_version, n_notes, n_tokens) over all committed batches.

    Groups whose notes are all deleted stay, with zeros. NULL datasets and languages are
    groups of their own. Additive, so the order of batches does not matter. A ledger
    without any batch has no totals.
    """
    return _read(spark, _ROWS, ledger).groupBy(*GROUP).agg(
        F.sum("d_notes").alias("n_notes"), F.sum("d_tokens").alias("n_tokens"))


def compact(spark: SparkSession, ledger: str, into: str) -> None:
    """Writes the totals so far as batch 0 of a new ledger, for ledgers of very many batches.

    The new ledger knows the numbers of the batches in it, and committing one of them
    again changes nothing. Batch numbers start at 1.
    """
    rows = token_totals(spark, ledger)
    batches = _read(spark, _ROWS, ledger).where("batch_id > 0").select("batch_id").union(compacted_batches(spark, ledger)).distinct()
    batches.write.mode("overwrite").parquet(f"{into}/{_COMPACTED}")
    rows.select(*GROUP, F.col("n_notes").alias("d_notes"), F.col("n_tokens").alias("d_tokens")).write.mode(
        "overwrite").parquet(f"{into}/batch_id=0")
