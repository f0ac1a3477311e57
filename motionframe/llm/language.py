"""Language of notes by word-first backoff."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from motionframe.llm.words import hash_share
from motionframe.session import materialize, ship_package

SAMPLE_PER_LANGUAGE = 2_000   # labelled notes that the model is fitted on, per language (about; by hash)
WORDS_PER_LANGUAGE = 20_000   # most frequent words kept per language
GRAMS_PER_LANGUAGE = 20_000   # most frequent character n-grams kept per language and length
LONGEST_GRAM = 5
UNKNOWN = "und"
KNOWN_WORDS = 200_000         # scored words that a Python worker keeps

# Fixed: a word is a run of letters, here and in the training query.
LETTERS = r"\p{L}+"
_ALNUM = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> Counter:
    """How often each lower-cased word stands in a text."""
    words = Counter(_ALNUM.findall(text.lower()))
    for w in [w for w in words if not w.isalpha()]:  # signs such as a superscript two are no letters
        n = words.pop(w)
        for part in regex.findall(LETTERS, w):
            words[part] += n
    return words


class BackoffModel:
    """Log frequencies per language: of words, and of n-grams with word edges marked by a space.

    A known word scores its log frequency in every language. An unseen one is walked
    from left to right: the longest known n-gram at each place scores, and the walk goes
    on behind it; single characters end the backoff.
    """

    def __init__(self, counts: list[tuple[str, int, str, int]]):
        """counts: (language, n, item, count), n = 0 for words."""
        self.counts = counts
        self.languages = sorted({c[0] for c in counts})
        at = {name: i for i, name in enumerate(self.languages)}
        self.rows: list[dict[str, int]] = [{} for _ in range(LONGEST_GRAM + 1)]
        size = 0
        for _, n, item, _ in counts:
            if item not in self.rows[n]:
                self.rows[n][item] = size
                size += 1
        logs = np.zeros((size + 1, len(self.languages)))
        for name, n, item, count in counts:
            logs[self.rows[n][item], at[name]] += count
        for n, table in enumerate(self.rows):
            own = np.fromiter(table.values(), int, len(table))
            totals = logs[own].sum(axis=0) + 0.5 * (len(own) + 1)
            logs[own] = np.log((logs[own] + 0.5) / totals)
            if n == 1:
                logs[size] = np.log(0.5 / totals)  # a character never seen
        self.logs, self.unseen, self.memo = logs, size, {}

    def __reduce__(self):
        return _in_worker, (self.counts,)

    def word(self, word: str) -> tuple[int, ...]:
        """The rows of `logs` that a word scores."""
        known = self.rows[0].get(word)
        if known is not None:
            return (known,)
        text, at, found = f" {word} ", 0, []
        while at < len(text):
            for n in range(min(LONGEST_GRAM, len(text) - at), 0, -1):
                row = self.rows[n].get(text[at:at + n])
                if row is not None:
                    break
            else:
                row, n = self.unseen, 1
            found.append(row)
            at += n
        return tuple(found)

    def note(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its share among all, `und` and 0 where there is no letter."""
        words = letter_runs(text) if text else None
        if not words or not self.languages:
            return UNKNOWN, 0.0
        if len(self.memo) > KNOWN_WORDS:
            self.memo.clear()
        memo, rows, weights = self.memo, [], []
        for w, n in words.items():
            own = memo.get(w)
            if own is None:
                own = memo[w] = self.word(w)
            rows += own
            weights += (n,) * len(own)
        total = np.array(weights, float) @ self.logs[rows]
        best = int(total.argmax())  # ties: first in code point order
        share = 1.0 / np.exp(np.minimum(total - total[best], 0)).sum()
        return self.languages[best], float(share)


def _in_worker(counts: list[tuple[str, int, str, int]]) -> BackoffModel:
    """The model without the counts it came from, which only the driver sends on."""
    model = BackoffModel(counts)
    model.counts = []
    return model


def language_counts(labelled: DataFrame, *, key: str = "run_id", notes: str = "notes", lang: str = "lang",
                    sample: int = SAMPLE_PER_LANGUAGE, words: int = WORDS_PER_LANGUAGE,
                    grams: int = GRAMS_PER_LANGUAGE) -> DataFrame:
    """(language, n, item, count): the most frequent words (n = 0) and n-grams per language.

    Counted over about `sample` labelled notes per language, drawn by hash of the key at a
    rate that follows from the language's number of notes; all notes where there are
    fewer. Rows with NULL language or notes are left out. Only the drawn notes' words are
    moved; the rates are one row per language, as is the model itself.
    """
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(notes).isNotNull()).select(
        F.col(key).alias("k"), F.col(lang).alias("language"), F.col(notes).alias("notes"))
    rates = labelled.groupBy("language").agg((sample / F.count("*")).alias("rate"))
    draw = F.coalesce(hash_share("k"), F.lit(0.0))
    texts = labelled.join(F.broadcast(rates), "language").where(draw < F.col("rate"))
    found = texts.select("language", F.explode(F.regexp_extract_all(F.lower("notes"), F.lit(LETTERS), F.lit(0))).alias("word"))
    found = found.groupBy("language", "word").agg(F.count("*").alias("count"))
    found = materialize(found)
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    pieces = found.select("language", "count", padded.alias("w"), F.explode(F.sequence(F.lit(1), F.lit(LONGEST_GRAM))).alias("n"))
    pieces = pieces.where(F.length("w") >= F.col("n")).select(
        "language", "n", "count", F.explode(F.expr("transform(sequence(1, length(w) - n + 1), i -> substring(w, i, n))")).alias("item"))
    pieces = pieces.groupBy("language", "n", "item").agg(F.sum("count").alias("count"))
    rows = found.select("language", F.lit(0).alias("n"), F.col("word").alias("item"), "count").unionByName(pieces)
    most = F.row_number().over(W.partitionBy("language", "n").orderBy(F.desc("count"), "item"))
    rows = rows.withColumn("most", most)
    return rows.where(F.col("most") <= F.when(F.col("n") == 0, words).otherwise(grams)).select("language", "n", "item", "count")


def detect_language(runs: DataFrame, counts: DataFrame, *, key: str = "run_id", notes: str = "notes",
                    keep: Sequence[str] = (), pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Predicts the language of whole notes from `language_counts`.

    Returns (key, *keep, lang_pred, score) per input row; only the notes are looked at.
    The score is the language's share of likelihood among all, from 0 to 1. NULL notes
    and notes without a letter give `und` and 0, as do all notes if nothing was learnt;
    equal scores go to the first language in code point order. Repeated rows are kept,
    other columns ignored, an empty table gives no rows. Columns of `keep` must not be
    named as `pred` and `score`, which can be chosen.

    The model is a bounded table (languages times the limits above), so it is sent to
    all tasks; a Python worker builds it once.
    """
    spark = runs.sparkSession
    ship_package(spark)
    # bounded by the limits of language_counts
    model = spark.sparkContext.broadcast(BackoffModel([tuple(r) for r in counts.collect()]))
    names = list(dict.fromkeys([key, *keep]))
    read = names if notes in names else [*names, notes]
    shape = runs.select(*names, F.lit("").alias(pred), F.lit(0.0).alias(score)).schema

    def tasks(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [model.value.note(t) for t in part.column(read.index(notes)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(names)], pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.float64())], [*names, pred, score])

    return runs.select(*read).mapInArrow(tasks, shape)


def held_out(key: str | Column) -> Column:
    """A quarter of all keys that no model learns from: crc32 of the key as text, modulo 4, is 2."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
