"""Log probabilities of notes under an n-gram model with deleted interpolation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from motionframe.llm.grams import Answers, Grams, count_and_tell, distinct, pack, sizes_of, unpack, word_hashes
from motionframe.llm.words import mix64, split_words, text_bytes
from motionframe.session import scratch_dir, ship_package

TUNING_SHARE = 1 / 32  # of the notes to learn from: held out of the counts while weights are learned
FREQUENCIES = 48       # buckets of context counts: powers of two
ROUNDS = 15            # of expectation-maximisation
CHANGE = 1e-4          # weights that move less are settled
START = 0.5            # weight before the first round
PART_BYTES = 6 << 20   # of notes per part
NOTES_PER_ROW = 500    # of the written counts

# Fixed: stand for the begin and the end of a note among the hashes of words.
BEGIN, END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)
_PAIR, _TRIPLE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A3564E27F8865B)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Tokens:
    """The tokens of a part's notes, words and one end each, with their n-grams."""

    def __init__(self, notes: pa.Array):
        raw, bounds = text_bytes(notes)
        raw = _LOWER[raw]
        starts, ends, firsts = split_words(raw, bounds)
        words = word_hashes(raw, starts, ends)
        n_notes = len(bounds) - 1
        self.sizes = np.diff(firsts) + 1
        self.stops = np.cumsum(self.sizes)              # one behind the end token of each note
        self.starts = self.stops - self.sizes
        tokens = np.empty(len(words) + n_notes, np.uint64)
        own = np.ones(len(tokens), bool)
        own[self.stops - 1] = False
        tokens[own], tokens[~own] = words, END
        before = np.concatenate([[BEGIN], tokens[:-1]])
        before[self.starts] = BEGIN
        self.words = tokens
        self.pairs = mix64(before * _PAIR + tokens)
        context = np.concatenate([[BEGIN], self.pairs[:-1]])
        context[self.starts] = BEGIN
        self.triples = mix64(context * _TRIPLE + tokens)

    def by_width(self):
        return {1: self.words, 2: self.pairs, 3: self.triples}


def _log_buckets(counts: Column) -> Column:
    """The bucket of a context count, its power of two; NULL for contexts never seen."""
    return F.when(counts > 0, F.least(F.floor(F.log2(counts.cast("double"))), F.lit(FREQUENCIES - 1))).cast("int")


def _fit(events: DataFrame, n_types: int, n_tokens: int) -> list[list[float]]:
    """Weights of the maximum-likelihood estimates, one list by context frequency for each n-gram width.

    Each round is one aggregate over the tuning events: a token shares itself among the
    estimates in proportion to what they give it, and a weight becomes the share that its
    estimate got of all that reached its width.
    """
    part = {w: F.when(F.col(f"x{w}") > 0, F.col(f"c{w}") / F.col(f"x{w}")).otherwise(F.lit(0.0)) for w in (2, 3)}
    events = events.select("n", part[3].alias("m3"), part[2].alias("m2"), (F.col("c1") / max(n_tokens, 1)).alias("m1"),
                           _log_buckets(F.col("x3")).alias("b3"), _log_buckets(F.col("x2")).alias("b2"))
    weights, reached = [[START], [START] * FREQUENCIES, [START] * FREQUENCIES], set()
    for _ in range(ROUNDS):
        def at(width):
            if width == 1:
                return F.lit(weights[0][0])
            table = F.array(*[F.lit(float(v)) for v in weights[width - 1]])
            return F.coalesce(F.element_at(table, F.col(f"b{width}") + 1), F.lit(0.0))

        rows = events.select("*", at(3).alias("l3"), at(2).alias("l2"), at(1).alias("l1"))
        rest3, rest2 = 1 - F.col("l3"), (1 - F.col("l3")) * (1 - F.col("l2"))
        rows = rows.select("n", "b3", "b2", (F.col("l3") * F.col("m3")).alias("w3"), (rest3 * F.col("l2") * F.col("m2")).alias("w2"),
                           (rest2 * F.col("l1") * F.col("m1")).alias("w1"), (rest2 * (1 - F.col("l1")) / (n_types + 1)).alias("w0"))
        whole = F.col("w3") + F.col("w2") + F.col("w1") + F.col("w0")
        share = lambda *c: F.col("n") * sum((F.col(x) for x in c), F.lit(0.0)) / whole
        shares = rows.select(F.explode(F.array(
            F.struct(F.lit(3).alias("width"), F.col("b3").alias("b"), share("w3").alias("got"), F.col("n").cast("double").alias("of")),
            F.struct(F.lit(2).alias("width"), F.col("b2").alias("b"), share("w2").alias("got"), share("w2", "w1", "w0").alias("of")),
            F.struct(F.lit(1).alias("width"), F.lit(0).alias("b"), share("w1").alias("got"), share("w1", "w0").alias("of")))).alias("s"))
        found = shares.where("s.b is not null").groupBy("s.width", "s.b").agg(
            (F.sum("s.got") / F.sum("s.of")).alias("weight")).collect()  # a row per width and bucket: under a hundred
        moved = 0.0
        for width, b, weight in found:
            if weight is not None:
                weight = round(weight, 6)  # sums of doubles depend on their order
                reached.add((width, b))
                moved = max(moved, abs(weight - weights[width - 1][b]))
                weights[width - 1][b] = weight
        if moved < CHANGE:
            break
    for width in (2, 3):  # contexts more frequent than the tuning notes know weigh as the nearest that they know
        for b in range(1, FREQUENCIES):
            if (width, b) not in reached:
                weights[width - 1][b] = weights[width - 1][b - 1]
    return weights


def note_scores(runs: DataFrame, *, key: str = "run_id", notes: str = "notes", learn: str = "learn",
                tuning_share: float = TUNING_SHARE) -> DataFrame:
    """Log10 probability of the notes of runs under a trigram model learnt from the rows whose `learn` is true.

    Tokens of a note are its words, A-Z lower-cased, and one end. Returns per input row
    (key, n_tokens, n_known, train_tokens, base_score, score): tokens, those seen in
    training, all training tokens N, the sum of log10((c + 1) / (N + V + 1)) over the
    tokens (c: the token's training count, V: distinct training tokens), and the sum of
    log10 probabilities of the model.

    Deleted interpolation: the probability of a token after two others is the relative
    frequency of the triple times a weight, plus the rest times the same for pairs, for
    words, and last 1 / (V + 1). A weight depends on how often its context was seen, by
    powers of two; contexts never seen weigh nothing. Weights are learned by
    expectation-maximisation on about `tuning_share` of the training notes, drawn by hash
    of the key and left out of the counts meanwhile. The scores then use the counts of all
    training notes; a frequency that no tuning token has takes the weight of the next lower
    one.

    NULL and blank notes consist of their end. NULL `learn` is false, a NULL key is drawn
    like any other. Repeated rows count and are scored each. Other columns are ignored,
    whatever their names. Nothing to learn from gives N = 0, base_score and score 0; no
    tuning notes leave all weights at one half. An empty table gives no rows.

    Notes move once; n-grams go to their buckets as packed hashes, each distinct one of a
    part once, and what comes back is written as counts per token. Weights are read from
    that table and scores computed on it without another exchange.
    """
    spark = runs.sparkSession
    ship_package(spark)
    k, learns = F.col(key).cast("long"), F.coalesce(F.col(learn), F.lit(False))
    drawn = F.pmod(F.xxhash64(k, F.lit(3)), F.lit(1 << 20)) < int(tuning_share * (1 << 20))
    fold = F.when(learns & drawn, 1).when(learns, 0).otherwise(2)
    rows = runs.select(k.alias("k"), F.coalesce(F.col(notes), F.lit("")).alias("notes"), fold.alias("fold"))
    sizes = sizes_of(rows, "notes", 2, exact=(1,), part_bytes=PART_BYTES)
    apart = -(-sizes.parts // 32)  # parts of tuning notes alone come first
    part = F.when(F.col("fold") == 1, F.pmod(F.xxhash64("k", "notes"), F.lit(apart))).otherwise(
        apart + F.pmod(F.xxhash64("k", "notes"), F.lit(sizes.parts)))
    rows, sizes.parts = rows.withColumn("part", part.cast("int")), sizes.parts + apart

    def grams(table: pa.Table) -> Grams:
        tokens = Tokens(table["notes"].combine_chunks())
        fold = np.repeat(table["fold"].to_numpy(), tokens.sizes)
        out = {}
        for width, hashes in tokens.by_width().items():
            found, _, index = distinct(sizes.shorten(hashes, width))
            out[width] = found, np.bincount(index[fold < 2], minlength=len(found))
        return out

    def counted(part: int, table: pa.Table, answers: Answers) -> pa.Table:
        tokens = Tokens(table["notes"].combine_chunks())
        index = {w: distinct(sizes.shorten(h, w))[2] for w, h in tokens.by_width().items()}
        fold = table["fold"].to_numpy()
        seen = [answers.counts(w)[index[w]] for w in (1, 2, 3)]
        kept = [answers.counts(w, True)[index[w]] for w in (1, 2, 3)] if part < apart else None
        out = {"ks": [], "sizes": [], "kept_tokens": [], "seen": [], "kept": []}
        for at in range(0, len(fold), NOTES_PER_ROW):
            some = slice(at, at + NOTES_PER_ROW)
            a, b = int(tokens.starts[at]), int(tokens.stops[some][-1])
            out["ks"].append(table["k"][some].to_pylist())
            out["sizes"].append(tokens.sizes[some])
            out["kept_tokens"].append(int(tokens.sizes[some][fold[some] == 0].sum()))
            out["seen"].append(pack(np.concatenate([c[a:b] for c in seen])))
            out["kept"].append(pack(np.concatenate([c[a:b] for c in kept])) if kept else None)
        first = np.arange(len(out["ks"])) == 0
        types = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary())
        return pa.table({**{k: pa.array(v, t) for (k, v), t in zip(out.items(), types)},
                         "kinds": pa.array(np.where(first, answers.kinds, 0), pa.int64()),
                         "mass": pa.array(np.where(first, answers.mass, 0), pa.int64())})

    path = scratch_dir(spark, "token-counts")
    count_and_tell(rows, grams, counted, "ks array<long>, sizes array<long>, kept_tokens long, seen binary, kept binary, kinds long, mass long",
                   sizes, apart=apart).write.parquet(path)
    table = spark.read.parquet(path)
    n_types, n_tokens, n_kept = (v or 0 for v in table.agg(F.sum("kinds"), F.sum("mass"), F.sum("kept_tokens")).first())
    tuning = table.where("kept is not null").select("sizes", "kept")
    events = tuning.mapInArrow(_events, "c3 long, x3 long, c2 long, x2 long, c1 long, n long").groupBy(
        "c3", "x3", "c2", "x2", "c1").agg(F.sum("n").alias("n"))
    events_path = scratch_dir(spark, "tuning-events")
    events.write.parquet(events_path)
    events = spark.read.parquet(events_path)
    weights = _fit(events, n_types, n_kept)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, three = (np.array([*w, 0.0]) for w in weights)
        for keys, size, counts in _rows_of(batches):
            c1, c2, c3, x2, x3 = _contexts(size, counts)
            probability = one[0] * c1 / max(n_tokens, 1) + (1 - one[0]) / (n_types + 1)
            if not n_tokens:
                probability = np.ones(len(c1))
            for c, x, w in ((c2, x2, two), (c3, x3, three)):
                weight = w[np.where(x > 0, np.minimum(np.frexp(np.maximum(x, 1))[1] - 1, FREQUENCIES - 1), FREQUENCIES)]
                probability = weight * c / np.maximum(x, 1) + (1 - weight) * probability
            starts = np.cumsum(size) - size
            add = lambda v: np.add.reduceat(v, starts) if len(size) else np.zeros(0)
            base = np.log10(c1 + 1) - np.log10(n_tokens + n_types + 1)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(size, pa.int64()), pa.array(add((c1 > 0).astype(np.int64)), pa.int64()),
                 pa.array(np.full(len(size), n_tokens), pa.int64()), pa.array(add(base), pa.float64()),
                 pa.array(add(np.log10(probability)), pa.float64())],
                [key, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    shape = runs.select(k.alias(key)).schema.add("n_tokens", "long").add("n_known", "long").add(
        "train_tokens", "long").add("base_score", "double").add("score", "double")
    return table.select("sizes", "seen", "ks").mapInArrow(scored, shape)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array | None, np.ndarray, np.ndarray]]:
    """Keys, numbers of tokens, and counts (word, pair, triple) per token, of one row of notes after the other."""
    for batch in batches:
        for i in range(batch.num_rows):
            sizes = batch.column(0)[i].values.to_numpy(zero_copy_only=False)
            n = int(sizes.sum())
            counts = unpack(batch.column(1)[i].as_py(), 3 * n).astype(np.int64).reshape(3, n)
            yield (batch.column(2)[i].values if batch.num_columns > 2 else None), sizes, counts


def _contexts(sizes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Per token the counts of its word, pair and triple, and of what comes before it in pair and triple.

    A context is counted by the shorter n-gram that ends one token earlier; the begin of a
    note by the number of notes, which is the count of their ends.
    """
    c1, c2, c3 = counts
    starts = np.cumsum(sizes) - sizes
    x2, x3 = np.concatenate([[0], c1[:-1]]), np.concatenate([[0], c2[:-1]])
    x2[starts] = x3[starts] = c1[sizes[0] - 1]
    return [c1, c2, c3, x2, x3]


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tuning tokens that look alike in all counts, as one row with their number."""
    for _, sizes, counts in _rows_of(batches):
        c1, c2, c3, x2, x3 = _contexts(sizes, counts)
        found, n = np.unique(np.stack([c3, x3, c2, x2, c1], axis=1), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in found.T), pa.array(n, pa.int64())],
                                         ["c3", "x3", "c2", "x2", "c1", "n"])
