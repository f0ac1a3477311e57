"""Collocations in the notes of runs, from a weighted de Bruijn graph of their words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from motionframe.llm.grams import Answers, Grams, count_and_tell, distinct, sizes_of, word_hashes
from motionframe.llm.words import hash_words, mix64, split_words, text_bytes
from motionframe.plans.ranking import group_ranks
from motionframe.session import scratch_dir, ship_package

LEAST = 30              # occurrences of a phrase
LONGEST = 4             # words of a phrase, and of an edge of the graph
TOP = 2_000             # phrases reported per dataset
PART_BYTES = 6 << 20    # of notes per part
PARTS_PER_TASK = 8      # whose paths a task adds up before they are moved
SCALE = 2_000_000       # of the score
SHARES = 64             # of a dataset's phrases that are ranked apart first
COVERED = 80            # percent of a phrase's occurrences that a longer one takes to stand for it

# Fixed: pieces end at these signs, words at a space or tab.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[9] = 32
_PLAIN[list(PIECE_ENDS)] = 10

_WIDTH = [np.uint64(x) for x in (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_PATHS = "dataset string, words string, n_words int, path boolean, n long"


class Pieces:
    """The words of a part's notes in order, where their pieces end, and the hashes of their phrases."""

    def __init__(self, table: pa.Table):
        raw, bounds = text_bytes(table["notes"].combine_chunks())
        raw = _PLAIN[raw]
        self.raw = raw.tobytes()
        self.starts, self.ends, firsts = split_words(raw, bounds)
        words = word_hashes(raw, self.starts, self.ends)
        datasets = table["dataset"].combine_chunks().dictionary_encode()
        self.datasets = datasets.dictionary.to_pylist()
        self.dataset = np.repeat(datasets.indices.fill_null(-1).to_numpy(zero_copy_only=False), np.diff(firsts))
        raw_names, name_bounds = text_bytes(pa.array([n + "\x00" for n in self.datasets] + [""], pa.string()))
        salt = hash_words(raw_names, name_bounds[:-1], name_bounds[1:])[self.dataset]
        n = len(words)
        joined = np.zeros(n, bool)  # the next word follows in the same piece
        if n:
            breaks = np.cumsum(raw == 10)
            joined[:-1] = breaks[self.starts[1:]] == breaks[self.starts[:-1]]
            last = firsts[1:] - 1
            joined[last[last >= 0]] = False
        cut = np.flatnonzero(~joined)
        self.left = cut[np.searchsorted(cut, np.arange(n))] - np.arange(n) + 1  # words to the end of the piece
        self.hashes = [mix64(words + salt)]  # of the phrases of 1, 2, ... words that start at each word
        for width in range(2, LONGEST + 1):
            longer, size = self.hashes[-1].copy(), max(0, n - width + 1)
            longer[:size] = mix64(self.hashes[-1][:size] * _WIDTH[width - 2] + words[width - 1:])
            self.hashes.append(longer)

    def phrases(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of so many words start, and their hashes."""
        at = np.flatnonzero(self.left >= width)
        return at, self.hashes[width - 1][at]

    def text(self, start: int, stop: int) -> str:
        """Words start to stop, joined by one space."""
        return b" ".join(self.raw[a:b] for a, b in zip(self.starts[start:stop].tolist(), self.ends[start:stop].tolist())).decode()


def _paths_of(pieces: Pieces, reach: np.ndarray) -> dict:
    """The part's graph, compacted: unary paths of edges with their weight, and what ends short of an edge.

    `reach` is, for every word, the length of the longest phrase from there that is
    followed up. An edge is four words, from the node of its first three to that of its
    last three; where a shorter phrase is all, the flow through its node ends. A node is
    unary if one edge leads in, one leads out, and no flow starts or ends there: all
    occurrences of the edges around it are the same, so they are one path. Such a path can
    be read off the notes at the first occurrence of its first edge. Rows without words
    hold the number of all words of a dataset.
    """
    out = {"dataset": [], "words": [], "n_words": [], "path": [], "n": []}

    def emit(starts, sizes, counts, path):
        for start, size, count in zip(starts.tolist(), sizes.tolist(), counts.tolist()):
            code = pieces.dataset[start]
            out["dataset"].append(pieces.datasets[code] if code >= 0 else None)
            out["words"].append(pieces.text(start, start + size))
            out["n_words"].append(size)
            out["path"].append(path)
            out["n"].append(count)

    def first_of(width, at):
        _, counts, index = distinct(pieces.hashes[width - 1][at])
        where = np.zeros(len(counts), np.int64)
        where[index[::-1]] = at[::-1]
        return where, counts

    for width in range(1, LONGEST):
        where, counts = first_of(width, np.flatnonzero(reach == width))
        emit(where, np.full(len(counts), width), counts, False)
    edge_at = np.flatnonzero(reach == LONGEST)
    if len(edge_at):
        where, weight = first_of(LONGEST, edge_at)
        at = np.flatnonzero(reach >= LONGEST - 1)
        node = distinct(pieces.hashes[LONGEST - 2][at])[2]
        node_of = np.full(len(reach), -1)
        node_of[at] = node
        n_nodes = int(node.max()) + 1
        unary = (np.bincount(node_of[where + 1], minlength=n_nodes) == 1) & (np.bincount(node_of[where], minlength=n_nodes) == 1)
        entered = np.zeros(len(reach), bool)
        entered[edge_at + 1] = True
        unary[node_of[at[~entered[at] | (reach[at] < LONGEST)]]] = False
        # a path goes on while the node ahead is unary
        stops = at[~unary[node]]
        head = ~unary[node_of[where]]
        start = where[head]
        stop = stops[np.searchsorted(stops, start + 1)]
        emit(start, stop - start + LONGEST - 1, weight[head], True)
    codes, counts = np.unique(pieces.dataset, return_counts=True)
    for code, count in zip(codes.tolist(), counts.tolist()):
        for name, value in zip(out, (pieces.datasets[code] if code >= 0 else None, None, 0, False, count)):
            out[name].append(value)
    return out


def _flow(edges: DataFrame, ends: DataFrame, width: int) -> DataFrame:
    """Counts of the phrases one word shorter than `edges`: the flow out of a node, plus what ends there."""
    out = edges.select("dataset", F.substring_index("phrase", " ", width).alias("phrase"), "n")
    return out.unionByName(ends.where(F.col("n_words") == width).select("dataset", F.col("words").alias("phrase"), "n")).groupBy(
        "dataset", "phrase").agg(F.sum("n").alias("n"))


def _cut_scores(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds a candidate's lowest-scoring cut: l and r, the counts of its two parts, and the score."""
    words = F.split("phrase", " ")
    cuts = candidates.select("dataset", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cuts = cuts.select("dataset", "phrase", "k", "a", "at", F.array_join(F.slice(words, 1, F.col("at")), " ").alias("first"),
                       F.array_join(F.slice(words, F.col("at") + 1, F.col("k")), " ").alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        own = counts.select(F.col("dataset").alias("_d"), F.col("phrase").alias(part), F.col("n").alias(name))
        cuts = cuts.join(own, part).where(F.col("dataset").eqNullSafe(F.col("_d"))).drop("_d")
    score = F.expr(f"(cast({SCALE} as decimal(8,0)) * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0))")
    cuts = cuts.withColumn("score", score)
    return cuts.groupBy("dataset", "phrase").agg(
        F.first("k").alias("k"), F.first("a").alias("a"), F.min(F.struct("score", "at", "l", "r")).alias("low")).select(
        "dataset", "phrase", "k", "a", "low.l", "low.r", "low.score")


def _kept(candidates: DataFrame) -> DataFrame:
    """Candidates that no longer one stands for."""
    words = F.split("phrase", " ")
    inner = candidates.where("k > 2").select("dataset", F.col("a").alias("longer"), words.alias("w"), F.col("k").alias("kk"))
    inner = inner.select("dataset", "longer", "w", "kk", F.explode(F.sequence(F.lit(2), F.col("kk") - 1)).alias("size"))
    inner = inner.select("dataset", "longer", "w", "size", F.explode(F.sequence(F.lit(1), F.col("kk") - F.col("size") + 1)).alias("at"))
    inner = inner.select("dataset", "longer", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"))
    inner = inner.groupBy(F.col("dataset").alias("_d"), F.col("phrase").alias("_p")).agg(F.max("longer").alias("longer"))
    same = F.col("dataset").eqNullSafe(F.col("_d")) & (F.col("phrase") == F.col("_p"))
    stands = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * COVERED
    return candidates.join(inner, same, "left").where(~F.coalesce(stands, F.lit(False))).drop("_d", "_p", "longer")


def mine_phrases(runs: DataFrame, *, key: str = "run_id", notes: str = "notes", dataset: str = "dataset",
                 least: int = LEAST, top: int | None = TOP) -> DataFrame:
    """Phrases of two to four words that stand together in the notes of a dataset's runs.

    Notes are lower-cased (A-Z) and cut at the signs .,;:!? and line ends into pieces,
    pieces at spaces and tabs into words. Per dataset, n counts all words and f(phrase)
    all its contiguous places within pieces. Candidates have a = f(phrase) of `least` or
    more. A cut after k words gives l and r, the counts of both parts, and the score
    floor(2000000 * a / (l + r)); the lowest-scoring cut counts, the first of equals. A
    candidate goes if its words lie inside a longer candidate with four fifths of its
    occurrences. Returns (dataset, rank, phrase, a, l, r, n, score), the `top` best per
    dataset (all if None) by score, a and phrase in byte order; ranks start at 1.

    NULL notes have no words; NULL datasets are one dataset. Repeated runs count each.
    Other columns are ignored, whatever their names. Blank notes or an empty table give
    no rows.

    Notes are dealt to parts by hash of `key`. Each edge of the graph is four words,
    between the nodes of its first and last three. Before edges are built, phrases are
    counted by hash over all parts, never too low: those below `least` are no candidate
    and no part of one, so flow ends where the next word would make one. Parts compact
    the unary paths of what is left, edges are added up over all parts, and the counts of
    shorter phrases follow from the flow out of their node plus what ends there: at the
    end of a piece, or short of a rare phrase. Every aggregate combines before its
    shuffle; sums are exact and products decimal.
    """
    spark = runs.sparkSession
    ship_package(spark)
    rows = runs.select(F.col(key).alias("k"), F.col(dataset).cast("string").alias("dataset"),
                       F.coalesce(F.col(notes), F.lit("")).alias("notes"))
    sizes = sizes_of(rows, "notes", LONGEST, part_bytes=PART_BYTES)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("k", "notes"), F.lit(sizes.parts)).cast("int")).drop("k")

    widths = range(1, LONGEST + 1)

    def grams(table: pa.Table) -> Grams:
        pieces = Pieces(table)
        return {w: distinct(sizes.shorten(pieces.phrases(w)[1], w))[:2] for w in widths}

    def graph(part: int, table: pa.Table, answers: Answers) -> pa.Table:
        pieces = Pieces(table)
        reach = np.zeros(len(pieces.left), np.int64)
        for w in widths:
            at, hashes = pieces.phrases(w)
            frequent = answers.counts(w)[distinct(sizes.shorten(hashes, w))[2]] >= least
            reach[at[frequent & (reach[at] == w - 1)]] = w
        out = _paths_of(pieces, reach)
        types = (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})

    path = scratch_dir(spark, "phrase-paths")
    count_and_tell(rows, grams, graph, _PATHS, sizes, ceiling=least).write.parquet(path)
    table = spark.read.parquet(path).coalesce(-(-sizes.parts // PARTS_PER_TASK))
    ends = table.where("not path and words is not null")
    words = F.split("words", " ")
    edges = table.where("path").select("dataset", "n", words.alias("w"), F.explode(
        F.sequence(F.lit(1), F.col("n_words") - LONGEST + 1)).alias("at"))
    edges = edges.select("dataset", "n", F.array_join(F.slice("w", F.col("at"), LONGEST), " ").alias("phrase"))
    level = edges.groupBy("dataset", "phrase").agg(F.sum("n").alias("n"))
    folder = scratch_dir(spark, "phrase-counts")
    for width in range(LONGEST, 0, -1):
        level.write.parquet(f"{folder}/k={width}")
        level = spark.read.parquet(f"{folder}/k={width}")
        level = _flow(level, ends, width - 1)
    # parts of a candidate are as frequent as it is
    every = spark.read.parquet(folder).where(F.col("n") >= least)
    candidates = every.where("k > 1").withColumnRenamed("n", "a")
    scored = _cut_scores(_kept(candidates), every)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is None:
        ranked = group_ranks(scored.withColumns({"_score": -F.col("score"), "_a": -F.col("a")}), ["dataset"], "_score", ["_a", "phrase"])
        best = ranked.withColumn("rank", F.col("rn").cast("int")).drop("rn", "n")
    else:  # the best of every share of a dataset first, so that the last step sees a bounded number of rows
        share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
        some = scored.withColumn("_rank", F.row_number().over(W.partitionBy("dataset", share).orderBy(*order))).where(F.col("_rank") <= top)
        best = some.withColumn("rank", F.row_number().over(W.partitionBy("dataset").orderBy(*order))).where(F.col("rank") <= top)
    totals = table.where("words is null").groupBy(F.col("dataset").alias("_d")).agg(F.sum("n").alias("n"))
    return best.join(totals, F.col("dataset").eqNullSafe(F.col("_d"))).select(
        "dataset", "rank", "phrase", "a", "l", "r", "n", "score")
