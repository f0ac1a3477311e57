"""Channel selection, sequence building, samples and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from motionframe.functions.columns import hash_order, null_to_zero
from motionframe.plans.ranking import attach, ordered_prefix
from motionframe.plans.selection import mark_first, sample_n


# -- channels ---------------------------------------------------------------

def select_channels(tracks: DataFrame, membership: DataFrame, subset: str,
                    coords: str = "xyz") -> DataFrame:
    """Rows of one subset's channels with only the named coordinates."""
    rows = membership.where(F.col("subset") == subset).select("row")
    keep = [c for c in tracks.columns if c not in ("x", "y", "z") or c in coords]
    return tracks.join(rows, "row", "left_semi").select(*keep)


def feature_columns(membership: DataFrame, coords: str = "xyz") -> DataFrame:
    """Flat feature index of each subset: row * 3 + coordinate, in channel order."""
    pos = F.explode(F.array(*[F.lit("xyz".index(c)) for c in coords]))
    return membership.select("subset", "row", pos.alias("coord")).select(
        "subset", (F.col("row") * 3 + F.col("coord")).alias("feature"))


def row_of(df: DataFrame, layout: DataFrame) -> DataFrame:
    """Adds the global row of (grp, idx) from the layout's offsets."""
    return df.join(layout.select("grp", "row_offset"), "grp").withColumn(
        "row", F.col("row_offset") + F.col("idx")).drop("row_offset")


def build_membership(components: DataFrame, parts: DataFrame) -> DataFrame:
    """Subsets as unions of components: distinct (subset, row)."""
    return parts.join(components, "component").select("subset", "row").distinct()


def subset_op(membership: DataFrame, a: str, b: str, op: str) -> DataFrame:
    """Rows of union, intersection or difference of two subsets."""
    left, right = (membership.where(F.col("subset") == s).select("row") for s in (a, b))
    ops = {"union": lambda: left.union(right).distinct(), "intersect": lambda: left.intersect(right),
           "except": lambda: left.subtract(right)}
    return ops[op]()


def subset_sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("subset").agg(F.count_distinct("row").alias("n_channels"))


# -- sequences --------------------------------------------------------------

def with_positions(tracks: DataFrame) -> DataFrame:
    """Adds `pos` (frame within the entity's range) and `n_frames`."""
    ext = tracks.groupBy("entity_id").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"))
    return tracks.join(ext, "entity_id").withColumn("pos", F.col("frame") - F.col("f0")).withColumn(
        "n_frames", F.col("f1") - F.col("f0") + 1).drop("f0", "f1")


def subsample_uniform(seq: DataFrame, n: int) -> DataFrame:
    """Frames trunc(linspace(0, T-1, n)) of sequences longer than n; shorter ones unchanged.

    Each row finds its own output position, so nothing is grouped or joined.
    """
    if n == 1:  # linspace of one point is its start
        one = seq.where("n_frames <= 1 OR pos = 0").withColumn("pos", F.col("pos").cast("long"))
        return one.withColumn("n_frames", F.least(F.col("n_frames"), F.lit(1)))
    step = f"((n_frames - 1) / {n - 1}D)"
    index = f"if(i = {n - 1}, n_frames - 1, floor(i * {step}))"
    near = f"floor(pos / {step})"
    found = f"filter(sequence({near} - 1, {near} + 2), i -> i BETWEEN 0 AND {n - 1} AND {index} = pos)"
    out = seq.withColumn("new_pos", F.expr(
        f"CASE WHEN n_frames <= {n} THEN CAST(pos AS BIGINT) ELSE try_element_at({found}, 1) END"))
    return (out.where("new_pos IS NOT NULL").drop("pos").withColumnRenamed("new_pos", "pos")
            .withColumn("n_frames", F.least(F.col("n_frames"), F.lit(n))))


def resample_uniform(seq: DataFrame, n: int) -> DataFrame:
    """Exactly n frames by rounded linspace (half to even); short sequences repeat frames."""
    if n == 1:
        return seq.where("pos = 0").withColumn("pos", F.lit(0)).withColumn("n_frames", F.lit(1))
    step = f"((n_frames - 1) / {n - 1}D)"
    index = f"if(i = {n - 1}, CAST(n_frames - 1 AS DOUBLE), rint(i * {step}))"
    low = f"greatest(0, CAST(floor((pos - 0.5D) / {step}) AS INT) - 1)"
    high = f"least({n - 1}, CAST(ceil((pos + 0.5D) / {step}) AS INT) + 1)"
    hits = f"""CASE WHEN n_frames = {n} THEN array(CAST(pos AS INT)) WHEN n_frames = 1 THEN sequence(0, {n - 1})
        ELSE filter(sequence({low}, {high}), i -> {index} = pos) END"""
    return (seq.withColumn("new_pos", F.explode(F.expr(hits))).drop("pos")
            .withColumnRenamed("new_pos", "pos").withColumn("n_frames", F.lit(n)))


def pad_or_truncate(tracks: DataFrame, n: int, rows: Sequence[int],
                    axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """First n frames of each entity as one flat array, frame by frame, zero-padded to n.

    Frames are the ones present, in order; NULL and unobserved cells are 0. Only n
    frames per entity are ever collected.
    """
    channels = {r: i for i, r in enumerate(sorted(rows))}
    order = W.partitionBy("entity_id").orderBy("frame")
    first = (tracks.select("entity_id", "frame").distinct()
             .withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n))
    place = F.create_map(*[F.lit(v) for kv in channels.items() for v in kv])
    cells = tracks.join(first, ["entity_id", "frame"]).withColumn("channel", place[F.col("row")])
    base = ((F.col("pos") - 1) * len(channels) + F.col("channel")) * len(axes)
    cells = cells.select("entity_id", F.inline(F.array(*[
        F.struct((base + k).cast("int").alias("p"), null_to_zero(F.col(a).cast("double")).alias("v"))
        for k, a in enumerate(axes)])))
    packed = cells.groupBy("entity_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "v")))).alias("cells"))
    width = n * len(channels) * len(axes)
    lengths = first.groupBy("entity_id").agg(F.count("*").alias("n_frames"))
    return packed.join(lengths, "entity_id").selectExpr("entity_id", "n_frames", f"""
        CASE WHEN size(cells) = 0 THEN array_repeat(0.0D, {width}) ELSE
        concat(flatten(transform(cells, (e, i) -> concat(
                 array_repeat(0.0D, e.p - if(i = 0, -1, cells[i - 1].p) - 1), array(e.v)))),
               array_repeat(0.0D, {width} - 1 - cells[size(cells) - 1].p)) END AS seq""")


def pack_offsets(lengths: DataFrame, order: str, length: str = "n_frames") -> DataFrame:
    """Start and end of each entity in a flat store of concatenated sequences."""
    out = ordered_prefix(lengths, [order], length).withColumnRenamed("before", "start")
    return out.withColumn("end", (F.col("start") + F.col(length)).cast("long"))


def padded_batches(lengths: DataFrame, order: str, batch: int, length: str = "n_frames") -> DataFrame:
    """Batches of consecutive sequences; inside a batch longest first, padded to the longest."""
    rows = ordered_prefix(lengths, [order]).withColumn("batch_id", F.floor(F.col("before") / batch)).drop("before")
    w = W.partitionBy("batch_id")
    return rows.select("*", (F.row_number().over(w.orderBy(F.desc(length), order)) - 1).alias("slot"),
                       F.max(length).over(w).alias("padded_to"))


def padded_values(sequences: DataFrame, order: str, batch: int, dim: int) -> DataFrame:
    """Sequences (order, n_frames, seq) with the values of their place in a padded batch.

    Batches, slots and `padded_to` are those of `padded_batches`; `values` is the flat
    array of padded_to * dim numbers, the sequence's own first and zeros behind. NULL
    values are zero, a NULL sequence is all zeros. A row is one slot of one batch, so no
    task holds more than it, however large the batch.
    """
    places = padded_batches(sequences.select(order, "n_frames"), order, batch)
    rows = places.join(sequences.select(order, "seq"), order)
    own = F.transform(F.coalesce("seq", F.array().cast("array<double>")), lambda v: null_to_zero(v.cast("double")))
    width = (F.col("padded_to") * dim).cast("int")
    filled = F.concat(own, F.array_repeat(F.lit(0.0), F.greatest(width - F.size(own), F.lit(0))))
    return rows.select("batch_id", "slot", order, "n_frames", "padded_to", F.slice(filled, F.lit(1), width).alias("values"))


def chunk_ids(df: DataFrame, order: str, size: int) -> DataFrame:
    """Deterministic chunks of `size` consecutive rows by the order key."""
    rows = ordered_prefix(df, [order])
    number = F.floor(F.col("before") / size).cast("string")
    return rows.withColumn("chunk", F.concat(F.lit("chunk_"), F.lpad(number, 5, "0"))).drop("before")


# -- labels -----------------------------------------------------------------

def encode_labels(df: DataFrame, label_map: DataFrame, col: str = "class") -> DataFrame:
    """Adds `label`; unmapped classes are NULL, for `Expect.required` to report."""
    m = label_map.select(F.col("class").alias(col), "label")
    return df.join(m, col, "left")


def encode_sorted(df: DataFrame, col: str = "class") -> DataFrame:
    """Adds `label`, the position of the class in sorted order; rows without a class stay, with a NULL label."""
    classes = ordered_prefix(df.select(col).where(F.col(col).isNotNull()).distinct(), [col])
    return df.join(classes.withColumnRenamed("before", "label"), col, "left").withColumn("label", F.col("label").cast("int"))


def label_distribution(df: DataFrame, col: str = "class", by: Sequence[str] = ()) -> DataFrame:
    """Rows per class with mean, mode, deviation and variance of the counts, and side of the mean."""
    by = list(by)
    counts = df.groupBy(*by, col).agg(F.count("*").alias("count"))
    stats = counts.groupBy(*by).agg(F.avg("count").alias("mean"), F.stddev_samp("count").alias("std"),
                                    F.var_samp("count").alias("variance"))
    times = counts.groupBy(*by, "count").agg(F.count("*").alias("t"))
    mode = times.groupBy(*by).agg(F.min(F.struct(-F.col("t"), "count"))["count"].alias("mode"))
    out = attach(attach(counts, stats, by, ["mean", "std", "variance"]), mode, by, ["mode"])
    side = F.when(F.col("count") > F.col("mean"), "above").when(F.col("count") < F.col("mean"), "below")
    return out.select(*by, col, "count", "mean", "mode", "std", "variance",
                      F.coalesce(side, F.lit("equal")).alias("side"))


# -- unions -----------------------------------------------------------------

def union_units(parts: Sequence[DataFrame]) -> DataFrame:
    """Unit outputs by column name; columns a part lacks are NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def dedup_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order."""
    rn = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn <= 1").drop("_rn")


# -- samples and splits -----------------------------------------------------

def sample_classes(df: DataFrame, k: int, seed: int, *, cls: str = "class", key: str = "key",
                   per_class: int | None = None, min_size: int | None = None) -> DataFrame:
    """k classes in seeded order (those with at least `min_size` rows), then all or n rows of each."""
    sizes = df.groupBy(cls).agg(F.count("*").alias("size"))
    if min_size:
        sizes = sizes.where(F.col("size") >= min_size)
    chosen = sizes.orderBy(hash_order(seed, cls), cls).limit(k).select(cls)
    rows = df.join(F.broadcast(chosen), cls, "left_semi")  # k rows
    if per_class is None:
        return rows
    order = W.partitionBy(cls).orderBy(hash_order(seed, key), key)
    return rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= per_class).drop("_rn")


def sample_two_stage(df: DataFrame, k: int, n: int, seed: int, *, cls: str = "class",
                     key: str = "key") -> DataFrame:
    """n rows of each of k classes that have at least n; fails if too few classes do."""
    eligible = df.groupBy(cls).agg(F.count("*").alias("size")).where(F.col("size") >= n).limit(k).count()
    if eligible < k:
        raise ValueError(f"only {eligible} classes have at least {n} rows, {k} wanted")
    return sample_classes(df, k, seed, cls=cls, key=key, per_class=n, min_size=n)


def class_quota(df: DataFrame, frac: float, cls: str = "class") -> DataFrame:
    """Rows to take per class: total exactly ceil(frac * n), shares by largest remainder.

    Rows without a class are a class of their own.
    """
    sizes = df.groupBy(cls).agg(F.count("*").alias("size"))
    n = sizes.agg(F.sum("size")).scalar()
    sizes = sizes.withColumn("n", n)
    total = F.ceil(F.round(F.lit(float(frac)) * F.col("n"), 9))
    sizes = sizes.withColumn("total", total).select(
        cls, "total", F.expr("(total * size) div n").alias("base"), F.expr("-((total * size) % n)").alias("left"))
    spare = sizes.agg(F.max("total") - F.sum("base")).scalar()
    ranked = ordered_prefix(sizes, ["left", cls])
    return ranked.select(cls, (F.col("base") + (F.col("before") < spare).cast("long")).alias("take"))


def stratified_split(df: DataFrame, frac: float, seed: int, *, cls: str = "class", key: str = "key",
                     names: tuple[str, str] = ("train", "val")) -> DataFrame:
    """Adds `split`: seeded, exact in total and per class, independent of partitioning."""
    marked = mark_first(df, [cls], class_quota(df, frac, cls), seed, key)
    return marked.withColumn("split", F.when(F.col("selected"), names[1]).otherwise(names[0])).drop("selected")


def split_three_way(df: DataFrame, seed: int, *, cls: str = "class", key: str = "key",
                    held_out: float = 0.2) -> DataFrame:
    """80/10/10 by splitting twice."""
    first = stratified_split(df, held_out, seed, cls=cls, key=key, names=("train", "rest"))
    rest = stratified_split(first.where("split = 'rest'").drop("split"), 0.5, seed + 1, cls=cls, key=key,
                            names=("test", "val"))
    return first.where("split = 'train'").unionByName(rest)


def disjoint_slices(units: DataFrame, order: str, size: int, n_slices: int) -> DataFrame:
    """First n_slices * size units, cut into non-overlapping slices; fails if there are too few."""
    found = units.count()
    if found < size * n_slices:
        raise ValueError(f"{found} units are too few for {n_slices} slices of {size}")
    first = ordered_prefix(units, [order]).where(F.col("before") < size * n_slices)
    return first.withColumn("slice", F.floor(F.col("before") / size)).drop("before")
