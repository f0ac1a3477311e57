"""Queries on sources of tracks, sequence building, samples, splits and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import rounded, sql, sql_round as rd
from checks.registry import query
from motionframe.functions.columns import subset_tag
from motionframe.operators import datasets as ds, learning as ln
from motionframe.session import scratch_dir
from motionframe.sources import frame_store, tracks as tr


# -- track sources ----------------------------------------------------------

@query("a1_read_catalog", sql(
    "SELECT path, CAST(entity_id % 21 AS BIGINT) AS participant_id, entity_id AS sequence_id, class AS sign, '/data/set/' || path AS abs_path FROM catalog",
    "catalog"))
def read_catalog(spark, sf):
    path = scratch_dir(spark, "catalog")
    fx.catalog(spark, sf).select("path", (F.col("entity_id") % 21).alias("participant_id"),
                                 F.col("entity_id").alias("sequence_id"), F.col("class").alias("sign")
                                 ).write.option("header", True).csv(path)
    return tr.read_catalog(spark, path, "/data\\set")


def _track_files(spark, sf):
    """Packed track files below a scratch path, and a catalog of the entities in them."""
    root = scratch_dir(spark, "tracks") + "/set one + 50%"  # such names are encoded in file metadata
    tr.write_tracks(fx.tracks(spark, sf).select("entity_id", "frame", "grp", "idx", "x", "y", "z"), root)
    return root, fx.catalog(spark, sf).drop("path").join(tr.packed_entities(spark, root), "entity_id")


FILE_SCHEMA = "entity_id long, frame int, grp string, idx int, x double, y double, z double"


@query("a2_read_tracks", sql(
    f"SELECT entity_id, class, frame, grp, idx, {rd('x')} AS x, {rd('y')} AS y, {rd('z')} AS z FROM tracks", "tracks"))
def read_tracks(spark, sf):
    root, cat = _track_files(spark, sf)
    return rounded(tr.read_tracks(spark, f"{root}/*.parquet", cat, FILE_SCHEMA, ["entity_id"]))


@query("a3_register_track_view", sql(
    f"SELECT class, grp, idx, count(*) AS n, {rd('avg(x)', 9)} AS x FROM tracks GROUP BY class, grp, idx", "tracks"))
def register_track_view(spark, sf):
    root, cat = _track_files(spark, sf)
    tr.register_track_view(spark, "all_tracks", f"{root}/*.parquet", cat, FILE_SCHEMA, ["entity_id"])
    return rounded(spark.sql("SELECT class, grp, idx, count(*) AS n, avg(x) AS x FROM all_tracks GROUP BY class, grp, idx"), digits=9)


@query("a4_decode_archives", sql(
    """SELECT CAST(e.entity_id AS VARCHAR) AS id, e.class AS label, CAST(f.frame AS INTEGER) AS frame, CAST(r.row AS INTEGER) AS row,
    t.y AS x, CASE WHEN t.y IS NOT NULL THEN CAST(t.idx AS DOUBLE) END AS y
    FROM (SELECT entity_id, class, max(frame) + 1 AS n FROM tracks GROUP BY 1, 2) e
    JOIN (SELECT unnest(range(64)) AS frame) f ON f.frame < e.n JOIN (SELECT unnest(range(10)) AS row) r ON true
    LEFT JOIN tracks t ON t.entity_id = e.entity_id AND t.frame = f.frame AND t.row = r.row""", "tracks"))
def decode_archives(spark, sf):
    def pack(key, pdf):
        import io

        import numpy as np
        import pandas as pd

        marks = np.full((int(pdf["frame"].max()) + 1, 10, 3), np.nan, dtype=np.float16)
        at = (pdf["frame"].to_numpy(), pdf["row"].to_numpy())
        marks[at + (np.zeros(len(pdf), int),)] = pdf["y"]
        marks[at + (np.ones(len(pdf), int),)] = pdf["idx"]
        buf = io.BytesIO()
        np.savez_compressed(buf, landmarks=marks, fps=np.float32(30), num_frames=np.int32(len(marks)))
        return pd.DataFrame({"id": [str(key[0])], "label": [key[1]], "content": [buf.getvalue()]})

    files = fx.tracks(spark, sf).groupBy("entity_id", "class").applyInPandas(
        pack, "id string, label string, content binary")
    rows = tr.decode_archives(files)
    return rows.select("id", "label", "frame", F.col("row").cast("int").alias("row"),
                       F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@query("c1_attach_catalog", sql(
    "SELECT c.class, e.event_id FROM events e JOIN catalog c ON c.entity_id = e.user_id WHERE c.entity_id % 3 <> 0", "catalog"))
def attach_catalog(spark, sf):
    e = fx.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("file:///data\\train\\c"), (F.col("user_id") % 10).cast("string"), F.lit("\\"),
                             F.col("user_id").cast("string")).alias("file_path"))
    cat = fx.catalog(spark, sf).where("entity_id % 3 <> 0").select(
        "class", F.concat(F.lit("/data/"), F.col("path")).alias("abs_path"))
    return tr.attach_catalog(e, cat).select("class", "event_id")


# -- channels ---------------------------------------------------------------

@query("b1_select_channels", sql(
    f"SELECT entity_id, class, grp, idx, row, frame, {rd('x')} AS x, {rd('y')} AS y FROM tracks WHERE row IN (SELECT row FROM membership WHERE subset = 'HANDS_4')",
    "tracks", "membership"))
def select_channels(spark, sf):
    return rounded(ds.select_channels(fx.tracks(spark, sf), fx.membership(spark), "HANDS_4", "xy"))


@query("b2_feature_columns", sql(
    """SELECT m.subset, CAST(count(*) AS BIGINT) AS n_cells, CAST(sum(m.row * 3 + k.c) AS BIGINT) AS feature_sum FROM membership m
    JOIN (VALUES (0), (1)) k(c) ON true JOIN tracks t ON t.row = m.row GROUP BY m.subset""", "tracks", "membership"))
def feature_columns(spark, sf):
    feats = ds.feature_columns(fx.membership(spark), "xy").withColumn("row", F.floor(F.col("feature") / 3).cast("int"))
    return fx.tracks(spark, sf).join(feats, "row").groupBy("subset").agg(
        F.count("*").alias("n_cells"), F.sum("feature").alias("feature_sum"))


@query("b4_row_of", sql(
    "SELECT entity_id, frame, grp, idx, CAST(row_offset + idx AS INTEGER) AS row FROM tracks JOIN layout USING (grp)", "tracks", "layout"))
def row_of(spark, sf):
    t = ds.row_of(fx.raw_tracks(spark, sf), fx.layout(spark))
    return t.select("entity_id", "frame", "grp", "idx", "row")


@query("b_subset_tag", sql(
    """SELECT DISTINCT subset, coords, CASE WHEN coords = 'xyz' THEN replace(lower(subset), '_', '')
       ELSE replace(lower(subset), '_', '') || '-' || coords END AS tag
    FROM (SELECT subset, CASE WHEN run_id % 3 = 0 THEN 'xy' ELSE 'xyz' END AS coords FROM runs)""", "runs"))
def subset_tags(spark, sf):
    r = fx.runs(spark, sf).select("subset", F.when(F.col("run_id") % 3 == 0, "xy").otherwise("xyz").alias("coords")).distinct()
    return r.withColumn("tag", subset_tag("subset", F.col("coords")))


@query("g2_subset_algebra", sql(
    """SELECT 'union' AS op, count(*) AS n_rows, CAST(sum(row) AS BIGINT) AS row_sum FROM (SELECT row FROM m WHERE subset = 'a' UNION SELECT row FROM m WHERE subset = 'b')
    UNION ALL SELECT 'intersect', count(*), CAST(sum(row) AS BIGINT) FROM (SELECT row FROM m WHERE subset = 'a' INTERSECT SELECT row FROM m WHERE subset = 'b')
    UNION ALL SELECT 'except', count(*), CAST(sum(row) AS BIGINT) FROM (SELECT row FROM m WHERE subset = 'a' EXCEPT SELECT row FROM m WHERE subset = 'b')""",
    extra="""comp AS (SELECT 'p' || CAST(p_size % 7 AS VARCHAR) AS component, p_partkey AS row FROM part),
m AS (SELECT DISTINCT d.subset, c.row FROM (VALUES ('a', 'p1'), ('a', 'p2'), ('a', 'p3'), ('b', 'p3'), ('b', 'p4')) d(subset, component) JOIN comp c USING (component))"""))
def subset_algebra(spark, sf):
    comp = fx.table(spark, sf, "part").select(
        F.concat(F.lit("p"), (F.col("p_size") % 7).cast("string")).alias("component"), F.col("p_partkey").alias("row"))
    parts = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("a", "p3"), ("b", "p3"), ("b", "p4")], "subset string, component string")
    m = ds.build_membership(comp, parts)
    m = m.union(m.where("row % 2 = 0"))  # rows that repeat are one
    return ds.union_units([ds.subset_op(m, "a", "b", o).agg(F.count("*").alias("n_rows"), F.sum("row").alias("row_sum"))
                           .select(F.lit(o).alias("op"), "*") for o in ("union", "intersect", "except")])


UNITS = {"click": "x", "error": "z", "purchase": "y", "signup": "x", "view": "y"}


@query("g1_union_units", sql(" UNION ALL ".join(
    "SELECT entity_id, " + ", ".join(f"{rd(c) if c == v else 'CAST(NULL AS DOUBLE)'} AS {c}" for c in "xyz") + f" FROM tracks WHERE grp = '{g}'"
    for g, v in UNITS.items()), "tracks"))
def union_units(spark, sf):
    t = fx.tracks(spark, sf)
    return rounded(ds.union_units([t.where(F.col("grp") == g).select("entity_id", v) for g, v in UNITS.items()]))


@query("g3_dedup_first", sql(
    "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1"))
def dedup_first(spark, sf):
    return ds.dedup_first(fx.table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_type", "event_id")


# -- sequences --------------------------------------------------------------

POS = """pos0 AS (SELECT t.entity_id, t.row, t.x, t.frame - e.f0 AS pos, e.f1 - e.f0 + 1 AS n FROM tracks t
  JOIN (SELECT entity_id, min(frame) AS f0, max(frame) AS f1 FROM tracks GROUP BY 1) e USING (entity_id))"""


def _linspace(n: int, fn: str) -> str:
    return f"CASE WHEN i = {n - 1} THEN n - 1 ELSE CAST({fn}(i * ((n - 1) / {n - 1}.0::DOUBLE)) AS BIGINT) END"


@query("b7_subsample_uniform", sql(
    f"""SELECT p.entity_id, p.row, CAST(coalesce(k.i, p.pos) AS BIGINT) AS pos, CAST(least(p.n, 13) AS INTEGER) AS n_frames, {rd('p.x')} AS x
    FROM pos0 p LEFT JOIN (SELECT DISTINCT n, i, {_linspace(13, 'trunc')} AS src FROM pos0, range(13) r(i)) k ON k.n = p.n AND k.src = p.pos
    WHERE p.n <= 13 OR k.i IS NOT NULL""", "tracks", extra=POS))
def subsample_uniform(spark, sf):
    s = ds.subsample_uniform(ds.with_positions(fx.tracks(spark, sf)), 13)
    return rounded(s.select("entity_id", "row", "pos", "n_frames", "x"))


@query("b8_resample_uniform", sql(
    f"""SELECT p.entity_id, p.row, CAST(k.i AS INTEGER) AS pos, 64 AS n_frames, {rd('p.x')} AS x
    FROM pos0 p JOIN (SELECT DISTINCT n, i, {_linspace(64, 'round_even')} AS src FROM pos0, range(64) r(i)) k ON k.n = p.n AND k.src = p.pos""".replace(
        "round_even(i * ((n - 1) / 63.0::DOUBLE))", "round_even(i * ((n - 1) / 63.0::DOUBLE), 0)"), "tracks", extra=POS))
def resample_uniform(spark, sf):
    s = ds.resample_uniform(ds.with_positions(fx.tracks(spark, sf)), 64)
    return rounded(s.select("entity_id", "row", "pos", "n_frames", "x"))


@query("b9_pad_or_truncate", sql(
    f"""SELECT e.entity_id, CAST(p.i AS INTEGER) AS pos, least(e.n, 20) AS n_frames, {rd('coalesce(CASE WHEN p.i % 2 = 0 THEN t.x ELSE t.y END, 0)')} AS value
    FROM (SELECT entity_id, count(DISTINCT frame) AS n FROM tracks GROUP BY 1) e CROSS JOIN range(240) p(i)
    LEFT JOIN (SELECT *, dense_rank() OVER (PARTITION BY entity_id ORDER BY frame) - 1 AS k FROM tracks) t
      ON t.entity_id = e.entity_id AND t.k = p.i // 12 AND t.row = (p.i % 12) // 2""", "tracks"))
def pad_or_truncate(spark, sf):
    s = ds.pad_or_truncate(fx.tracks(spark, sf), 20, range(6))
    return rounded(s.select("entity_id", "n_frames", F.posexplode("seq").alias("pos", "value")))


def _lengths(spark, sf):
    return fx.table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("n_frames"))


@query("b10_pack_offsets", sql(
    """SELECT doc_id AS key, n_chars AS n_frames, CAST(sum(n_chars) OVER w - n_chars AS BIGINT) AS start, CAST(sum(n_chars) OVER w AS BIGINT) AS "end"
    FROM documents WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)"""))
def pack_offsets(spark, sf):
    return ds.pack_offsets(_lengths(spark, sf), "key")


@query("b11_padded_batches", sql(
    """SELECT key, n_frames, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY n_frames DESC, key) - 1 AS slot,
    max(n_frames) OVER (PARTITION BY batch_id) AS padded_to
    FROM (SELECT doc_id AS key, n_chars AS n_frames, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id FROM documents)"""))
def padded_batches(spark, sf):
    b = ds.padded_batches(_lengths(spark, sf), "key", 32)
    return b.withColumn("slot", F.col("slot").cast("long"))


SEQ_DIM = 4
SEQ_SQL = """s AS (SELECT vec_id AS key, 1 + vec_id % 8 AS n_frames, label,
    CAST(embedding[1:4 * (1 + vec_id % 8)] AS DOUBLE[]) AS seq FROM embeddings)"""


def _sequences(spark, sf):
    """Embeddings cut to sequences of one to eight frames of four features."""
    n = (1 + F.col("vec_id") % 8).cast("long")
    return fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("key"), n.alias("n_frames"), "label",
        F.transform(F.slice("embedding", F.lit(1), (n * SEQ_DIM).cast("int")), lambda x: x.cast("double")).alias("seq"))


@query("b11_padded_values", sql(
    f"""SELECT batch_id, slot, key, n_frames, padded_to, place, {rd('v')} AS value FROM (
        SELECT batch_id, slot, key, n_frames, padded_to, unnest(range(0, padded_to * 4)) AS place, unnest(list_concat(
            seq, list_resize([]::DOUBLE[], (padded_to - n_frames) * 4, 0.0::DOUBLE))) AS v
        FROM (SELECT key, n_frames, seq, batch_id, max(n_frames) OVER (PARTITION BY batch_id) AS padded_to,
                     row_number() OVER (PARTITION BY batch_id ORDER BY n_frames DESC, key) - 1 AS slot
              FROM (SELECT *, (row_number() OVER (ORDER BY key) - 1) // 32 AS batch_id FROM s)))""", extra=SEQ_SQL))
def padded_values(spark, sf):
    b = ds.padded_values(_sequences(spark, sf), "key", 32, SEQ_DIM)
    cells = b.select("batch_id", F.col("slot").cast("long").alias("slot"), "key", "n_frames", "padded_to", F.posexplode("values").alias("place", "value"))
    return rounded(cells.withColumn("place", F.col("place").cast("long")))


@query("b10_offset_slices", sql(
    f"""SELECT key AS entity_id, position, feature, {rd('v')} AS value FROM (
        SELECT key, position, unnest(range(0, 4)) AS feature, unnest(seq[position * 4 + 1:position * 4 + 4]) AS v
        FROM (SELECT *, unnest(range(0, n_frames)) AS position FROM s WHERE label = 3))""", extra=SEQ_SQL))
def offset_slices(spark, sf):
    path, seq = scratch_dir(spark, "frame-store"), _sequences(spark, sf)
    at = F.explode(F.sequence(F.lit(0), (F.col("n_frames") - 1).cast("int")))
    frames = seq.select(F.col("key").alias("entity_id"), "seq", at.alias("frame")).select(
        "entity_id", "frame", F.slice("seq", F.col("frame") * SEQ_DIM + 1, F.lit(SEQ_DIM)).alias("features"))
    frame_store.write_frame_store(frames, path, frames_per_block=1_000)
    got = frame_store.read_slices(spark, path, seq.where("label = 3").select(F.col("key").alias("entity_id")))
    cells = got.select("entity_id", "position", F.posexplode("features").alias("feature", "value"))
    return rounded(cells.withColumn("feature", F.col("feature").cast("long")))


@query("e16_chunk_ids", sql(
    "SELECT entity_id, class, path, 'chunk_' || lpad(CAST((row_number() OVER (ORDER BY path) - 1) // 40 AS VARCHAR), 5, '0') AS chunk FROM catalog", "catalog"))
def chunk_ids(spark, sf):
    return ds.chunk_ids(fx.catalog(spark, sf), "path", 40)


# -- labels and splits ------------------------------------------------------

@query("c2_encode_labels", sql(
    """SELECT key, class, CASE class WHEN 'de' THEN 3 WHEN 'en' THEN 1 WHEN 'fr' THEN 7 END AS label FROM split_in""", "split_in"))
def encode_labels(spark, sf):
    m = spark.createDataFrame([("de", 3), ("en", 1), ("fr", 7)], "class string, label int")
    return ds.encode_labels(fx.split_in(spark, sf), m)


@query("c2_encode_sorted", sql(
    "SELECT key, class, CAST(dense_rank() OVER (ORDER BY class) - 1 AS INTEGER) AS label FROM split_in", "split_in"))
def encode_sorted(spark, sf):
    return ds.encode_sorted(fx.split_in(spark, sf))


def _dist(src: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""SELECT {head}class, count, {rd('mean')} AS mean, mode, {rd('std')} AS std, {rd('variance')} AS variance,
      CASE WHEN count > mean THEN 'above' WHEN count < mean THEN 'below' ELSE 'equal' END AS side FROM (
      SELECT {head}class, count, avg(count) OVER ({part}) AS mean, stddev_samp(count) OVER ({part}) AS std, var_samp(count) OVER ({part}) AS variance,
        first_value(count) OVER ({part} ORDER BY times DESC, count) AS mode
      FROM (SELECT *, count(*) OVER (PARTITION BY {head}count) AS times FROM (SELECT {head}class, count(*) AS count FROM {src} GROUP BY ALL)))"""


@query("d14_label_distribution", sql(_dist("(SELECT source AS class FROM documents)")))
def label_distribution(spark, sf):
    return rounded(ds.label_distribution(fx.table(spark, sf, "documents").select(F.col("source").alias("class"))))


@query("h1_sample_n", sql("SELECT entity_id, class, path FROM catalog ORDER BY md5('42|' || CAST(entity_id AS VARCHAR)), entity_id LIMIT 50", "catalog"))
def sample_n(spark, sf):
    from motionframe.plans.selection import sample_n as take

    return take(fx.catalog(spark, sf), 50, 42, "entity_id")


@query("h2_sample_classes", sql(
    """SELECT key, class FROM split_in WHERE class IN (SELECT class FROM (SELECT DISTINCT class FROM split_in) ORDER BY md5('7|' || class), class LIMIT 2)
    QUALIFY row_number() OVER (PARTITION BY class ORDER BY md5('7|' || CAST(key AS VARCHAR)), key) <= 30""", "split_in"))
def sample_classes(spark, sf):
    return ds.sample_classes(fx.split_in(spark, sf), 2, 7, per_class=30).select("key", "class")


@query("h3_sample_two_stage", sql(
    """SELECT entity_id, class FROM descr0 WHERE class IN (SELECT class FROM descr0 GROUP BY class HAVING count(*) >= 45
      ORDER BY md5('5|' || CAST(class AS VARCHAR)), class LIMIT 3)
    QUALIFY row_number() OVER (PARTITION BY class ORDER BY md5('5|' || CAST(entity_id AS VARCHAR)), entity_id) <= 45""",
    extra="descr0 AS (SELECT vec_id AS entity_id, label AS class FROM embeddings)"))
def sample_two_stage(spark, sf):
    v = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("entity_id"), F.col("label").alias("class"))
    return ds.sample_two_stage(v, 3, 45, 5, key="entity_id").select("entity_id", "class")


def quota_sql(name: str, src: str, frac: str) -> str:
    return f"""{name}0 AS (SELECT class, count(*) AS size, CAST(ceil(round({frac}::DOUBLE * sum(count(*)) OVER (), 9)) AS BIGINT) AS total,
  CAST(sum(count(*)) OVER () AS BIGINT) AS n FROM {src} GROUP BY class),
{name}1 AS (SELECT class, (total * size) // n AS base, (total * size) % n AS left_, total FROM {name}0),
{name} AS (SELECT class, base + CASE WHEN row_number() OVER (ORDER BY left_ DESC, class) <= total - sum(base) OVER () THEN 1 ELSE 0 END AS take FROM {name}1)"""


def split_sql(name: str, src: str, quota: str, seed: int, a: str, b: str) -> str:
    return f"""{name} AS (SELECT s.key, s.class, CASE WHEN row_number() OVER (PARTITION BY s.class ORDER BY md5('{seed}|' || CAST(s.key AS VARCHAR)), s.key) <= q.take
  THEN '{b}' ELSE '{a}' END AS split FROM {src} s JOIN {quota} q USING (class))"""


SPLIT = quota_sql("q1", "split_in", "0.1") + ", " + split_sql("sp", "split_in", "q1", 42, "train", "val")
THREE = (quota_sql("q2", "split_in", "0.2") + ", " + split_sql("sp2", "split_in", "q2", 42, "train", "rest")
         + ", rest AS (SELECT key, class FROM sp2 WHERE split = 'rest'), " + quota_sql("q3", "rest", "0.5") + ", "
         + split_sql("sp3", "rest", "q3", 43, "test", "val")
         + ", three AS (SELECT * FROM sp2 WHERE split = 'train' UNION ALL SELECT * FROM sp3)")


@query("h4_stratified_split", sql("SELECT * FROM sp", "split_in", extra=SPLIT))
def stratified_split(spark, sf):
    return ds.stratified_split(fx.split_in(spark, sf), 0.1, 42)


@query("h5_split_three_way", sql("SELECT * FROM three", "split_in", extra=THREE))
def split_three_way(spark, sf):
    return ds.split_three_way(fx.split_in(spark, sf), 42)


@query("h6_disjoint_slices", sql(
    "SELECT key, class, (row_number() OVER (ORDER BY key) - 1) // 20 AS slice FROM split_in ORDER BY key LIMIT 100", "split_in"))
def disjoint_slices(spark, sf):
    return ds.disjoint_slices(fx.split_in(spark, sf), "key", 20, 5)


@query("h7_split_stats", sql(_dist("three", "split"), "split_in", extra=THREE))
def split_stats(spark, sf):
    return rounded(ds.label_distribution(ds.split_three_way(fx.split_in(spark, sf), 42), by=["split"]))


# -- learning ---------------------------------------------------------------

@query("j2_standardize", sql(
    f"""SELECT d.entity_id, d.class, d.row, d.descriptor, {rd('(d.value - s.m) / s.sd')} AS value FROM descr d
    JOIN (SELECT row, descriptor, avg(value) AS m, stddev_pop(value) AS sd FROM descr WHERE entity_id % 10 <> 0 GROUP BY 1, 2) s USING (row, descriptor)""", "descr"))
def standardize(spark, sf):
    d = fx.desc(spark, sf)
    return rounded(ln.standardize(d.where("entity_id % 10 <> 0"), d))


def _features(spark, sf):
    return fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("entity_id"), F.col("label").alias("class"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"))


# What SQL can derive of a probe: sizes, the split per class, and what share naming the
# commonest class of the validation rows would get right. That the fit has settled is judged by its
# gradient over all training rows; the fitted numbers are tested against a plain solver.
PROBE = """em AS (SELECT vec_id AS key, label AS class FROM embeddings),
""" + quota_sql("pq", "em", "0.1")
MAJORITY = "(SELECT max(take)::DOUBLE / sum(take) FROM pq)"
PROBE_TOL = 1e-4


def _settled():
    """The gradient over all training rows vanishes, and the loss is below that of equal odds.

    Accuracy is no criterion here: labels of the table do not depend on its vectors.
    """
    return ((F.col("gradient_norm") <= PROBE_TOL) & (F.col("n_iter") > 0)
            & (F.col("loss") < F.log(F.col("n_classes").cast("double")))).alias("settled")


@query("j3_probe_subset", sql(
    f"""SELECT class AS label, CAST(take AS BIGINT) AS n_val, 8 AS n_channels, {rd(MAJORITY)} AS majority, true AS settled
    FROM pq WHERE take > 0""", extra=PROBE))
def probe_subset(spark, sf):
    summary, per_class = ln.probe_subset(_features(spark, sf), fx.DESC_SUBSETS["EVEN_8"], 4, tol=PROBE_TOL)
    one = summary.select("n_channels", "majority", _settled())
    return rounded(per_class.crossJoin(F.broadcast(one)).select("label", "n_val", "n_channels", "majority", "settled"))  # one row


@query("j4_probe_leaderboard", sql(
    f"""SELECT s.subset, CAST(s.n AS INTEGER) AS n_channels, (SELECT CAST(sum(take) AS BIGINT) FROM pq) AS n_val, {rd('s.median_f')} AS median_f,
        {rd(MAJORITY)} AS majority, true AS settled
    FROM (SELECT m.subset, count(*) AS n, median(f.f_max) AS median_f FROM desc_membership m JOIN fm f USING (row) GROUP BY m.subset) s""",
    "descr", "desc_membership", extra=PROBE + """,
nn AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT class)::DOUBLE AS k FROM em),
cl AS (SELECT row, descriptor, class, count(*)::DOUBLE AS c, avg(value) AS m, var_pop(value) AS v FROM descr GROUP BY ALL),
gr AS (SELECT row, descriptor, avg(value) AS g FROM descr GROUP BY ALL),
ff AS (SELECT row, descriptor, (sum(c * (m - g) * (m - g)) / (any_value(k) - 1)) / (sum(c * v) / (any_value(n) - any_value(k))) AS f
       FROM cl JOIN gr USING (row, descriptor), nn GROUP BY row, descriptor),
fm AS (SELECT row, max(f) AS f_max FROM ff GROUP BY row)"""))
def probe_leaderboard(spark, sf):
    from motionframe.operators import scoring as sc

    f = sc.max_per_channel(sc.f_ratio(fx.desc(spark, sf)), "f", "f_max")
    med = sc.subset_median(fx.membership(spark, fx.DESC_SUBSETS), f, "f_max", "median_f")
    board = ln.probe_leaderboard(_features(spark, sf), fx.DESC_SUBSETS, 4, med, tol=PROBE_TOL)
    return rounded(board.select("subset", "n_channels", "n_val", "median_f", "majority", _settled()))


@query("j5_score_entities", sql(
    "SELECT vec_id AS entity_id, label, CAST((list_position(embedding, list_max(embedding)) - 1) % 10 AS INTEGER) AS pred FROM embeddings"))
def score_entities(spark, sf):
    def load():
        import numpy as np

        return lambda arrays: np.stack(arrays).argmax(axis=1) % 10

    v = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("entity_id"), "label", F.col("embedding").alias("features"))
    return ln.score_entities(v, load)
