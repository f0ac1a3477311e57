"""Inputs derived from the driver's tables, once as DataFrames and once as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# groups of the fixture, in row order; two channels each (first and second half of the day)
GROUPS = ["click", "error", "purchase", "signup", "view"]
GROUP_SIZE = 2
ROLES = {"left_hand": "click", "face": "error", "pose": "purchase", "right_hand": "signup"}
SUBSETS = {
    "HANDS_4": [0, 1, 6, 7],
    "FACE_2": [2, 3],
    "HANDS_POSE_6": [0, 1, 4, 5, 6, 7],
    "FULL_10": list(range(10)),
}
DESC_SUBSETS = {
    "FIRST_4": [0, 1, 2, 3],
    "EVEN_8": [0, 2, 4, 6, 8, 10, 12, 14],
    "FULL_16": list(range(16)),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layout(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(g, i * GROUP_SIZE, GROUP_SIZE) for i, g in enumerate(GROUPS)],
        "grp string, row_offset int, size int")


def membership(spark: SparkSession, subsets=None) -> DataFrame:
    return spark.createDataFrame(
        [(s, r) for s, rows in (subsets or SUBSETS).items() for r in rows], "subset string, row int")


def raw_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track rows before the channel row number is known."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return (e.groupBy(
        F.col("user_id").alias("entity_id"),
        F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string")).alias("class"),
        F.datediff(ts, F.lit("2024-01-01")).alias("frame"),
        F.col("event_type").alias("grp"),
        F.floor(F.hour(ts) / 12).cast("int").alias("idx"))
        .agg(F.avg("value").alias("x"), F.count("*").cast("double").alias("y"),
             (F.max("value") - F.min("value")).alias("z")))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    offset = F.lit(None).cast("int")
    for i, g in enumerate(GROUPS):
        offset = F.when(F.col("grp") == g, F.lit(i * GROUP_SIZE)).otherwise(offset)
    return raw_tracks(spark, sf_dir).select(
        "entity_id", "class", "grp", "idx", (offset + F.col("idx")).alias("row"),
        "frame", "x", "y", "z")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id").distinct()
    cls = F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string"))
    return e.select(
        F.col("user_id").alias("entity_id"), cls.alias("class"),
        F.concat(F.lit("train/"), cls, F.lit("/"), F.col("user_id").cast("string")).alias("path"))


def desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return (v.select(F.col("vec_id").alias("entity_id"), F.col("label").alias("class"),
                     F.posexplode("embedding").alias("pos", "value"))
            .select("entity_id", "class", F.floor(F.col("pos") / 4).cast("int").alias("row"),
                    (F.col("pos") % 4).alias("descriptor"), F.col("value").cast("double").alias("value")))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    r = v.select("vec_id", "label", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("run_id"))
    wrong = (F.col("vec_id") * 7 + F.col("run_id") * 3) % 4 == 0
    return r.select(
        "run_id", F.col("vec_id").alias("entity_id"), "label",
        F.when(wrong, (F.col("label") + 1 + F.col("vec_id") % 3) % 10)
        .otherwise(F.col("label")).cast("int").alias("pred"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    tested = F.when(k % 4 != 0, F.struct((k % 5 == 0).alias("tested"),
                                         F.when(k % 5 == 0, F.lit("local")).alias("platform")))
    return o.select(
        k.alias("run_id"), F.col("o_orderpriority").alias("architecture"),
        F.col("o_orderstatus").alias("dataset"),
        F.when(k % 2 == 0, F.lit("ME_126")).otherwise(F.lit("HANDS_42")).alias("subset"),
        F.when(k % 4 == 0, F.lit(2)).otherwise(F.lit(3)).alias("schema_version"),
        F.struct(
            F.when(k % 3 != 0, (k * 37 % 1000) / F.lit(1000.0)).alias("overall_accuracy"),
            ((k * 53 % 1000) / F.lit(1000.0)).alias("train_val_acc"),
            F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 3 != 0, F.lit("canonical"))
            .otherwise(F.lit("pending")).alias("eval_status")).alias("metrics"),
        tested.alias("submission"),
        F.when(k % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("note "), k.cast("string"))).alias("notes"))


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    w = W.partitionBy("run_id").orderBy("o_orderkey")
    h = o.withColumn("run_id", F.col("o_custkey")).withColumn("epoch", F.row_number().over(w))
    val = (F.col("epoch") / (F.col("epoch") + F.lit(8.0))
           + ((F.col("o_orderkey") * 31) % 7) / F.lit(1000.0))
    return (h.withColumn("val_acc", val)
            .select("run_id", "epoch", "val_acc",
                    F.least(F.lit(1.0), F.col("val_acc") + F.col("epoch") * 0.004).alias("train_acc")))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id % 11 <> 0")
    failed = F.col("doc_id") % 7 == 0
    return d.select(
        F.col("doc_id").alias("unit_id"),
        F.when(failed, "failed").otherwise("done").alias("status"),
        F.when(failed, F.concat(F.lit("error "), (F.col("doc_id") % 3).cast("string"))).alias("error"),
        (F.col("n_chars") % 120).cast("int").alias("n_frames"),
        (F.col("n_chars") / F.lit(1000.0)).alias("seconds"),
        F.when(~failed, F.concat(F.lit("out/"), F.col("doc_id").cast("string"), F.lit(".npz"))).alias("artifact"))


def work_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("unit_id"), F.col("lang").alias("split"),
                    F.col("source").alias("class"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on disk: some done units lost theirs, some have one without a manifest row."""
    d = table(spark, sf_dir, "documents").where("doc_id % 13 <> 0 AND doc_id % 7 <> 0")
    return d.select(F.col("doc_id").alias("unit_id"), F.col("n_chars").alias("size_bytes"))


def split_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"), F.col("lang").alias("class"))


def pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("trial"), F.col("p_size").alias("n_workers"),
        (F.col("p_retailprice") / F.lit(1000.0)).alias("videos_per_s"),
        (F.col("p_partkey") % 100).cast("double").alias("cpu_mean_pct"))


def r6(c, digits: int = 6) -> Column:
    """Rounded for comparison; adding 0.0 turns a negative zero into zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round the named columns, or every double column when none is named."""
    cols = cols or tuple(f.name for f in df.schema.fields if f.dataType.typeName() == "double")
    return df.select(*[r6(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------------------
# the same inputs as SQL common table expressions

CTE: dict[str, str] = {}

CTE["tracks"] = """tracks AS (
  SELECT user_id AS entity_id, 'c' || CAST(user_id % 10 AS VARCHAR) AS class, event_type AS grp,
         CAST(floor(hour(ts) / 12) AS INTEGER) AS idx,
         CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 2 WHEN 'purchase' THEN 4
              WHEN 'signup' THEN 6 WHEN 'view' THEN 8 END + floor(hour(ts) / 12) AS INTEGER) AS row,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS frame,
         avg(value) AS x, CAST(count(*) AS DOUBLE) AS y, max(value) - min(value) AS z
  FROM events GROUP BY ALL)"""
CTE["catalog"] = """catalog AS (
  SELECT DISTINCT user_id AS entity_id, 'c' || CAST(user_id % 10 AS VARCHAR) AS class,
         'train/c' || CAST(user_id % 10 AS VARCHAR) || '/' || CAST(user_id AS VARCHAR) AS path
  FROM events)"""
CTE["layout"] = "layout(grp, row_offset, size) AS (VALUES " + ", ".join(
    f"('{g}', {i * GROUP_SIZE}, {GROUP_SIZE})" for i, g in enumerate(GROUPS)) + ")"
CTE["membership"] = "membership(subset, row) AS (VALUES " + ", ".join(
    f"('{s}', {r})" for s, rows in SUBSETS.items() for r in rows) + ")"
CTE["desc_membership"] = "desc_membership(subset, row) AS (VALUES " + ", ".join(
    f"('{s}', {r})" for s, rows in DESC_SUBSETS.items() for r in rows) + ")"
CTE["descr"] = """descr AS (
  SELECT entity_id, class, CAST(floor((pos - 1) / 4) AS INTEGER) AS row,
         CAST((pos - 1) % 4 AS INTEGER) AS descriptor, CAST(value AS DOUBLE) AS value
  FROM (SELECT vec_id AS entity_id, label AS class, unnest(embedding) AS value,
               generate_subscripts(embedding, 1) AS pos FROM embeddings))"""
CTE["preds"] = """preds AS (
  SELECT CAST(r AS INTEGER) AS run_id, vec_id AS entity_id, label,
         CAST(CASE WHEN (vec_id * 7 + r * 3) % 4 = 0 THEN (label + 1 + vec_id % 3) % 10
              ELSE label END AS INTEGER) AS pred
  FROM embeddings, (VALUES (0), (1), (2)) t(r))"""
CTE["runs"] = """runs AS (
  SELECT o_orderkey AS run_id, o_orderpriority AS architecture, o_orderstatus AS dataset,
         CASE WHEN o_orderkey % 2 = 0 THEN 'ME_126' ELSE 'HANDS_42' END AS subset,
         CAST(CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 3 END AS INTEGER) AS schema_version,
         CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey * 37 % 1000) / 1000.0::DOUBLE END AS overall_accuracy,
         (o_orderkey * 53 % 1000) / 1000.0::DOUBLE AS train_val_acc,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 <> 0 THEN 'canonical'
              ELSE 'pending' END AS eval_status,
         CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 5 = 0 END AS tested,
         CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 5 = 0 THEN 'local' END AS platform,
         CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'note ' || CAST(o_orderkey AS VARCHAR) END AS notes,
         coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey * 37 % 1000) / 1000.0::DOUBLE END,
                  (o_orderkey * 53 % 1000) / 1000.0::DOUBLE) AS accuracy
  FROM orders)"""
CTE["hist"] = """hist0 AS (
  SELECT o_custkey AS run_id, o_orderkey,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS epoch
  FROM orders),
hist1 AS (SELECT run_id, epoch, epoch / (epoch + 8.0::DOUBLE) + ((o_orderkey * 31) % 7) / 1000.0::DOUBLE AS val_acc
  FROM hist0),
hist AS (SELECT *, least(1.0::DOUBLE, val_acc + epoch * 0.004::DOUBLE) AS train_acc FROM hist1)"""
CTE["manifest"] = """manifest AS (
  SELECT doc_id AS unit_id, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'done' END AS status,
         CASE WHEN doc_id % 7 = 0 THEN 'error ' || CAST(doc_id % 3 AS VARCHAR) END AS error,
         CAST(n_chars % 120 AS INTEGER) AS n_frames, n_chars / 1000.0::DOUBLE AS seconds,
         CASE WHEN doc_id % 7 <> 0 THEN 'out/' || CAST(doc_id AS VARCHAR) || '.npz' END AS artifact
  FROM documents WHERE doc_id % 11 <> 0)"""
CTE["work_catalog"] = "work_catalog AS (SELECT doc_id AS unit_id, lang AS split, source AS class FROM documents)"
CTE["artifacts"] = """artifacts AS (SELECT doc_id AS unit_id, n_chars AS size_bytes FROM documents
  WHERE doc_id % 13 <> 0 AND doc_id % 7 <> 0)"""
CTE["split_in"] = "split_in AS (SELECT doc_id AS key, lang AS class FROM documents)"
CTE["pilot"] = """pilot AS (SELECT p_partkey AS trial, p_size AS n_workers,
  p_retailprice / 1000.0::DOUBLE AS videos_per_s, CAST(p_partkey % 100 AS DOUBLE) AS cpu_mean_pct FROM part)"""

# frame grid and gap filling, needs tracks
CTE["grid"] = """ext AS (SELECT entity_id, min(frame) AS f0, max(frame) AS f1 FROM tracks GROUP BY entity_id),
chan AS (SELECT DISTINCT entity_id, class, grp, idx, row FROM tracks),
grid AS (
  SELECT c.entity_id, c.class, c.grp, c.idx, c.row, CAST(g.f AS INTEGER) AS frame, e.f0, e.f1, t.x, t.y, t.z
  FROM chan c JOIN ext e USING (entity_id)
  JOIN (SELECT unnest(range((SELECT min(f0) FROM ext), (SELECT max(f1) + 1 FROM ext))) AS f) g
    ON g.f BETWEEN e.f0 AND e.f1
  LEFT JOIN tracks t ON t.entity_id = c.entity_id AND t.row = c.row AND t.frame = g.f)"""


def _fill(a: str) -> str:
    return f"""CASE WHEN {a} IS NOT NULL THEN {a} WHEN {a}p IS NULL THEN {a}n WHEN {a}n IS NULL THEN {a}p
      ELSE {a}p + ({a}n - {a}p) * (frame - fp{a}) / (fn{a} - fp{a}) END AS {a}f"""


CTE["filled"] = """fill0 AS (
  SELECT *, x IS NOT NULL AS seen, """ + ", ".join(
    f"""last_value({a} IGNORE NULLS) OVER pre AS {a}p, first_value({a} IGNORE NULLS) OVER post AS {a}n,
    last_value(CASE WHEN {a} IS NOT NULL THEN frame END IGNORE NULLS) OVER pre AS fp{a},
    first_value(CASE WHEN {a} IS NOT NULL THEN frame END IGNORE NULLS) OVER post AS fn{a}"""
    for a in "xyz") + """
  FROM grid WINDOW pre AS (PARTITION BY entity_id, row ORDER BY frame ROWS UNBOUNDED PRECEDING),
    post AS (PARTITION BY entity_id, row ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT entity_id, class, grp, idx, row, frame, f0, f1, x, y, z, seen, """ + ", ".join(
    _fill(a) for a in "xyz") + " FROM fill0)"


def _weight_rows() -> str:
    """(window, position class, offset, weight): position -1 is the interior."""
    from motionframe.functions.smoothing import hat_matrix

    out = ["(1, -1, 0, 1.0::DOUBLE)"]
    for w in (3, 5, 7):
        h = hat_matrix(w, min(2, w - 1))
        for i in range(w):
            p = i if i != w // 2 else -1
            out += [f"({w}, {p}, {j - i}, {h[i][j]:.15f}::DOUBLE)" for j in range(w)]
    return ", ".join(out)


# end positions count from the start (0..w/2-1) or reach w-1 at the last frame
CTE["smooth"] = f"""weights(w, p, o, wt) AS (VALUES {_weight_rows()}),
posed0 AS (SELECT *, frame - f0 AS i, f1 - f0 + 1 AS n,
  CASE WHEN f1 - f0 + 1 < 3 THEN 1 WHEN f1 - f0 + 1 < 5 THEN 3 WHEN f1 - f0 + 1 < 7 THEN 5 ELSE 7 END AS w
  FROM filled),
posed AS (SELECT *, CASE WHEN w = 1 THEN -1 WHEN i < w // 2 THEN i WHEN n - 1 - i < w // 2 THEN w - n + i
  ELSE -1 END AS p FROM posed0),
smooth AS (
  SELECT a.entity_id, a.class, a.grp, a.idx, a.row, a.frame, a.f0, a.f1, a.seen,
         any_value(a.x) AS x, any_value(a.y) AS y, any_value(a.z) AS z,
         sum(k.wt * b.xf) AS xs, sum(k.wt * b.yf) AS ys, sum(k.wt * b.zf) AS zs
  FROM posed a JOIN weights k ON k.w = a.w AND k.p = a.p
  JOIN posed b ON b.entity_id = a.entity_id AND b.row = a.row AND b.frame = a.frame + k.o
  GROUP BY a.entity_id, a.class, a.grp, a.idx, a.row, a.frame, a.f0, a.f1, a.seen)"""
CTE["steps"] = """steps AS (
  SELECT *, xs - lag(xs) OVER w AS dx, ys - lag(ys) OVER w AS dy, zs - lag(zs) OVER w AS dz,
         seen AND coalesce(lag(seen) OVER w, false) AS valid
  FROM smooth WINDOW w AS (PARTITION BY entity_id, row ORDER BY frame))"""
CTE["energy"] = """energy AS (
  SELECT entity_id, class, grp, idx, row,
         sqrt(avg(CASE WHEN valid THEN dx*dx + dy*dy + dz*dz END)) AS rms_speed,
         count(CASE WHEN valid THEN 1 END) AS n_valid_transitions
  FROM steps GROUP BY ALL)"""

# which other expressions each one needs, in order
NEEDS = {
    "grid": ["tracks"], "filled": ["grid"], "smooth": ["filled"], "steps": ["smooth"],
    "energy": ["steps"],
}


def sql(body: str, *ctes: str, extra: str = "") -> str:
    """Body with the named common table expressions and what they build on."""
    done: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in done:
            done.append(name)

    for c in ctes:
        add(c)
    parts = [CTE[n] for n in done] + ([extra] if extra else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def sql_round(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0::DOUBLE)"
