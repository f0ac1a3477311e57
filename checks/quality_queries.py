"""Queries on presence, gaps and quality proxies."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import rounded, sql, sql_round as rd
from checks.registry import query
from motionframe.functions.columns import null_to_zero
from motionframe.operators import presence as pr, quality as ql, scoring as sc

ROLES = fx.ROLES
SEGMENTS = {"left": (4, 5), "right": (5, 6)}
N_CHANNELS = 10


def qtracks(spark, sf):
    """Two configurations of every entity: the second one loses low values."""
    t = fx.tracks(spark, sf).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("cfg"))
    return t.select((F.col("entity_id") * 2 + F.col("cfg")).alias("entity_id"), "class", "grp", "idx",
                    "row", "frame", F.when((F.col("cfg") == 0) | (F.col("x") >= 20), F.col("x")).alias("x"),
                    "y", "z")


def qcatalog(spark, sf):
    # one entity in eleven has no frames at all: its id is not a user
    c = fx.catalog(spark, sf).select(
        F.explode(F.array(F.col("entity_id") * 2, F.col("entity_id") * 2 + 1,
                          F.when(F.col("entity_id") % 11 == 0, -F.col("entity_id") - 1))).alias("entity_id"))
    return c.where("entity_id IS NOT NULL").select(
        "entity_id", F.when(F.pmod("entity_id", F.lit(2)) == 0, "default").otherwise("strict").alias("config"))


def entity_quality(spark, sf):
    return ql.entity_quality(qcatalog(spark, sf), qtracks(spark, sf), N_CHANNELS, ROLES, SEGMENTS)


QT = """qtracks AS (SELECT entity_id * 2 + c.cfg AS entity_id, class, grp, idx, row, frame,
  CASE WHEN c.cfg = 0 OR x >= 20 THEN x END AS x, y, z FROM tracks, (VALUES (0), (1)) c(cfg)),
qcatalog AS (SELECT entity_id, CASE WHEN entity_id % 2 = 0 THEN 'default' ELSE 'strict' END AS config FROM (
  SELECT entity_id * 2 + c.cfg AS entity_id FROM catalog, (VALUES (0), (1)) c(cfg)
  UNION ALL SELECT -entity_id - 1 FROM catalog WHERE entity_id % 11 = 0))"""


def quality_sql(src: str) -> str:
    return f"""flags AS (SELECT entity_id, CAST(frame AS BIGINT) AS frame,
  bool_or(x IS NOT NULL AND grp = 'click') AS l, bool_or(x IS NOT NULL AND grp = 'signup') AS r,
  bool_or(x IS NOT NULL AND grp = 'purchase') AS p, bool_or(x IS NOT NULL AND grp = 'error') AS f,
  count(x) AS n_seen FROM {src} GROUP BY ALL),
fext AS (SELECT entity_id, min(frame) AS f0, max(frame) AS f1, max(frame) - min(frame) + 1 AS n FROM flags GROUP BY 1),
spine AS (SELECT e.entity_id, e.f0, e.f1, e.n, g.f AS frame, coalesce(k.l, false) AS l, coalesce(k.r, false) AS r,
  coalesce(k.p, false) AS p, coalesce(k.f, false) AS f, coalesce(k.l OR k.r, false) AS a, coalesce(k.n_seen, 0) AS n_seen
  FROM fext e JOIN (SELECT unnest(range(0, (SELECT max(f1) + 1 FROM fext))) AS f) g ON g.f BETWEEN e.f0 AND e.f1
  LEFT JOIN flags k ON k.entity_id = e.entity_id AND k.frame = g.f),
rates AS (SELECT entity_id, count(*) AS n_frames, avg(CAST(f AS INT)) AS face_rate, avg(CAST(p AS INT)) AS pose_rate,
  avg(CAST(l AS INT)) AS left_hand_rate, avg(CAST(r AS INT)) AS right_hand_rate,
  (avg(CAST(l AS INT)) + avg(CAST(r AS INT))) / 2 AS hand_rate, avg(CAST(a AS INT)) AS any_hand_rate,
  avg(CAST(l AND r AS INT)) AS both_hands_rate, 1 - sum(n_seen) / (count(*) * {N_CHANNELS}.0::DOUBLE) AS nan_frac
  FROM spine GROUP BY 1),
isl AS (SELECT entity_id, a, sum(CAST(a AS INT)) OVER (PARTITION BY entity_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS k FROM spine),
runs_ AS (SELECT entity_id, k, count(CASE WHEN NOT a THEN 1 END) AS len FROM isl GROUP BY 1, 2),
gaps AS (SELECT entity_id, max(len) AS longest_gap_frames FROM runs_ GROUP BY 1),
gaps2 AS (SELECT entity_id, n AS n_frames, longest_gap_frames, longest_gap_frames / n::DOUBLE AS longest_gap_frac FROM gaps JOIN fext USING (entity_id)),
disp AS (SELECT a.entity_id, a.grp, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS d FROM {src} a JOIN {src} b
  ON a.entity_id = b.entity_id AND a.row = b.row AND a.frame = b.frame + 1 WHERE a.x IS NOT NULL AND b.x IS NOT NULL),
jit AS (SELECT entity_id, grp, quantile_cont(d, 0.5) AS jitter FROM disp WHERE grp IN ('click', 'signup', 'purchase') GROUP BY 1, 2),
seg AS (SELECT a.entity_id, a.row AS s, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS d FROM {src} a JOIN {src} b
  ON a.entity_id = b.entity_id AND a.frame = b.frame AND b.row = a.row + 1 WHERE a.row IN (4, 5)),
cv0 AS (SELECT entity_id, s, CASE WHEN count(*) >= 2 THEN stddev_pop(d) / avg(d) END AS cv FROM seg WHERE d > 0 GROUP BY 1, 2),
cv AS (SELECT entity_id, avg(cv) AS bone_cv FROM cv0 GROUP BY 1),
jit2 AS (SELECT entity_id, avg(CASE WHEN grp IN ('click', 'signup') THEN jitter END) AS jitter_hand,
  max(CASE WHEN grp = 'purchase' THEN jitter END) AS jitter_pose FROM jit GROUP BY 1)"""


EQ = """eq AS (SELECT c.entity_id, c.config, coalesce(r.n_frames, 0) AS n_frames,
  """ + ", ".join(f"coalesce(r.{c}, 0) AS {c}" for c in (
      "face_rate", "pose_rate", "left_hand_rate", "right_hand_rate", "hand_rate", "any_hand_rate")) + """,
  j.jitter_hand, j.jitter_pose, v.bone_cv, coalesce(g.longest_gap_frames, 0) AS longest_gap_frames,
  coalesce(g.longest_gap_frac, 1) AS longest_gap_frac, coalesce(r.nan_frac, 1) AS nan_frac
  FROM qcatalog c LEFT JOIN rates r USING (entity_id) LEFT JOIN gaps2 g USING (entity_id)
  LEFT JOIN jit2 j USING (entity_id) LEFT JOIN cv v USING (entity_id))"""
EQ_COLS = ["face_rate", "pose_rate", "left_hand_rate", "right_hand_rate", "hand_rate", "any_hand_rate",
           "jitter_hand", "jitter_pose", "bone_cv", "longest_gap_frac", "nan_frac"]

_W = ql.DEFAULT_WEIGHTS
ZS = "med AS (SELECT " + ", ".join(f"median({c}) AS {n}" for n, c in ql.METRICS.items()) + """ FROM eq),
imp AS (SELECT eq.*, """ + ", ".join(f"coalesce(eq.{c}, med.{n}) AS v_{n}" for n, c in ql.METRICS.items()) + """ FROM eq, med),
st AS (SELECT """ + ", ".join(f"avg(v_{n}) AS m_{n}, stddev_pop(v_{n}) AS s_{n}" for n in ql.METRICS) + """ FROM imp),
zs0 AS (SELECT imp.*, """ + ", ".join(
    f"CASE WHEN s_{n} <= abs(m_{n}) * 1e-12 THEN 0 ELSE (v_{n} - m_{n}) / s_{n} END AS z_{n}" for n in ql.METRICS) + """ FROM imp, st),
zs AS (SELECT *, """ + " + ".join(f"({_W[n]}::DOUBLE) * z_{n}" for n in ql.METRICS) + " AS quality_score FROM zs0)"


@query("d6_group_presence", sql(
    "SELECT entity_id, frame, grp, bool_or(x IS NOT NULL) AS present FROM qtracks GROUP BY ALL",
    "tracks", "catalog", extra=QT))
def group_presence(spark, sf):
    return pr.group_presence(qtracks(spark, sf))


@query("d7_detection_rates", sql(
    "SELECT entity_id, n_frames, " + ", ".join(f"{rd(c)} AS {c}" for c in (
        "face_rate", "pose_rate", "left_hand_rate", "right_hand_rate", "hand_rate", "any_hand_rate",
        "both_hands_rate", "nan_frac")) + " FROM rates", "tracks", extra=quality_sql("tracks")))
def detection_rates(spark, sf):
    return rounded(pr.detection_rates(fx.tracks(spark, sf), N_CHANNELS, ROLES))


@query("e5_longest_gap", sql(
    f"SELECT entity_id, n_frames, longest_gap_frames, {rd('longest_gap_frac')} AS longest_gap_frac FROM gaps2",
    "tracks", "catalog", extra=QT + ", " + quality_sql("qtracks")))
def longest_gap(spark, sf):
    return rounded(pr.longest_gap(pr.frame_flags(qtracks(spark, sf), ROLES)))


@query("e6_jitter", sql(f"SELECT entity_id, grp, {rd('jitter')} AS jitter FROM jit", "tracks",
                        extra=quality_sql("tracks")))
def jitter(spark, sf):
    return rounded(ql.jitter(fx.tracks(spark, sf), ["click", "signup", "purchase"]))


@query("e7_segment_cv", sql(
    f"""SELECT e.entity_id, {rd('l.cv')} AS left_cv, {rd('r.cv')} AS right_cv, {rd('cv.bone_cv')} AS bone_cv
    FROM (SELECT DISTINCT entity_id FROM tracks WHERE row IN (4, 5, 6)) e
    LEFT JOIN cv0 l ON l.entity_id = e.entity_id AND l.s = 4 LEFT JOIN cv0 r ON r.entity_id = e.entity_id AND r.s = 5
    LEFT JOIN cv ON cv.entity_id = e.entity_id""", "tracks", extra=quality_sql("tracks")))
def segment_cv(spark, sf):
    return rounded(ql.segment_cv(fx.tracks(spark, sf), SEGMENTS))


@query("e8_frame_quality", sql(
    f"""SELECT entity_id, frame, {rd('(3 * (CAST(l AS INT) + CAST(r AS INT)) / 2.0::DOUBLE + CAST(p AS INT) + 0.5::DOUBLE * CAST(f AS INT)) / 4.5::DOUBLE')} AS quality
    FROM spine""", "tracks", extra=quality_sql("tracks")))
def frame_quality(spark, sf):
    return rounded(pr.frame_quality(fx.tracks(spark, sf), ROLES))


@query("e9_entity_quality", sql(
    "SELECT entity_id, config, n_frames, longest_gap_frames, " + ", ".join(f"{rd(c)} AS {c}" for c in EQ_COLS) + " FROM eq",
    "tracks", "catalog", extra=QT + ", " + quality_sql("qtracks") + ", " + EQ))
def entity_quality_query(spark, sf):
    return rounded(entity_quality(spark, sf))


@query("e10_zscore_composite", sql(
    "SELECT entity_id, config, " + ", ".join(f"{rd('z_' + n)} AS z_{n}" for n in ql.METRICS)
    + f", {rd('quality_score')} AS quality_score FROM zs",
    "tracks", "catalog", extra=QT + ", " + quality_sql("qtracks") + ", " + EQ + ", " + ZS))
def zscore_composite(spark, sf):
    scored = ql.zscore_composite(entity_quality(spark, sf))
    return rounded(scored.select("entity_id", "config", *[f"z_{n}" for n in ql.METRICS], "quality_score"))


@query("d23_config_scores", sql(
    "SELECT config, " + ", ".join(f"{rd(f'avg({c})')} AS {c}" for c in (
        "quality_score", "hand_rate", "any_hand_rate", "pose_rate", "face_rate", "jitter_hand", "bone_cv",
        "longest_gap_frac", "nan_frac")) + ", count(entity_id) AS n_entities FROM zs GROUP BY config",
    "tracks", "catalog", extra=QT + ", " + quality_sql("qtracks") + ", " + EQ + ", " + ZS))
def config_scores(spark, sf):
    return rounded(ql.config_scores(ql.zscore_composite(entity_quality(spark, sf))))


MEAS = [("any_hand_rate", True), ("jitter_hand", False), ("bone_cv", False), ("longest_gap_frac", False)]


@query("c7_paired_compare", sql(
    " UNION ALL ".join(f"""SELECT '{m}' AS metric, {rd('avg(a)')} AS mean_a, {rd('avg(b)')} AS mean_b,
      {rd('avg(b - a)')} AS mean_diff, count(CASE WHEN {'d > 0' if up else 'd < 0'} THEN 1 END) AS n_better,
      count(CASE WHEN {'d < 0' if up else 'd > 0'} THEN 1 END) AS n_worse,
      count(CASE WHEN d = 0 THEN 1 END) AS n_unchanged, count(*) AS n_units
      FROM (SELECT a.v AS a, b.v AS b, CASE WHEN abs(b.v - a.v) <= greatest(abs(a.v), abs(b.v)) * 1e-9::DOUBLE THEN 0 ELSE b.v - a.v END AS d
      FROM (SELECT CAST(floor(entity_id / 2) AS BIGINT) AS u, {m} AS v FROM eq WHERE config = 'default' AND {m} IS NOT NULL) a
      JOIN (SELECT CAST(floor(entity_id / 2) AS BIGINT) AS u, {m} AS v FROM eq WHERE config = 'strict' AND {m} IS NOT NULL) b USING (u))"""
                       for m, up in MEAS),
    "tracks", "catalog", extra=QT + ", " + quality_sql("qtracks") + ", " + EQ))
def paired_compare(spark, sf):
    q = entity_quality(spark, sf).withColumn("unit", F.floor(F.col("entity_id") / 2))
    return rounded(sc.paired_compare(q, "unit", "config", "default", "strict", dict(MEAS)))


@query("e11_pick_extremes", sql(
    f"""SELECT kind, position, quality, entity_id, frame FROM (
      SELECT {rd('q')} AS quality, entity_id, frame, row_number() OVER (ORDER BY q, entity_id, frame) - 1 AS position, count(*) OVER () AS n
      FROM (SELECT entity_id, frame, (3 * (CAST(l AS INT) + CAST(r AS INT)) / 2.0::DOUBLE + CAST(p AS INT) + 0.5::DOUBLE * CAST(f AS INT)) / 4.5::DOUBLE AS q FROM spine))
    JOIN (VALUES ('worst'), ('best'), ('median')) k(kind)
      ON (kind = 'worst' AND position < 80) OR (kind = 'best' AND position >= n - 10)
      OR (kind = 'median' AND position >= n // 2 - 5 AND position < n // 2 + 5)""",
    "tracks", extra=quality_sql("tracks")))
def pick_extremes(spark, sf):
    return rounded(ql.pick_extremes(pr.frame_quality(fx.tracks(spark, sf), ROLES)))


@query("d30_presence_profile", sql(
    f"""SELECT CAST(20 * (frame - f0) // n AS BIGINT) AS bin, count(*) AS n_frames, {rd('avg(CAST(a AS INT))')} AS rate FROM spine GROUP BY 1""",
    "tracks", extra=quality_sql("tracks")))
def presence_profile(spark, sf):
    df = rounded(pr.presence_profile(pr.frame_flags(fx.tracks(spark, sf), ROLES)))
    return df.withColumn("n_frames", F.col("n_frames").cast("long"))


SPAN = """span AS (SELECT entity_id, max(n) AS n_frames, min(f0) AS f0, min(CASE WHEN a THEN frame END) AS first_frame,
  max(CASE WHEN a THEN frame END) AS last_frame FROM spine GROUP BY 1),
act AS (SELECT s.entity_id, s.n_frames, s.first_frame, s.last_frame, (s.first_frame - s.f0) / s.n_frames::DOUBLE AS first_share,
  (s.last_frame - s.f0) / s.n_frames::DOUBLE AS last_share, (s.last_frame - s.first_frame + 1) / s.n_frames::DOUBLE AS span_share,
  avg(CAST(p.a AS INT)) AS any_rate, (avg(CAST(p.l AS INT)) + avg(CAST(p.r AS INT))) / 2 AS hand_rate
  FROM span s LEFT JOIN spine p ON p.entity_id = s.entity_id AND p.frame BETWEEN s.first_frame AND s.last_frame GROUP BY ALL)"""


@query("d31_active_span", sql(
    f"""SELECT entity_id, n_frames, first_frame, last_frame, {rd('first_share')} AS first_share, {rd('last_share')} AS last_share,
    {rd('span_share')} AS span_share, {rd('any_rate')} AS any_hand_rate_in_span, {rd('hand_rate')} AS hand_rate_in_span FROM act""",
    "tracks", "catalog", extra=QT + ", " + quality_sql("qtracks") + ", " + SPAN))
def active_span(spark, sf):
    return rounded(pr.active_span(pr.frame_flags(qtracks(spark, sf), ROLES)))


def sql_spearman(src: str, a: str, b: str) -> str:
    """One-row query with rho and n."""
    return f"""SELECT {rd('corr(ra, rb)')} AS rho, count(*) AS n FROM (
      SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra,
             rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb
      FROM (SELECT {a} AS a, {b} AS b FROM {src}) WHERE a IS NOT NULL AND b IS NOT NULL)"""


@query("e17_overlap_test", sql(
    f"""SELECT m.*, s.* FROM (SELECT {rd('quantile_cont(first_share, 0.5)')} AS median_first_share,
      {rd('quantile_cont(last_share, 0.5)')} AS median_last_share FROM act) m, ({sql_spearman('gaps2', 'longest_gap_frames', 'n_frames')}) s""",
    "tracks", "catalog", extra=QT + ", " + quality_sql("qtracks") + ", " + SPAN))
def overlap_test(spark, sf):
    return rounded(pr.overlap_test(pr.frame_flags(qtracks(spark, sf), ROLES)))


@query("e12_spearman", sql(sql_spearman("orders", "round(o_totalprice, -3)", "o_custkey")))
def spearman(spark, sf):
    from motionframe.plans.ranking import spearman as rank_corr

    o = fx.table(spark, sf, "orders").select(F.round("o_totalprice", -3).alias("a"), F.col("o_custkey").alias("b"))
    return rounded(rank_corr(o, "a", "b", rows_per_part=500))


@query("b3_null_to_zero", sql(
    f"SELECT entity_id, class, grp, idx, row, CAST(frame AS BIGINT) AS frame, {rd('coalesce(x, 0)')} AS x FROM grid", "grid"))
def null_to_zero_query(spark, sf):
    from motionframe.operators.series import frame_grid

    g = frame_grid(fx.tracks(spark, sf), ("x",))
    return rounded(g.withColumn("x", null_to_zero("x")))
