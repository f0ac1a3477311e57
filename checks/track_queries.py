"""Queries over the derived tracks: series, speed and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import rounded, sql, sql_round as rd
from checks.registry import query
from motionframe.operators import energy as en, geometry as ge, series as se


@query("b5_frame_grid", sql(
    f"SELECT entity_id, class, grp, idx, row, CAST(frame AS BIGINT) AS frame, {rd('x')} AS x, {rd('y')} AS y, {rd('z')} AS z FROM grid",
    "grid"))
def frame_grid(spark, sf):
    return rounded(se.frame_grid(fx.tracks(spark, sf)))


@query("e1_interpolate_gaps", sql(
    f"SELECT entity_id, class, grp, idx, row, CAST(frame AS BIGINT) AS frame, seen, {rd('xf')} AS x, {rd('yf')} AS y, {rd('zf')} AS z FROM filled",
    "filled"))
def interpolate_gaps(spark, sf):
    return rounded(se.interpolate_gaps(fx.tracks(spark, sf)))


@query("e2_savgol_smooth", sql(
    f"SELECT entity_id, class, grp, idx, row, CAST(frame AS BIGINT) AS frame, seen, {rd("xs", 8)} AS x, {rd("ys", 8)} AS y, {rd("zs", 8)} AS z FROM smooth",
    "smooth"))
def savgol_smooth(spark, sf):
    return rounded(se.savgol_smooth(fx.tracks(spark, sf)), digits=8)


@query("e3_rms_speed", sql(
    f"SELECT entity_id, class, grp, idx, row, n_valid_transitions, {rd('rms_speed')} AS rms_speed FROM energy",
    "energy"))
def rms_speed(spark, sf):
    return rounded(se.rms_speed(fx.tracks(spark, sf)))


@query("d1_energy_summary", sql(
    f"""SELECT grp, idx, {rd('avg(rms_speed)')} AS rms_speed_mean, {rd('stddev_samp(rms_speed)')} AS rms_speed_std,
    count(*) AS n_entities FROM energy WHERE rms_speed IS NOT NULL GROUP BY grp, idx""", "energy"))
def energy_summary(spark, sf):
    return rounded(en.energy_summary(se.rms_speed(fx.tracks(spark, sf))))


@query("d2_energy_by_class", sql(
    f"""SELECT class, grp, idx, {rd('avg(rms_speed)')} AS rms_speed_mean, {rd('stddev_samp(rms_speed)')} AS rms_speed_std,
    count(rms_speed) AS n_entities FROM energy GROUP BY class, grp, idx""", "energy"))
def energy_by_class(spark, sf):
    return rounded(en.energy_by_class(se.rms_speed(fx.tracks(spark, sf))))


@query("d33_scope_summary", sql(
    f"""SELECT grp, idx, class, CAST(grouping(class) AS INTEGER) AS is_global, {rd('avg(rms_speed)')} AS rms_speed_mean,
    {rd('stddev_samp(rms_speed)')} AS rms_speed_std, count(rms_speed) AS n_entities
    FROM energy GROUP BY GROUPING SETS ((grp, idx, class), (grp, idx))""", "energy"))
def scope_summary(spark, sf):
    return rounded(en.scope_summary(se.rms_speed(fx.tracks(spark, sf))))


@query("d29_axis_energy_share", sql(
    f"""SELECT grp, {rd('avg(r3)')} AS rms_xyz, {rd('avg(r2)')} AS rms_xy, {rd('1 - avg(r2*r2) / avg(r3*r3)')} AS z_share
    FROM (SELECT entity_id, grp, row, sqrt(avg(CASE WHEN valid THEN dx*dx + dy*dy + dz*dz END)) AS r3,
                 sqrt(avg(CASE WHEN valid THEN dx*dx + dy*dy END)) AS r2 FROM steps GROUP BY ALL) GROUP BY grp""",
    "steps"))
def axis_energy_share(spark, sf):
    return rounded(en.axis_energy_share(fx.tracks(spark, sf)))


@query("b6_pivot_frames", sql(
    f"""SELECT entity_id, frame, """ + ", ".join(
        f"{rd(f'max(CASE WHEN row = {r} THEN x END)')} AS x_{r}" for r in range(10)) +
    " FROM tracks GROUP BY entity_id, frame", "tracks"))
def pivot_frames(spark, sf):
    return rounded(se.pivot_frames(fx.tracks(spark, sf), range(10)))


@query("b6_unpivot_frames", sql(
    f"""SELECT f.entity_id, f.frame, CAST(r.row AS INTEGER) AS row, {rd('t.x')} AS x
    FROM (SELECT DISTINCT entity_id, frame FROM tracks) f, (SELECT unnest(range(10)) AS row) r
    LEFT JOIN tracks t ON t.entity_id = f.entity_id AND t.frame = f.frame AND t.row = r.row""", "tracks"))
def unpivot_frames(spark, sf):
    wide = se.pivot_frames(fx.tracks(spark, sf), range(10))
    return rounded(se.unpivot_frames(wide, range(10)))


PLAIN = """pos0 AS (SELECT *, row_number() OVER (PARTITION BY entity_id, row ORDER BY frame) - 1 AS i,
  count(*) OVER (PARTITION BY entity_id, row) AS n FROM tracks),
pos AS (SELECT *, CASE WHEN i < 3 THEN i WHEN n - 1 - i < 3 THEN 7 - n + i ELSE -1 END AS p FROM pos0 WHERE n >= 7),
plain AS (SELECT a.entity_id, a.class, a.grp, a.idx, a.row, a.i, sum(k.wt * b.x) AS xs, sum(k.wt * b.y) AS ys,
  sum(k.wt * b.z) AS zs FROM pos a JOIN weights k ON k.w = 7 AND k.p = a.p
  JOIN pos b ON b.entity_id = a.entity_id AND b.row = a.row AND b.i = a.i + k.o GROUP BY ALL),
plain_steps AS (SELECT *, xs - lag(xs) OVER w AS dx, ys - lag(ys) OVER w AS dy, zs - lag(zs) OVER w AS dz
  FROM plain WINDOW w AS (PARTITION BY entity_id, row ORDER BY i)),
plain_energy AS (SELECT entity_id, row, sqrt(avg(dx*dx + dy*dy + dz*dz)) AS motion_energy FROM plain_steps GROUP BY ALL)"""


@query("e4_rms_speed_plain", sql(
    f"""SELECT c.entity_id, c.class, c.grp, c.idx, c.row, {rd('e.motion_energy')} AS motion_energy
    FROM (SELECT DISTINCT entity_id, class, grp, idx, row FROM tracks) c LEFT JOIN plain_energy e USING (entity_id, row)""",
    "smooth", extra=PLAIN))
def rms_speed_plain(spark, sf):
    return rounded(se.rms_speed_plain(fx.tracks(spark, sf)))


@query("k3_causal_velocity", sql(
    f"""SELECT entity_id, class, grp, idx, row, frame,
    {rd('CASE WHEN pf IS NULL THEN 0 WHEN pf = frame - 1 THEN x - px END')} AS dx,
    {rd('CASE WHEN pf IS NULL THEN 0 WHEN pf = frame - 1 THEN y - py END')} AS dy
    FROM (SELECT *, lag(frame) OVER w AS pf, lag(x) OVER w AS px, lag(y) OVER w AS py FROM tracks
          WINDOW w AS (PARTITION BY entity_id, row ORDER BY frame))""", "tracks"))
def causal_velocity(spark, sf):
    return rounded(se.causal_velocity(fx.tracks(spark, sf)))


@query("k4_causal_running_std", sql(
    f"""SELECT entity_id, class, grp, idx, row, frame, {rd('stddev_pop(x) OVER (PARTITION BY entity_id, row ORDER BY frame ROWS UNBOUNDED PRECEDING)')} AS running_std
    FROM tracks""", "tracks"))
def causal_running_std(spark, sf):
    return rounded(se.causal_running_std(fx.tracks(spark, sf)))


# -- planned in the project, built here ---------------------------------------

@query("p1_normalize_frames", sql(
    f"""SELECT t.entity_id, t.class, t.grp, t.idx, t.row, t.frame, {rd('(t.x - (r.lx + r.rx) / 2) / r.s', 5)} AS x,
    {rd('(t.y - (r.ly + r.ry) / 2) / r.s', 5)} AS y FROM tracks t LEFT JOIN (
      SELECT *, CASE WHEN lx IS NOT NULL AND rx IS NOT NULL THEN greatest(sqrt((lx - rx) ** 2 + (ly - ry) ** 2), 0.5) END AS s FROM (
        SELECT entity_id, frame, max(CASE WHEN row = 0 THEN x END) AS lx, max(CASE WHEN row = 0 THEN y END) AS ly,
               max(CASE WHEN row = 6 THEN x END) AS rx, max(CASE WHEN row = 6 THEN y END) AS ry
        FROM tracks WHERE row IN (0, 6) GROUP BY entity_id, frame)) r USING (entity_id, frame)""", "tracks"))
def normalize_frames(spark, sf):
    t = ge.normalize_frames(fx.tracks(spark, sf).drop("z"), 0, 6, floor=0.5)
    return rounded(t.select("entity_id", "class", "grp", "idx", "row", "frame", "x", "y"), digits=5)


@query("p2_acceleration", sql(
    f"""SELECT entity_id, class, grp, idx, row, CAST(frame AS BIGINT) AS frame,
    CASE WHEN ok THEN {rd('xs - 2 * x1 + x2', 5)} END AS d2x, CASE WHEN ok THEN {rd('ys - 2 * y1 + y2', 5)} END AS d2y FROM (
      SELECT *, coalesce(seen AND lag(seen) OVER w AND lag(seen, 2) OVER w, false) AS ok, lag(xs) OVER w AS x1, lag(xs, 2) OVER w AS x2,
             lag(ys) OVER w AS y1, lag(ys, 2) OVER w AS y2 FROM smooth WINDOW w AS (PARTITION BY entity_id, row ORDER BY frame))""", "smooth"))
def acceleration(spark, sf):
    return rounded(ge.acceleration(fx.tracks(spark, sf), segment_frames=14), digits=5)


@query("p6_reference_reliability", sql(
    f"""SELECT CAST(r.row AS INTEGER) AS row, count(DISTINCT entity_id) AS n_entities, {rd("count(t.x) / (SELECT sum(t)::DOUBLE FROM (SELECT max(frame) - min(frame) + 1 AS t FROM tracks GROUP BY entity_id))")} AS reliability
    FROM (VALUES (0), (6), (42)) r(row) LEFT JOIN tracks t ON t.row = r.row AND t.x IS NOT NULL GROUP BY r.row""", "tracks"))
def reference_reliability(spark, sf):
    return rounded(ge.reference_reliability(fx.tracks(spark, sf), [0, 6, 42]))


@query("p3_infer_handedness", sql(
    """SELECT entity_id, count(CASE WHEN grp = 'click' THEN x END) AS n_left, count(CASE WHEN grp = 'signup' THEN x END) AS n_right,
    CASE WHEN count(CASE WHEN grp = 'click' THEN x END) > count(CASE WHEN grp = 'signup' THEN x END) THEN 'left' ELSE 'right' END AS hand
    FROM tracks GROUP BY entity_id""", "tracks"))
def infer_handedness(spark, sf):
    return ge.infer_handedness(fx.tracks(spark, sf), "click", "signup")


@query("p3_mirror", sql(
    f"""SELECT entity_id, class, frame, CASE grp WHEN 'click' THEN 'signup' WHEN 'signup' THEN 'click' ELSE grp END AS grp, idx,
    CAST(CASE grp WHEN 'click' THEN row + 6 WHEN 'signup' THEN row - 6 ELSE row END AS INTEGER) AS row,
    {rd('100 - x')} AS x, {rd('y')} AS y FROM tracks""", "tracks"))
def mirror(spark, sf):
    pairs = [(i, i + 6, "signup", i) for i in (0, 1)] + [(i + 6, i, "click", i) for i in (0, 1)]
    swap = spark.createDataFrame(pairs, "row int, to_row int, to_grp string, to_idx int")
    t = ge.mirror(fx.tracks(spark, sf).drop("z"), swap, 100.0)
    return rounded(t.select("entity_id", "class", "frame", "grp", "idx", "row", "x", "y"))


def _u(*parts: str) -> str:
    text = " || '|' || ".join(["'7'", *parts])
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query("p4_augment", sql(
    f"""SELECT entity_id, class, grp, idx, row, frame, CASE WHEN kept THEN {rd('s * (x * cos(a) - y * sin(a)) + dx', 5)} END AS x,
    CASE WHEN kept THEN {rd('s * (x * sin(a) + y * cos(a)) + dy', 5)} END AS y, CASE WHEN kept THEN {rd('s * z', 5)} END AS z FROM (
      SELECT *, (2 * {_u("'0'", 'CAST(entity_id AS VARCHAR)')} - 1) * 0.2::DOUBLE AS a, 1 + (2 * {_u("'1'", 'CAST(entity_id AS VARCHAR)')} - 1) * 0.1::DOUBLE AS s,
             (2 * {_u("'2'", 'CAST(entity_id AS VARCHAR)')} - 1) * 0.05::DOUBLE AS dx, (2 * {_u("'3'", 'CAST(entity_id AS VARCHAR)')} - 1) * 0.05::DOUBLE AS dy,
             {_u("'frame'", 'CAST(entity_id AS VARCHAR)', 'CAST(frame AS VARCHAR)')} >= 0.1 AS kept FROM tracks)""", "tracks"))
def augment(spark, sf):
    return rounded(ge.augment(fx.tracks(spark, sf), 7), digits=5)
