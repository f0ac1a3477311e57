"""Queries on channel scores, subsets and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import rounded, sql, sql_round as rd
from checks.quality_queries import sql_spearman
from checks.registry import query
from motionframe.operators import descriptors as de, energy as en, evaluation as ev, scoring as sc, series as se

DESC = """dsc AS (SELECT entity_id, class, grp, idx, row,
  sqrt(avg(CASE WHEN valid THEN dx*dx + dy*dy END)) AS rms_speed_xy, avg(x) AS x_mean, avg(y) AS y_mean,
  stddev_pop(x) AS x_std, stddev_pop(y) AS y_std, count(x) / count(*)::DOUBLE AS detection_rate,
  count(CASE WHEN valid THEN 1 END) AS n_valid_transitions FROM steps GROUP BY ALL)"""
DCOLS = list(de.DESCRIPTORS)


@query("d3_energy_rank", sql(
    f"""SELECT grp, idx, {rd('avg(motion_energy)')} AS mean, {rd('quantile_cont(motion_energy, 0.5)')} AS median,
    {rd('stddev_samp(motion_energy)')} AS std, count(motion_energy) AS count
    FROM (SELECT grp, idx, rms_speed AS motion_energy FROM energy) GROUP BY grp, idx""", "energy"))
def energy_rank(spark, sf):
    return rounded(sc.channel_rank(se.rms_speed(fx.tracks(spark, sf))))


@query("d4_describe_by", sql(
    f"""SELECT grp, count(rms_speed) AS count, {rd('avg(rms_speed)')} AS mean, {rd('stddev_samp(rms_speed)')} AS std,
    {rd('min(rms_speed)')} AS min, {rd('quantile_cont(rms_speed, 0.25)')} AS p25, {rd('quantile_cont(rms_speed, 0.5)')} AS p50,
    {rd('quantile_cont(rms_speed, 0.75)')} AS p75, {rd('max(rms_speed)')} AS max FROM energy GROUP BY grp""", "energy"))
def describe_by(spark, sf):
    return rounded(sc.describe_by(se.rms_speed(fx.tracks(spark, sf)), ["grp"], "rms_speed"))


@query("d4_describe_values", sql(
    f"""SELECT event_type, count(value) AS count, {rd('avg(value)')} AS mean, {rd('stddev_samp(value)')} AS std,
    {rd('min(value)')} AS min, {rd('quantile_cont(value, 0.25)')} AS p25, {rd('quantile_cont(value, 0.5)')} AS p50,
    {rd('quantile_cont(value, 0.75)')} AS p75, {rd('max(value)')} AS max FROM events GROUP BY event_type"""))
def describe_values(spark, sf):
    return rounded(sc.describe_by(fx.table(spark, sf, "events"), ["event_type"], "value"))


@query("d5_channel_descriptors", sql(
    "SELECT entity_id, class, grp, idx, row, n_valid_transitions, " + ", ".join(f"{rd(c)} AS {c}" for c in DCOLS) + " FROM dsc",
    "steps", extra=DESC))
def channel_descriptors(spark, sf):
    return rounded(de.channel_descriptors(fx.tracks(spark, sf)))


CONS = """cons AS (SELECT row, CASE WHEN abs(avg(rms_speed_xy)) > 0 THEN stddev_samp(rms_speed_xy) / abs(avg(rms_speed_xy)) END AS cv_speed,
  sqrt(var_samp(x_mean) + var_samp(y_mean)) AS pos_spread, avg(detection_rate) AS det_mean FROM dsc WHERE class = 'c3' GROUP BY row)"""


@query("d8_class_consistency", sql(
    f"SELECT row, {rd('cv_speed')} AS cv_speed, {rd('pos_spread')} AS pos_spread, {rd('det_mean')} AS det_mean FROM cons",
    "steps", extra=DESC + ", " + CONS))
def class_consistency(spark, sf):
    return rounded(sc.class_consistency(de.channel_descriptors(fx.tracks(spark, sf)), "c3"))


@query("d13_subset_consistency", sql(
    f"""SELECT subset, count(*) AS n_channels, {rd('median(cv_speed)')} AS median_cv_speed, {rd('median(pos_spread)')} AS median_pos_spread,
    {rd('avg(det_mean)')} AS mean_detection FROM membership LEFT JOIN cons USING (row) GROUP BY subset""",
    "steps", "membership", extra=DESC + ", " + CONS))
def subset_consistency(spark, sf):
    cons = sc.class_consistency(de.channel_descriptors(fx.tracks(spark, sf)), "c3")
    return rounded(sc.subset_consistency(fx.membership(spark), cons))


FR = """fcell AS (SELECT row, descriptor, class, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM descr GROUP BY ALL),
fr AS (SELECT row, descriptor, (sum(s*s/n) - sum(s)*sum(s)/sum(n)) / (count(*) - 1)
  / ((sum(q) - sum(s*s/n)) / (sum(n) - count(*))) AS f FROM fcell GROUP BY 1, 2),
fmax AS (SELECT row, max(f) AS f_max FROM fr GROUP BY 1)"""
MB = """tiles AS (SELECT row, descriptor, class, ntile(10) OVER (PARTITION BY row, descriptor ORDER BY value, entity_id) AS b FROM descr),
jc AS (SELECT row, descriptor, b, class, count(*) AS c FROM tiles GROUP BY ALL),
jm AS (SELECT row, descriptor, c, sum(c) OVER (PARTITION BY row, descriptor) AS n, sum(c) OVER (PARTITION BY row, descriptor, b) AS cb,
  sum(c) OVER (PARTITION BY row, descriptor, class) AS cc FROM jc),
mib AS (SELECT row, descriptor, sum(c / n::DOUBLE * ln(c * n::DOUBLE / (cb * cc))) AS mi FROM jm GROUP BY 1, 2),
mimax AS (SELECT row, max(mi) AS mi_max FROM mib GROUP BY 1)"""


@query("d9_f_ratio", sql(f"SELECT row, descriptor, {rd('f')} AS f FROM fr", "descr", extra=FR))
def f_ratio(spark, sf):
    return rounded(sc.f_ratio(fx.desc(spark, sf)))


@query("d9_f_ratio_channels", sql(f"SELECT row, {rd('f_max')} AS f_max FROM fmax", "descr", extra=FR))
def f_ratio_channels(spark, sf):
    return rounded(sc.max_per_channel(sc.f_ratio(fx.desc(spark, sf)), "f", "f_max"))


@query("d10_mutual_info_binned", sql(f"SELECT row, descriptor, {rd('mi')} AS mi FROM mib", "descr", extra=MB))
def mutual_info_binned(spark, sf):
    return rounded(sc.mutual_info_binned(fx.desc(spark, sf)))


def sql_digamma(x: str) -> str:
    s = f"({x} + 8.0::DOUBLE)"
    tail = " + ".join(f"1.0::DOUBLE / ({x} + {j})" for j in range(8))
    return (f"(ln({s}) - 0.5::DOUBLE / {s} - 1.0::DOUBLE / (12 * {s} * {s}) + 1.0::DOUBLE / (120 * {s} ** 4)"
            f" - 1.0::DOUBLE / (252 * {s} ** 6) - ({tail}))")


@query("d11_mutual_info_knn", sql(
    f"""SELECT row, descriptor, {rd(f"greatest({sql_digamma('count(*)')} + avg({sql_digamma('k')}) - avg({sql_digamma('size')}) - avg({sql_digamma('m')}), 0)")} AS mi
    FROM (SELECT a.row, a.descriptor, a.entity_id, any_value(a.k) AS k, any_value(a.size) AS size,
            count(CASE WHEN (a.r > 0 AND abs(b.value - a.value) < a.r) OR (a.r = 0 AND b.value = a.value) THEN 1 END) AS m
          FROM near a JOIN descr b ON a.row = b.row AND a.descriptor = b.descriptor
          GROUP BY a.row, a.descriptor, a.entity_id) GROUP BY row, descriptor""",
    "descr", extra="""cls AS (SELECT class, count(DISTINCT entity_id) AS size FROM descr GROUP BY 1),
pairs AS (SELECT a.row, a.descriptor, a.entity_id, a.value, c.size, abs(a.value - b.value) AS d,
    row_number() OVER (PARTITION BY a.row, a.descriptor, a.entity_id ORDER BY abs(a.value - b.value)) AS i
  FROM descr a JOIN descr b ON a.row = b.row AND a.descriptor = b.descriptor AND a.class = b.class AND a.entity_id <> b.entity_id
  JOIN cls c ON c.class = a.class),
near AS (SELECT row, descriptor, entity_id, value, size, d AS r, least(3, size - 1) AS k FROM pairs WHERE i = least(3, size - 1))"""))
def mutual_info_knn(spark, sf):
    return rounded(sc.mutual_info_knn(fx.desc(spark, sf)))


@query("d12_subset_median", sql(
    f"SELECT subset, {rd('median(f_max)')} AS median_f FROM desc_membership JOIN fmax USING (row) GROUP BY subset",
    "descr", "desc_membership", extra=FR))
def subset_median(spark, sf):
    scores = sc.max_per_channel(sc.f_ratio(fx.desc(spark, sf)), "f", "f_max")
    return rounded(sc.subset_median(fx.membership(spark, fx.DESC_SUBSETS), scores, "f_max", "median_f"))


@query("c6_merge_scores", sql(
    f"SELECT row, {rd('f_max')} AS f_max, {rd('mi_max')} AS mi_max FROM fmax JOIN mimax USING (row)",
    "descr", extra=FR + ", " + MB))
def merge_scores(spark, sf):
    d = fx.desc(spark, sf)
    return rounded(sc.merge_scores([sc.max_per_channel(sc.f_ratio(d), "f", "f_max"),
                                    sc.max_per_channel(sc.mutual_info_binned(d), "mi", "mi_max")], ["row"]))


def _cast_pair(text: str, name: str) -> str:
    return f"SELECT '{name}' AS pair, rho, n FROM ({text})"


@query("j6_agreement_report", sql(
    _cast_pair(sql_spearman("fmax JOIN mimax USING (row)", "f_max", "mi_max"), "f against mi") + " UNION ALL "
    + _cast_pair(sql_spearman("fmax JOIN (SELECT row, avg(value) AS v FROM descr GROUP BY row) USING (row)", "f_max", "round(v, 9)"), "f against mean"),
    "descr", extra=FR + ", " + MB))
def agreement_report(spark, sf):
    d = fx.desc(spark, sf)
    f = sc.max_per_channel(sc.f_ratio(d), "f", "f_max")
    mi = sc.max_per_channel(sc.mutual_info_binned(d), "mi", "mi_max")
    mean = d.groupBy("row").agg(F.round(F.avg("value"), 9).alias("v"))
    return rounded(sc.agreement_report({
        "f against mi": (f.join(mi, "row"), "f_max", "mi_max"),
        "f against mean": (f.join(mean, "row"), "f_max", "v")}))


@query("c5_align_summaries", sql(
    f"""SELECT grp, idx, {rd('a.v')} AS all_entities, {rd('b.v')} AS one_class FROM
    (SELECT grp, idx, avg(rms_speed) AS v FROM energy WHERE grp <> 'view' GROUP BY 1, 2) a
    FULL JOIN (SELECT grp, idx, avg(m) AS v FROM (SELECT class, grp, idx, avg(rms_speed) AS m FROM energy
               WHERE class = 'c1' AND grp <> 'click' GROUP BY 1, 2, 3) GROUP BY 1, 2) b USING (grp, idx)""", "energy"))
def align_summaries(spark, sf):
    e = se.rms_speed(fx.tracks(spark, sf))
    by_class = en.energy_by_class(e.where("class = 'c1' AND grp <> 'click'"))
    return rounded(sc.align_summaries({"all_entities": (e.where("grp <> 'view'"), "rms_speed"),
                                       "one_class": (by_class, "rms_speed_mean")}))


@query("d15_per_class_accuracy", sql(
    f"SELECT run_id, label, {rd('avg(CAST(label = pred AS INT))')} AS accuracy, count(*) AS n_val FROM preds GROUP BY ALL", "preds"))
def per_class_accuracy(spark, sf):
    return rounded(ev.per_class_accuracy(fx.preds(spark, sf), group=["run_id"]))


PC = "pc AS (SELECT label, avg(CAST(label = pred AS INT)) AS accuracy, count(*) AS n_val FROM preds GROUP BY label)"


@query("d16_eval_summary", sql(
    f"""SELECT {rd('sum(accuracy * n_val) / sum(n_val)')} AS overall_accuracy, {rd('avg(accuracy)')} AS macro_accuracy,
    {rd('median(accuracy)')} AS median_class_accuracy, count(CASE WHEN accuracy < 0.5 THEN 1 END) AS n_classes_below_50pct,
    CAST(sum(n_val) AS BIGINT) AS n_val,
    (SELECT string_agg(CAST(label AS VARCHAR), ',' ORDER BY accuracy, label) FROM (SELECT * FROM pc ORDER BY accuracy, label LIMIT 5)) AS worst,
    (SELECT string_agg(CAST(label AS VARCHAR), ',' ORDER BY accuracy, label) FROM (SELECT * FROM pc ORDER BY accuracy DESC, label DESC LIMIT 5)) AS best
    FROM pc""", "preds", extra=PC))
def eval_summary(spark, sf):
    s = ev.eval_summary(fx.preds(spark, sf))
    for c in ("worst", "best"):
        s = s.withColumn(c, F.array_join(F.transform(c, lambda e: e["label"].cast("string")), ","))
    return rounded(s)


@query("d17_balanced_accuracy", sql(f"SELECT {rd('avg(accuracy)')} AS balanced_accuracy FROM pc", "preds", extra=PC))
def balanced_accuracy(spark, sf):
    return rounded(ev.balanced_accuracy(fx.preds(spark, sf)))


REP = """cls AS (SELECT DISTINCT label AS c FROM preds UNION SELECT DISTINCT pred FROM preds),
rep0 AS (SELECT c, (SELECT count(*) FROM preds WHERE label = c) AS support, (SELECT count(*) FROM preds WHERE pred = c) AS predicted,
  (SELECT count(*) FROM preds WHERE pred = c AND label = c) AS tp FROM cls),
rep1 AS (SELECT c, support, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted::DOUBLE END AS precision,
  CASE WHEN support = 0 THEN 0 ELSE tp / support::DOUBLE END AS recall FROM rep0),
rep AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM rep1)"""


@query("d18_classification_report", sql(
    f"""SELECT CAST(c AS VARCHAR) AS name, {rd('precision')} AS precision, {rd('recall')} AS recall, {rd('f1')} AS f1, support FROM rep
    UNION ALL SELECT 'macro avg', {rd('avg(precision)')}, {rd('avg(recall)')}, {rd('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM rep
    UNION ALL SELECT 'weighted avg', {rd('sum(precision * support) / sum(support)')}, {rd('sum(recall * support) / sum(support)')},
      {rd('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM rep""", "preds", extra=REP))
def classification_report(spark, sf):
    return rounded(ev.classification_report(fx.preds(spark, sf)))


@query("d19_confusion_matrix", sql(
    f"""SELECT CAST(a.i AS INTEGER) AS label, CAST(b.i AS INTEGER) AS pred,
    {rd('coalesce(c.n / sum(c.n) OVER (PARTITION BY a.i), 0)')} AS value
    FROM range(12) a(i), range(12) b(i) LEFT JOIN (SELECT label, pred, count(*) AS n FROM preds GROUP BY ALL) c
    ON c.label = a.i AND c.pred = b.i""", "preds"))
def confusion_matrix(spark, sf):
    return rounded(ev.confusion_matrix(fx.preds(spark, sf), 12))


@query("d19_confusion_counts", sql("SELECT run_id, label, pred, count(*) AS n FROM preds GROUP BY ALL", "preds"))
def confusion_counts(spark, sf):
    return ev.confusion_counts(fx.preds(spark, sf), ["run_id"])


MC = """mcc AS (SELECT run_id, label, pred, count(*) AS n FROM preds GROUP BY ALL),
mc0 AS (SELECT run_id, label, pred, n / sum(n) OVER (PARTITION BY run_id, label) AS rate FROM mcc),
mc AS (SELECT label, pred, sum(rate) / (SELECT count(DISTINCT run_id) FROM preds) AS mean_rate FROM mc0 GROUP BY ALL)"""


@query("d20_mean_confusion", sql(f"SELECT label, pred, {rd('mean_rate')} AS mean_rate FROM mc", "preds", extra=MC))
def mean_confusion(spark, sf):
    return rounded(ev.mean_confusion(fx.preds(spark, sf)))


@query("d21_confused_pairs", sql(
    f"""SELECT a.label, a.pred, {rd('a.mean_rate')} AS mean_rate, {rd('coalesce(d.mean_rate, 0)')} AS true_recall,
    {rd('coalesce(b.mean_rate, 0)')} AS symmetric_rate FROM mc a LEFT JOIN mc d ON d.label = a.label AND d.pred = a.label
    LEFT JOIN mc b ON b.label = a.pred AND b.pred = a.label WHERE a.label <> a.pred
    ORDER BY a.mean_rate DESC, a.label, a.pred LIMIT 20""", "preds", extra=MC))
def confused_pairs(spark, sf):
    return rounded(ev.confused_pairs(fx.preds(spark, sf)))


@query("d22_confused_pairs_count", sql(
    "SELECT label, pred, count(*) AS n FROM preds WHERE label <> pred GROUP BY ALL ORDER BY n DESC, label, pred LIMIT 20", "preds"))
def confused_pairs_count(spark, sf):
    return ev.confused_pairs_count(fx.preds(spark, sf))


@query("f6_top_n_per_side", sql(
    f"""SELECT label, {rd('accuracy')} AS accuracy, n_val, side FROM (
      (SELECT *, 'worst' AS side FROM pc ORDER BY accuracy, label LIMIT 3) UNION ALL
      (SELECT *, 'best' AS side FROM pc ORDER BY accuracy DESC, label LIMIT 3))""", "preds", extra=PC))
def top_n_per_side(spark, sf):
    return rounded(ev.top_n_per_side(ev.per_class_accuracy(fx.preds(spark, sf)), "accuracy", "label", 3))


@query("j7_external_validation", sql(
    sql_spearman("(SELECT label, avg(CAST(label = pred AS INT)) AS r FROM preds WHERE run_id = 0 GROUP BY 1) JOIN "
                 "(SELECT label, avg(CAST(label = pred AS INT)) AS a FROM preds WHERE run_id = 1 GROUP BY 1) USING (label)", "r", "a"),
    "preds"))
def external_validation(spark, sf):
    p = fx.preds(spark, sf)
    recall = ev.per_class_accuracy(p.where("run_id = 0")).select("label", F.col("accuracy").alias("recall"))
    acc = ev.per_class_accuracy(p.where("run_id = 1")).select("label", "accuracy")
    return rounded(sc.external_validation(recall, acc, "label"))


@query("d32_winner", sql(
    f"""SELECT b.subset, {rd('b.m')} AS median_f, c.label, {rd('c.accuracy')} AS accuracy FROM
    (SELECT subset, median(f_max) AS m FROM desc_membership JOIN fmax USING (row) GROUP BY subset ORDER BY m DESC, subset LIMIT 1) b,
    (SELECT * FROM pc ORDER BY accuracy, label LIMIT 3) c""", "descr", "desc_membership", "preds", extra=FR + ", " + PC))
def winner(spark, sf):
    scores = sc.max_per_channel(sc.f_ratio(fx.desc(spark, sf)), "f", "f_max")
    board = sc.subset_median(fx.membership(spark, fx.DESC_SUBSETS), scores, "f_max", "median_f")
    best = sc.winner(board, [F.desc("median_f"), F.col("subset")])
    worst = ev.per_class_accuracy(fx.preds(spark, sf)).orderBy("accuracy", "label").limit(3)
    return rounded(sc.with_worst_classes(best, worst).select("subset", "median_f", "label", "accuracy"))


@query("e13_plateau", sql(
    f"""SELECT run_id, min(CASE WHEN since >= 5 THEN epoch END) AS stop_epoch, max(epoch) AS last_epoch, {rd('max(greatest(b, val_acc))')} AS best_val_acc
    FROM (SELECT *, epoch - coalesce(max(CASE WHEN val_acc > b + 0.01::DOUBLE THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING), 0) AS since
      FROM (SELECT *, greatest(0::DOUBLE, coalesce(max(val_acc) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS b FROM hist))
    GROUP BY run_id""", "hist"))
def plateau(spark, sf):
    return rounded(ev.plateau(fx.hist(spark, sf), 0.01, 5))


@query("e14_best_epoch_gap", sql(
    f"""SELECT run_id, epoch AS best_epoch, {rd('train_acc')} AS train_acc, {rd('val_acc')} AS val_acc, {rd('train_acc - val_acc')} AS train_val_gap
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val_acc DESC, epoch) AS i FROM hist) WHERE i = 1""", "hist"))
def best_epoch_gap(spark, sf):
    return rounded(ev.best_epoch_gap(fx.hist(spark, sf)))


@query("j1_assemble_features", sql(
    f"""SELECT e.entity_id, e.class, CAST(p.i AS INTEGER) AS pos, {rd('coalesce(d.value, 0)')} AS value
    FROM (SELECT DISTINCT entity_id, class FROM dl) e, range(60) p(i)
    LEFT JOIN dl d ON d.entity_id = e.entity_id AND d.row * 6 + d.descriptor = p.i""",
    "steps", extra=DESC + ", dl AS (" + " UNION ALL ".join(
        f"SELECT entity_id, class, row, {i} AS descriptor, {c} AS value FROM dsc" for i, c in enumerate(DCOLS)) + ")"))
def assemble_features(spark, sf):
    long = de.long_descriptors(de.channel_descriptors(fx.tracks(spark, sf)))
    feats = de.assemble_features(long, 10, 6)
    return rounded(feats.select("entity_id", "class", F.posexplode("features").alias("pos", "value")))


@query("p5_support_vs_accuracy", sql(
    f"""SELECT {rd('corr(ra, rb)')} AS rho, count(*) AS n FROM (
      SELECT rank() OVER (ORDER BY n_val) + (count(*) OVER (PARTITION BY n_val) - 1) / 2.0::DOUBLE AS ra,
             rank() OVER (ORDER BY accuracy) + (count(*) OVER (PARTITION BY accuracy) - 1) / 2.0::DOUBLE AS rb FROM pc)""", "preds", extra=PC))
def support_vs_accuracy(spark, sf):
    return rounded(ev.support_vs_accuracy(fx.preds(spark, sf)))


@query("p5_weak_class_overlap", sql(
    f"""SELECT count(*) AS n_pairs, count(w.label) AS n_from_weak, {rd('count(w.label) / count(*)')} AS share, count(DISTINCT w.label) AS n_weak_classes
    FROM (SELECT a.label FROM mc a WHERE a.label <> a.pred ORDER BY a.mean_rate DESC, a.label, a.pred LIMIT 20) p
    LEFT JOIN (SELECT label FROM pc ORDER BY accuracy, label LIMIT 4) w ON w.label = p.label""", "preds", extra=MC + ", " + PC))
def weak_class_overlap(spark, sf):
    return rounded(ev.weak_class_overlap(fx.preds(spark, sf), 20, 4))
