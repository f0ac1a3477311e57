"""Queries on run records, manifests and operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import rounded, sql, sql_round as rd
from checks.registry import query
from motionframe import schemas
from motionframe.functions.columns import clip_seconds, epoch_seconds, iso_timestamp
from motionframe.operators import operations as op, registry as rg
from motionframe.operators.checks import Expect
from motionframe.session import scratch_dir
from motionframe.sources import runs as rs, sinks, tracks as tr

RUN_COLS = "run_id, dataset, architecture, subset, train_val_acc, eval_status, overall_accuracy, platform, accuracy, coalesce(tested, false) AS tested, notes"


@query("b12_query_runs", sql(f"""SELECT {RUN_COLS} FROM runs WHERE eval_status = 'pending' AND subset = 'ME_126'
    ORDER BY accuracy DESC, run_id LIMIT 200""", "runs"))
def query_runs(spark, sf):
    return rg.query_runs(fx.runs(spark, sf), "metrics.eval_status = 'pending' AND subset = 'ME_126'",
                         [F.desc("accuracy"), "run_id"], 200)


@query("f1_leaderboard", sql(f"SELECT {RUN_COLS} FROM runs WHERE dataset = 'F'", "runs"))
def leaderboard(spark, sf):
    return rg.leaderboard(fx.runs(spark, sf), "F")


@query("f1_leaderboard_top", sql(f"SELECT {RUN_COLS} FROM runs WHERE dataset = 'O' ORDER BY accuracy DESC NULLS LAST, run_id LIMIT 50", "runs"))
def leaderboard_top(spark, sf):
    return rg.leaderboard(fx.runs(spark, sf), "O", 50)


@query("f2_untested_queue", sql(f"""SELECT {RUN_COLS} FROM runs WHERE dataset = 'F' AND NOT coalesce(tested, false)
    ORDER BY accuracy DESC NULLS LAST, run_id LIMIT 100""", "runs"))
def untested_queue(spark, sf):
    return rg.untested_queue(fx.runs(spark, sf), "F")


@query("f3_eval_backlog", sql(
    """SELECT run_id, CAST(min(source) AS INTEGER) AS source, max(accuracy) AS accuracy FROM (
      SELECT run_id, 0 AS source, accuracy FROM runs WHERE dataset = 'F' AND eval_status <> 'canonical'
      UNION ALL SELECT run_id, 1, NULL FROM runs WHERE run_id % 50 = 0) WHERE run_id % 9 <> 0 GROUP BY run_id""", "runs"))
def eval_backlog(spark, sf):
    r = fx.runs(spark, sf)
    return rg.eval_backlog(r, "F", r.where("run_id % 9 <> 0"), r.where("run_id % 50 = 0").select("run_id"))


INDEX = """SELECT run_id, dataset, architecture, subset, accuracy AS val_acc, eval_status, overall_accuracy, train_val_acc,
  coalesce(tested, false) AS submission_tested, platform AS submission_platform, notes FROM runs"""


@query("b15_flatten_runs", sql(INDEX, "runs"))
def flatten_runs(spark, sf):
    return rg.flatten_runs(fx.runs(spark, sf))


@query("f4_index_order", sql(INDEX, "runs"))
def index_order(spark, sf):
    return rg.index_order(rg.flatten_runs(fx.runs(spark, sf)))


@query("b13_filter_runs", sql(f"""SELECT * FROM ({INDEX}) WHERE lower(subset) = 'me_126' AND lower(dataset) = 'f' AND NOT submission_tested
    ORDER BY dataset, architecture, val_acc DESC NULLS LAST, run_id LIMIT 40""", "runs"))
def filter_runs(spark, sf):
    return rg.filter_runs(rg.flatten_runs(fx.runs(spark, sf)), {"subset": "me_126", "dataset": "f"}, True, 40)


@query("e15_best_per_group", sql(f"""SELECT * FROM (SELECT {RUN_COLS} FROM runs)
    QUALIFY row_number() OVER (PARTITION BY architecture ORDER BY accuracy DESC NULLS LAST, run_id) = 1""", "runs"))
def best_per_group(spark, sf):
    return rg.best_per_group(rg.query_runs(fx.runs(spark, sf)))


@query("c9_backfill_schema", sql("""SELECT run_id, CAST(3 AS INTEGER) AS schema_version, schema_version <> 3 OR tested IS NULL AS changed,
    coalesce(tested, false) AS tested, platform FROM runs""", "runs"))
def backfill_schema(spark, sf):
    return rg.backfill_schema(fx.runs(spark, sf)).select(
        "run_id", "schema_version", "changed", "submission.tested", "submission.platform")


def _with_assets(df, log, extra):
    return df.withColumn("assets", F.create_map(
        F.lit("log"), F.concat(F.lit(log), F.col("run_id").cast("string")), F.lit(extra), F.lit("v")))


@query("c8_upsert_protected", sql("""
  SELECT run_id, CASE WHEN o IS NULL THEN 'provisional' WHEN n IS NULL OR old_status = 'canonical' THEN old_status ELSE 'provisional' END AS eval_status,
    CASE WHEN n IS NULL OR (o IS NOT NULL AND old_status = 'canonical') THEN overall_accuracy ELSE 0.5::DOUBLE END AS overall_accuracy,
    CASE WHEN n IS NULL THEN train_val_acc ELSE 0.25::DOUBLE END AS train_val_acc,
    CASE WHEN n IS NULL OR (o IS NOT NULL AND coalesce(tested, false)) THEN tested ELSE false END AS tested,
    CASE WHEN n IS NULL OR (o IS NOT NULL AND coalesce(tested, false)) THEN platform END AS platform,
    CASE WHEN n IS NULL THEN notes WHEN run_id % 2 = 0 THEN CASE WHEN o IS NULL THEN '' ELSE notes END ELSE 'new' END AS notes,
    CASE WHEN o IS NOT NULL THEN 'kept ' || r END AS legacy, CASE WHEN o IS NOT NULL THEN run_id END AS old_metric,
    CASE WHEN n IS NULL THEN 'log=a' || r || ',old=v' WHEN o IS NULL THEN 'log=b' || r || ',new=v' ELSE 'log=b' || r || ',new=v,old=v' END AS assets
  FROM (SELECT *, eval_status AS old_status, CAST(run_id AS VARCHAR) AS r, CASE WHEN run_id % 5 <> 1 THEN 1 END AS o,
               CASE WHEN run_id % 5 <> 2 THEN 1 END AS n FROM runs)""", "runs"))
def upsert_protected(spark, sf):
    r = fx.runs(spark, sf)
    old = _with_assets(r.where("run_id % 5 <> 1"), "a", "old")
    # fields that only the old records have
    old = old.withColumn("legacy", F.concat(F.lit("kept "), F.col("run_id").cast("string"))).withColumn(
        "metrics", F.col("metrics").withField("old_metric", F.col("run_id")))
    new = _with_assets(r.where("run_id % 5 <> 2"), "b", "new")
    new = new.withColumn("metrics", F.struct(F.lit(0.5).alias("overall_accuracy"), F.lit(0.25).alias("train_val_acc"),
                                             F.lit("provisional").alias("eval_status")))
    new = new.withColumn("submission", F.struct(F.lit(False).alias("tested"), F.lit(None).cast("string").alias("platform")))
    new = new.withColumn("notes", F.when(F.col("run_id") % 2 == 0, "").otherwise("new"))
    m = rg.upsert_protected(old, new)
    entries = F.transform(F.map_entries("assets"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    # log first, then new, then old: the order of the SQL text
    rank = F.transform(entries, lambda e: F.struct(
        F.when(e.startswith("log"), 0).when(e.startswith("new"), 1).otherwise(2).alias("r"), e.alias("e")))
    return m.select("run_id", "metrics.eval_status", "metrics.overall_accuracy", "metrics.train_val_acc",
                    "submission.tested", "submission.platform", "notes", "legacy", "metrics.old_metric",
                    F.array_join(F.transform(F.array_sort(rank), lambda s: s["e"]), ",").alias("assets"))


@query("c10_mark_done", sql("""SELECT run_id, CASE WHEN run_id % 8 = 1 THEN true ELSE tested END AS tested,
    CASE WHEN run_id % 8 = 1 AND NOT coalesce(tested, false) THEN 'remote' ELSE platform END AS platform,
    run_id % 8 = 1 AND NOT coalesce(tested, false) AS stamped FROM runs""", "runs"))
def mark_done(spark, sf):
    r = fx.runs(spark, sf).withColumn("submission", F.when(F.col("submission").isNotNull(), F.col("submission").withField(
        "submitted_at", F.lit(None).cast("string"))))
    u = r.where("run_id % 8 = 1").select("run_id", F.lit("remote").alias("platform"))
    return rg.mark_done(r, u).select("run_id", "submission.tested", "submission.platform",
                                     F.col("submission.submitted_at").isNotNull().alias("stamped"))


@query("f_compare_runs", sql("""SELECT run_id, subset, CASE WHEN run_id % 3 = 0 THEN 'xy' ELSE 'xyz' END AS coords,
    CAST(run_id % 543 AS BIGINT) AS n_landmarks, run_id * 10 AS n_params, CAST(run_id % 90 AS BIGINT) AS epochs,
    run_id % 9 <> 0 AS finished, run_id % 4 = 1 AS early_stopped, train_val_acc, eval_status, overall_accuracy FROM runs""", "runs"))
def compare_runs(spark, sf):
    k = F.col("run_id")
    r = fx.runs(spark, sf).withColumns({
        "coords": F.when(k % 3 == 0, "xy").otherwise("xyz"), "n_landmarks": (k % 543).cast("long"), "n_params": k * 10,
        "training": F.struct((k % 90).cast("long").alias("epochs_trained"), (k % 9 != 0).alias("finished"),
                             (k % 4 == 1).alias("early_stopped"))})
    return rg.compare_runs(r)


@query("s_times", sql("""SELECT o_orderkey AS run_id, strftime(make_timestamp((1784400000 + o_orderkey) * 1000000), '%Y-%m-%dT%H:%M:%S') AS created,
    CASE WHEN o_custkey % 4 > 0 THEN CAST(o_custkey AS DOUBLE) / (o_custkey % 4 * 15) END AS seconds FROM orders"""))
def times(spark, sf):
    o = fx.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), iso_timestamp(epoch_seconds(F.col("o_orderkey") + 1784400000)).alias("created"),
                    clip_seconds("o_custkey", F.col("o_custkey") % 4 * 15).alias("seconds"))


@query("f5_operating_point", sql("""SELECT * FROM pilot ORDER BY (cpu_mean_pct <= 75) DESC, videos_per_s DESC, trial LIMIT 1""", "pilot"))
def operating_point(spark, sf):
    return rg.operating_point(fx.pilot(spark, sf), 0.7)


@query("b14_expect", sql("""
  SELECT 'required' AS "check", count(*) AS n_violations FROM runs WHERE eval_status IS NULL OR notes IS NULL
  UNION ALL SELECT 'unique run', 0
  UNION ALL SELECT 'unique line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
  UNION ALL SELECT 'status', count(*) FROM runs WHERE coalesce(eval_status NOT IN ('canonical'), true)
  UNION ALL SELECT 'accuracy range', count(*) FROM runs WHERE coalesce(NOT overall_accuracy BETWEEN 0.1 AND 0.9, true)
  UNION ALL SELECT 'row count', 1
  UNION ALL SELECT 'labels known', count(*) FROM (SELECT DISTINCT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
  UNION ALL SELECT 'label in id', count(*) FROM pages
     WHERE NOT contains(regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', ''), '-' || string_split(url, '/')[-2] || '-')""", "runs"))
def expect(spark, sf):
    r = fx.runs(spark, sf)
    files = tr.catalog_from_paths(fx.table(spark, sf, "pages").select("url"), "url")
    return (Expect()
            .required(r.select("metrics.eval_status", "notes"), ["eval_status", "notes"])
            .unique(r, ["run_id"], "unique run")
            .unique(fx.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "unique line")
            .allowed(r.select("metrics.eval_status"), "eval_status", ["canonical"], "status")
            .between(r.select("metrics.overall_accuracy"), "overall_accuracy", 0.1, 0.9, "accuracy range")
            .row_count(r, 7, "row count")
            .contained(fx.table(spark, sf, "documents"), fx.table(spark, sf, "labels"), "doc_id", "labels known")
            .holds(files, tr.label_in_id(), "label in id")
            .result())


# -- sources ----------------------------------------------------------------

@query("a5_read_label_map", sql("SELECT class, CAST(row_number() OVER (ORDER BY class) - 1 AS INTEGER) AS label FROM (SELECT DISTINCT class FROM catalog)", "catalog"))
def read_label_map(spark, sf):
    from motionframe.operators.datasets import encode_sorted

    path = scratch_dir(spark, "labels")
    classes = encode_sorted(fx.catalog(spark, sf).select("class").distinct())
    classes.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("class", "label")))).alias("value")).write.text(path)
    return rs.read_label_map(spark, path)


@query("a6_read_runs", sql("""SELECT run_id, architecture, dataset, notes, overall_accuracy, train_val_acc, eval_status,
    coalesce(tested, false) AS tested, platform, CAST(schema_version AS BIGINT) AS schema_version FROM runs""", "runs"))
def read_runs(spark, sf):
    path = scratch_dir(spark, "runs")
    fx.runs(spark, sf).write.json(path)
    r = rs.read_runs(spark, path, multiline=False)
    return r.select("run_id", "architecture", "dataset", "notes", "metrics.overall_accuracy", "metrics.train_val_acc",
                    "metrics.eval_status", "submission.tested", "submission.platform", "schema_version")


@query("a7_read_history", sql(f"SELECT run_id, CAST(epoch AS INTEGER) AS epoch, {rd('train_acc')} AS train_acc, {rd('val_acc')} AS val_acc FROM hist", "hist"))
def read_history(spark, sf):
    h = fx.hist(spark, sf).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("epoch", "train_acc", "val_acc"))).alias("e"))
    none = F.transform("e", lambda x: F.lit(None).cast("double"))
    # packed records, below a folder whose name is a number too
    root = f"{scratch_dir(spark, 'history')}/2024"
    rs.write_histories(h.select("run_id", none.alias("train_loss"), F.col("e.train_acc").alias("train_acc"),
                                F.col("e.val_acc").alias("val_acc")), root)
    return rounded(rs.read_history(spark, f"{root}/part-*", multiline=False).select("run_id", "epoch", "train_acc", "val_acc"))


@query("a8_write_dataset", sql("SELECT class, entity_id, path FROM catalog WHERE class <> 'c0' UNION ALL SELECT class, entity_id, 'again' FROM catalog WHERE class = 'c0'", "catalog"))
def write_dataset(spark, sf):
    path = scratch_dir(spark, "dataset")
    c = fx.catalog(spark, sf)
    sinks.write_dataset(c, path, ["class"])
    sinks.write_dataset(c.withColumn("path", F.lit("ignored")), path, ["class"])
    again = c.where("class = 'c0'").withColumn("path", F.lit("again"))
    return sinks.write_dataset(again, path, ["class"], if_exists="partitions").select("class", "entity_id", "path")


@query("a9_write_summary", sql(f"SELECT architecture, count(*) AS n, {rd('avg(train_val_acc)')} AS mean FROM runs GROUP BY architecture", "runs"))
def write_summary(spark, sf):
    path = scratch_dir(spark, "summary")
    s = fx.runs(spark, sf).groupBy("architecture").agg(
        F.count("*").alias("n"), F.avg("metrics.train_val_acc").alias("mean"))
    sinks.write_summary(rounded(s), path, "csv")
    return spark.read.schema("architecture string, n long, mean double").option("header", True).csv(path)


@query("a10_file_catalog", sql(r"""SELECT url AS file_path, string_split(url, '/')[-2] AS label,
    regexp_replace(string_split(url, '/')[-1], '\.[^.]*$', '') AS id FROM pages"""))
def file_catalog(spark, sf):
    return tr.catalog_from_paths(fx.table(spark, sf, "pages").select("url"), "url").orderBy("id")


# -- operations -------------------------------------------------------------

STATE = """state AS (SELECT c.*, m.status AS recorded, CASE WHEN a.unit_id IS NULL THEN 'pending' WHEN m.status = 'done' THEN 'done' ELSE 'adopted' END AS state
  FROM work_catalog c LEFT JOIN manifest m USING (unit_id) LEFT JOIN artifacts a USING (unit_id))"""
WORK = ("work_catalog", "manifest", "artifacts")


@query("c3_work_state", sql("SELECT * FROM state", *WORK, extra=STATE))
def work_state(spark, sf):
    return op.work_state(fx.work_catalog(spark, sf), fx.manifest(spark, sf), fx.artifacts(spark, sf))


@query("c3_pending_work", sql("SELECT unit_id, split, class, recorded FROM state WHERE state = 'pending'", *WORK, extra=STATE))
def pending_work(spark, sf):
    return op.pending_work(fx.work_catalog(spark, sf), fx.manifest(spark, sf), fx.artifacts(spark, sf))


@query("c4_coverage_gap", sql("SELECT c_nationkey AS key, count(*) AS n_rows FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY 1"))
def coverage_gap(spark, sf):
    have = fx.table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("key"))
    want = fx.table(spark, sf, "customer").select(F.col("c_nationkey").alias("key"))
    return op.coverage_gap(have, want, "key")


@query("d24_manifest_qc", sql(f"""SELECT count(*) AS attempted, count(CASE WHEN status = 'done' THEN 1 END) AS done,
    count(CASE WHEN status = 'failed' THEN 1 END) AS failed, count(CASE WHEN status = 'done' AND n_frames = 0 THEN 1 END) AS zero_frames,
    {rd("quantile_cont(CASE WHEN status = 'done' THEN n_frames END, 0.05)")} AS p05, {rd("quantile_cont(CASE WHEN status = 'done' THEN n_frames END, 0.5)")} AS median,
    {rd("quantile_cont(CASE WHEN status = 'done' THEN n_frames END, 0.95)")} AS p95,
    (SELECT CAST(sum(size_bytes) AS BIGINT) FROM manifest JOIN artifacts USING (unit_id) WHERE status = 'done') AS bytes_on_disk FROM manifest""", *WORK))
def manifest_qc(spark, sf):
    return rounded(op.manifest_qc(fx.manifest(spark, sf), fx.artifacts(spark, sf)))


@query("d24_failure_reasons", sql("SELECT error, count(*) AS n FROM manifest WHERE status = 'failed' GROUP BY error ORDER BY n DESC, error LIMIT 5", "manifest"))
def failure_reasons(spark, sf):
    return op.failure_reasons(fx.manifest(spark, sf))


PROG = """count(*) AS total, count(CASE WHEN m.status = 'done' THEN 1 END) AS done, count(CASE WHEN m.status = 'failed' THEN 1 END) AS failed,
  round(100.0::DOUBLE * count(CASE WHEN m.status = 'done' THEN 1 END) / count(*), 1) AS pct FROM work_catalog c LEFT JOIN manifest m USING (unit_id)"""


@query("d25_progress", sql(f"SELECT split, {PROG} GROUP BY split", *WORK))
def progress(spark, sf):
    return op.progress(fx.work_catalog(spark, sf), fx.manifest(spark, sf))


@query("d25_progress_by_class", sql(f"SELECT split, class, {PROG} GROUP BY split, class", *WORK))
def progress_by_class(spark, sf):
    return op.progress(fx.work_catalog(spark, sf), fx.manifest(spark, sf), ["split", "class"])


@query("d26_throughput", sql(f"""SELECT CAST(unit_id % 4 AS BIGINT) AS n_workers, count(*) AS n_units, count(CASE WHEN status = 'failed' THEN 1 END) AS n_failed,
    {rd('sum(seconds)')} AS elapsed_s, {rd('count(*) / sum(seconds)')} AS units_per_s,
    {rd("sum(CASE WHEN status = 'done' THEN n_frames END) / sum(seconds)")} AS frames_per_s,
    {rd('avg(CAST(unit_id % 100 AS DOUBLE))')} AS load_mean, {rd('max(CAST(unit_id % 100 AS DOUBLE))')} AS load_max
    FROM manifest GROUP BY 1""", "manifest"))
def throughput(spark, sf):
    m = fx.manifest(spark, sf).withColumn("n_workers", F.col("unit_id") % 4).withColumn(
        "load", (F.col("unit_id") % 100).cast("double"))
    return rounded(op.throughput(m, ["n_workers"], "load"))


@query("d27_eta_projection", sql("""SELECT split, count(*) AS units, count(CASE WHEN state = 'pending' THEN 1 END) AS pending,
    round(count(CASE WHEN state = 'pending' THEN 1 END) / 0.0125::DOUBLE / 3600, 1) AS eta_h, round(count(*) * 165.25::DOUBLE / 1000, 1) AS projected_gb
    FROM state GROUP BY split""", *WORK, extra=STATE))
def eta_projection(spark, sf):
    s = op.work_state(fx.work_catalog(spark, sf), fx.manifest(spark, sf), fx.artifacts(spark, sf))
    return op.eta_projection(s, 0.0125, 165.25)


@query("d28_latency_summary", sql(f"""SELECT l_returnflag, {rd('avg(v)')} AS mean, {rd('min(v)')} AS min, {rd('max(v)')} AS max,
    {rd('count(v) * 64 / sum(v)')} AS per_second, {rd('quantile_cont(v, 0.5)')} AS median, {rd('quantile_cont(v, 0.95)')} AS p95,
    {rd('quantile_cont(v, 0.99)')} AS p99 FROM (SELECT l_returnflag, l_extendedprice AS v FROM lineitem) GROUP BY 1"""))
def latency_summary(spark, sf):
    return rounded(op.latency_summary(fx.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"),
                                      ["l_returnflag"], "l_extendedprice", 64))


@query("k1_process_units", sql("""SELECT class AS unit, CASE WHEN class = 'c3' THEN 'failed' ELSE 'done' END AS status, class = 'c3' AS has_error,
    CASE WHEN class = 'c3' THEN 0 ELSE count(*) END AS n_rows FROM (SELECT DISTINCT entity_id, class FROM tracks) GROUP BY class""", "tracks"))
def process_units(spark, sf):
    def mean_x(pdf):
        if (pdf["class"] == "c3").any():
            raise ValueError("bad unit")
        out = pdf.groupby("entity_id", as_index=False)["x"].mean()
        return out.rename(columns={"x": "mean_x"})

    m = op.process_units(fx.tracks(spark, sf), "class", "entity_id", mean_x, "entity_id long, mean_x double",
                         scratch_dir(spark, "units"))
    return m.select("unit", "status", F.col("error").isNotNull().alias("has_error"), "n_rows")
