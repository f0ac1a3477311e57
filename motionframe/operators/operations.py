"""Pending work, progress and quality control of bulk processing."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from motionframe.functions.columns import safe_ratio
from motionframe.plans.ranking import attach, exact_quantiles
from motionframe.sources.sinks import path_exists

# executors get the task functions with the task instead of importing them
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def work_state(catalog: DataFrame, manifest: DataFrame, artifacts: DataFrame,
               unit: str = "unit_id") -> DataFrame:
    """State per unit: `done` (recorded, artifact there), `adopted` (artifact without a done record), `pending`."""
    m = manifest.select(unit, F.col("status").alias("recorded"))
    a = artifacts.select(unit, F.lit(True).alias("on_disk"))
    state = (F.when(F.col("on_disk").isNull(), "pending").when(F.col("recorded") == "done", "done")
             .otherwise("adopted"))
    return catalog.join(m, unit, "left").join(a, unit, "left").select(
        *catalog.columns, "recorded", state.alias("state"))


def pending_work(catalog: DataFrame, manifest: DataFrame, artifacts: DataFrame,
                 unit: str = "unit_id") -> DataFrame:
    """Units still to run."""
    return work_state(catalog, manifest, artifacts, unit).where("state = 'pending'").drop("state")


def coverage_gap(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """Keys of `want` that `have` lacks, with their row counts."""
    return (want.groupBy(key).agg(F.count("*").alias("n_rows"))
            .join(have.select(key).distinct(), key, "left_anti"))


def manifest_counts(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count("*").alias("attempted"), F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if((F.col("status") == "done") & (F.col("n_frames") == 0)).alias("zero_frames"))


def failure_reasons(manifest: DataFrame, top: int = 5) -> DataFrame:
    """Most frequent errors of failed units."""
    return (manifest.where("status = 'failed'").groupBy("error").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "error").limit(top))


def manifest_qc(manifest: DataFrame, artifacts: DataFrame, unit: str = "unit_id") -> DataFrame:
    """One row: attempts, done, failed, frame quantiles of done units, zero-frame units, bytes on disk."""
    done = manifest.where("status = 'done'")
    q = exact_quantiles(done.select("n_frames"), [], "n_frames", {"p05": 0.05, "median": 0.5, "p95": 0.95})
    size = done.select(unit).join(artifacts, unit).agg(
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes_on_disk"))
    one = F.lit(1).alias("one")  # three single rows side by side
    return (manifest_counts(manifest).select("*", one).join(q.select("*", one), "one")
            .join(size.select("*", one), "one").drop("one"))


def progress(catalog: DataFrame, manifest: DataFrame, by: Sequence[str] = ("split",),
             unit: str = "unit_id") -> DataFrame:
    """Total, done, failed and percent done per split (or class)."""
    j = catalog.join(manifest.select(unit, "status"), unit, "left")
    done = F.count_if(F.col("status") == "done")
    return j.groupBy(*by).agg(
        F.count("*").alias("total"), done.alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(100 * done / F.count("*"), 1).alias("pct"))


def throughput(manifest: DataFrame, by: Sequence[str], load: str | None = None) -> DataFrame:
    """Units and frames per second, failures and load per run configuration; rates NULL at 0 seconds."""
    cols = [F.count("*").alias("n_units"),
            F.count_if(F.col("status") == "failed").alias("n_failed"),
            F.sum("seconds").alias("elapsed_s"),
            safe_ratio(F.count("*"), F.sum("seconds")).alias("units_per_s"),
            safe_ratio(F.sum(F.when(F.col("status") == "done", F.col("n_frames"))), F.sum("seconds"))
            .alias("frames_per_s")]
    if load:
        cols += [F.avg(load).alias("load_mean"), F.max(load).alias("load_max")]
    return manifest.groupBy(*by).agg(*cols)


def eta_projection(states: DataFrame, units_per_s: float, mean_mb: float,
                   by: Sequence[str] = ("split",)) -> DataFrame:
    """Hours left for pending units and disk projected for all units, per split."""
    pending = F.count_if(F.col("state") == "pending")
    return states.groupBy(*by).agg(
        F.count("*").alias("units"), pending.alias("pending"),
        F.round(pending / F.lit(units_per_s) / 3600, 1).alias("eta_h"),
        F.round(F.count("*") * F.lit(mean_mb) / 1000, 1).alias("projected_gb"))


def latency_summary(samples: DataFrame, by: Sequence[str], value: str, batch: int = 1) -> DataFrame:
    """mean, median, p95, p99, min, max of a latency, and samples per second at a batch size."""
    q = exact_quantiles(samples.select(*by, value), by, value, {"median": 0.5, "p95": 0.95, "p99": 0.99})
    stats = samples.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        safe_ratio(F.count(value) * batch, F.sum(value)).alias("per_second"))
    if not by:
        one = F.lit(1).alias("one")  # two single rows side by side
        return stats.select("*", one).join(q.select("*", one), "one").drop("one")
    return stats.join(q, list(by))


UNIT_STATUS = "unit string, part int, status string, error string, n_rows long"


ROWS_PER_PART = 100_000  # rows that one call of a unit function gets


def run_parts(data: DataFrame, unit: str, entity: str, fn: Callable, schema: str,
              rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Apply `fn` to parts of every unit; each output row carries the result or the error.

    A part holds whole entities; a unit has as many as its rows need, so a large unit is
    spread over tasks. `fn` takes and returns a pandas frame. An exception becomes an
    error row.
    """
    from pyspark.sql.types import StructType

    result = StructType.fromDDL(schema)
    names = result.names

    def run(key, pdf):
        import pandas as pd

        head = {"unit": str(key[0]), "part": int(key[1])}
        try:
            out = fn(pdf.drop(columns=["_unit", "_part"]))[names].copy()
            out["_kind"], out["_error"] = "row", None
            done = pd.DataFrame([{**{n: None for n in names}, "_kind": "done", "_error": None}])
            out = pd.concat([out.astype(object), done.astype(object)], ignore_index=True) if len(out) else done
        except Exception as exc:
            out = pd.DataFrame([{**{n: None for n in names}, "_kind": "failed", "_error": repr(exc)}])
        out.insert(0, "_unit", head["unit"])
        out.insert(1, "_part", head["part"])
        return out[["_unit", "_part", "_kind", "_error", *names]]

    keyed = data.withColumn("_unit", F.col(unit).cast("string"))
    sizes = keyed.groupBy("_unit").agg(F.ceil(F.count("*") / rows_per_part).alias("_parts"))
    keyed = attach(keyed, sizes, ["_unit"], ["_parts"])
    keyed = keyed.withColumn("_part", F.pmod(F.xxhash64(entity), F.col("_parts")).cast("int")).drop("_parts")
    ddl = "_unit string, _part int, _kind string, _error string, " + schema
    return keyed.groupBy("_unit", "_part").applyInPandas(run, ddl)


def process_units(data: DataFrame, unit: str, entity: str, fn: Callable, schema: str, root: str,
                  rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Run `fn` over all units that are not done yet and record the outcome.

    Below `root`: `results/unit=<id>` holds the rows of done units, `manifest` one row
    per attempt, written after the results. Done units with results are skipped and
    failed ones retried; one unit's error does not stop the others. Returns the latest
    manifest row per unit.
    """
    spark = data.sparkSession
    manifest = read_manifest(spark, root)
    if manifest is not None:
        # results are written before the manifest, so a done record implies its rows
        done = manifest.where("status = 'done'").select("unit")
        data = data.join(done, F.col(unit).cast("string") == F.col("unit"), "left_anti")
    if not data.isEmpty():
        attempt = spark.sql("SELECT uuid()").first()[0]
        staged = f"{root}/staging/{attempt}"
        run_parts(data, unit, entity, fn, schema, rows_per_part).write.mode("overwrite").parquet(staged)
        out = spark.read.parquet(staged)
        errors = out.where("_kind <> 'row'").groupBy(F.col("_unit").alias("unit")).agg(
            F.max("_error").alias("error"))
        rows = out.where("_kind = 'row'").join(
            errors.where("error IS NULL").select(F.col("unit").alias("_unit")), "_unit", "left_semi")
        names = [c for c in out.columns if not c.startswith("_")]
        # one file per part of a unit
        (rows.repartition("_unit", "_part").select(*names, F.col("_unit").alias("unit")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("unit").parquet(f"{root}/results"))
        counts = rows.groupBy(F.col("_unit").alias("unit")).agg(F.count("*").alias("n_rows"))
        status = errors.join(counts, "unit", "left").select(
            "unit", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"),
            "error", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
            F.current_timestamp().alias("ts"))
        status.write.mode("append").parquet(f"{root}/manifest")
        # the staged copy is no longer needed: an empty table takes its place
        spark.createDataFrame([], out.schema).write.mode("overwrite").parquet(staged)
    return read_manifest(spark, root)


def read_manifest(spark, root: str) -> DataFrame | None:
    """Latest record per unit, or None before the first run."""
    if not path_exists(spark, f"{root}/manifest"):
        return None
    log = spark.read.parquet(f"{root}/manifest")
    last = F.max_by(F.struct("status", "error", "n_rows", "ts"), "ts").alias("m")
    return log.groupBy("unit").agg(last).select("unit", "m.*")
