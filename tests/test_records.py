"""Sources, run records, resumable units, quality defaults and streams."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motionframe import schemas
from motionframe.functions.columns import missing_to_null, null_to_zero
from motionframe.operators import datasets as ds, operations as op, quality as ql, registry as rg
from motionframe.operators.datasets import subset_sizes
from motionframe.sources import runs as rs, sinks, tracks as tr
from motionframe.streaming import incremental as inc


def test_channel_subsets_have_their_sizes(spark):
    rows = [(name, r) for name, (parts, _) in schemas.CHANNEL_SUBSETS.items() for p in parts for r in p]
    got = {r.subset: r.n_channels for r in subset_sizes(spark.createDataFrame(rows, "subset string, row int")).collect()}
    assert got == {name: size for name, (_, size) in schemas.CHANNEL_SUBSETS.items()}


def test_missing_values(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double")
    got = [tuple(r) for r in df.select(null_to_zero("v"), missing_to_null("v")).collect()]
    assert got == [(1.5, 1.5), (0.0, None), (0.0, float("inf")), (0.0, float("-inf")), (0.0, None)]


def test_archives(spark, tmp_path):
    folder = tmp_path / "train" / "cat"
    os.makedirs(folder)
    marks = np.full((3, 5, 3), np.nan, dtype=np.float16)
    marks[1, 2] = (0.5, 0.25, -1)
    for name in ("a.b.npz", "c.tmp.npz"):
        with open(folder / name, "wb") as f:
            np.savez_compressed(f, landmarks=marks, fps=np.float32(25), num_frames=np.int32(3))
    rows = tr.read_track_archives(spark, str(tmp_path)).collect()
    assert len(rows) == 15 and {(r.id, r.label, r.fps) for r in rows} == {("a.b", "cat", 25.0)}
    seen = [(r.frame, r.row, r.x, r.y, r.z) for r in rows if r.x is not None]
    assert seen == [(1, 2, 0.5, 0.25, -1.0)]
    assert tr.build_file_catalog(spark, str(tmp_path), "*.npz").where("id = 'a.b'").first().label == "cat"


def test_runs_and_history(spark, tmp_path):
    for rid, extra in ((11, {}), (12, {"submission": {"tested": True, "platform": "local"}})):
        d = tmp_path / str(rid)
        os.makedirs(d / "assets")
        (d / "meta.json").write_text(json.dumps({
            "run_id": rid, "dataset": "d", "schema_version": 2 if rid == 11 else 3,
            "metrics": {"train_val_acc": 0.5}, "hyperparameters": {"lr": 0.1}, **extra}, indent=1))
        (d / "assets" / "history.json").write_text(json.dumps({
            "train_loss": [3.0, 2.0], "train_acc": [0.1, 0.2], "val_loss": [3, 2.5], "val_acc": [0.1, 0.3], "lr": [1, 1]}))
    runs = rs.read_runs(spark, f"{tmp_path}/*/meta.json")
    assert [(r.run_id, r.submission.tested) for r in runs.orderBy("run_id").collect()] == [(11, False), (12, True)]
    flat = rg.flatten_runs(runs, ["lr"])
    assert flat.columns[0] == "dataset" and flat.columns[-1] == "notes" and "hyp_lr" in flat.columns
    hist = rs.read_history(spark, f"{tmp_path}/*/assets/history.json")
    assert [(r.run_id, r.epoch, r.val_acc) for r in hist.orderBy("run_id", "epoch").collect()][1] == (11, 2, 0.3)
    fixed = rg.backfill_schema(runs.withColumn("submission", F.when(F.col("run_id") == 12, F.col("submission"))))
    assert {r.run_id: r.changed for r in fixed.collect()} == {11: True, 12: False}
    assert not rg.backfill_schema(fixed.drop("changed")).where("changed").count()


def test_packed_histories_take_files_by_partitions_not_by_runs(spark, tmp_path):
    runs = spark.range(500).select(F.col("id").alias("run_id"), F.array(F.lit(None).cast("double"), F.lit(0.5)).alias("train_loss"),
                                   F.array(F.col("id") / 4, F.lit(None).cast("double")).alias("val_acc"))
    root = tmp_path / "2024"  # a number, but not the runs'
    rs.write_histories(runs.repartition(3), str(root / "packed"))
    assert len(list((root / "packed").glob("part-*"))) == 3
    got = rs.read_history(spark, str(root / "packed"), multiline=False).orderBy("run_id", "epoch").collect()
    assert [(r.run_id, r.epoch, r.train_loss, r.val_acc, r.lr) for r in got] == [
        row for i in range(500) for row in ((i, 1, None, i / 4, None), (i, 2, 0.5, None, None))]
    # a file per run, named by its folder in either way, and records that name their run
    for folder, text in (("7/assets", '{"lr": [1]}'), ("run_id=8", '{"lr": [2]}'), ("9", '{"run_id": 10, "lr": [3]}')):
        os.makedirs(root / "single" / folder)
        (root / "single" / folder / "history.json").write_text(text)
    single = [rs.read_history(spark, f"{root}/single/{g}/history.json") for g in ("7/*", "run_id=8", "9")]
    assert [(r.run_id, r.lr) for df in single for r in df.collect()] == [(7, 1.0), (8, 2.0), (10, 3.0)]
    with pytest.raises(Exception, match="without a run"):
        rs.write_histories(runs.withColumn("run_id", F.lit(None).cast("long")), str(tmp_path / "none"))


def test_history_query_writes_no_file_per_run(spark):
    import __spark_entry__ as entry
    from motionframe.session import checkpoint_root

    before = set(os.listdir(checkpoint_root(spark)))
    entry.queries()["a7_read_history"](spark, "/root/testdata/sf0.001")
    folder, = {f for f in os.listdir(checkpoint_root(spark)) if f.startswith("history-")} - before
    n_files = sum(len([f for f in names if f.startswith("part-")]) for _, _, names in os.walk(os.path.join(checkpoint_root(spark), folder)))
    assert 0 < n_files <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_write_dataset_replaces_half_written(spark, tmp_path):
    path = str(tmp_path / "d")
    os.makedirs(path)
    (tmp_path / "d" / "part-0.parquet").write_bytes(b"broken")
    assert sinks.write_dataset(spark.range(5), path).count() == 5
    assert sinks.write_dataset(spark.range(9), path).count() == 5
    assert sinks.write_dataset(spark.range(9), path, if_exists="overwrite").count() == 9


def test_process_units_resumes(spark, tmp_path):
    rows = [(u, e, float(e)) for u in ("a", "b", "hot") for e in range(40 if u == "hot" else 5)]
    df = spark.createDataFrame(rows, "unit_name string, entity_id long, v double")
    root = str(tmp_path / "units")

    def double(pdf):
        return pd.DataFrame({"entity_id": pdf["entity_id"], "twice": pdf["v"] * 2})

    def broken_b(pdf):
        if (pdf["unit_name"] == "b").any():
            raise ValueError("no b today")
        return double(pdf)

    first = op.process_units(df, "unit_name", "entity_id", broken_b, "entity_id long, twice double", root, 10)
    assert {r.unit: (r.status, r.n_rows) for r in first.collect()} == {
        "a": ("done", 5), "b": ("failed", 0), "hot": ("done", 40)}
    stamps = {r.unit: r.ts for r in first.collect()}
    second = op.process_units(df, "unit_name", "entity_id", double, "entity_id long, twice double", root, 10)
    after = {r.unit: r for r in second.collect()}
    assert {u: r.status for u, r in after.items()} == {"a": "done", "b": "done", "hot": "done"}
    assert after["a"].ts == stamps["a"] and after["hot"].ts == stamps["hot"]  # only b ran again
    out = spark.read.parquet(f"{root}/results")
    assert not [f for f in (tmp_path / "units" / "staging").rglob("*.parquet") if spark.read.parquet(str(f)).count()]
    assert out.count() == 50 and out.agg(F.sum("twice")).first()[0] == 2 * sum(r[2] for r in rows)


def test_composite_edges(spark):
    rows = [(i, 1.0, 0.5, 0.2 * i, None if i == 0 else float(i), 0.1, 0.3) for i in range(5)]
    df = spark.createDataFrame(rows, "entity_id int, hand_rate double, pose_rate double, face_rate double, "
                                     "jitter_hand double, bone_cv double, longest_gap_frac double")
    out = {r.entity_id: r for r in ql.zscore_composite(df, {"face_rate": 2.0}).collect()}
    assert all(r.z_hand_rate == 0 and r.z_gap == 0 for r in out.values())
    v = np.array([2.5, 1, 2, 3, 4])
    z = (v - v.mean()) / v.std()
    f = np.arange(5) * 0.2
    zf = (f - f.mean()) / f.std()
    for i, r in out.items():
        assert abs(r.z_jitter - z[i]) < 1e-9 and abs(r.quality_score - (2 * zf[i] - 2 * z[i])) < 1e-9


def test_stream_processes_each_file_once(spark, tmp_path):
    schema = "entity_id long, class string, grp string, idx int, row int, frame int, x double, y double"
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))

    def arrive(entity):
        rows = [(entity, "c", "g", 0, 0, f, float(f * f % 7), float(f)) for f in range(12)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    arrive(1)
    inc.incremental_descriptors(inc.track_stream(spark, src, schema), out, state).awaitTermination()
    arrive(2)
    for _ in range(2):
        inc.incremental_descriptors(inc.track_stream(spark, src, schema), out, state).awaitTermination()
    rows = inc.read_descriptors(spark, out).collect()
    assert sorted(r.entity_id for r in rows) == [1, 2]
    assert len({(r.rms_speed_xy, r.x_mean) for r in rows}) == 1
    # more frames of an entity that is known already: one row over all of them
    more = [(1, "c", "g", 0, 0, f, float(f * f % 7), float(f)) for f in range(12, 20)]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(src)
    inc.incremental_descriptors(inc.track_stream(spark, src, schema), out, state).awaitTermination()
    again = {r.entity_id: r for r in inc.read_descriptors(spark, out).collect()}
    assert again[1].n_valid_transitions == 19 and again[1].y_mean == 9.5 and again[2].n_valid_transitions == 11


def test_late_frames_are_dropped_and_counted(spark, tmp_path):
    schema = "entity_id long, row int, frame int, x double, y double"
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for frames in ((0, 1, 2, 5, 6), (3, 4, 7)):
        rows = [(1, c, f, float(f * f + c), float(f)) for f in frames for c in (0, 3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        inc.run_available(inc.causal_features(inc.track_stream(spark, src, schema)), out, state)
    got = {(r.row, r.frame): (r.dx, r.n_late) for r in spark.read.parquet(out).collect()}
    assert sorted(f for c, f in got if c == 3) == [0, 1, 2, 5, 6, 7]
    assert got[0, 7] == got[3, 7] == (13.0, 2) and got[0, 5] == (None, 0)


def test_dataset_names_are_values_not_text(spark):
    runs = spark.createDataFrame([(1, "O'B", "a")], "run_id long, dataset string, architecture string").selectExpr(
        "*", "named_struct('overall_accuracy', 0.5D, 'train_val_acc', 0.4D, 'eval_status', 'pending') AS metrics",
        "CAST(NULL AS STRUCT<tested: BOOLEAN>) AS submission")
    for fn in (rg.leaderboard, rg.untested_queue):
        assert [r.run_id for r in fn(runs, "O'B").collect()] == [1]
        assert fn(runs, "x' OR '1'='1").count() == 0
    assert rg.eval_backlog(runs, "O'B", runs).count() == 1


def test_track_files_with_odd_names(spark, tmp_path):
    root = tmp_path / "set one + 50%"
    os.makedirs(root)
    for name in ("a b", "c"):
        pd.DataFrame({"frame": [0, 1], "x": [1.0, 2.0]}).to_parquet(root / f"{name}.parquet")
    cat = spark.createDataFrame([(f"{root}/a b.parquet", "k")], "abs_path string, class string")
    rows = tr.read_tracks(spark, f"{root}/*.parquet", cat, "frame long, x double")
    assert rows.count() == 2
    left = tr.unmatched_files(spark, f"{root}/*.parquet", cat).collect()
    assert [os.path.basename(r.file_path) for r in left] == ["c.parquet"]


def test_packed_track_files_take_partitions_not_entities(spark, tmp_path):
    path = str(tmp_path / "set one + 50%")
    rows = spark.range(900).selectExpr("id % 300 AS entity_id", "id div 300 AS frame", "IF(id % 7 = 0, double('NaN'), id / 4) AS x")
    tr.write_tracks(rows, path)
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert 0 < len(files) <= 8
    listed = tr.packed_entities(spark, path)
    assert listed.count() == listed.select("entity_id").distinct().count() == 300
    cat = listed.where("entity_id < 200").withColumn("class", F.concat(F.lit("c"), F.col("entity_id").cast("string")))
    got = tr.read_tracks(spark, f"{path}/*.parquet", cat, "entity_id long, frame long, x double", ["entity_id"]).collect()
    assert sorted((r.entity_id, r.frame, r.x, r["class"]) for r in got) == sorted(
        (i % 300, i // 300, None if i % 7 == 0 else i / 4, f"c{i % 300}") for i in range(900) if i % 300 < 200)


def test_paths_are_decoded_once_a_file(spark, tmp_path):
    """An entity of two files takes the catalog row of each; no row of a file decodes or normalizes its path."""
    root = tmp_path / "set one + 50%"
    os.makedirs(root)
    for name, x in (("a b", 1.0), ("c%20d", 2.0), ("e", 3.0)):
        pd.DataFrame({"entity_id": [5, 6], "x": [x, float("nan")]}).to_parquet(root / f"{name}.parquet")
    cat = spark.createDataFrame([
        (f"file:{root}/a b.parquet", 5, "k"), (f"{root}/c%20d.parquet".replace("/", "\\"), 5, "l"),
        (f"{root}/c%20d.parquet", 6, "m")], "abs_path string, entity_id long, class string")
    rows = tr.read_tracks(spark, f"{root}/*.parquet", cat, "entity_id long, x double", ["entity_id"])
    assert rows.columns == ["entity_id", "x", "class"]
    assert sorted(map(tuple, rows.collect())) == [(5, 1.0, "k"), (5, 2.0, "l"), (6, None, "m")]
    side = rows._jdf.queryExecution().optimizedPlan().toString().split("Relation [")[0]  # what the rows pass before the join
    assert "Join Inner" in side and "UrlCodec" not in side and "regexp_replace" not in side


def test_view_query_writes_no_file_per_entity(spark):
    _few_track_files(spark, "a3_register_track_view")


def test_read_query_writes_no_file_per_entity(spark):
    _few_track_files(spark, "a2_read_tracks")


def _few_track_files(spark, name):
    import __spark_entry__ as entry
    from motionframe.session import checkpoint_root

    root = checkpoint_root(spark)
    before = set(os.listdir(root))
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    folder, = {f for f in os.listdir(root) if f.startswith("tracks-")} - before
    n_files = sum(f.endswith(".parquet") for _, _, names in os.walk(os.path.join(root, folder)) for f in names)
    assert 0 < n_files <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_slices_of_a_frame_store(spark, tmp_path):
    """Offsets across blocks, empty choices, entities that are not there; only the blocks of a slice are read."""
    from motionframe.sources import frame_store as fs

    rows = [(e, f, [float(e), float(f)]) for e, n in ((3, 7), (1, 1), (9, 12), (5, 3)) for f in range(n)] + [(5, 1, [5.0, 1.5])]
    frames = spark.createDataFrame(rows, "entity_id int, frame int, features array<double>").repartition(4)
    path = str(tmp_path / "store")
    fs.write_frame_store(frames, path, frames_per_block=5)
    index = {r.entity_id: (r.start, r.end) for r in spark.read.parquet(f"{path}/index").collect()}
    assert index == {1: (0, 1), 3: (1, 8), 5: (8, 12), 9: (12, 24)}
    want = spark.createDataFrame([(9,), (5,), (5,), (77,)], "entity_id int")
    got = sorted((r.entity_id, r.position, r.features) for r in fs.read_slices(spark, path, want).collect())
    assert [(e, p) for e, p, _ in got] == [(5, i) for i in range(4)] + [(9, i) for i in range(12)]
    assert [v[1] for e, _, v in got if e == 9] == [float(i) for i in range(12)] and {v[1] for e, _, v in got if e == 5} == {0.0, 1.0, 1.5, 2.0}
    assert fs.read_slices(spark, path, want.limit(0)).count() == 0
    plan = fs.read_slices(spark, path, want.where("entity_id = 9"))._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    with pytest.raises(Exception, match="without an entity"):
        fs.write_frame_store(spark.createDataFrame([(None, 1, [1.0])], frames.schema), str(tmp_path / "bad"))


def test_padded_values_of_odd_sequences(spark):
    seqs = spark.createDataFrame([(1, 2, [1.0, None, float("nan"), 4.0]), (2, 3, [1.0] * 6), (3, 0, None), (4, 1, [7.0, 8.0])],
                                 "key int, n_frames long, seq array<double>")
    got = {r.key: r for r in ds.padded_values(seqs, "key", 2, 2).collect()}
    assert got[1]["values"] == [1.0, 0.0, 0.0, 4.0, 0.0, 0.0] and got[2].slot == 0 and got[2]["values"] == [1.0] * 6
    assert got[3]["values"] == [0.0, 0.0] and got[4]["values"] == [7.0, 8.0] and got[4].padded_to == 1
    assert ds.padded_values(seqs.limit(0), "key", 2, 2).count() == 0
