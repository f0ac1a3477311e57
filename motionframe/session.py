"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings the operators are written for. They are ordinary Spark settings; a
# cluster may set them in its defaults instead.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    # checkpoints go when the driver no longer refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed join may be split even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # many small track files: pack them into few read tasks
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.files.openCostInBytes": str(1024 * 1024),
}


def build_session(app_name: str = "motionframe", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


SHARED_FOLDER = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, from the setting spark.checkpoint.dir.

    Only a local session may go without it and gets a temporary folder: on a cluster the
    executors would not see the driver's.
    """
    root = spark.conf.get(SHARED_FOLDER, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError(f"set {SHARED_FOLDER} to a folder that all executors share; {master} has none")
        root = tempfile.mkdtemp(prefix="motionframe-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for written intermediate tables."""
    return os.path.join(checkpoint_root(spark), f"{label}-{uuid.uuid4().hex}")


def materialize(df):
    """Write a result that several later steps read, as columns that they read by need, and go on from the files."""
    path = scratch_dir(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, as --py-files would.

    Tasks then find it wherever the driver was started, without an installation.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="motionframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "motionframe.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    out.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), os.path.dirname(home)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
