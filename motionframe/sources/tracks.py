"""Catalogs, track files and track archives."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from motionframe import schemas
from motionframe.functions.columns import decoded_path, missing_to_null, normalize_path, path_parent, path_stem

# executors get the decoder with the task instead of importing it
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_catalog(spark: SparkSession, path: str, root: str,
                 schema: StructType | str = schemas.CATALOG) -> DataFrame:
    """CSV catalog with the normalized absolute path of each track file, ordered by path."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    root = root.replace("\\", "/").rstrip("/")
    return df.withColumn("abs_path", normalize_path(F.concat(F.lit(root + "/"), F.col("path")))).orderBy("path")


def attach_catalog(rows: DataFrame, catalog: DataFrame, path: str = "file_path", keys: Sequence[str] = ()) -> DataFrame:
    """Inner join of track rows to the catalog on the normalized path; path columns dropped.

    `keys` are columns of both that tell the entities of a file apart, for packed files.
    """
    left = rows.withColumn("_p", normalize_path(path)).drop(path)
    right = catalog.withColumn("_p", normalize_path("abs_path")).drop("abs_path", "path")
    return left.join(right, ["_p", *keys]).drop("_p")


def write_tracks(tracks: DataFrame, path: str, keys: Sequence[str] = ("entity_id",)) -> None:
    """Track rows as packed files, whole entities and many to a file.

    A file per entity costs a folder, a listing and an open file each; here their number
    follows the partitions that the rows fill, whatever their entities.
    """
    tracks.repartition(*keys).sortWithinPartitions(*keys).write.parquet(path)


def packed_entities(spark: SparkSession, path: str, keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """(abs_path, keys) of each entity of the packed files below a folder, to join to a catalog."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("_f"), *keys).distinct()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.col("path").alias("abs_path"))
    return files.join(rows, decoded_path("_f") == F.element_at(F.split("abs_path", "/"), -1)).drop("_f")


def read_tracks(spark: SparkSession, paths: str | Sequence[str], catalog: DataFrame,
                schema: StructType | str = schemas.TRACK_FILE, keys: Sequence[str] = ()) -> DataFrame:
    """Track rows of the given files (or globs) with their catalog columns; NaN becomes NULL.

    A file is one entity's, or with `keys`, which rows and catalog have, that of many
    (`write_tracks`).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    rows = spark.read.schema(schema).parquet(*paths)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_f"))
    for c in ("x", "y", "z"):
        if c in rows.columns:
            rows = rows.withColumn(c, missing_to_null(c))
    # paths are decoded once a file, not once a row: rows meet the catalog on the path as Spark gives it
    files = rows.select("_f").distinct()
    known = attach_catalog(files.select("_f", decoded_path("_f").alias("_path")), catalog, "_path")
    return rows.join(known, [*keys, "_f"]).drop("_f")


def unmatched_files(spark: SparkSession, paths: str | Sequence[str], catalog: DataFrame) -> DataFrame:
    """(file_path) of track files without a catalog row, which `read_tracks` leaves out."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(paths).select(normalize_path("path").alias("file_path"))
    return files.join(catalog.select(normalize_path("abs_path").alias("file_path")), "file_path", "left_anti")


def register_track_view(spark: SparkSession, name: str, glob: str, catalog: DataFrame,
                        schema: StructType | str = schemas.TRACK_FILE, keys: Sequence[str] = ()) -> DataFrame:
    """SQL view of all tracks joined to the catalog, as `read_tracks` gives them."""
    df = read_tracks(spark, glob, catalog, schema, keys)
    df.createOrReplaceTempView(name)
    return df


def read_track_archives(spark: SparkSession, path: str) -> DataFrame:
    """Long track rows of `<label>/<id>.npz` archives, decoded in the tasks that read them.

    Staging files (`*.tmp.npz`) are skipped; undetected values (NaN) become NULL.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.npz")
             .option("recursiveFileLookup", True).load(path)
             .where(~F.col("path").endswith(".tmp.npz"))
             .select(path_stem("path").alias("id"), path_parent("path").alias("label"), "content"))
    return decode_archives(files)


def decode_archives(files: DataFrame) -> DataFrame:
    """Long track rows from (id, label, content) where content is the bytes of an archive."""
    rows = files.select("id", "label", "content").mapInPandas(_decode, schemas.ARCHIVE_FRAMES)
    return rows.select("id", "label", "fps", "frame", "row",
                       *[missing_to_null(c).alias(c) for c in ("x", "y", "z")])


def _decode(batches):
    import io

    import numpy as np
    import pandas as pd

    piece = 256  # frames handed over at a time
    for pdf in batches:
        for item in pdf.itertuples(index=False):
            with np.load(io.BytesIO(item.content)) as z:
                marks, fps = z["landmarks"].astype(np.float32), float(z["fps"])
            channels = marks.shape[1]
            for start in range(0, len(marks), piece):
                part = marks[start:start + piece]
                n = len(part)
                flat = part.reshape(-1, 3)
                yield pd.DataFrame({
                    "id": item.id, "label": item.label, "fps": np.float32(fps),
                    "frame": np.repeat(np.arange(start, start + n, dtype=np.int32), channels),
                    "row": np.tile(np.arange(channels, dtype=np.int16), n),
                    "x": flat[:, 0], "y": flat[:, 1], "z": flat[:, 2]})


def catalog_from_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """(file_path, label, id): label is the parent directory, id the file name without extension."""
    p = normalize_path(path)
    return paths.select(p.alias("file_path"), path_parent(p).alias("label"), path_stem(p).alias("id"))


def build_file_catalog(spark: SparkSession, root: str, pattern: str = "*.mp4") -> DataFrame:
    """Recursive listing as a catalog ordered by id; file contents are not read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", True).load(root).select("path"))
    return catalog_from_paths(files).orderBy("id")


def label_in_id(label: str = "label", ident: str = "id"):
    """Condition: the id names its label between dashes."""
    return F.col(ident).contains(F.concat(F.lit("-"), F.col(label), F.lit("-")))
