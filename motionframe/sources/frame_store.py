"""A flat store of frames: all sequences one after the other, read back by offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from motionframe.operators.datasets import pack_offsets

FRAMES_PER_BLOCK = 1_000_000  # frames of one folder of the store


def write_frame_store(frames: DataFrame, path: str, *, frames_per_block: int = FRAMES_PER_BLOCK, page_bytes: int = 64 << 10) -> None:
    """Writes frames (entity_id, frame, features) at consecutive offsets, entities in order, and an index of their slices.

    The store has `frames` (offset, features), in folders of `frames_per_block` offsets,
    each sorted by offset in small pages with an index, and `index` (entity_id, start,
    end). Frames that repeat within an entity are kept one after the other. Rows without
    an entity are refused. Offsets are a prefix sum over the entities; a task orders the
    frames of single entities and writes whole blocks.
    """
    bad = F.raise_error(F.lit("frames without an entity")).cast("long")
    counts = frames.groupBy("entity_id").agg(F.count("*").alias("n_frames"))
    counts = counts.withColumn("n_frames", F.when(F.col("entity_id").isNull(), bad).otherwise(F.col("n_frames")))
    pack_offsets(counts, "entity_id").select("entity_id", "start", "end", F.lit(frames_per_block).alias("frames_per_block")).write.parquet(
        f"{path}/index")
    index = frames.sparkSession.read.parquet(f"{path}/index")
    place = F.row_number().over(W.partitionBy("entity_id").orderBy("frame")) - 1
    rows = frames.select("entity_id", "features", place.alias("place")).join(index, "entity_id")
    rows = rows.select((F.col("start") + F.col("place")).alias("offset"), "features")
    rows = rows.withColumn("block", F.floor(F.col("offset") / frames_per_block))
    (rows.repartition("block").sortWithinPartitions("block", "offset").write.option("parquet.page.size", page_bytes)
     .partitionBy("block").parquet(f"{path}/frames"))


def read_slices(spark: SparkSession, path: str, entities: DataFrame) -> DataFrame:
    """Frames (entity_id, position, features) of the entities of a table from a store, positions from 0.

    An entity's slice names the folders and offsets that hold it, and only these folders
    are read. Entities that the store lacks give no rows; repeated ones count once.
    """
    index = spark.read.parquet(f"{path}/index").join(entities.select("entity_id").distinct(), "entity_id", "left_semi")
    size = F.col("frames_per_block")
    blocks = F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))
    wanted = index.select("entity_id", "start", "end", F.explode(blocks).alias("block"))
    frames = spark.read.parquet(f"{path}/frames")
    inside = (F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end"))
    return frames.join(wanted, "block").where(inside).select(
        "entity_id", (F.col("offset") - F.col("start")).alias("position"), "features")
