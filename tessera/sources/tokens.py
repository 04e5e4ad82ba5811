"""Token tables: one row per visual token, keyed by video, frame and grid place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import grid

DIM = 64
GRID_H = GRID_W = 2


def from_embeddings(embeddings: DataFrame, h: int = GRID_H, w: int = GRID_W) -> DataFrame:
    """tokens(video_id, pos, frame, y, x, vec): a label is a video, its vectors by
    vec_id are the tokens of frames of h x w; an incomplete last frame is left out."""
    n = h * w
    by = Window.partitionBy("label")
    numbered = embeddings.where("label is not null").select(
        F.col("label").cast("long").alias("video_id"),
        (F.row_number().over(by.orderBy("vec_id")) - 1).cast("long").alias("pos"),
        F.count("*").over(by).alias("total"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )
    frame, y, x = grid.coordinates(F.col("pos"), F.lit(h), F.lit(w))
    return numbered.where(F.col("pos") < n * F.floor(F.col("total") / n)).select("video_id", "pos", frame.alias("frame"), y.alias("y"), x.alias("x"), "vec")


def queries_from_embeddings(embeddings: DataFrame, per_video: int = 3, labels: int = 10) -> DataFrame:
    """query_tokens(video_id, qpos, vec, valid): the first vectors of the next label."""
    by = Window.partitionBy("label").orderBy("vec_id")
    first = embeddings.where("label is not null").withColumn("qpos", (F.row_number().over(by) - 1).cast("long")).where(F.col("qpos") < per_video)
    return first.select(
        ((F.col("label") + labels - 1) % labels).cast("long").alias("video_id"), "qpos", F.col("embedding").cast("array<double>").alias("vec"), F.lit(True).alias("valid")
    )
