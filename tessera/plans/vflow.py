"""Selection by scores that were computed elsewhere, on another grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import grid
from tessera.operators import ranking


def resample(scores: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, pos, score): scores (video_id, t, y, x, score) of a whole source grid, at the nearest place of
    the target grids (video_id, t, h, w).  Videos whose source grid has gaps or repeats are left out."""
    source = scores.groupBy("video_id").agg((F.max("t") + 1).alias("st"), (F.max("y") + 1).alias("sh"), (F.max("x") + 1).alias("sw"), F.count("*").alias("n"), F.count_distinct("t", "y", "x").alias("d"))
    whole = source.where((F.col("n") == F.col("st") * F.col("sh") * F.col("sw")) & (F.col("n") == F.col("d")))
    target = grid.dense_grid(videos).join(whole, "video_id")
    axis = grid.scaled_axis
    at = target.select(
        "video_id", F.col("flat").alias("pos"), axis(F.col("frame"), F.col("st"), F.col("t")).alias("t"), axis(F.col("y"), F.col("sh"), F.col("h")).alias("y"), axis(F.col("x"), F.col("sw"), F.col("w")).alias("x")
    )
    return at.join(scores, ["video_id", "t", "y", "x"]).select("video_id", "pos", "score")


def layer_mean(layers: DataFrame) -> DataFrame:
    """(question_id, local_idx, score): the mean over the layers of (question_id, layer, local_idx, value)."""
    return layers.groupBy("question_id", "local_idx").agg(F.avg("value").alias("score"))


def plan(scores: DataFrame, ratio: float, policy: str = "high") -> DataFrame:
    """Kept tokens (video_id, pos, score): the highest or lowest up to floor(total * ratio), at least one."""
    return ranking.keep_by_score(scores, ["video_id"], "score", ratio, policy)


def summary(kept: DataFrame, videos: DataFrame) -> DataFrame:
    """Kept tokens per frame, frames without any included: (video_id, frame, kept, low, high, mean)."""
    frames = videos.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("t") - 1).cast("long"))).alias("frame"), (F.col("h") * F.col("w")).alias("per_frame"))
    x = frames.join(kept, (frames.video_id == kept.video_id) & (frames.frame == F.floor(kept.pos / frames.per_frame)), "left").select(frames.video_id, "frame", "pos", "score")
    return x.groupBy("video_id", "frame").agg(F.count("pos").alias("kept"), F.min("score").alias("low"), F.max("score").alias("high"), F.avg("score").alias("mean"))
