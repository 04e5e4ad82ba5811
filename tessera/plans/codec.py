"""Selection of token groups that a codec marked, and its random baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import ranking


def selected_groups(stored: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, g): stored groups of videos whose grid (t, gh, gw) is the stored one, in range, once each.
    Videos that get none here are to be kept dense."""
    same = stored.join(videos, ["video_id", "t", "gh", "gw"])
    rows = same.select("video_id", F.explode(F.col("groups").cast("array<bigint>")).alias("g"), (F.col("t") * F.col("gh") * F.col("gw")).alias("n"))
    return rows.where("g >= 0 and g < n").select("video_id", "g").distinct()


def with_coverage(groups: DataFrame, videos: DataFrame) -> DataFrame:
    """``groups`` and, for each frame without any, its first group."""
    per_frame = F.col("gh") * F.col("gw")
    frames = videos.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("t") - 1).cast("long"))).alias("frame"), per_frame.cast("long").alias("per_frame"))
    has = groups.join(videos.select("video_id", per_frame.alias("per_frame")), "video_id").select("video_id", F.floor(F.col("g") / F.col("per_frame")).alias("frame")).distinct()
    missing = frames.join(has, ["video_id", "frame"], "left_anti").select("video_id", (F.col("frame") * F.col("per_frame")).alias("g"))
    return groups.unionByName(missing).distinct()


def counts_per_frame(groups: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, frame, n), zeros included."""
    frames = videos.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("t") - 1).cast("long"))).alias("frame"), (F.col("gh") * F.col("gw")).alias("per_frame"))
    x = frames.join(groups, (frames.video_id == groups.video_id) & (frames.frame == F.floor(groups.g / frames.per_frame)), "left")
    return x.groupBy(frames.video_id, "frame").agg(F.count("g").alias("n"))


def random_groups(groups: DataFrame, videos: DataFrame, seed=0) -> DataFrame:
    """As many random groups as ``groups`` has per video: one of each frame if that affords it, then any others.
    Hash order stands in for a generator: the same sizes and invariants, not the same draws."""
    wanted = groups.groupBy("video_id").agg(F.count("*").alias("wanted"))
    n = F.col("t") * F.col("gh") * F.col("gw")
    every = videos.where(n > 0).select("video_id", "t", (F.col("gh") * F.col("gw")).alias("per_frame"), F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).alias("g")).join(wanted, "video_id")
    order = ranking.random_order(seed, "video_id", "g")
    every = every.withColumn("frame", F.floor(F.col("g") / F.col("per_frame")))
    every = every.withColumn("first", (F.row_number().over(Window.partitionBy("video_id", "frame").orderBy(order, "g")) == 1) & (F.col("wanted") >= F.col("t")))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.col("first").desc(), order, "g"))
    return every.withColumn("rank", rank).where(F.col("rank") <= F.col("wanted")).select("video_id", "g")
