"""Curvature-aware selection: frames where the video turns get more tokens, and outliers are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import budgets
from tessera.functions import vectors as V
from tessera.operators import ranking, similarity


def frame_budgets(tokens: DataFrame, dim: int, *, ratio: float = 0.25, min_k: int = 1, temperature: float = 1.0) -> DataFrame:
    """(video_id, frame, weight, k): budgets by softmax of the curvature; a video of one frame keeps it whole."""
    bend = similarity.curvature(tokens, dim)
    top = bend.groupBy("video_id").agg(F.max("curvature").alias("top"))
    e = bend.join(top, "video_id").withColumn("e", F.exp((F.col("curvature") - F.col("top")) / temperature))
    mass = e.groupBy("video_id").agg(F.sum("e").alias("mass"))
    sizes = tokens.groupBy("video_id").agg(F.count("*").alias("total"), F.count_distinct("frame").alias("t"))
    x = e.join(mass, "video_id").join(sizes, "video_id").withColumn("weight", F.col("e") / F.col("mass"))
    per_frame = F.floor(F.col("total") / F.col("t"))
    least = F.least(F.lit(min_k), per_frame)
    x = x.withColumn("per_frame", per_frame.cast("long")).withColumn("budget", F.greatest(budgets.half_even(F.col("total"), ratio), F.col("t") * least))
    x = x.select("video_id", "frame", "weight", "budget", "per_frame")
    out = ranking.per_frame_allocation(x, "weight", F.col("budget"), min_k, F.col("per_frame"))
    whole = F.when(F.col("t") <= 1, F.col("per_frame")).otherwise(F.col("k"))
    sizes = sizes.select("video_id", "t", F.floor(F.col("total") / F.col("t")).cast("long").alias("per_frame"))
    return out.select("video_id", "frame", "weight", "k").join(sizes, "video_id").select("video_id", "frame", "weight", whole.cast("long").alias("k"))


def token_scores(tokens: DataFrame, dim: int) -> DataFrame:
    """(video_id, frame, pos, score): 1 - cosine to the frame's mean, plus the norm scaled to 0..1 within the frame."""
    reps = similarity.frame_means(tokens, dim).select("video_id", "frame", V.normalised("mean").alias("rep"))
    x = tokens.join(reps, ["video_id", "frame"]).select("video_id", "frame", "pos", (1 - V.cosine("vec", "rep")).alias("outlier"), V.norm("vec").alias("size"))
    ends = x.groupBy("video_id", "frame").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    scaled = (F.col("size") - F.col("low")) / (F.col("high") - F.col("low") + 1e-6)
    return x.join(ends, ["video_id", "frame"]).select("video_id", "frame", "pos", (F.col("outlier") + scaled).alias("score"))


def plan(tokens: DataFrame, dim: int, *, ratio: float = 0.25, min_k: int = 1, temperature: float = 1.0) -> DataFrame:
    """Kept tokens (video_id, frame, pos, score): the best k of each frame, ties to the lower place."""
    k = frame_budgets(tokens, dim, ratio=ratio, min_k=min_k, temperature=temperature).select("video_id", "frame", "k")
    scored = token_scores(tokens, dim).join(k, ["video_id", "frame"])
    return ranking.top_k(scored, ["video_id", "frame"], F.col("score"), F.col("k")).select("video_id", "frame", "pos", "score")
