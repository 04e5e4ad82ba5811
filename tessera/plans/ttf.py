"""Temporal token filtering: tokens that an anchor frame already shows are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import budgets
from tessera.functions import vectors as V
from tessera.operators import ranking, similarity


def anchors(tokens: DataFrame, dim: int, policy: str = "auto") -> DataFrame:
    """(video_id, anchor): the first or last frame, or that most like the mean of all (ties: earlier)."""
    if policy in ("first", "last"):
        return tokens.groupBy("video_id").agg((F.min if policy == "first" else F.max)("frame").alias("anchor"))
    if policy != "auto":
        raise ValueError(f"unsupported anchor: {policy}")
    s = similarity.frame_similarity(tokens, dim)
    return s.groupBy("video_id").agg(F.max(F.struct("similarity", (-F.col("frame")).alias("f"))).alias("best")).select("video_id", (-F.col("best.f")).alias("anchor"))


def dynamic_anchors(tokens: DataFrame, dim: int, radius: int) -> DataFrame:
    """(video_id, frame, anchor): of the frames at most ``radius`` away, itself excluded, the most
    similar by frame means (ties: earlier)."""
    frames = similarity.frame_means(tokens, dim).select("video_id", "frame", V.normalised("mean").alias("u"))
    steps = F.explode(F.array(*(F.lit(d) for d in range(-radius, radius + 1) if d)))
    near = frames.withColumn("step", steps).withColumn("anchor", F.col("frame") + F.col("step"))
    both = near.join(frames.select("video_id", F.col("frame").alias("anchor"), F.col("u").alias("v")), ["video_id", "anchor"])
    best = F.max(F.struct(V.dot("u", "v").alias("s"), (-F.col("anchor")).alias("a")))
    return both.groupBy("video_id", "frame").agg(best.alias("best")).select("video_id", "frame", (-F.col("best.a")).alias("anchor"))


def best_match(tokens: DataFrame, anchor: DataFrame, radius: int = 1) -> DataFrame:
    """(video_id, frame, pos, best, match): the most similar token of the anchor frame within the window."""
    u = tokens.select("video_id", "frame", "pos", "y", "x", V.normalised("vec").alias("u"))
    pairs = similarity.neighbours(u.join(anchor, [c for c in ("video_id", "frame") if c in anchor.columns]).where("frame != anchor"), u.select("video_id", "frame", "y", "x", "pos", F.col("u").alias("v")), radius)
    best = F.max(F.struct(V.dot("u", "v").alias("s"), (-F.col("other")).alias("o")))
    return pairs.groupBy("video_id", "frame", "pos").agg(best.alias("best")).select("video_id", "frame", "pos", F.col("best.s").alias("best"), (-F.col("best.o")).alias("match"))


def plan(tokens: DataFrame, dim: int, *, anchor: str = "auto", radius: int = 1, mode: str = "retain_ratio", threshold: float = 0.7, ratio: float = 0.25, order: str = "chronological") -> DataFrame:
    """Kept tokens (video_id, frame, pos, best, out).

    The anchor frame is kept whole.  ``threshold``: others are kept where their best similarity
    is under it.  ``retain_ratio``: others by rising similarity (ties: lower place) up to
    round-half-even(total * ratio), at least one frame.  ``out`` is the place in the output: by
    position, or (``paper``) the anchor frame first.  A video of one frame is kept whole.
    """
    if mode not in ("threshold", "retain_ratio") or order not in ("chronological", "paper"):
        raise ValueError(f"unsupported mode or order: {mode}, {order}")
    chosen = anchors(tokens, dim, anchor)
    match = best_match(tokens, chosen, radius)
    base = tokens.select("video_id", "frame", "pos").join(chosen, "video_id").join(match.drop("frame", "match"), ["video_id", "pos"], "left")
    source = F.col("frame") != F.col("anchor")
    if mode == "threshold":
        kept = base.where(~source | (F.col("best") < threshold))
    else:
        sizes = base.groupBy("video_id").agg(F.count("*").alias("total"), F.sum((~source).cast("long")).alias("whole"))
        rows = base.join(sizes, "video_id")
        rank = F.row_number().over(Window.partitionBy("video_id", source).orderBy("best", "pos"))
        rows = rows.withColumn("rank", rank).withColumn("target", budgets.half_even(F.col("total"), ratio, F.col("whole")))
        kept = rows.where(~source | (F.col("rank") <= F.col("target") - F.col("whole")))
    key = [F.when(source, 1).otherwise(0)] if order == "paper" else []
    out = (F.row_number().over(Window.partitionBy("video_id").orderBy(*key, "pos")) - 1).cast("long")
    return kept.select("video_id", "frame", "pos", "anchor", "best", out.alias("out"))


def summary(tokens: DataFrame, kept: DataFrame) -> DataFrame:
    """(video_id, anchor, kept, total, effective_threshold): the largest kept similarity of other frames."""
    totals = tokens.groupBy("video_id").agg(F.count("*").alias("total"))
    got = kept.groupBy("video_id").agg(F.first("anchor").alias("anchor"), F.count("*").alias("kept"), F.max("best").alias("effective_threshold"))
    return got.join(totals, "video_id")


def dynamic_plan(tokens: DataFrame, dim: int, *, temporal_radius: int = 2, radius: int = 1, mode: str = "retain_ratio", threshold: float = 0.7, ratio: float = 0.25) -> DataFrame:
    """Every frame has its own anchor and none is protected.  Kept tokens (video_id, frame, pos, anchor, best).

    ``threshold`` keeps the least similar token of a video where none would be left.
    """
    chosen = dynamic_anchors(tokens, dim, temporal_radius)
    match = best_match(tokens, chosen, radius).drop("match")
    rows = match.join(chosen, ["video_id", "frame"])
    alone = tokens.select("video_id", "frame", "pos").join(chosen.select("video_id").distinct(), "video_id", "left_anti")  # videos of one frame
    by = Window.partitionBy("video_id")
    rows = rows.withColumn("rank", F.row_number().over(by.orderBy("best", "pos")))
    if mode == "threshold":
        kept = rows.where((F.col("best") < threshold) | (F.col("rank") == 1))
    else:
        kept = ranking.with_total(rows, ["video_id"]).where(F.col("rank") <= budgets.half_even(F.col("total"), ratio))
    return kept.select("video_id", "frame", "pos", "anchor", "best").unionByName(alone.withColumns({"anchor": F.lit(None).cast("long"), "best": F.lit(None).cast("double")}))
