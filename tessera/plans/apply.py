"""Applying a selection to the tokens themselves, and to further layers of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gather(tokens: DataFrame, plan: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The rows of ``tokens`` that the plan keeps, with their place ``out`` in the result.

    The plan's own ``out`` counts if it has one, else the order of positions.  Deep layers are
    further columns of the same rows, so one join serves them all; ``columns`` picks some.
    """
    if "out" not in plan.columns:
        plan = plan.withColumn("out", (F.row_number().over(Window.partitionBy("video_id").orderBy("pos")) - 1).cast("long"))
    return tokens.select("video_id", "pos", *(columns or [c for c in tokens.columns if c not in ("video_id", "pos")])).join(plan.select("video_id", "pos", "out"), ["video_id", "pos"])


def positions(dense: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (video_id, flat, …) of dense positions that the plan keeps."""
    return dense.join(plan.select("video_id", F.col("pos").alias("flat")), ["video_id", "flat"], "left_semi")


def kept_per_frame(tokens: DataFrame, plan: DataFrame) -> DataFrame:
    """(video_id, frame, kept) for every frame, zeros included."""
    frames = tokens.select("video_id", "frame").distinct()
    return frames.join(plan.groupBy("video_id", "frame").agg(F.count("*").alias("kept")), ["video_id", "frame"], "left").fillna(0, ["kept"])
