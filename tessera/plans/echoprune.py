"""Query-aware pruning: relevance less what the previous frame already tells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import budgets
from tessera.operators import ranking, similarity


def scores(tokens: DataFrame, query_tokens: DataFrame, *, temperature: float = 0.1, radius: int | None = None) -> DataFrame:
    """(video_id, frame, pos, relevance, correlation, echo, score)."""
    key = ["video_id", "pos"]
    out = similarity.relevance(tokens, query_tokens)
    out = out.join(similarity.same_place_before(tokens), key)
    out = out.join(similarity.temporal_echo(tokens, temperature, radius).drop("frame"), key)
    return out.withColumn("score", F.col("relevance") - F.col("correlation") - F.col("echo"))


def plan(scored: DataFrame, *, ratio: float | None = None, target: int | None = None, policy: str = "paper") -> DataFrame:
    """Kept tokens (video_id, frame, pos).

    ``paper``: frame 0 has a quota of min(N, B, max(1, B div T)) by relevance, other frames the rest by
    score, and frame 0 fills up what they cannot.  ``global``: all by score, frame 0's being its
    relevance.  One frame alone goes by relevance.
    """
    by = ["video_id"]
    sizes = scored.groupBy(*by).agg(F.count("*").alias("total"), F.count_distinct("frame").alias("frames"), F.sum((F.col("frame") == 0).cast("long")).alias("first"))
    x = scored.join(sizes, by).withColumn("budget", budgets.explicit_or_ratio(F.col("total"), target, ratio if ratio is not None else 1.0))
    early = F.col("frame") == 0
    x = x.withColumn("value", F.when(early, F.col("relevance")).otherwise(F.col("score")))
    if policy == "global":
        return ranking.top_k(x, by, F.col("value"), F.col("budget")).select("video_id", "frame", "pos")
    if policy != "paper":
        raise ValueError(f"unsupported policy: {policy}")
    quota = F.least(F.col("first"), F.col("budget"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("budget") / F.col("frames"))))
    later = F.least(F.col("budget") - quota, F.col("total") - F.col("first"))
    x = x.withColumn("part", early.cast("int")).withColumn("k", F.when(early, F.col("budget") - later).otherwise(later))
    return ranking.top_k(x, ["video_id", "part"], F.col("value"), F.col("k")).select("video_id", "frame", "pos")
