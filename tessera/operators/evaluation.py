"""Scoring of answers and accuracy by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

GROUPS = ("domain", "sub_category", "task_category", "duration")


def scored(rows: DataFrame) -> DataFrame:
    """Rows (prediction, choices, answer) with ``extracted`` and ``hit``; what no rule settles is ``unresolved`` and no hit."""
    extracted = F.coalesce(T.infer(F.col("prediction"), F.col("choices")), F.lit("unresolved"))
    return rows.withColumn("extracted", extracted).withColumn("hit", (F.col("extracted") == F.col("answer")).cast("long"))


def normalised_fields(rows: DataFrame) -> DataFrame:
    """Groups that are missing are filled from their stand-ins: domain from category, task_category from task_type, then sub_category."""
    has = set(rows.columns)
    pick = lambda names, last: F.coalesce(*(F.col(c) for c in names if c in has), F.lit(last))
    return rows.withColumns({"domain": pick(("domain", "category"), "unknown"), "task_category": pick(("task_category", "task_type", "sub_category"), "unknown")})


def accuracy(rows: DataFrame, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """(level, value, n, accuracy): overall, and by each group, in one pass over the rows."""
    sets = [[], *([F.col(g)] for g in groups)]
    level = F.lit("overall")
    for g in groups:
        level = F.when(F.grouping(g) == 0, F.lit(g)).otherwise(level)
    out = rows.groupingSets(sets, *(F.col(g) for g in groups)).agg(level.alias("level"), F.count("*").alias("n"), F.avg("hit").alias("accuracy"))
    return out.select("level", F.coalesce(*(F.col(g).cast("string") for g in groups), F.lit("")).alias("value"), "n", "accuracy")


def throughput(seconds: float, samples: int) -> dict[str, float | None]:
    """Total seconds, seconds a sample, samples a second; null where there is nothing to divide by."""
    return {"total_s": seconds, "s_per_sample": seconds / samples if samples else None, "samples_per_s": samples / seconds if seconds > 0 else None}
