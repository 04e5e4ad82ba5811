"""Ranked and random selections.  Ties always go to the lower index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import budgets


def top_k(df: DataFrame, keys: list[str], score: Column, k, ties: str = "pos", largest: bool = True) -> DataFrame:
    """The ``k`` (a number or column) best rows of each key, with ``rank`` from 1."""
    order = [score.desc_nulls_last() if largest else score.asc_nulls_last(), F.col(ties)]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def with_total(df: DataFrame, keys: list[str], name: str = "total") -> DataFrame:
    """Rows per key beside each row; the counts are aggregated first, so only they are joined."""
    return df.join(df.groupBy(*keys).agg(F.count("*").alias(name)), keys)


def ranked_set(df: DataFrame, keys: list[str], score: str, ratio: float, condition: str = "top", ties: str = "pos") -> DataFrame:
    """Top or bottom share of each key, rounded half up, at least one."""
    if condition not in ("top", "bottom"):
        raise ValueError(f"condition must be top or bottom, got {condition}")
    return top_k(with_total(df, keys), keys, F.col(score), budgets.half_up(F.col("total"), ratio), ties, condition == "top").drop("total", "rank")


def keep_by_score(df: DataFrame, keys: list[str], score: str, ratio: float, policy: str = "high", ties: str = "pos") -> DataFrame:
    """High or low scores up to floor(total * ratio)."""
    if policy not in ("high", "top", "low", "bottom"):
        raise ValueError(f"unsupported keep policy: {policy}")
    return top_k(with_total(df, keys), keys, F.col(score), budgets.floored(F.col("total"), ratio), ties, policy in ("high", "top")).drop("total", "rank")


def random_order(seed, *columns) -> Column:
    """A reproducible order that looks random: the hash of the seed and the columns."""
    return F.xxhash64(F.lit(str(seed)), *columns)


def random_global(df: DataFrame, keys: list[str], ratio: float, seed=0, ties: str = "pos") -> DataFrame:
    """A random share of each key, half up, the same for the same seed."""
    return top_k(with_total(df, keys), keys, random_order(seed, *keys, ties), budgets.half_up(F.col("total"), ratio), ties).drop("total", "rank")


def random_matched(df: DataFrame, top: DataFrame, keys: list[str], time: str, seed=0, ties: str = "pos") -> DataFrame:
    """A random set with as many rows of each time as ``top`` has."""
    wanted = top.groupBy(*keys, time).agg(F.count("*").alias("wanted"))
    return top_k(df.join(wanted, [*keys, time]), [*keys, time], random_order(seed, *keys, ties), F.col("wanted"), ties).drop("wanted", "rank")


def selection_sets(df: DataFrame, keys: list[str], scores: list[str], ratios: list[float], time: str, seed=0, repeats: int = 1, ties: str = "pos") -> DataFrame:
    """All sets: score x ratio x (top, bottom, random_global, random_matched), one row per selected row."""
    out = None
    for score in scores:
        for ratio in ratios:
            top = ranked_set(df, keys, score, ratio, "top", ties)
            sets = [("top", 0, top), ("bottom", 0, ranked_set(df, keys, score, ratio, "bottom", ties))]
            for r in range(repeats):
                sets.append(("random_global", r, random_global(df, keys, ratio, f"{seed}|{score}|{ratio}|{r}", ties)))
                sets.append(("random_matched", r, random_matched(df, top, keys, time, f"{seed}|{score}|{ratio}|{r}|m", ties)))
            for condition, r, rows in sets:
                part = rows.select(*keys, time, ties, F.lit(score).alias("score_type"), F.lit(float(ratio)).alias("ratio"), F.lit(condition).alias("condition"), F.lit(r).cast("long").alias("repeat"))
                out = part if out is None else out.unionByName(part)
    return out


def exact_counts(df: DataFrame, keys: list[str], index: str, size: str, target: Column) -> DataFrame:
    """Largest-remainder shares of ``target`` by ``size``, ties to the lower index: adds ``count``."""
    whole = df.groupBy(*keys).agg(F.sum(size).alias("whole"))
    raw = df.join(whole, keys).withColumn("target", F.greatest(F.lit(0), F.least(target, F.col("whole"))).cast("long"))
    raw = raw.withColumn("raw", F.when(F.col("whole") > 0, F.col("target") * (F.col(size) / F.col("whole"))).otherwise(F.lit(0.0))).withColumn("floor", F.least(F.col(size), F.floor("raw")))
    spare = raw.groupBy(*keys).agg((F.first("target") - F.sum("floor")).alias("spare"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy((F.col("raw") - F.col("floor")).desc(), index))
    out = raw.join(spare, keys).withColumn("rank", rank)
    return out.withColumn("count", (F.col("floor") + F.when(F.col("rank") <= F.col("spare"), 1).otherwise(0)).cast("long")).drop("whole", "raw", "floor", "spare", "rank", "target")


def per_frame_allocation(df: DataFrame, weight: str, total: Column, min_k: int, max_k: Column) -> DataFrame:
    """Shares of a budget by weight (video_id, frame): adds ``k``.

    Each frame first gets ``min_k`` (if the budget affords that for all), then the
    whole part of its share of the rest, at most ``max_k``.  What is left
    goes to the frames by largest fraction, each filled up before the next.
    """
    by = ["video_id"]
    sums = df.groupBy(*by).agg(F.count("*").alias("frames"), F.sum(F.greatest(F.col(weight), F.lit(0.0))).alias("mass"))
    x = df.join(sums, by).withColumn("max_k", max_k.cast("long")).withColumn("least", F.least(F.lit(min_k).cast("long"), F.col("max_k")))
    x = x.withColumn("all", F.greatest(F.lit(0).cast("long"), F.least(total.cast("long"), F.col("frames") * F.col("max_k"))))
    x = x.withColumn("least", F.when(F.col("all") >= F.col("frames") * F.col("least"), F.col("least")).otherwise(F.lit(0).cast("long")))
    share = F.when(F.col("mass") > 0, F.greatest(F.col(weight), F.lit(0.0)) / F.greatest(F.col("mass"), F.lit(1e-6))).otherwise(F.lit(1.0) / F.greatest(F.col("frames"), F.lit(1)))
    x = x.withColumn("raw", share * (F.col("all") - F.col("frames") * F.col("least")))
    x = x.withColumn("got", F.col("least") + F.least(F.floor("raw"), F.col("max_k") - F.col("least")))
    x = x.withColumn("room", F.col("max_k") - F.col("got"))
    left = x.groupBy(*by).agg((F.first("all") - F.sum("got")).alias("left"))
    order = Window.partitionBy(*by).orderBy(F.when(F.col("room") > 0, F.col("raw") - F.floor("raw")).otherwise(F.lit(-1.0)).desc(), "frame")
    x = x.join(left, by).withColumn("before", F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    k = F.col("got") + F.least(F.col("room"), F.greatest(F.lit(0).cast("long"), F.col("left") - F.col("before")))
    return x.select(*df.columns, k.cast("long").alias("k"))


def inclusion_probabilities(df: DataFrame, weight: str, budget: Column) -> DataFrame:
    """Adds ``pi``: probabilities in proportion to the weight, capped at 1 and the excess dealt on, that sum to the budget.

    Sorted by falling weight, the first m rows are capped, for the smallest m at
    which the next one's share of what is left is under 1; running sums find m.
    """
    by = Window.partitionBy("video_id").orderBy(F.desc(weight), "pos")
    x = df.withColumn("budget", budget.cast("long")).withColumn("i", F.row_number().over(by) - 1)
    x = x.withColumn("rest", F.sum(weight).over(Window.partitionBy("video_id").orderBy(weight, F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("budget") - F.col("i")) * F.col(weight) / F.col("rest") < 1 - 1e-10
    m = x.groupBy("video_id").agg(F.min(F.when(fits, F.struct("i", "rest"))).alias("m"), F.count("*").alias("n"))
    x = x.join(m, "video_id")
    pi = F.when(F.col("budget") <= 0, 0.0).when((F.col("budget") >= F.col("n")) | F.col("m").isNull() | (F.col("i") < F.col("m.i")), F.when(F.col("i") < F.col("budget"), 1.0).otherwise(0.0))
    return x.withColumn("pi", pi.otherwise((F.col("budget") - F.col("m.i")) * F.col(weight) / F.col("m.rest"))).drop("budget", "i", "rest", "m", "n")
