"""How far two selections of the same tokens agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap(a: DataFrame, b: DataFrame, totals: DataFrame, keys: list[str], index: str = "pos") -> DataFrame:
    """Per key of ``totals`` (…keys, n): sizes, intersection, shares, IoU, expected overlap a*b/n, enrichment over
    it and overlap normalised to the largest possible.  Null where a denominator is not positive."""
    mark = lambda d, c: d.select(*keys, index).distinct().withColumn(c, F.lit(1))
    both = mark(a, "in_a").join(mark(b, "in_b"), [*keys, index], "full")
    got = both.groupBy(*keys).agg(F.count("in_a").alias("a"), F.count("in_b").alias("b"), F.count(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1)).alias("both"))
    x = totals.join(got, keys, "left").fillna(0, ["a", "b", "both"])
    over = lambda p, q: F.when(q > 0, p / q)
    n, sa, sb, hit = (F.col(c).cast("double") for c in ("n", "a", "b", "both"))
    expected = over(sa * sb, n)
    mine = over(hit, sa)
    room = F.least(sa, sb) - expected
    return x.select(
        *keys, F.col("n").alias("dense_token_count"), F.col("a").alias("a_count"), F.col("b").alias("b_count"), F.col("both").alias("overlap_count"),
        mine.alias("a_overlap_fraction"), over(hit, sb).alias("b_overlap_fraction"), over(hit, sa + sb - hit).alias("iou"), expected.alias("expected_overlap_count"),
        over(sb, n).alias("expected_fraction"), over(mine, over(sb, n)).alias("enrichment"), over(hit - expected, room).alias("normalized_overlap"),
    )


def finite_mean(c: str):
    """Aggregate: the mean of the finite values."""
    x = F.col(c).cast("double")
    return F.avg(F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))


def summary(records: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: rows, distinct questions, and finite means of the measures."""
    measures = ["a_overlap_fraction", "b_overlap_fraction", "iou", "enrichment", "normalized_overlap"]
    return records.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct("video_id").alias("unique_questions"), *(finite_mean(c).alias(f"mean_{c}") for c in measures))


def missing(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Combinations that were expected but not found."""
    return expected.select(*keys).distinct().join(found.select(*keys).distinct(), keys, "left_anti")


def compared(dumps: DataFrame, references: DataFrame, totals: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overlap records of every method with every reference set, and the ledger of what could not be compared.

    ``dumps``: video_id, method, drop_ratio, dense_token_count, drop_indices; ``references``: video_id, kind,
    drop_ratio, pos; ``totals``: video_id, n; ``methods``: method, drop_ratio.  Ledger: video_id, method,
    drop_ratio, reason (``missing``, or ``count mismatch`` where a dump is of another number of tokens).
    """
    want = totals.crossJoin(F.broadcast(methods.distinct()))  # the few methods and ratios of a run
    x = want.join(dumps.select("video_id", "method", "drop_ratio", "dense_token_count", "drop_indices"), ["video_id", "method", "drop_ratio"], "left")
    reason = F.when(F.col("dense_token_count").isNull(), "missing").when(F.col("dense_token_count") != F.col("n"), "count mismatch")
    x = x.withColumn("reason", reason)
    ledger = x.where("reason is not null").select("video_id", "method", "drop_ratio", "reason")
    keys = ["video_id", "method", "drop_ratio", "kind"]
    good = x.where("reason is null").join(references.select("video_id", "kind", "drop_ratio").distinct(), ["video_id", "drop_ratio"])
    a = good.select(*keys, F.explode("drop_indices").alias("pos")).withColumn("pos", F.col("pos").cast("long"))
    b = good.select(*keys).join(references, ["video_id", "kind", "drop_ratio"]).select(*keys, "pos")
    return overlap(a, b, good.select(*keys, "n"), keys), ledger


def strict(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """The records; any row of the ledger raises."""
    n = ledger.count()
    if n:
        raise ValueError(f"missing or mismatched dumps: {n}")
    return records


def write_comparison(records: DataFrame, ledger: DataFrame, path: str) -> None:
    """Records as JSON lines, their summary as CSV, the ledger as JSON lines."""
    records.write.mode("overwrite").json(f"{path}/overlap_records")
    summary(records, ["method", "drop_ratio", "kind"]).write.mode("overwrite").option("header", True).csv(f"{path}/overlap_summary")
    ledger.write.mode("overwrite").json(f"{path}/ledger")


def reference_set(scores: DataFrame, stored: DataFrame, ratio: float, condition: str = "top", half_up: bool = False) -> DataFrame:
    """(video_id, pos): the stored set of a video, else one recomputed from the scores.

    Rounding is half to even, or ``half_up`` as in the ranked sets.
    """
    from tessera.functions import budgets

    from . import ranking

    fresh = scores.join(stored.select("video_id").distinct(), "video_id", "left_anti")
    k = (budgets.half_up if half_up else budgets.half_even)(F.col("total"), ratio)
    got = ranking.top_k(ranking.with_total(fresh, ["video_id"]), ["video_id"], F.col("score"), k, largest=condition == "top")
    return stored.select("video_id", "pos").unionByName(got.select("video_id", "pos"))
