"""Choosing and ordering samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.cells import CELL_ROWS, dealt


def samples(df: DataFrame, order: str, *, ids: DataFrame | None = None, id_column: str | None = None, shards: int = 1, shard: int = 0, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Allow-list, then shard by place modulo ``shards``, then offset, then limit: each counts what the one before left.

    Places are global; they are numbered within ranges and shifted by the counts of the earlier
    ranges, so no task holds all rows.
    """
    if not 0 <= shard < shards:
        raise ValueError(f"shard {shard} of {shards}")
    if ids is not None:
        df = df.join(ids.select(F.col(ids.columns[0]).alias(id_column)).distinct(), id_column, "left_semi")
    # Of the numbered rows those from first to last, step by step.
    first = shard + offset * shards
    out = numbered(df, order, "place").where((F.col("place") % shards == shard) & (F.col("place") >= first))
    return (out if limit is None else out.where(F.col("place") < first + limit * shards)).drop("place")


def numbered(df: DataFrame, order: str, out: str, rows: int = CELL_ROWS) -> DataFrame:
    """Adds the place of each row by ``order``, from 0.  Rows are dealt by quantiles, about ``rows`` together;
    only rows of one value must meet."""
    x = dealt(df, [], order, "cell_", rows)
    sizes = x.groupBy("cell_").agg(F.count("*").alias("rows_"))
    before = sizes.select("cell_", F.coalesce(F.sum("rows_").over(Window.orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    x = x.join(before, "cell_")
    place = F.row_number().over(Window.partitionBy("cell_").orderBy(order)) - 1 + F.col("before_")
    return x.withColumn(out, place.cast("long")).drop("cell_", "before_")


def high_confidence(rows: DataFrame, k: int, require_correct: bool = False) -> DataFrame:
    """The ``k`` most confident parsed answers: confidence = exp(min(0, logprob)); ties by logprob, then question id."""
    lp = F.col("logprob")
    ok = ~F.coalesce("skip", F.lit(False)) & (F.col("parse_status") == "ok") & lp.isNotNull() & ~F.isnan(lp) & (F.abs(lp) != float("inf"))
    if require_correct:
        ok = ok & F.coalesce("correct", F.lit(False))
    return rows.where(ok).withColumn("confidence", F.exp(F.least(F.lit(0.0), lp))).orderBy(F.desc("confidence"), F.desc("logprob"), "question_id").limit(k)


def first_distinct(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first ``n`` distinct keys in order of first appearance."""
    return rows.groupBy(key).agg(F.min(order).alias("first")).orderBy("first").limit(n).select(key)


def layer_range(layers: int, start: int | None = None, end: int | None = None, stride: int = 1) -> list[int]:
    """Middle third of the layers by default, at least one layer."""
    low = layers // 3 if start is None else max(0, start)
    high = 2 * layers // 3 if end is None else min(layers, end)
    return list(range(low, max(high, low + 1), max(1, stride)))


def unfinished(samples_: DataFrame, results: DataFrame, key: str = "question_id") -> DataFrame:
    """Samples without a result yet."""
    return samples_.join(results.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
