"""Runs of an order, so that rows can be numbered or summed along it in many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows (or distinct values) of a run, about.
CELL_ROWS = 1_000_000


def at_or_below(cuts: Column, value: Column, most: int) -> Column:
    """How many of the sorted ``cuts`` (at most ``most``; null: none) are at or below the value, by binary search."""
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(max(1, most.bit_length())))))
    return F.aggregate(steps, F.lit(0), lambda low, s: F.when(F.get(cuts, low + s - 1) <= value, low + s).otherwise(low))


def largest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the key that has most."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("rows_")) if keys else df.agg(F.count("*").alias("rows_"))
    return counts.agg(F.max("rows_")).first()[0] or 0


def hot_cuts(df: DataFrame, keys: list[str], order: str, rows: int, most: int) -> DataFrame:
    """(…keys, cuts_) of the keys of more than ``rows`` rows.  Made here and now, so that all that goes by them has the same."""
    n = -(-most // rows)
    cuts = F.array_sort(F.array_distinct(F.percentile_approx(order, [i / n for i in range(1, n)], max(10_000, 20 * n)))).alias("cuts_")
    hot = df.groupBy(*keys).agg(F.count("*").alias("rows_"), cuts).where(F.col("rows_") > rows).drop("rows_")
    return df.sparkSession.createDataFrame(hot.toArrow(), hot.schema)


def dealt(df: DataFrame, keys: list[str], order: str, out: str, rows: int = CELL_ROWS, most: int | None = None) -> DataFrame:
    """``df`` with ``out``: the run of the row within its key, by quantiles of ``order``.

    ``most``: a bound of the rows of a key, where it is known.  Only keys of more than ``rows`` rows have several runs; they are at most as many as
    the whole table holds times ``rows``, so their cuts are broadcast.  Equal values are of one run.
    """
    most = largest(df, keys) if most is None else most
    if most <= rows:
        return df.withColumn(out, F.lit(0))
    hot = hot_cuts(df, keys, order, rows, most)
    if not keys:
        found = next((r.cuts_ for r in hot.collect()), None) or []
        return df.withColumn(out, at_or_below(F.array(*(F.lit(c) for c in found)), F.col(order), -(-most // rows)))
    return df.join(F.broadcast(hot), keys, "left").withColumn(out, at_or_below(F.col("cuts_"), F.col(order), -(-most // rows))).drop("cuts_")


def running(df: DataFrame, keys: list[str], order: str, weight: str, out: str, rows: int = CELL_ROWS, most: int | None = None, source: DataFrame | None = None) -> DataFrame:
    """``df`` (one row for each key and value of ``order``) with ``out``: the sum of ``weight`` over lower values.

    ``source``: the rows that ``weight`` counts, where it does.  Cuts and sums of the runs then come from reading these, and ``df`` is made once.
    """
    source = df if source is None else source.withColumn(weight, F.lit(1).cast("long"))
    most = largest(source, keys) if most is None else most
    below = lambda *by: F.coalesce(F.sum(weight).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if most <= rows:
        return df.withColumn(out, below(*keys))
    hot = hot_cuts(source, keys, order, rows, most)
    cell = at_or_below(F.col("cuts_"), F.col(order), -(-most // rows))
    join = lambda x, how: x.join(F.broadcast(hot), keys, how) if keys else x.crossJoin(F.broadcast(hot))
    sums = join(source, "inner").groupBy(*keys, cell.alias("cell_")).agg(F.sum(weight).alias("sum_"))
    before = F.coalesce(F.sum("sum_").over(Window.partitionBy(*keys).orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = join(df, "left").withColumn("cell_", cell).drop("cuts_")
    x = x.join(F.broadcast(sums.select(*keys, "cell_", before.alias("before_"))), [*keys, "cell_"], "left")
    return x.withColumn(out, F.coalesce("before_", F.lit(0)) + below(*keys, "cell_")).select(*df.columns, out)
