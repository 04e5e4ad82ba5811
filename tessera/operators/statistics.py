"""Rank correlation and concentration of a value within groups.

Rows are first counted by key and value, in the tasks that read them; all
that follows needs only these counts and their running sums, so a key or value
that most rows have is one row more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.cells import CELL_ROWS, largest, running


def counted(df: DataFrame, keys: list[str], value: str, most: int | None = None) -> DataFrame:
    """(…keys, value, c, below): rows of each value, and rows with a lower one.  ``most``: a bound of the rows of a key."""
    most = largest(df, keys) if most is None else most  # of the rows, so that the counts need not be made for it
    rows = df.select(*keys, value)
    return running(rows.groupBy(*keys, value).agg(F.count("*").alias("c")), keys, value, "c", "below", CELL_ROWS, most, rows)


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds 0-based ranks by rising value, ties sharing the mean of their places."""
    ranks = counted(df, keys, value).select(*(F.col(k).alias(f"{k}__") for k in keys), F.col(value).alias("value__"), (F.col("below") + (F.col("c") - 1) / 2).alias(out))
    same = F.col(value).eqNullSafe(F.col("value__"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__"))
    return df.join(ranks, same, "left").drop("value__", *(f"{k}__" for k in keys))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, out: str = "spearman", most: int | None = None) -> DataFrame:
    """(…keys, out): correlation of the average ranks; null for fewer than two rows or a constant.  Rows without one of the values do not count."""
    df = df.dropna(subset=[*dict.fromkeys([*keys, x, y])]).select(*keys, F.col(x).alias("x_"), F.col(y).alias("y_"))
    most = largest(df, keys) if most is None else most
    fewer, more = ("x_", "y_") if most <= CELL_ROWS else _by_variety(df)
    n = df.groupBy(*keys).agg(F.count("*").alias("n_"))
    # Ranks around their mean, (n - 1) / 2, so that sums of products lose no digits.
    rank = F.col("below") + (F.col("c") - 1) / 2 - (F.col("n_") - 1) / 2
    ranks = counted(df, keys, fewer, most).join(n, keys).select(*keys, fewer, "c", rank.alias("r_"))
    # Of each value of the other column only the sum of these ranks counts, so rows meet the ranks of one column alone.
    met = df.join(ranks.drop("c"), [*keys, fewer]).groupBy(*keys, more).agg(F.count("*").alias("c"), F.sum("r_").alias("sum_r"))
    others = running(met, keys, more, "c", "below", CELL_ROWS, most, df.select(*keys, more)).join(n, keys).withColumn("other", rank)
    both = others.groupBy(*keys).agg(F.sum(F.col("other") * F.col("sum_r")).alias("xy"), F.sum(F.col("c") * F.col("other") * F.col("other")).alias("yy"))
    one = ranks.groupBy(*keys).agg(F.sum(F.col("c") * F.col("r_") * F.col("r_")).alias("xx"))
    return both.join(one, keys).select(*keys, F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias(out))


def _by_variety(df: DataFrame) -> list[str]:
    """The columns x_ and y_, that of fewer values first."""
    found = df.agg(F.approx_count_distinct("x_").alias("x_"), F.approx_count_distinct("y_").alias("y_")).first()
    return sorted(["x_", "y_"], key=lambda c: found[c])


def _gini(v) -> Column:
    """From counts with their running sums: places of equal values are consecutive, so their sum is closed."""
    c, n = F.col("c"), F.col("n")
    places = c * F.col("below") + c * (c + 1) / 2
    mass = F.sum(c * v)
    return F.when(mass > 0, F.sum((2 * places - (n + 1) * c) * v) / (F.first("n") * mass)).otherwise(F.lit(0.0))


def gini(df: DataFrame, keys: list[str], value: str, out: str = "gini") -> DataFrame:
    """(…keys, out): negative values are shifted by the smallest; 0 if the sum is not positive."""
    low = df.groupBy(*keys).agg(F.least(F.min(value), F.lit(0.0)).alias("low"), F.count("*").alias("n"))
    return counted(df, keys, value).join(low, keys).groupBy(*keys).agg(_gini(F.col(value) - F.col("low")).alias(out))


def concentration(df: DataFrame, keys: list[str], value: str, index: str, time: str | None = None) -> DataFrame:
    """Per key: mass of the top 1, 5, 10 and 20 % (rounded up), normalised entropy, effective count and
    fraction, Gini, max, mean, deviation, and rank correlation with the index (and time).  Sums must be positive."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias("mass"), F.count("*").alias("n")).where("mass > 0")
    most = largest(df, keys)
    x = counted(df, keys, value, most).join(sums, keys).withColumn("p", F.col(value) / F.col("mass"))
    c, n, p = F.col("c"), F.col("n"), F.col("p")
    above = n - F.col("below") - c

    def top(share):
        """Of equal values it is all the same which are among the first."""
        most = F.greatest(F.lit(1), F.ceil(n * F.lit(share)))
        return F.sum(F.greatest(F.lit(0), F.least(c, most - above)) * p)

    tops = [top(f).alias(f"top_{int(f * 100)}pct_mass") for f in (0.01, 0.05, 0.1, 0.2)]
    safe = F.greatest("p", F.lit(1e-300))
    out = x.groupBy(*keys, "n").agg(*tops, F.sum(-c * safe * F.ln(safe)).alias("entropy"), F.max("p").alias("max"), F.sum(c * p / n).alias("mean"), F.sqrt(F.sum(c * (p - 1 / n) * (p - 1 / n) / n)).alias("std"), _gini(p).alias("gini"))
    out = out.withColumns({
        "normalized_entropy": F.when(n > 1, F.col("entropy") / F.ln(n.cast("double"))).otherwise(F.lit(0.0)),
        "effective_token_count": F.exp("entropy"),
        "effective_token_fraction": F.exp("entropy") / n,
    }).drop("entropy", "n")
    # Keys without a positive sum are not in ``out``, so they need not be left out again.
    out = out.join(spearman(df, keys, value, index, "spearman_local_index", most), keys)
    return out.join(spearman(df, keys, value, time, "spearman_temporal_index", most), keys) if time else out
