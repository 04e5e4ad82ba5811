"""Two-level means, paired differences and bootstrap intervals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dense


def two_level_mean(df: DataFrame, sample: list[str], group: list[str], value: str) -> DataFrame:
    """Repeats are averaged per sample first, then samples per group: (…group, n, mean).  ``group`` is part of ``sample``."""
    per = df.groupBy(*sample).agg(F.avg(value).alias("v"))
    return per.groupBy(*group).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def paired_differences(df: DataFrame, sample: list[str], condition: str, a, b, value: str) -> DataFrame:
    """(…sample, diff): mean under ``a`` minus mean under ``b``, of samples that have both."""
    pick = lambda c: F.avg(F.when(F.col(condition) == F.lit(c), F.col(value)))
    x = df.where(F.col(condition).isin(a, b)).groupBy(*sample).agg(pick(a).alias("a"), pick(b).alias("b"))
    return x.where("a is not null and b is not null").select(*sample, (F.col("a") - F.col("b")).alias("diff"))


#: Values of a key that are drawn from in one task.
CELL_ROWS = 1_000_000


def bootstrap_interval(df: DataFrame, keys: list[str], value: str, *, resamples: int = 2000, seed: int = 3407, alpha: float = 0.05, order: list[str] | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(…keys, n, mean, low, high): percentile interval of the mean over resamples with replacement.

    Null and infinite values do not count.  Up to ``cell_rows`` values of a key are drawn from as one
    array, in the order of ``order`` (else of the values), by one generator of the seed.  A larger key is
    dealt to cells by the hash of the values and ``order``: how many draws of a resample fall to each cell is
    multinomial, from the seed and the resample, and each cell draws its own.  Neither depends on partitions.
    """
    clean = df.select(*dict.fromkeys([*keys, *(order or [])]), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v) and abs(v) != double('inf')")
    sizes = clean.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    x = clean.join(sizes.select(*keys, F.ceil(F.col("n") / cell_rows).cast("long").alias("cells")), keys).withColumn("cell", F.pmod(F.xxhash64("v", *(order or [])), F.col("cells")))
    counts = x.groupBy(*keys, "cell").agg(F.count("*").alias("m")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cell", "m"))).alias("sizes"))
    x = x.join(counts.select(*keys, F.col("sizes.cell").alias("ids"), F.col("sizes.m").alias("sizes")), keys)

    def draw(t):
        v, ids, m = t["v"], t["ids"][0].astype(np.int64), t["sizes"][0].astype(np.int64)
        rng = np.random.default_rng(seed if len(m) == 1 else [seed, int(t["cell"][0])])
        sums = np.empty(resamples)
        for i in range(resamples):
            here = len(v)
            if len(m) > 1:
                here = int(np.random.default_rng([seed, i]).multinomial(m.sum(), m / m.sum())[np.searchsorted(ids, t["cell"][0])])
            sums[i] = rng.choice(v, size=here, replace=True).sum()
        return {"sums": [sums.tolist()]}

    def close(t):
        means = t["sums"].sum(0) / t["n"][0]
        return {"low": [float(np.percentile(means, 100 * alpha / 2))], "high": [float(np.percentile(means, 100 * (1 - alpha / 2)))]}

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.select(*keys).schema.fields)
    drawn = dense.per_key(x, [*keys, "cell"], order or ["v"], draw, f"{ddl}, cell long, sums array<double>")
    ends = dense.per_key(drawn.join(sizes.select(*keys, "n"), keys), keys, ["cell"], close, f"{ddl}, low double, high double")
    return sizes.join(ends, keys)
