"""Coverage-driven selection: tokens that best cover the query and the video itself."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import budgets
from tessera.operators import dense

EPS = 1e-8
#: Up to so many tokens of a video are selected by the exact greedy rule, more by the sampled one.
EXACT_MOST = 1024


def log_normalisers(targets: DataFrame, tokens: DataFrame, temperature: float) -> DataFrame:
    """(video_id, qpos, logz) of target rows (video_id, qpos, vec) over all tokens of the video."""
    f = lambda q, t: {"qpos": q["qpos"], "logz": dense.log_normaliser(dense.unit(q["vec"], EPS), dense.unit(t["vec"], EPS), temperature)}
    return dense.per_pair(targets.select("video_id", "qpos", "vec"), tokens.select("video_id", "pos", "vec"), ["video_id"], (["qpos"], ["pos"]), f, "video_id long, qpos long, logz double")


def text_probabilities(queries: DataFrame, tokens: DataFrame, temperature: float) -> DataFrame:
    """(video_id, qpos, pos, p): softmax over the tokens of a video of the cosines to each query row."""

    def f(q, t):
        p = dense.softmax(dense.unit(q["vec"], EPS), dense.unit(t["vec"], EPS), temperature)
        return {"qpos": np.repeat(q["qpos"], len(t["pos"])), "pos": np.tile(t["pos"], len(q["qpos"])), "p": p.ravel()}

    return dense.per_pair(queries.select("video_id", "qpos", "vec"), tokens.select("video_id", "pos", "vec"), ["video_id"], (["qpos"], ["pos"]), f, "video_id long, qpos long, pos long, p double")


def diagnostics(p: DataFrame) -> DataFrame:
    """Of rows of probabilities (video_id, qpos, pos, p): mean entropy, its share of the largest
    possible, effective support, mean largest and mean sum of the five largest."""
    rank = F.row_number().over(Window.partitionBy("video_id", "qpos").orderBy(F.desc("p"), "pos"))
    x = p.withColumn("rank", rank)
    rows = x.groupBy("video_id", "qpos").agg(
        F.sum(-F.col("p") * F.ln(F.greatest("p", F.lit(1e-45)))).alias("entropy"), F.count("*").alias("n"), F.max("p").alias("top1"), F.sum(F.when(F.col("rank") <= 5, F.col("p"))).alias("top5")
    )
    return rows.groupBy("video_id").agg(
        F.avg("entropy").alias("entropy_mean"),
        F.avg(F.col("entropy") / F.ln(F.greatest(F.col("n"), F.lit(2)).cast("double"))).alias("entropy_norm"),
        F.avg(F.exp("entropy")).alias("effective_support"),
        F.avg(F.exp("entropy") / F.col("n")).alias("support_ratio"),
        F.avg("top1").alias("top1"),
        F.avg("top5").alias("top5_mass"),
    )


def coreset(videos: DataFrame, target: int) -> DataFrame:
    """(video_id, pos, weight): rows that stand for a video (video_id, t, n tokens per frame).

    Frames are split into min(t, target) bins, the first ones larger; bins get at least one row and
    else the whole part of their share, then one more by largest deficit (ties: earlier).  A bin's
    tokens are split likewise, and the middle of each part has its share of all tokens as weight.
    """
    x = videos.withColumn("total", F.col("t") * F.col("n")).withColumn("u", F.greatest(F.lit(1), F.least(F.lit(target), F.col("total"))).cast("long")).withColumn("bins", F.least("t", "u"))
    b = x.where("total > 0").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)))
    large, size = F.col("t") % F.col("bins"), F.floor(F.col("t") / F.col("bins"))
    b = b.withColumn("first", F.col("bin") * size + F.least(F.col("bin"), large)).withColumn("frames", size + (F.col("bin") < large).cast("long"))
    b = b.withColumn("raw", F.col("frames") * F.col("n") / F.col("total") * F.col("u")).withColumn("base", F.greatest(F.lit(1).cast("long"), F.floor("raw")))
    by = Window.partitionBy("video_id")
    b = b.withColumn("spare", F.col("u") - F.sum("base").over(by)).withColumn("rank", F.row_number().over(by.orderBy((F.col("raw") - F.col("base")).desc(), "bin")))
    b = b.withColumn("count", F.col("base") + (F.col("rank") <= F.col("spare")).cast("long"))
    p = b.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    tokens = F.col("frames") * F.col("n")
    more, each = tokens % F.col("count"), F.floor(tokens / F.col("count"))
    start = F.col("first") * F.col("n") + F.col("part") * each + F.least(F.col("part"), more)
    length = each + (F.col("part") < more).cast("long")
    return p.select("video_id", (start + F.floor((length - 1) / 2)).cast("long").alias("pos"), (length / F.col("total")).alias("weight"))


def greedy_exact(coverage: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns in the order taken, each with the largest gain in the sum of row maxima (ties: first), and that sum so far."""
    best, taken, trace = np.zeros(len(coverage)), [], []
    free = np.ones(coverage.shape[1], bool)
    for _ in range(min(budget, coverage.shape[1])):
        gain = np.where(free, np.maximum(coverage - best[:, None], 0).sum(0), -1.0)
        j = int(np.argmax(gain))
        taken.append(j)
        free[j] = False
        best = np.maximum(best, coverage[:, j])
        trace.append(best.sum())
    return np.array(taken, int), np.array(trace)


#: Entries of a coverage matrix that are held at once.
HELD = 1 << 22


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each set of equal rows, rising, and for each row the number of its set."""
    x = np.ascontiguousarray(x + 0.0)  # one zero
    _, first, of = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    order = np.argsort(first)
    return first[order], np.argsort(order)[of.ravel()]


def greedy_streamed(tokens: np.ndarray, targets: np.ndarray, temperature: np.ndarray, weight: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """As greedy_exact, of the coverage weight * softmax(target . token / temperature) of unit vectors, which is never held whole.

    The gain of every token is kept up to date: a token that is taken raises the maxima of some rows, of about one in k at
    step k, and only these rows are made again, ``HELD`` entries at a time.  Sums of differences may be off in the last digits, so gains that
    are about the largest are summed anew before one is taken.  Equal tokens are one column, of which the first is taken and
    the others then gain nothing; equal rows are one with the sum of their weights.
    """
    first, of = _distinct(tokens)
    u, copies, n = tokens[first], np.bincount(of).astype(float), len(tokens)
    targets, temperature, weight = (x[weight > 0] for x in (targets, temperature, weight))
    scaled = targets / temperature[:, None]
    some, same = _distinct(scaled)
    a, weight = scaled[some], np.bincount(same, weight, len(some))
    step, wide = max(1, HELD // len(u)), max(1, HELD // max(1, len(a)))
    shift, gain = np.empty(len(a)), np.zeros(len(u))  # the coverage is exp(a . u + shift)
    for s in (slice(k, k + step) for k in range(0, len(a), step)):
        x = a[s] @ u.T
        top = x.max(1)
        x -= top[:, None]
        np.exp(x, out=x)
        share = weight[s] / (x @ copies)
        gain += share @ x
        shift[s] = np.log(share) - top
    level, best = np.full(len(a), -np.inf), np.zeros(len(a))
    near_by, done, free = 1e-11 * gain.max(), np.zeros(len(u), bool), np.ones(n, bool)
    taken, trace, unused = [], [], 0
    for _ in range(min(budget, n)):
        near = np.flatnonzero(~done & (gain >= gain.max() - near_by))
        while len(near) > 1 or len(near) and gain[near[0]] <= near_by:
            for k in range(0, len(near), wide):
                c = near[k : k + wide]
                gain[c] = np.maximum(np.exp(a @ u[c].T + shift[:, None]) - best[:, None], 0).sum(0)
            done[near] = gain[near] <= 0
            gain[done] = -np.inf
            if not done[near].all():
                near = near[np.argmax(gain[near])][None]
                break
            near = np.flatnonzero(~done & (gain >= gain.max() - near_by))
        if len(near):
            c, j = near[0], first[near[0]]
            now = a @ u[c]
            raised = np.flatnonzero(now > level)
            after = np.exp(now[raised] + shift[raised])
            for k in range(0, len(raised), step):
                rows = raised[k : k + step]
                x = a[rows] @ u.T
                at = np.flatnonzero(x > level[rows, None])
                if 8 * len(at) < x.size:
                    row, column = np.divmod(at, len(u))
                    more = np.exp(np.minimum(x.ravel()[at], now[rows][row]) + shift[rows][row]) - best[rows][row]
                    gain -= np.bincount(column, more, len(u))
                else:
                    np.clip(x, level[rows, None], now[rows, None], out=x)
                    x += shift[rows, None]
                    gain -= np.exp(x, out=x).sum(0) - best[rows].sum()
            level[raised], best[raised] = now[raised], after
            done[c], gain[c] = True, -np.inf
        else:  # nothing gains: the first that is left
            unused += int(np.argmax(free[unused:]))
            j = unused
        free[j] = False
        taken.append(int(j))
        trace.append(best.sum())
    return np.array(taken, int), np.array(trace)


def greedy_sampled(coverage: np.ndarray, budget: int, rng: np.random.Generator, epsilon: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """As greedy_exact, with only ceil(n / budget * ln(1 / epsilon)) random candidates each time."""
    n = coverage.shape[1]
    size = max(1, math.ceil(n / max(1, budget) * math.log(1 / epsilon)))
    best, taken, trace, free = np.zeros(len(coverage)), [], [], np.arange(n)
    for _ in range(min(budget, n)):
        some = np.sort(rng.choice(free, min(size, len(free)), replace=False))
        j = int(some[np.argmax(np.maximum(coverage[:, some] - best[:, None], 0).sum(0))])
        taken.append(j)
        free = free[free != j]
        best = np.maximum(best, coverage[:, j])
        trace.append(best.sum())
    return np.array(taken, int), np.array(trace)


def adaptive_temperature(tokens: DataFrame, queries: DataFrame, targets: DataFrame, candidates: list[float], text_temperature: float) -> DataFrame:
    """(video_id, text_peak, tau, gap): the vision temperature whose weighted second-largest probability is
    closest to the mean largest text probability (ties within 1e-12: the smaller)."""
    core = tokens.join(targets, ["video_id", "pos"]).select("video_id", F.col("pos").alias("qpos"), "vec", "weight")
    peak = text_probabilities(queries, tokens, text_temperature).groupBy("video_id", "qpos").agg(F.max("p").alias("top")).groupBy("video_id").agg(F.avg("top").alias("text_peak"))

    def f(q, t):
        a, b = dense.unit(q["vec"], EPS), dense.unit(t["vec"], EPS)
        w = q["weight"]
        second = [float((np.partition(dense.softmax(a, b, tau), -2, axis=1)[:, -2] * w).sum()) if len(b) > 1 else 0.0 for tau in candidates]
        return {"tau": np.array(candidates), "second": np.array(second)}

    x = dense.per_pair(core, tokens.select("video_id", "pos", "vec"), ["video_id"], (["qpos"], ["pos"]), f, "video_id long, tau double, second double")
    gap = F.abs(F.col("text_peak") - F.col("second"))
    best = F.min(F.struct(F.round(gap, 12).alias("gap"), F.col("tau")))
    return x.join(peak, "video_id").groupBy("video_id", "text_peak").agg(best.alias("best")).select("video_id", "text_peak", F.col("best.tau").alias("tau"), F.col("best.gap").alias("gap"))


def plan(tokens: DataFrame, queries: DataFrame, targets: DataFrame, *, ratio: float = 0.25, rounding: str = "floor", alpha: float = 0.5, text_temperature: float = 0.02, vision_temperature: float = 0.2, profile: str = "auto", epsilon: float = 0.1, seed: int = 0) -> DataFrame:
    """Kept tokens (video_id, pos, step, objective): greedy coverage of text rows (softmax / number of rows)
    and of the coreset's vision rows (softmax times alpha times weight)."""
    core = tokens.join(targets, ["video_id", "pos"]).select("video_id", F.col("pos").alias("qpos"), "vec", (F.col("weight") * alpha).alias("weight"), F.lit(1).alias("vision"))
    text = queries.select("video_id", "qpos", "vec", F.lit(0.0).alias("weight"), F.lit(0).alias("vision"))

    def f(t, rows):
        u = dense.unit(t["vec"], EPS)
        vision = rows["vision"] == 1
        targets = dense.unit(rows["vec"], EPS)
        n = len(u)
        budget = max(1, min(n, int(np.floor(n * ratio) if rounding == "floor" else np.rint(n * ratio))))
        weight = np.where(vision, rows["weight"], 1 / max(1, (~vision).sum()))
        if profile == "exact" or profile == "auto" and n <= EXACT_MOST:
            taken, trace = greedy_streamed(u, targets, np.where(vision, vision_temperature, text_temperature), weight, budget)
        else:
            parts = [dense.softmax(targets[some], u, tau) * weight[some, None] for some, tau in ((~vision, text_temperature), (vision, vision_temperature)) if some.any()]
            taken, trace = greedy_sampled(np.concatenate(parts), budget, np.random.default_rng([seed, int(t["video_id"][0])]), epsilon)
        return {"pos": t["pos"][taken], "step": np.arange(len(taken)), "objective": trace}

    return dense.per_pair(tokens.select("video_id", "pos", "vec"), core.unionByName(text), ["video_id"], (["pos"], ["vision", "qpos"]), f, "video_id long, pos long, step long, objective double")
