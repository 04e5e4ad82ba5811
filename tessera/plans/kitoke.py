"""Kernel-density token selection with temporal intervals and weighted merging."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import budgets
from tessera.functions import vectors as V
from tessera.operators import dense, ranking, similarity


def diversity(tokens: DataFrame, alpha: float) -> DataFrame:
    """(video_id, frame, pos, diversity): one over the kernel density."""
    return similarity.kernel_density(tokens, alpha).select("video_id", "frame", "pos", (1 / F.col("density")).alias("diversity"))


def boundaries(transitions: DataFrame, *, tau: float, delta: float, relative: float, one_sided: bool = False) -> DataFrame:
    """Adds ``delta``, ``delta_pct``, ``strength`` and ``boundary`` (before frame + 1) to the transitions.

    The change is the sum of both differences.  A boundary is where it is over tau, or where it exceeds
    a neighbour's by over ``delta`` and by over ``relative`` of that neighbour's.  The two ends are
    compared with their one neighbour only if ``one_sided``.  ``strength`` is in units of the thresholds.
    """
    by = Window.partitionBy("video_id").orderBy("frame")
    x = transitions.withColumn("diff", F.col("diff_pos") + F.col("diff_match")).withColumn("before", F.lag("diff").over(by)).withColumn("after", F.lead("diff").over(by))
    over = lambda c: F.col("diff") - F.col(c)
    part = lambda c: over(c) / F.greatest(F.col(c), F.lit(1e-6))
    compared = F.coalesce("before", "after").isNotNull() if one_sided else F.col("before").isNotNull() & F.col("after").isNotNull()
    x = x.withColumn("delta", F.when(compared, F.greatest(over("before"), over("after")))).withColumn("delta_pct", F.when(compared, F.greatest(part("before"), part("after"))))
    cut = (F.col("diff") > tau) | F.coalesce((F.col("delta") > delta) & (F.col("delta_pct") > relative), F.lit(False))
    units = [F.col(c) / max(u, 1e-6) for c, u in (("diff", tau), ("delta", delta), ("delta_pct", relative))]
    local = F.when(compared, F.least(units[1], units[2]))
    return x.withColumn("boundary", cut).withColumn("strength", F.greatest(units[0], local)).drop("before", "after")


def coarsened(bounds: DataFrame, budget: Column) -> DataFrame:
    """Of each video's boundaries the ``budget`` - 1 strongest stay (ties: the earlier)."""
    rank = F.row_number().over(Window.partitionBy("video_id", "boundary").orderBy(F.desc("strength"), "frame"))
    return bounds.withColumn("boundary", F.col("boundary") & (rank <= budget - 1))


def intervals(tokens: DataFrame, bounds: DataFrame) -> DataFrame:
    """(video_id, frame, interval): frames between boundaries."""
    frames = tokens.select("video_id", "frame").distinct()
    cuts = bounds.where("boundary").select("video_id", (F.col("frame") + 1).alias("frame"), F.lit(1).alias("cut"))
    x = frames.join(cuts, ["video_id", "frame"], "left")
    return x.select("video_id", "frame", F.sum(F.coalesce("cut", F.lit(0))).over(Window.partitionBy("video_id").orderBy("frame")).cast("long").alias("interval"))


def top(div: DataFrame, ratio: float) -> DataFrame:
    """The most diverse tokens up to floor(total * ratio)."""
    return ranking.keep_by_score(div, ["video_id"], "diversity", ratio, "high")


def seed_of(*parts) -> int:
    """A seed from the text of its parts."""
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest(), "big") >> 1


def pivotal_sample(pi: np.ndarray, rng: np.random.Generator, sequential: bool = False, tol: float = 1e-7) -> np.ndarray:
    """Fixed-size sample with the given inclusion probabilities.

    Fractional entries are paired; of each pair one takes as much as it can
    of the other's mass, so that at least one of them is settled, with odds
    that keep both expectations.
    """
    pi = pi.astype(float).copy()
    budget = int(round(pi.sum()))
    if budget <= 0 or budget >= len(pi):
        return np.arange(len(pi) if budget > 0 else 0)
    while True:
        pi[pi <= tol], pi[pi >= 1 - tol] = 0, 1
        open_ = np.flatnonzero((pi > 0) & (pi < 1))
        if len(open_) < 2:
            break
        if not sequential:
            open_ = rng.permutation(open_)
        i, j = open_[0 : len(open_) // 2 * 2 : 2], open_[1::2]
        a, b, u = pi[i], pi[j], rng.random(len(i))
        s = a + b
        full = s > 1
        odds = np.where(full, (1 - b) / np.maximum(2 - s, tol), a / np.maximum(s, tol))
        win = u < odds
        big, small = np.where(full, 1.0, s), np.where(full, s - 1, 0.0)
        pi[i], pi[j] = np.where(win, big, small), np.where(win, small, big)
    return np.sort(np.argsort(-pi, kind="stable")[:budget])


def sample(div: DataFrame, ratio: float, method: str = "pivotal", seed: int = 0) -> DataFrame:
    """Random tokens by diversity, floor(total * ratio) of them: ``pivotal`` or ``multinomial`` (without replacement).
    The generator's seed is the text of the seed and the video."""
    if method not in ("pivotal", "multinomial"):
        raise ValueError(f"unsupported method: {method}")
    sized = ranking.with_total(div, ["video_id"])
    x = ranking.inclusion_probabilities(sized, "diversity", budgets.floored(F.col("total"), ratio)) if method == "pivotal" else sized.withColumn("pi", F.col("diversity"))

    def f(t):
        rng = np.random.default_rng(seed_of(seed, t["video_id"][0]))
        n = len(t["pos"])
        if method == "pivotal":
            keep = pivotal_sample(t["pi"], rng)
        else:
            keep = np.sort(rng.choice(n, min(n, max(1, int(np.floor(n * ratio)))), replace=False, p=t["pi"] / t["pi"].sum()))
        return {"frame": t["frame"][keep], "pos": t["pos"][keep], "diversity": t["diversity"][keep]}

    return dense.per_key(x.select("video_id", "frame", "pos", "diversity", "pi"), ["video_id"], ["pos"], f, "video_id long, frame long, pos long, diversity double")


#: Names of what to do where an interval has no selected token.
EMPTY_POLICIES = ("paper_strict", "repair_swap", "coarsen_then_repair")


def repaired(div: DataFrame, spans: DataFrame, chosen: DataFrame, policy: str = "repair_swap") -> DataFrame:
    """The selection after repair: (video_id, frame, interval, pos, diversity).

    An empty interval takes its most diverse token (ties: earlier).  For each, one
    token goes: from the first interval on, all but the most diverse one of an
    interval can be spared, the least diverse first (ties: later).  Under
    ``paper_strict`` an empty interval is an error; it always is one if not
    enough tokens can be spared, as with fewer selected ones than intervals.
    """
    if policy not in EMPTY_POLICIES:
        raise ValueError(f"unsupported policy: {policy}")
    x = div.join(spans, ["video_id", "frame"]).join(chosen.select("video_id", "pos", F.lit(1).alias("own")), ["video_id", "pos"], "left")
    held = x.groupBy("video_id", "interval").agg(F.count("own").alias("held"))
    need = held.groupBy("video_id").agg(F.sum((F.col("held") == 0).cast("long")).alias("empty"), F.sum(F.greatest(F.col("held") - 1, F.lit(0))).alias("spare"))
    x = x.join(held, ["video_id", "interval"]).join(need, "video_id").withColumn("own", F.col("own").isNotNull())
    within = Window.partitionBy("video_id", "interval", "own")
    x = x.withColumn("worst", F.row_number().over(within.orderBy("diversity", F.desc("pos")))).withColumn("best", F.row_number().over(within.orderBy(F.desc("diversity"), "pos")))
    x = x.withColumn("spared", F.col("own") & (F.col("worst") < F.col("held")))
    x = x.withColumn("turn", F.row_number().over(Window.partitionBy("video_id", "spared").orderBy("interval", "worst")))
    stays = F.col("own") & ~(F.col("spared") & (F.col("turn") <= F.col("empty")))
    keep = stays | ((F.col("held") == 0) & (F.col("best") == 1))
    short = (F.col("empty") > 0) if policy == "paper_strict" else F.col("empty") > F.col("spare")
    message = F.concat(F.lit("video "), F.col("video_id"), F.lit(": "), F.col("empty"), F.lit(" empty intervals, "), F.col("spare"), F.lit(f" tokens to spare ({policy})"))
    return x.where(F.when(short, F.raise_error(message).cast("boolean")).otherwise(keep)).select("video_id", "frame", "interval", "pos", "diversity")


def assignments(tokens: DataFrame, spans: DataFrame, chosen: DataFrame) -> DataFrame:
    """(video_id, pos, rep): each token's most similar representative in its interval (ties: earlier);
    representatives go to themselves, and tokens of intervals without one are left out."""
    u = tokens.select("video_id", "frame", "pos", V.normalised("vec").alias("u")).join(spans, ["video_id", "frame"])
    reps = u.join(chosen.select("video_id", "pos"), ["video_id", "pos"]).select("video_id", "interval", F.col("pos").alias("rep"), F.col("u").alias("v"))

    def f(t, r):
        if not len(r["rep"]):
            return {"video_id": [], "pos": [], "rep": []}
        best = np.concatenate([r["rep"][np.argmax(t["u"][s] @ r["v"].T, axis=1)] for s in dense.blocks(len(t["pos"]), len(r["rep"]))])
        own = np.isin(t["pos"], r["rep"])
        return {"pos": t["pos"], "rep": np.where(own, t["pos"], best)}

    return dense.per_pair(u.select("video_id", "interval", "pos", "u"), reps, ["video_id", "interval"], (["pos"], ["rep"]), f, "video_id long, pos long, rep long")


def merge_weights(assigned: DataFrame, div: DataFrame, mode: str = "diversity") -> DataFrame:
    """(video_id, pos, rep, weight): weights of the tokens of a representative, which sum to 1."""
    return weights_by_mode(assigned, div, [mode]).drop("mode")


def weights_by_mode(assigned: DataFrame, div: DataFrame, modes: list[str]) -> DataFrame:
    """(video_id, pos, rep, weight, mode) of all these modes, from one pass over the assignments."""
    raw = {"diversity": F.col("diversity") if "diversity" in modes else None, "uniform": F.lit(1.0), "none": (F.col("pos") == F.col("rep")).cast("double")}
    if unknown := set(modes) - set(raw):
        raise ValueError(f"unsupported merge mode: {', '.join(sorted(unknown))}")
    x = assigned.join(div.select("video_id", "pos", "diversity"), ["video_id", "pos"]) if "diversity" in modes else assigned
    x = x.select("video_id", "pos", "rep", F.inline(F.array(*(F.struct(F.lit(m).alias("mode"), raw[m].alias("raw")) for m in modes))))
    mass = F.sum("raw").over(Window.partitionBy("video_id", "rep", "mode"))
    return x.select("video_id", "pos", "rep", (F.col("raw") / mass).alias("weight"), "mode")


def merged(tokens: DataFrame, weights: DataFrame, dim: int) -> DataFrame:
    """(video_id, rep, vec): the weighted sum of each representative's tokens."""
    return tokens.select("video_id", "pos", "vec").join(weights, ["video_id", "pos"]).groupBy("video_id", "rep").agg(V.weighted_sum("vec", "weight", dim).alias("vec"))


def compress(
    tokens: DataFrame, dim: int, *, ratio: float = 0.25, alpha: float = 2.0, method: str = "topk", seed: int = 0, tau: float = 110.0, delta: float = 70.0, relative: float = 0.4, merge: str = "diversity", policy: str = "coarsen_then_repair"
) -> DataFrame:
    """The whole method: (video_id, rep, vec).  ``coarsen_then_repair`` first leaves no more intervals than the budget."""
    div = diversity(tokens, alpha)
    chosen = top(div, ratio) if method == "topk" else sample(div, ratio, method, seed)
    bounds = boundaries(similarity.transitions(tokens), tau=tau, delta=delta, relative=relative)
    if policy == "coarsen_then_repair":
        sizes = tokens.groupBy("video_id").agg(F.count("*").alias("total"))
        bounds = coarsened(bounds.join(sizes, "video_id"), budgets.floored(F.col("total"), ratio)).drop("total")
    spans = intervals(tokens, bounds)
    fixed = repaired(div, spans, chosen, policy)
    return merged(tokens, merge_weights(assignments(tokens, spans, fixed), div, merge), dim)
