"""Segment-wise compression: diverse tokens per frame, temporal merge trees, density-peak clusters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import dense, similarity


def segments(tokens: DataFrame, dim: int, *, threshold: float, least: int = 1) -> DataFrame:
    """(video_id, frame, similarity, segment): a cut before a frame whose mean is less similar than
    ``threshold`` to the one before, and as many more (least similar first, ties: earlier) as make ``least`` segments."""
    by = Window.partitionBy("video_id").orderBy("frame")
    u = similarity.frame_means(tokens, dim).select("video_id", "frame", V.normalised("mean").alias("u"))
    s = u.withColumn("p", F.lag("u").over(by)).select("video_id", "frame", F.when(F.col("p").isNotNull(), V.dot("u", "p")).alias("similarity"))
    sizes = s.groupBy("video_id").agg(F.count("*").alias("t"), F.sum((F.col("similarity") < threshold).cast("long")).alias("cuts"))
    x = s.join(sizes, "video_id").withColumn("cut", F.coalesce(F.col("similarity") < threshold, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("video_id", "cut", F.col("similarity").isNull()).orderBy("similarity", "frame"))
    more = ~F.col("cut") & F.col("similarity").isNotNull() & (rank <= F.least(F.col("t"), F.lit(least)) - 1 - F.coalesce("cuts", F.lit(0)))
    x = x.withColumn("at", (F.col("cut") | more).cast("long"))
    return x.select("video_id", "frame", "similarity", F.sum("at").over(by).cast("long").alias("segment"))


def diverse_tokens(x: np.ndarray, attention: np.ndarray, k: int, method: str = "attn_div", relevance: np.ndarray | None = None) -> np.ndarray:
    """Places of the tokens of one frame that are kept as such, in greedy order.

    ``attn``: most attention.  Otherwise the token whose second-smallest distance is largest comes
    first, then always that whose smallest distance to those taken is largest; distances are
    cosine distances, each column scaled by the token's attention (``attn_div``) and relevance (``attn_div_v2``).
    """
    n = len(x)
    attention = np.nan_to_num(attention, nan=0.0, posinf=0.0, neginf=0.0)
    if k <= 0 or k >= n:
        return np.arange(n if k > 0 else 0)
    if method == "attn":
        return dense.stable_top(attention, k)
    u = dense.unit(x)
    d = 1 - u @ u.T
    if method != "div":
        d = d * (attention * 1e6)[None, :]
    if method == "attn_div_v2":
        d = d * relevance[None, :]
    taken = [int(np.argmax(np.partition(d, 1, axis=0)[1]))]
    nearest = d[taken[0]].copy()
    while len(taken) < k:
        score = nearest.copy()
        score[taken] = -np.inf
        taken.append(int(np.argmax(score)))
        nearest = np.minimum(nearest, d[taken[-1]])
    return np.array(taken)


def matches(tokens: DataFrame, spans: DataFrame, open_tokens: DataFrame | None = None) -> DataFrame:
    """(video_id, segment, frame, pos, parent, best): each open token's most similar open one in the previous
    frame of its segment (ties: lower place); null in a segment's first frame."""
    u = tokens.select("video_id", "frame", "pos", V.normalised("vec").alias("u")).join(spans.select("video_id", "frame", "segment"), ["video_id", "frame"])
    if open_tokens is not None:
        u = u.join(open_tokens.select("video_id", "pos"), ["video_id", "pos"], "left_semi")
    before = u.select("video_id", "segment", (F.col("frame") + 1).alias("frame"), F.col("pos").alias("other"), F.col("u").alias("v"))

    def f(t, p):
        n = len(t["pos"])
        if not len(p["other"]):
            return {"pos": t["pos"], "parent": [None] * n, "best": [None] * n}
        s = t["u"] @ p["v"].T
        return {"pos": t["pos"], "parent": p["other"][np.argmax(s, axis=1)], "best": s.max(1)}

    return dense.per_pair(u, before, ["video_id", "segment", "frame"], (["pos"], ["other"]), f, "video_id long, segment long, frame long, pos long, parent long, best double")


def merges(matched: DataFrame, sizes: DataFrame, *, threshold: float) -> DataFrame:
    """Adds ``merge``: a token goes into its parent where they are more similar than the threshold.

    ``sizes`` (video_id, segment, total, lower): tokens of a segment (all, open or not) and the least
    number of roots.  Where merging would leave fewer, the threshold rises to the similarity of
    the best match that would be one too many.
    """
    by = ["video_id", "segment"]
    x = matched.join(sizes, by)
    hits = x.groupBy(*by).agg(F.sum(F.coalesce((F.col("best") > threshold).cast("long"), F.lit(0))).alias("hits"))
    x = x.join(hits, by).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("best"), "pos")))
    allowed = F.greatest(F.lit(0), F.col("total") - F.col("lower"))
    few = F.col("total") - F.col("hits") < F.col("lower")
    kth = x.where(F.col("rank") == allowed).select(*by, F.greatest("best", F.lit(-1 + 1e-6)).alias("kth"))
    x = x.join(kth, by, "left")
    raised = F.when(allowed <= 0, F.lit(float("inf"))).otherwise(F.coalesce("kth", F.lit(-1 + 1e-6)))
    effective = F.when(few, raised).otherwise(F.lit(float(threshold)))
    return x.withColumn("effective", effective).withColumn("merge", F.coalesce(F.col("best") > F.col("effective"), F.lit(False))).drop("total", "lower", "hits", "rank", "kth")


def tree_roots(merged: DataFrame) -> DataFrame:
    """(video_id, pos, root): pointers doubled until each token of a segment points at the root of its tree."""

    def f(t):
        at = np.where(t["merge"].astype(bool), np.searchsorted(t["pos"], np.nan_to_num(t["parent"].astype(float), nan=-1)), np.arange(len(t["pos"])))
        while not np.array_equal(at, up := at[at]):
            at = up
        return {"pos": t["pos"], "root": t["pos"][at]}

    return dense.per_key(merged.select("video_id", "segment", "pos", "parent", "merge"), ["video_id", "segment"], ["pos"], f, "video_id long, segment long, pos long, root long")


def tree_means(tokens: DataFrame, roots: DataFrame, dim: int) -> DataFrame:
    """(video_id, root, n, vec): number and mean of the tokens of each tree."""
    return tokens.select("video_id", "pos", "vec").join(roots, ["video_id", "pos"]).groupBy("video_id", "root").agg(F.count("*").alias("n"), V.mean("vec", dim).alias("vec"))


#: Differences of coordinates that are held at once.
_DIFFERENCES = 1 << 22


def density_peaks(x: np.ndarray, k: int, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres (rising) and the cluster of each point: centres have the largest product of density (exp of minus
    the mean squared distance to the ``nearest`` nearest, itself included) and distance to the nearest denser point."""
    r = len(x)
    if k <= 0 or k >= r:
        return np.arange(r if k > 0 else 0), np.arange(r) if k > 0 else np.full(r, -1)
    m = min(max(1, nearest), r)
    rows = [slice(a, a + step) for step in [max(1, _DIFFERENCES // (r * max(1, x.shape[1])))] for a in range(0, r, step)]
    away = lambda some, others: np.sqrt(((x[some, None, :] - others[None, :, :]) ** 2).sum(2)) / math.sqrt(max(x.shape[1], 1))
    d = np.concatenate([away(some, x) for some in rows])
    density = np.exp(-np.concatenate([np.partition(d[some], m - 1, axis=1)[:, :m] ** 2 for some in rows]).mean(1))
    furthest = d.max()
    delta = np.concatenate([np.where(density[None, :] > density[some, None], d[some], furthest).min(1) for some in rows])
    centres = np.sort(dense.stable_top(density * delta, k))
    cluster = np.argmin(d[:, centres], axis=1)
    cluster[centres] = np.arange(k)
    return centres, cluster


def frame_clusters(points: DataFrame, *, nearest: int) -> DataFrame:
    """Density-peak clusters of each frame.  ``points`` has video_id, frame, pos, vec and k (the same for a frame):
    (video_id, frame, pos, centre), centre being the place of the cluster's centre; none where k is 0."""

    def f(t):
        centres, cluster = density_peaks(t["vec"], int(t["k"][0]), nearest)
        if not len(centres):
            return {"video_id": [], "frame": [], "pos": [], "centre": []}
        return {"pos": t["pos"], "centre": t["pos"][centres[cluster]]}

    return dense.per_key(points.select("video_id", "frame", "pos", "vec", "k"), ["video_id", "frame"], ["pos"], f, "video_id long, frame long, pos long, centre long")


def _split(n: int, ratio: float, alpha: float, expansion: float) -> tuple[int, int, int]:
    frame = math.ceil(n * min(1.0, ratio * expansion))
    diverse = math.ceil(frame * min(1.0, max(0.0, alpha)))
    return frame, diverse, frame - diverse


def _shares(sizes: list[int], target: int) -> list[int]:
    """Largest remainders, ties to the lower index."""
    whole = sum(sizes)
    target = max(0, min(target, whole))
    raw = [target * (s / whole) if whole else 0.0 for s in sizes]
    out = [min(s, math.floor(r)) for s, r in zip(sizes, raw, strict=True)]
    for i in sorted(range(len(sizes)), key=lambda i: (out[i] - raw[i], i))[: target - sum(out)]:
        out[i] += 1
    return out


def compress_segment(x: np.ndarray, attention: np.ndarray, relevance: np.ndarray | None, *, diverse: int, rest: int, frame_budget: int, threshold: float, nearest: int, method: str, exact: bool) -> np.ndarray:
    """Places (frame * n + token) that represent one segment x [frames, tokens, dim]."""
    s, n, _ = x.shape
    keep, open_ = [], np.ones((s, n), bool)
    for t in range(s):
        got = np.sort(diverse_tokens(x[t], attention[t], diverse, method, None if relevance is None else relevance[t]))
        keep.append(t * n + got)
        open_[t, got] = False
    u = dense.unit(x)
    best, parent = np.full((s, n), -np.inf), np.full((s, n), -1)
    for t in range(1, s):
        a, b = np.flatnonzero(open_[t]), np.flatnonzero(open_[t - 1])
        if len(a) and len(b):
            sim = u[t, a] @ u[t - 1, b].T
            best[t, a], parent[t, a] = sim.max(1), b[np.argmax(sim, axis=1)]
    merge = best > threshold
    lower = frame_budget * s
    if (~merge).sum() < lower:
        allowed = max(0, s * n - lower)
        merge = best > (max(np.sort(best.ravel())[::-1][allowed - 1], -1 + 1e-6) if allowed else np.inf)
    sums, counts = x.copy(), np.ones((s, n))
    for t in range(s - 1, 0, -1):
        child = np.flatnonzero(merge[t])
        np.add.at(sums[t - 1], parent[t, child], sums[t, child])
        np.add.at(counts[t - 1], parent[t, child], counts[t, child])
    roots = [np.flatnonzero(open_[t] & ~merge[t]) for t in range(s)]
    sizes = [len(r) for r in roots]
    target = rest * s
    if target >= sum(sizes):
        ks = sizes
    else:
        ks = _shares(sizes, target) if exact else [min(c, math.ceil(c * target / max(1, sum(sizes)))) for c in sizes]
    for t, (r, k) in enumerate(zip(roots, ks, strict=True)):
        if len(r):
            centres, _ = density_peaks(sums[t, r] / counts[t, r][:, None], k, nearest)
            keep.append(t * n + r[centres])
    return np.sort(np.concatenate(keep))


def compress(tokens: DataFrame, dim: int, *, ratio: float = 0.25, alpha: float = 0.7, expansion: float = 1.0, segment_threshold: float = 0.9, segments_least: int = 1, merge_threshold: float = 0.8, nearest: int = 5, method: str = "attn_div", exact: bool = True) -> DataFrame:
    """The whole method: kept places (video_id, segment, pos).

    Segments are cut and attention is scored as DataFrames; each segment is then compressed in one
    task, as its steps follow from each other.  With ``exact`` the count of a video is corrected:
    cut off, or filled up with the lowest unused places.
    """
    spans = segments(tokens, dim, threshold=segment_threshold, least=segments_least).select("video_id", "frame", "segment")
    rel = similarity.event_relevance(tokens, dim) if method == "attn_div_v2" else tokens.select("video_id", "pos", F.lit(1.0).alias("event_relevance"))
    x = tokens.select("video_id", "frame", "pos", "vec").join(similarity.incoming_attention(tokens).drop("frame"), ["video_id", "pos"]).join(rel, ["video_id", "pos"]).join(spans, ["video_id", "frame"])

    def f(t):
        frames, first = np.unique(t["frame"], return_index=True)
        n = len(t["pos"]) // len(frames)
        shape = (len(frames), n)
        frame_budget, diverse, rest = _split(n, ratio, alpha, expansion)
        got = compress_segment(
            t["vec"].reshape(*shape, -1), t["attention"].reshape(shape), t["event_relevance"].reshape(shape) if method == "attn_div_v2" else None,
            diverse=diverse, rest=rest, frame_budget=frame_budget, threshold=merge_threshold, nearest=nearest, method=method, exact=exact,
        )
        return {"pos": t["pos"][got]}

    kept = dense.per_key(x, ["video_id", "segment"], ["frame", "pos"], f, "video_id long, segment long, pos long")
    if not exact:
        return kept
    sizes = tokens.groupBy("video_id").agg(F.count("*").alias("total"), F.count_distinct("frame").alias("t"))
    planned = F.ceil(F.col("total") / F.col("t") * min(1.0, ratio * expansion)) * F.col("t")
    every = tokens.select("video_id", "frame", "pos").join(spans, ["video_id", "frame"]).join(kept.select("video_id", "pos", F.lit(0).alias("own")), ["video_id", "pos"], "left")
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.coalesce("own", F.lit(1)), "pos"))
    return every.join(sizes, "video_id").withColumn("rank", rank).where(F.col("rank") <= planned).select("video_id", "segment", "pos")
