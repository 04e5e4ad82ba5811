"""Similarity and pairwise kernels over token tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V

from . import dense


def frame_means(tokens: DataFrame, dim: int, eps: float | None = None) -> DataFrame:
    """(video_id, frame, mean); with ``eps``, of normalised tokens."""
    df = tokens if eps is None else tokens.withColumn("vec", V.normalised("vec", eps))
    return df.groupBy("video_id", "frame").agg(V.mean("vec", dim).alias("mean"))


def frame_similarity(tokens: DataFrame, dim: int) -> DataFrame:
    """(video_id, frame, similarity): cosine of each frame mean to the mean of the frame means."""
    frames = frame_means(tokens, dim)
    whole = frames.groupBy("video_id").agg(V.mean("mean", dim).alias("whole"))
    return frames.join(whole, "video_id").select("video_id", "frame", V.cosine("mean", "whole").alias("similarity"))


def same_place_before(tokens: DataFrame) -> DataFrame:
    """(video_id, frame, pos, correlation) with the same place of the frame before; 0 in frame 0."""
    now = tokens.select("video_id", "frame", "y", "x", "pos", V.normalised("vec").alias("u"))
    before = now.select("video_id", (F.col("frame") + 1).alias("frame"), "y", "x", F.col("u").alias("p"))
    return now.join(before, ["video_id", "frame", "y", "x"], "left").select("video_id", "frame", "pos", F.coalesce(V.dot("u", "p"), F.lit(0.0)).alias("correlation"))


def neighbours(tokens: DataFrame, others: DataFrame, radius: int) -> DataFrame:
    """Pairs of a token and the tokens of its ``anchor`` frame at most ``radius`` rows and columns away.

    ``tokens`` has video_id, pos, anchor, y, x, u; ``others`` video_id, frame, y, x, v.  Offsets are a
    fixed table, so the join is on equality and each token has at most (2r+1)^2 partners.
    """
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    near = tokens.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps)).withColumns({"ny": F.col("y") + F.col("dy"), "nx": F.col("x") + F.col("dx")})
    theirs = others.select(F.col("video_id"), F.col("frame").alias("anchor"), F.col("y").alias("ny"), F.col("x").alias("nx"), "v", F.col("pos").alias("other"))
    return near.join(theirs, ["video_id", "anchor", "ny", "nx"])


def relevance(tokens: DataFrame, query_tokens: DataFrame) -> DataFrame:
    """(video_id, pos, relevance): largest cosine with a valid query token; null without one."""

    def f(t, q):
        if not len(q["qpos"]):
            return {"pos": t["pos"], "relevance": [None] * len(t["pos"])}
        a, b = dense.unit(t["vec"]), dense.unit(q["vec"])
        return {"pos": t["pos"], "relevance": np.concatenate([(a[s] @ b.T).max(1) for s in dense.blocks(len(a))])}

    return dense.per_pair(tokens.select("video_id", "pos", "vec"), query_tokens.where("valid").select("video_id", "qpos", "vec"), ["video_id"], (["pos"], ["qpos"]), f, "video_id long, pos long, relevance double")


def temporal_echo(tokens: DataFrame, temperature: float, radius: int | None = None) -> DataFrame:
    """(video_id, frame, pos, echo): softmax-weighted similarity to the previous frame's tokens,
    all of them or those within ``radius``; 0 in frame 0."""
    now = tokens.select("video_id", "frame", "pos", "y", "x", V.normalised("vec").alias("u"))
    if radius is None:
        before = now.select("video_id", (F.col("frame") + 1).alias("frame"), F.col("u").alias("v"), F.col("pos").alias("other"))

        def f(t, p):
            if not len(p["other"]):
                return {"pos": t["pos"], "echo": np.zeros(len(t["pos"]))}
            s = t["u"] @ p["v"].T
            e = np.exp((s - s.max(1, keepdims=True)) / temperature)
            return {"pos": t["pos"], "echo": (e * s).sum(1) / e.sum(1)}

        return dense.per_pair(now, before, ["video_id", "frame"], (["pos"], ["other"]), f, "video_id long, frame long, pos long, echo double")
    pairs = neighbours(now.withColumn("anchor", F.col("frame") - 1), now.select("video_id", "frame", "y", "x", "pos", F.col("u").alias("v")), radius)
    s = pairs.select("video_id", "frame", "pos", V.dot("u", "v").alias("s"))
    # |s| is at most 1, so the weights need no maximum taken off.
    e = F.exp((F.col("s") - 1) / temperature)
    found = s.groupBy("video_id", "frame", "pos").agg((F.sum(e * F.col("s")) / F.sum(e)).alias("echo"))
    return now.select("video_id", "frame", "pos").join(found, ["video_id", "frame", "pos"], "left").withColumn("echo", F.coalesce("echo", F.lit(0.0)))


def kernel_density(tokens: DataFrame, alpha: float) -> DataFrame:
    """(video_id, frame, pos, density): sum over all tokens of the video, itself included, of exp(-d^2 / alpha)."""

    def f(t):
        x = t["vec"]
        out = [sum(np.exp(-dense.squared_distances(x[a], x[b]) / alpha).sum(1) for b in dense.blocks(len(x))) for a in dense.blocks(len(x))]
        return {"frame": t["frame"], "pos": t["pos"], "density": np.concatenate(out)}

    return dense.per_key(tokens.select("video_id", "frame", "pos", "vec"), ["video_id"], ["pos"], f, "video_id long, frame long, pos long, density double")


def cosine_distances(tokens: DataFrame) -> DataFrame:
    """(video_id, frame, pos, other, distance) of all pairs of a frame: 1 - cosine."""
    now = tokens.select("video_id", "frame", "pos", V.normalised("vec").alias("u"))
    then = now.select("video_id", "frame", F.col("pos").alias("other"), F.col("u").alias("v"))
    return now.join(then, ["video_id", "frame"]).select("video_id", "frame", "pos", "other", (1 - V.dot("u", "v")).alias("distance"))


def incoming_attention(tokens: DataFrame, scale: float | None = None) -> DataFrame:
    """(video_id, frame, pos, attention): mean over the queries of a frame of softmax(q k * scale), by key."""

    def f(t):
        x = t["vec"]
        s = x @ x.T * (1 / np.sqrt(x.shape[1]) if scale is None else scale)
        e = np.exp(s - s.max(1, keepdims=True))
        return {"pos": t["pos"], "attention": (e / e.sum(1, keepdims=True)).mean(0)}

    return dense.per_key(tokens.select("video_id", "frame", "pos", "vec"), ["video_id", "frame"], ["pos"], f, "video_id long, frame long, pos long, attention double")


def causal_attention(heads: DataFrame, scaling: float, groups: int = 1) -> DataFrame:
    """(question_id, q, k, a) for k <= q from rows (question_id, head, pos, q, k): softmax over the past by
    head, averaged over heads.  ``groups``: query heads that share a key head.  The heads of one key head are
    matrices of one task, which sends one sum a pair of places."""
    left = heads.where("q is not null").select("question_id", F.floor(F.col("head") / groups).cast("long").alias("kv"), "head", "pos", "q")
    right = heads.where("k is not null").select("question_id", F.col("head").alias("kv"), F.col("pos").alias("kp"), "k")

    def f(a, b):
        if not len(b["kp"]):
            return {"question_id": [], "kv": [], "q": [], "k": [], "p": [], "heads": []}
        total, seen = {}, {}
        for h in np.unique(a["head"]):
            own = np.flatnonzero(a["head"] == h)
            for some in dense.blocks(len(own)):
                at = own[some]
                s = np.where(b["kp"][None, :] <= a["pos"][at][:, None], a["q"][at] @ b["k"].T * scaling, -np.inf)
                e = np.exp(s - np.maximum(s.max(1, keepdims=True), -1e300))
                p = e / np.maximum(e.sum(1, keepdims=True), 1e-300)
                for i, q in enumerate(a["pos"][at].tolist()):
                    total[q] = total.get(q, 0) + p[i]
                    seen[q] = seen.get(q, 0) + 1
        q = np.array(sorted(total))
        row, col = np.nonzero(b["kp"][None, :] <= q[:, None])
        return {"q": q[row], "k": b["kp"][col], "p": np.array([total[v] for v in q])[row, col] if len(row) else np.zeros(0), "heads": np.array([seen[v] for v in q], np.int64)[row]}

    sums = dense.per_pair(left, right, ["question_id", "kv"], (["head", "pos"], ["kp"]), f, "question_id long, kv long, q long, k long, p double, heads long")
    return sums.groupBy("question_id", "q", "k").agg((F.sum("p") / F.sum("heads")).alias("a"))


def transitions(tokens: DataFrame) -> DataFrame:
    """(video_id, frame, diff_pos, diff_match) from each frame to the next: mean distance of the same
    places, and mean over the earlier tokens of the distance to the nearest later one."""
    now = tokens.select("video_id", "frame", "pos", "vec")
    then = now.select("video_id", (F.col("frame") - 1).alias("frame"), F.col("pos").alias("other"), F.col("vec").alias("later"))

    def f(a, b):
        n = min(len(a["pos"]), len(b["other"]))
        if not n:
            return {"frame": [], "diff_pos": [], "diff_match": []}
        d = np.sqrt(dense.squared_distances(a["vec"], b["later"]))
        return {"diff_pos": [float(np.linalg.norm(a["vec"][:n] - b["later"][:n], axis=1).mean())], "diff_match": [float(d.min(1).mean())]}

    def keyed(a, b):
        out = f(a, b)
        if not out["diff_pos"]:
            out |= {"video_id": [], "frame": []}
        return out

    return dense.per_pair(now, then, ["video_id", "frame"], (["pos"], ["other"]), keyed, "video_id long, frame long, diff_pos double, diff_match double")


def event_relevance(tokens: DataFrame, dim: int) -> DataFrame:
    """(video_id, pos, event_relevance): mean over the frames of the video of token . frame mean,
    which is the token . the mean of the frame means."""
    whole = frame_means(tokens, dim).groupBy("video_id").agg(V.mean("mean", dim).alias("whole"))
    return tokens.join(whole, "video_id").select("video_id", "pos", V.dot("vec", "whole").alias("event_relevance"))


def curvature(tokens: DataFrame, dim: int) -> DataFrame:
    """(video_id, frame, curvature): 1 - cosine of the steps into and out of each normalised frame mean; 1 at both ends."""
    from pyspark.sql import Window

    by = Window.partitionBy("video_id").orderBy("frame")
    reps = frame_means(tokens, dim).select("video_id", "frame", V.normalised("mean").alias("rep"))
    steps = reps.select("video_id", "frame", "rep", F.lag("rep").over(by).alias("a"), F.lead("rep").over(by).alias("b"))
    bend = 1 - V.cosine(V.minus("rep", "a"), V.minus("b", "rep"))
    return steps.select("video_id", "frame", F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(1.0)).otherwise(bend).alias("curvature"))


def group_means(rows: DataFrame, unit: int, dim: int, keys: list[str]) -> DataFrame:
    """Mean vector of each ``unit`` consecutive rows by ``flat``."""
    return rows.withColumn("merged", F.floor(F.col("flat") / unit).cast("long")).groupBy(*keys, "merged").agg(V.mean("vec", dim).alias("vec"))


def query_rows(query_tokens: DataFrame, videos: DataFrame) -> DataFrame:
    """Query tokens for each video: its own, or those without a video (null id), which serve all the others."""
    own = query_tokens.where("video_id is not null")
    shared = query_tokens.where("video_id is null").drop("video_id")
    lacking = videos.select("video_id").distinct().join(own.select("video_id").distinct(), "video_id", "left_anti")
    # Grouped into one row first, so each video meets one row whatever the number of tokens.
    packed = shared.agg(F.collect_list(F.struct(*shared.columns)).alias("rows"))
    given = lacking.crossJoin(F.broadcast(packed)).select("video_id", F.explode("rows").alias("r")).select("video_id", "r.*")
    return own.unionByName(given.select(*own.columns))
