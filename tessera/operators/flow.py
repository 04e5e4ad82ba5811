"""Attribution over causal attention: path mass, responsibility, direct attention."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dense


def causality_violations(attention: DataFrame, atol: float = 1e-5) -> DataFrame:
    """Questions with weight on the future: (question_id, worst)."""
    return attention.where("k > q").groupBy("question_id").agg(F.max(F.abs("a")).alias("worst")).where(F.col("worst") > atol)


def head_mean(attention: DataFrame) -> DataFrame:
    """Mean over heads and layers, before any path mass: (question_id, q, k, a)."""
    return attention.groupBy("question_id", "q", "k").agg(F.avg("a").alias("a"))


def reachability(attention: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """(…keys, pos, h): weight of all forward paths from each position to the target positions.

    h[i] = [i is a target] / targets + sum over j > i of A[j, i] h[j].  The diagonal does not count, repeated
    targets count once.  One sequence is solved in one task (a unit triangular system).
    """
    keys = list(keys)

    def f(a, t):
        n = int(max(a["q"].max(), a["k"].max(), t["target"].max() if len(t["target"]) else 0)) + 1
        h, w = np.zeros(n), np.zeros((n, n))
        np.add.at(w, (a["q"], a["k"]), a["a"])
        goal = np.unique(t["target"])
        if len(goal):
            h[goal] = 1 / len(goal)
        for i in range(n - 2, -1, -1):
            h[i] += w[i + 1 :, i] @ h[i + 1 :]
        return {"pos": np.arange(n), "h": h}

    return dense.per_pair(attention.select(*keys, "q", "k", "a"), targets.select(*keys, "target"), keys, (["q", "k"], ["target"]), f, ", ".join(f"{k} long" for k in keys) + ", pos long, h double")


def share(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``value`` over its sum by key; null where that is not positive."""
    mass = df.groupBy(*keys).agg(F.sum(value).alias("mass"))
    return df.join(mass, keys).withColumn(out, F.when(F.col("mass") > 0, F.col(value) / F.col("mass"))).drop("mass")


def responsibility(reach: DataFrame, visual: DataFrame) -> DataFrame:
    """(question_id, pos, responsibility): path mass over the visual positions, as shares."""
    return share(reach.join(visual, ["question_id", "pos"]), ["question_id"], "h", "responsibility").select("question_id", "pos", "responsibility")


def direct_attention(attention: DataFrame, targets: DataFrame, visual: DataFrame) -> DataFrame:
    """(question_id, pos, direct): mean weight from the target rows to each visual position, as shares if their sum is positive."""
    wanted = targets.select("question_id", F.col("target").alias("q")).distinct()
    n = wanted.groupBy("question_id").agg(F.count("*").alias("n"))
    got = attention.join(wanted, ["question_id", "q"]).groupBy("question_id", F.col("k").alias("pos")).agg(F.sum("a").alias("s"))
    x = visual.join(n, "question_id").join(got, ["question_id", "pos"], "left").select("question_id", "pos", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("m"))
    return share(x, ["question_id"], "m", "direct").select("question_id", "pos", F.coalesce("direct", "m").alias("direct"))


def target_position(answer: Column, mode: str) -> Column:
    """The position whose output (``decision``) or input (``post_answer``) is the answer."""
    if mode not in ("decision", "post_answer"):
        raise ValueError(f"unsupported target mode: {mode}")
    return answer - 1 if mode == "decision" else answer


def answer_logprob(logprobs: DataFrame, answers: DataFrame) -> DataFrame:
    """(question_id, total, mean) of the log-probabilities at (pos, token) of the answer; null if one is missing."""
    x = answers.join(logprobs, ["question_id", "pos", "token"], "left")
    whole = F.count("logprob") == F.count("*")
    return x.groupBy("question_id").agg(F.when(whole, F.sum("logprob")).alias("total"), F.when(whole, F.avg("logprob")).alias("mean"))


def stripped(ids: Column, eos: int, pad: int) -> Column:
    """Generated ids up to the first eos, without padding."""
    at = F.array_position(ids, F.lit(eos))
    return F.filter(F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids), lambda x: x != pad)


def outcomes(rows: DataFrame) -> DataFrame:
    """Adds answer_changed, correct_to_wrong, wrong_to_correct and logprob_drop; unknown where an answer is."""
    was, now, truth = F.col("baseline_answer"), F.col("answer"), F.col("truth")
    return rows.withColumns({
        "answer_changed": was != now,
        "correct_to_wrong": (was == truth) & (now != truth),
        "wrong_to_correct": (was != truth) & (now == truth),
        "logprob_drop": F.col("baseline_logprob") - F.col("logprob"),
    })


def layer_matrix(attention: DataFrame, targets: DataFrame, visual: DataFrame) -> DataFrame:
    """(question_id, layer, local_idx, value): path mass of each layer of ``attention`` (question_id, layer, q, k, a)
    at the visual positions, which are numbered from 0; not normalised."""
    layers = attention.select("question_id", "layer").distinct()
    reach = reachability(attention, targets.join(layers, "question_id"), ("question_id", "layer"))
    local = visual.withColumn("local_idx", (F.row_number().over(Window.partitionBy("question_id").orderBy("pos")) - 1).cast("long"))
    return reach.join(local, ["question_id", "pos"]).select("question_id", "layer", "local_idx", F.col("h").alias("value"))


def one_shape(layers: DataFrame) -> DataFrame:
    """(layers, tokens, questions) of the shapes of the questions' matrices; they can be stacked if this is one row."""
    shapes = layers.groupBy("question_id").agg(F.count_distinct("layer").alias("layers"), F.count_distinct("local_idx").alias("tokens"))
    return shapes.groupBy("layers", "tokens").agg(F.count("*").alias("questions"))


def layer_matrix_summary(layers: DataFrame) -> DataFrame:
    """(n, questions, most_common) of a long layer table (question_id, layer, local_idx, value): how many questions have n
    tokens, and which n most have (ties: the smaller)."""
    sizes = layers.groupBy("question_id").agg(F.count_distinct("local_idx").alias("n"))
    hist = sizes.groupBy("n").agg(F.count("*").alias("questions"))
    most = hist.agg(F.max(F.struct("questions", (-F.col("n")).alias("m"))).alias("best")).select((-F.col("best.m")).alias("common"))
    return hist.crossJoin(F.broadcast(most)).select("n", "questions", (F.col("n") == F.col("common")).alias("most_common"))  # one row


def layer_means(layers: DataFrame) -> DataFrame:
    """(layer, local_idx, value, questions): mean over the questions that have that token; rows that do not exist are the mask."""
    return layers.groupBy("layer", "local_idx").agg(F.avg("value").alias("value"), F.count("*").alias("questions"))
