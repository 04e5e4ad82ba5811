"""Every selection method under its name, with the settings that it shares with the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import echoprune, flashvid, kitoke, mmtok, ttf, vcast


def _dense(tokens: DataFrame, queries: DataFrame, dim: int, ratio: float) -> DataFrame:
    return tokens


def _ttf(tokens: DataFrame, queries: DataFrame, dim: int, ratio: float) -> DataFrame:
    return ttf.plan(tokens, dim, ratio=ratio)


def _ttf_dynamic(tokens: DataFrame, queries: DataFrame, dim: int, ratio: float) -> DataFrame:
    return ttf.dynamic_plan(tokens, dim, ratio=ratio)


def _echoprune(tokens: DataFrame, queries: DataFrame, dim: int, ratio: float) -> DataFrame:
    return echoprune.plan(echoprune.scores(tokens, queries), ratio=ratio)


def _vcast(tokens: DataFrame, queries: DataFrame, dim: int, ratio: float) -> DataFrame:
    return vcast.plan(tokens, dim, ratio=ratio)


def _kitoke(tokens: DataFrame, queries: DataFrame, dim: int, ratio: float) -> DataFrame:
    return kitoke.top(kitoke.diversity(tokens, 2.0), ratio)


def _flashvid(tokens: DataFrame, queries: DataFrame, dim: int, ratio: float) -> DataFrame:
    return flashvid.compress(tokens, dim, ratio=ratio)


def _mmtok(tokens: DataFrame, queries: DataFrame, dim: int, ratio: float) -> DataFrame:
    every = tokens.select("video_id", "pos", (1 / F.count("*").over(Window.partitionBy("video_id"))).alias("weight"))
    return mmtok.plan(tokens, queries, every, ratio=ratio, profile="exact")


#: (tokens, queries, dimensions, ratio) to kept tokens (video_id, pos, …).
METHODS: dict[str, Callable[[DataFrame, DataFrame, int, float], DataFrame]] = {
    "dense": _dense, "ttf": _ttf, "ttf_dynamic": _ttf_dynamic, "echoprune": _echoprune, "vcast": _vcast, "kitoke": _kitoke, "flashvid": _flashvid, "mmtok": _mmtok,
}


def selected(method: str, tokens: DataFrame, queries: DataFrame, dim: int, ratio: float = 0.25) -> DataFrame:
    """(method, video_id, pos): what a method keeps of every video."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    return METHODS[method](tokens, queries, dim, ratio).select(F.lit(method).alias("method"), "video_id", "pos")
