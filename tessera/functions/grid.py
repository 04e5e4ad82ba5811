"""Index arithmetic of row-major grids: flat = t * (h * w) + y * w + x."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _div(a: Column, b) -> Column:
    return F.floor(a / b).cast("long")


def coordinates(flat: Column, h: Column, w: Column) -> tuple[Column, Column, Column]:
    """Frame, row and column of a flat index."""
    within = flat % (h * w)
    return _div(flat, h * w), _div(within, w), within % w


def merged(t: Column, h: Column, w: Column, merge: Column, policy: str = "floor") -> tuple[Column, Column, Column, Column]:
    """Grid after spatial merging, and tokens per frame.  ``clamp``: sizes of at least
    1; ``reject``: null where the merge does not divide them."""
    mh, mw = _div(h, merge), _div(w, merge)
    if policy == "clamp":
        mh, mw = F.greatest(mh, F.lit(1)), F.greatest(mw, F.lit(1))
    elif policy == "reject":
        fits = (h % merge == 0) & (w % merge == 0)
        mh, mw = F.when(fits, mh), F.when(fits, mw)
    return t, mh, mw, mh * mw


def group_to_patches(groups: DataFrame, merge: str = "m") -> DataFrame:
    """(…, flat group ``g`` of a merged grid gh x gw) to its merge² patches of the dense grid."""
    per_frame = F.col("gh") * F.col("gw")
    unit = F.col(merge) * F.col(merge)
    each = F.explode(F.sequence(F.lit(0), (unit - 1).cast("int")))
    return groups.withColumn("k", each).withColumn("patch", _div(F.col("g"), per_frame) * per_frame * unit + (F.col("g") % per_frame) * unit + F.col("k")).drop("k")


def scaled_axis(i: Column, source: Column, target: Column) -> Column:
    """Nearest neighbour, half to even: rint(i * (source - 1) / (target - 1)); 0 where either size is 1 or less."""
    near = F.rint(i.cast("double") * (source - 1) / F.nullif(target - 1, F.lit(0)))
    return F.when((target <= 1) | (source <= 1), F.lit(0)).otherwise(F.least(F.greatest(near, F.lit(0.0)), (source - 1).cast("double"))).cast("long")


def dense_grid(videos: DataFrame, t: str = "t", h: str = "h", w: str = "w") -> DataFrame:
    """One row per token of each video's grid: frame, y, x, flat."""
    n = F.col(t) * F.col(h) * F.col(w)
    out = videos.where(n > 0).withColumn("flat", F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))))
    frame, y, x = coordinates(F.col("flat"), F.col(h), F.col(w))
    return out.withColumns({"frame": frame, "y": y, "x": x})


def local_mrope(videos: DataFrame) -> DataFrame:
    """Dense positions (t, h, w, width) of each token of a video's grid."""
    return dense_grid(videos).select("video_id", "flat", F.col("frame").alias("pos_t"), F.col("y").alias("pos_h"), F.col("x").alias("pos_w"), F.col("w").cast("long").alias("width"))


def sparse_mrope(segments: DataFrame) -> DataFrame:
    """(prompt_id, seq, pos_t, pos_h, pos_w) of every token of mixed prompts.

    ``segments`` has prompt_id, ord, length (of text; null for a grid), h, w (of a merged image or
    video frame) and selected (its kept places, row-major; null: all).  Text counts up on all
    three axes.  A grid starts where the text before it ends, and what follows it starts after the
    largest position it holds, so left-out rows and columns at its end take no place.
    """
    places = F.coalesce("selected", F.when(F.col("h") * F.col("w") > 0, F.sequence(F.lit(0).cast("long"), F.col("h") * F.col("w") - 1)).otherwise(F.array().cast("array<bigint>")))
    places = F.when(F.col("length").isNull(), F.array_sort(F.array_distinct(places)))
    x = segments.withColumn("places", places)
    highest = F.array_max(F.transform("places", lambda p: F.greatest(_div(p, F.col("w")), p % F.col("w"))))
    x = x.withColumns({"advance": F.coalesce("length", highest + 1, F.lit(0)), "tokens": F.coalesce(F.col("length"), F.size("places").cast("long"))})
    before = Window.partitionBy("prompt_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({"base": F.coalesce(F.sum("advance").over(before), F.lit(0)), "seq0": F.coalesce(F.sum("tokens").over(before), F.lit(0))}).where("tokens > 0")
    x = x.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1)))
    place, text = F.get("places", F.col("i").cast("int")), F.col("length").isNotNull()
    at = lambda grid: (F.col("base") + F.when(text, F.col("i")).otherwise(grid)).cast("long")
    return x.select("prompt_id", (F.col("seq0") + F.col("i")).cast("long").alias("seq"), at(F.lit(0)).alias("pos_t"), at(_div(place, F.col("w"))).alias("pos_h"), at(place % F.col("w")).alias("pos_w"))


def mrope_delta(positions: DataFrame) -> DataFrame:
    """(prompt_id, delta): where the next token would stand, less the number of tokens."""
    return positions.groupBy("prompt_id").agg((F.max(F.greatest("pos_t", "pos_h", "pos_w")) + 1 - F.count("*")).alias("delta"))


def token_positions(sequences: DataFrame, token: int, ids: str = "ids") -> DataFrame:
    """(…, seq_pos, nth) of each occurrence of a token id in a sequence column."""
    rest = [c for c in sequences.columns if c != ids]
    at = F.filter(F.transform(ids, lambda x, i: F.when(x == token, i)), lambda i: i.isNotNull())
    return sequences.select(*rest, F.posexplode(at).alias("nth", "seq_pos")).select(*rest, F.col("seq_pos").cast("long").alias("seq_pos"), F.col("nth").cast("long").alias("nth"))
