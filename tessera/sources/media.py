"""Frame sampling and subtitles: the arithmetic of video input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def frame_count(seconds: Column, frames: Column, fps: float = 2, least: int = 4, most: int = 512) -> Column:
    """round-half-even(seconds) * fps, from ``least`` to ``most``, at most the even number of frames there are."""
    wanted = F.rint(seconds) * F.lit(float(fps))
    return F.least(F.greatest(wanted, F.lit(float(least))), F.lit(float(most)), (F.floor(frames / 2) * 2).cast("double")).cast("long")


def sampled_frames(videos: DataFrame, fps: float = 2, least: int = 4, most: int = 512) -> DataFrame:
    """(video_id, i, index, seconds): evenly spaced frames of (video_id, frames, rate), first and last included."""
    n = frame_count(F.col("frames") / F.col("rate"), F.col("frames"), fps, least, most)
    x = videos.withColumn("n", n).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    last = F.col("frames") - 1
    at = F.when(F.col("n") > 1, F.rint(F.col("i") * last.cast("double") / (F.col("n") - 1))).otherwise(F.lit(0.0))
    index = F.least(F.greatest(at, F.lit(0.0)), last.cast("double")).cast("long")
    return x.select("video_id", "i", index.alias("index"), (index / F.col("rate")).alias("seconds"))


def frame_span(videos: DataFrame) -> DataFrame:
    """``videos`` (video_id, frames, rate, start, end: seconds or null) with ``first``, ``last`` and
    ``span``, the frames from ``start`` to ``end``.  A span without two frames raises."""
    # Least and greatest pass over nulls, so an open end has to stay null by itself.
    within = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.col(c), F.col("frames") / F.col("rate"))))
    first = F.coalesce(F.ceil(within("start") * F.col("rate")), F.lit(0))
    last = F.least(F.floor(within("end") * F.col("rate")), F.col("frames") - 1)
    x = videos.withColumns({"first": first.cast("long"), "last": last.cast("long")})
    empty = (F.col("start").isNotNull() | F.col("end").isNotNull()) & (F.col("first") >= F.col("last"))
    return x.withColumn("span", F.when(empty, F.raise_error(F.concat(F.lit("no frames in the span of video "), F.col("video_id"))).cast("long")).otherwise(F.col("last") - F.col("first") + 1))


def sampled_in_span(videos: DataFrame, fps: float = 2, least: int = 4, most: int = 512) -> DataFrame:
    """(video_id, i, index, seconds): evenly spaced frames from the first to the last of each video's span."""
    x = frame_span(videos)
    n = frame_count(F.col("span") / F.col("rate"), F.col("span"), fps, least, most)
    x = x.withColumn("n", n).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    step = (F.col("last") - F.col("first")).cast("double") / F.greatest(F.col("n") - 1, F.lit(1))
    index = F.rint(F.col("first") + F.col("i") * step).cast("long")
    return x.select("video_id", "i", index.alias("index"), (index / F.col("rate")).alias("seconds"))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, start_ms, end_ms, text) of SubRip files, one row per cue."""
    cues = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), r"\n\s*\n")).alias("ord", "cue"))
    stamp = r"(\d+):(\d+):(\d+)[,.](\d+)"
    part = lambda i: F.regexp_extract("cue", rf"{stamp}\s*-->\s*{stamp}", i).cast("long")
    ms = lambda o: ((part(o) * 60 + part(o + 1)) * 60 + part(o + 2)) * 1000 + part(o + 3)
    timed = cues.where(F.col("cue").rlike(rf"{stamp}\s*-->\s*{stamp}"))
    text = F.replace(F.trim(F.regexp_replace("cue", rf"(?s)^.*?{stamp}\s*-->\s*{stamp}[^\n]*\n?", "")), F.lit("\n"), F.lit("\\N"))
    return timed.select("path", F.col("ord").cast("long").alias("ord"), ms(1).alias("start_ms"), ms(5).alias("end_ms"), text.alias("text"))


def shown(cues: DataFrame, frames: DataFrame, bucket_s: int = 10) -> DataFrame:
    """Cues (video_id, ord, start_ms, end_ms, text) with a sampled frame (video_id, seconds) strictly inside.

    An interval semi-join: cues are laid out over buckets of ``bucket_s`` seconds, so the join is on equality.
    """
    first, last = F.floor(F.col("start_ms") / (1000 * bucket_s)), F.floor(F.col("end_ms") / (1000 * bucket_s))
    laid = cues.where("end_ms > start_ms").withColumn("bucket", F.explode(F.sequence(first, last)))
    times = frames.select("video_id", "seconds", F.floor(F.col("seconds") / bucket_s).alias("bucket"))
    hit = laid.join(times, ["video_id", "bucket"]).where("start_ms / 1000 < seconds and end_ms / 1000 > seconds").select("video_id", "ord").distinct()
    return cues.join(hit, ["video_id", "ord"], "left_semi")


def subtitle_text(cues: DataFrame) -> DataFrame:
    """(video_id, subtitles): texts in order, line breaks as blanks, blank ones left out."""
    clean = cues.withColumn("text", F.replace("text", F.lit("\\N"), F.lit(" "))).where(F.trim("text") != "")
    rows = clean.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("all"))
    return rows.select("video_id", F.array_join(F.col("all.text"), " ").alias("subtitles"))


def placeholder_spans(rows: DataFrame, merge: int = 2) -> DataFrame:
    """Rows (prompt_id, ord, t, h, w, placeholders) of several videos of a prompt with ``tokens`` and the
    ``offset`` of each one's first token.  A grid that the merge does not divide raises, and so do
    placeholders that are not as many as the tokens."""
    n = (F.col("t") * F.col("h") * F.col("w") / (merge * merge)).cast("long")
    where = F.concat(F.lit("prompt "), F.col("prompt_id"), F.lit(", video "), F.col("ord"))
    checked = (
        F.when((F.col("h") % merge != 0) | (F.col("w") % merge != 0), F.raise_error(F.concat(where, F.lit(f": grid not divisible by {merge}"))).cast("long"))
        .when(F.col("placeholders") != n, F.raise_error(F.concat(where, F.lit(": placeholders and tokens differ"))).cast("long"))
        .otherwise(n)
    )
    return running_offsets(rows.withColumn("tokens", checked), ["prompt_id"], "ord", "tokens", "offset")


def running_offsets(rows: DataFrame, keys: list[str], order: str, size: str, out: str) -> DataFrame:
    """Adds the sum of the sizes before each row: where its part starts."""
    return rows.withColumn(out, F.coalesce(F.sum(size).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
