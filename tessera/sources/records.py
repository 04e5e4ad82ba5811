"""Benchmark questions, JSON lines, dumps, guides, score archives and reports."""

from __future__ import annotations

import io

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Schemas as DDL, which needs no session.
QUESTION = (
    "question_id string, videoID string, duration string, domain string, sub_category string, task_type string, question string, options array<string>, answer string"
)
PREDICTION = (
    "question_id string, annotation struct<question:string,choices:map<string,string>,answer:string,domain:string,category:string,duration:string,sub_category:string,task_category:string,task_type:string>, result struct<gen:string,gen_raw:string>"
)
SELECTION = "question_id string, method string, drop_ratio double, dense_token_count int, keep_indices array<int>, drop_indices array<int>, grid_thw array<int>"
GUIDE = "sample_id string, video string, t long, gh long, gw long, groups array<long>"
DURATIONS = ("short", "medium", "long")


def questions(spark: SparkSession, path: str, duration: str | None = None) -> DataFrame:
    """Benchmark questions of one duration, or of all three; the filter reaches the scan."""
    return of_duration(spark.read.parquet(path), duration)


def annotated(df: DataFrame) -> DataFrame:
    """Questions with choices MAP<letter, text> from "A. text" options and the 0-based answer; answers outside A to E raise."""
    text = lambda o: F.trim(F.regexp_replace(o, r"^\s*[A-Z]\s*[.)]\s*", ""))
    entries = F.transform("options", lambda o, i: F.struct(F.char(i + 65).alias("key"), text(o).alias("value")))
    answer = F.when(F.col("answer").isin(*"ABCDE"), F.ascii("answer") - 65).otherwise(F.raise_error(F.concat(F.lit("answer out of range: "), F.coalesce("answer", F.lit("null")))).cast("int"))
    return df.withColumn("choices", F.map_from_entries(entries)).withColumn("answer_id", answer.cast("long"))


def read_jsonl(spark: SparkSession, path: str, schema, tolerant: bool = False) -> DataFrame:
    """JSON lines; ``tolerant`` drops lines that do not parse."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(rows: DataFrame, accuracy: DataFrame, path: str) -> None:
    """Rows as CSV and as TSV, the accuracy table as JSON."""
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/rows_csv")
    rows.write.mode("overwrite").option("header", True).option("sep", "\t").csv(f"{path}/rows_tsv")
    accuracy.write.mode("overwrite").json(f"{path}/accuracy")


def write_ordered_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """A summary as CSV with a fixed order of columns."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def _video_of(meta) -> Column:
    """sample_id, else the video's file name without ending."""
    return F.coalesce(meta["sample_id"], F.regexp_replace(F.element_at(F.split(meta["video"], "/"), -1), r"\.[^.]*$", ""))


def members(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """(path, content) of the files below ``path`` that end so, and of such members of ``.zip`` files."""

    def go(batches):
        import zipfile

        import pandas as pd

        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                if p.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(f"{p}/{name}", z.read(name)) for name in sorted(z.namelist()) if name.endswith(ending)]
                elif p.endswith(ending):
                    rows.append((p, content))
            yield pd.DataFrame(rows, columns=["path", "content"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{{{ending},.zip}}").load(path)
    return files.select("path", "content").mapInPandas(go, "path string, content binary")


def guides(spark: SparkSession, path: str) -> DataFrame:
    """One stored guide per id from ``*.meta.json`` files or members of zip files; the first by path wins,
    metas without an id are left out, and ``index`` numbers the ids in order."""
    raw = members(spark, path, ".meta.json").select("path", F.from_json(F.decode("content", "UTF-8"), GUIDE).alias("meta"))
    x = raw.select("path", "meta.*", _video_of(F.col("meta")).alias("video_id")).where("video_id is not null and video_id != ''")
    first = x.withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy("path"))).where("n = 1").drop("n")
    order = first.select("video_id").sort("video_id")  # an index of guides, one row for each
    return first.join(order.withColumn("index", (F.row_number().over(Window.orderBy("video_id")) - 1).cast("long")), "video_id")


def arrays(spark: SparkSession, path: str, ending: str = ".npy") -> DataFrame:
    """(path, key, values, ndim) of the arrays in ``.npy`` or ``.npz`` files, or members of zip files; of two dimensions, the mean over the first."""

    def go(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                got = np.load(io.BytesIO(content), allow_pickle=False)
                for key, x in ((k, got[k]) for k in got.files) if hasattr(got, "files") else [("", got)]:
                    x = np.asarray(x, float)
                    rows.append((p, key, (x.mean(0) if x.ndim == 2 else x.ravel()).tolist(), x.ndim))
            yield pd.DataFrame(rows, columns=["path", "key", "values", "ndim"])

    return members(spark, path, ending.lstrip("*")).mapInPandas(go, "path string, key string, values array<double>, ndim int")


def _called(name: str):
    return lambda a: a["key"] == name


#: The arrays of a score archive, by their short names.
SCORE_ARRAYS = {"score": "score", "t": "temporal_grid_indices", "y": "y_grid_indices", "x": "x_grid_indices"}


def score_table(loaded: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """(question_id, pos, score, t, y, x) from archives with arrays score, t, y and x (``names``: what they are called
    there).  These raise: an array that is missing or of another length, scores of over two dimensions or
    not finite, and two archives of one name."""
    names = names or {c: c for c in "score t y x".split()}
    called = F.regexp_extract("path", r"([^/]+)\.npz$", 1)
    x = loaded.withColumn("question_id", called).groupBy("question_id").agg(
        F.count_distinct("path").alias("files"), F.collect_list(F.struct("key", "values", "ndim")).alias("of")
    )
    for c, name in names.items():
        x = x.withColumn(c, F.get(F.filter("of", _called(name)), F.lit(0)))
    where = F.concat(F.lit("archive "), F.col("question_id"))
    fail = lambda text: F.raise_error(F.concat(where, F.lit(text))).cast("boolean")
    short = F.lit(False)
    for c in "tyx":
        short = short | (F.size(F.col(f"{c}.values")) != F.size("score.values"))
    missing = F.lit(False)
    for c in names:
        missing = missing | F.col(c).isNull()
    sane = (
        F.when(F.col("files") > 1, fail(": two files of this name")).when(missing, fail(": an array is missing")).when(F.col("score.ndim") > 2, fail(": scores of more than two dimensions"))
        .when(short, fail(": arrays of unlike lengths")).when(F.exists("score.values", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), fail(": scores that are not finite")).otherwise(F.lit(True))
    )
    zipped = x.where(sane).select("question_id", F.posexplode(F.arrays_zip(*(F.col(f"{c}.values").alias(c) for c in ("score", "t", "y", "x")))).alias("pos", "v"))
    return zipped.select("question_id", F.col("pos").cast("long").alias("pos"), "v.score", *(F.col(f"v.{c}").cast("long").alias(c) for c in "tyx"))


def write_arrays(rows: DataFrame, key: str, columns: list[str], path: str) -> DataFrame:
    """One ``.npz`` archive for each row in the folder ``path`` (shared by all tasks), named by ``key``; a file
    appears whole or not at all.  Gives (key, file)."""

    def go(batches):
        import os
        import uuid

        import numpy as np
        import pandas as pd

        folder = path.removeprefix("file://")
        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                name = f"{folder}/{getattr(row, key)}.npz"
                part = f"{folder}/.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    np.savez(f, **{c: np.asarray(getattr(row, c)) for c in columns})
                os.replace(part, name)
                out.append((str(getattr(row, key)), name))
            yield pd.DataFrame(out, columns=["key", "file"])

    return rows.select(key, *columns).mapInPandas(go, "key string, file string")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, which indexes must not have."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unique(df: DataFrame, key: str) -> DataFrame:
    """``df``; a key that occurs more than once raises."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("n_", n).where(F.when(F.col("n_") > 1, F.raise_error(F.concat(F.lit("repeated: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))).drop("n_")


def of_duration(df: DataFrame, duration: str | None = None) -> DataFrame:
    """Rows of one duration, or of all three."""
    return df.where(F.col("duration").isin(*(DURATIONS if duration is None else (duration,))))


def frame_similarities(similarities: DataFrame, grids: DataFrame) -> DataFrame:
    """(video_id, frame_grid_index, similarity, is_anchor, grid_thw, merged_grid_hw, tokens_per_frame) of similarities
    (video_id, frame, similarity) and grids (video_id, t, h, w, merge): the anchor is the most similar frame (ties: earlier)."""
    first = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("similarity"), "frame")) == 1
    mh, mw = (F.floor(F.col(c) / F.col("merge")).cast("long") for c in "hw")
    grid = F.concat_ws("x", *(F.col(c).cast("string") for c in "thw"))
    x = similarities.join(grids, "video_id").withColumn("is_anchor", first)
    return x.select("video_id", F.col("frame").alias("frame_grid_index"), "similarity", "is_anchor", grid.alias("grid_thw"), F.concat_ws("x", mh.cast("string"), mw.cast("string")).alias("merged_grid_hw"), (mh * mw).alias("tokens_per_frame"))


def selection_records(kept: DataFrame, totals: DataFrame, method: str) -> DataFrame:
    """Records (video_id, method, drop_ratio, dense_token_count, keep_indices, drop_indices) of a selection
    (video_id, pos) against the totals (video_id, n): sorted, once each; a place outside raises."""
    sane = kept.select("video_id", "pos").distinct().join(totals, "video_id")
    sane = sane.withColumn("pos", F.when((F.col("pos") >= 0) & (F.col("pos") < F.col("n")), F.col("pos")).otherwise(F.raise_error(F.lit("index out of range")).cast("long")))
    keep = sane.groupBy("video_id").agg(F.array_sort(F.collect_list("pos")).alias("keep_indices"))
    x = totals.join(keep, "video_id", "left").withColumn("keep_indices", F.coalesce("keep_indices", F.array().cast("array<bigint>")))
    every = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    x = x.withColumn("drop_indices", F.array_except(every, "keep_indices"))
    ratio = F.when(F.col("n") > 0, F.size("drop_indices") / F.col("n")).otherwise(F.lit(0.0))
    return x.select("video_id", F.lit(method).alias("method"), ratio.alias("drop_ratio"), F.col("n").alias("dense_token_count"), "keep_indices", "drop_indices")


def write_selections(records: DataFrame, path: str) -> None:
    records.write.mode("append").partitionBy("method").json(path)


def length_check(plan: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Videos whose number of rows differs between the plan and any other table (all keyed by video_id)."""
    out = plan.groupBy("video_id").agg(F.count("*").alias("plan"))
    for name, df in others.items():
        out = out.join(df.groupBy("video_id").agg(F.count("*").alias(name)), "video_id", "full")
    bad = F.lit(False)
    for name in others:
        bad = bad | ~F.col("plan").eqNullSafe(F.col(name))
    return out.where(bad)


def run_metadata(spark: SparkSession, **settings) -> DataFrame:
    """One row that describes a run: the session, the machine's Python, the commit of the code if it is in a repository, and the settings."""
    import platform
    import subprocess
    from pathlib import Path

    got = subprocess.run(["git", "rev-parse", "HEAD"], cwd=Path(__file__).parent, capture_output=True, text=True, check=False)
    rows = {
        "spark_version": spark.version, "application": spark.sparkContext.applicationId, "python_version": platform.python_version(), "platform": platform.platform(),
        "commit": got.stdout.strip() or "unknown", **{k: str(v) for k, v in settings.items()},
    }
    return spark.createDataFrame([tuple(rows.values())], list(rows))
