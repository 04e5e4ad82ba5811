"""Registration of queries, and the parts that their DuckDB SQL shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.sources import tokens as source

DIM = source.DIM
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.from_embeddings(table(spark, sf_dir, "embeddings"))


def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.queries_from_embeddings(table(spark, sf_dir, "embeddings"))


def scored_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with two scores: their first two components."""
    return tokens(spark, sf_dir).select("video_id", "frame", "pos", F.col("vec")[0].alias("s1"), F.col("vec")[1].alias("s2"))


def scratch(spark) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return os.path.join(base, uuid.uuid4().hex)


def out(df: DataFrame, *columns: str, rounded: tuple[str, ...] = ()) -> DataFrame:
    """The columns of a result, some rounded to six places."""
    return df.select(*columns, *(V.rounded(c).alias(c) for c in rounded))


#: Common table expressions by name; each may use those before it.
PARTS = {
    "tokens": """SELECT label::BIGINT AS video_id, pos, pos // 4 AS frame, (pos % 4) // 2 AS y, pos % 2 AS x, vec
        FROM (SELECT label, embedding::DOUBLE[] AS vec, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
                     count(*) OVER (PARTITION BY label) AS n FROM embeddings)
        WHERE pos < 4 * (n // 4)""",
    "queries": """SELECT ((label + 9) % 10)::BIGINT AS video_id, qpos, vec
        FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS qpos, embedding::DOUBLE[] AS vec FROM embeddings) WHERE qpos < 3""",
    "units": "SELECT *, [v / greatest(sqrt(list_dot_product(vec, vec)), 1e-6) for v in vec] AS u FROM tokens",
    "qunits": "SELECT *, [v / greatest(sqrt(list_dot_product(vec, vec)), 1e-6) for v in vec] AS u FROM queries",
    "dims": "SELECT video_id, frame, d, avg(v) AS m FROM (SELECT video_id, frame, unnest(vec) AS v, unnest(range(1, 65)) AS d FROM tokens) GROUP BY ALL",
    "fm": "SELECT video_id, frame, list(m ORDER BY d) AS mean FROM dims GROUP BY ALL",
    "fu": "SELECT video_id, frame, [v / greatest(sqrt(list_dot_product(mean, mean)), 1e-6) for v in mean] AS u FROM fm",
    "whole": "SELECT video_id, list(m ORDER BY d) AS whole FROM (SELECT video_id, d, avg(m) AS m FROM dims GROUP BY ALL) GROUP BY ALL",
    "fs": """SELECT video_id, frame, list_dot_product(mean, whole) / (greatest(sqrt(list_dot_product(mean, mean)), 1e-6) * greatest(sqrt(list_dot_product(whole, whole)), 1e-6)) AS similarity
        FROM fm JOIN whole USING (video_id)""",
    "anchor": "SELECT video_id, frame AS anchor FROM fs QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY similarity DESC, frame) = 1",
    "pairs": """SELECT t.video_id, t.frame, t.pos, a.pos AS other, list_dot_product(t.u, a.u) AS s FROM units t JOIN anchor USING (video_id)
        JOIN units a ON a.video_id = t.video_id AND a.frame = anchor AND abs(a.y - t.y) <= 1 AND abs(a.x - t.x) <= 1 WHERE t.frame != anchor""",
    "best": "SELECT video_id, frame, pos, s AS best, other AS match FROM pairs QUALIFY row_number() OVER (PARTITION BY video_id, pos ORDER BY s DESC, other) = 1",
    "base": "SELECT t.video_id, t.frame, t.pos, anchor, best FROM tokens t JOIN anchor USING (video_id) LEFT JOIN (SELECT video_id, pos, best FROM best) USING (video_id, pos)",
    "retained": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame = anchor ORDER BY best, pos) AS r,
            count(*) OVER (PARTITION BY video_id) AS total, count(*) FILTER (frame = anchor) OVER (PARTITION BY video_id) AS whole FROM base)
        WHERE frame = anchor OR r <= greatest(whole, least(total, round_even(total * 0.25::DOUBLE, 0))) - whole""",
    "anchor2": """SELECT a.video_id, a.frame, b.frame AS anchor FROM fu a JOIN fu b ON a.video_id = b.video_id AND b.frame != a.frame AND abs(b.frame - a.frame) <= 2
        QUALIFY row_number() OVER (PARTITION BY a.video_id, a.frame ORDER BY list_dot_product(a.u, b.u) DESC, b.frame) = 1""",
    "best2": """SELECT t.video_id, t.frame, t.pos, c.anchor, max(list_dot_product(t.u, a.u)) AS best FROM units t JOIN anchor2 c ON c.video_id = t.video_id AND c.frame = t.frame
        JOIN units a ON a.video_id = t.video_id AND a.frame = c.anchor AND abs(a.y - t.y) <= 1 AND abs(a.x - t.x) <= 1 GROUP BY ALL""",
    "relevance": "SELECT t.video_id, t.frame, t.pos, max(list_dot_product(t.u, q.u)) AS relevance FROM units t JOIN qunits q ON q.video_id = t.video_id GROUP BY ALL",
    "corr": "SELECT t.video_id, t.pos, coalesce(list_dot_product(t.u, p.u), 0) AS correlation FROM units t LEFT JOIN units p ON p.video_id = t.video_id AND p.frame = t.frame - 1 AND p.pos = t.pos - 4",
    "echo_full": """SELECT t.video_id, t.pos, coalesce(sum(exp(list_dot_product(t.u, p.u) / 0.1) * list_dot_product(t.u, p.u)) / sum(exp(list_dot_product(t.u, p.u) / 0.1)), 0) AS echo
        FROM units t LEFT JOIN units p ON p.video_id = t.video_id AND p.frame = t.frame - 1 GROUP BY ALL""",
    "echo_near": """SELECT t.video_id, t.pos, coalesce(sum(exp(list_dot_product(t.u, p.u) / 0.1) * list_dot_product(t.u, p.u)) / sum(exp(list_dot_product(t.u, p.u) / 0.1)), 0) AS echo
        FROM units t LEFT JOIN units p ON p.video_id = t.video_id AND p.frame = t.frame - 1 AND abs(p.y - t.y) <= 0 AND abs(p.x - t.x) <= 0 GROUP BY ALL""",
    "echo": "SELECT video_id, frame, pos, relevance, correlation, echo, relevance - correlation - echo AS score FROM relevance JOIN corr USING (video_id, pos) JOIN echo_full USING (video_id, pos)",
    "echo_budget": """SELECT *, CASE WHEN frame = 0 THEN relevance ELSE score END AS value, greatest(1, least(total, round_even(total * 0.25::DOUBLE, 0)))::BIGINT AS budget
        FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS total, max(frame) OVER (PARTITION BY video_id) + 1 AS frames FROM echo)""",
    "curvature": """SELECT video_id, frame, CASE WHEN a IS NULL OR b IS NULL THEN 1.0 ELSE 1 - list_dot_product(i, o) / (greatest(sqrt(list_dot_product(i, i)), 1e-6) * greatest(sqrt(list_dot_product(o, o)), 1e-6)) END AS curvature
        FROM (SELECT *, [u[k] - coalesce(a[k], 0) for k in range(1, 65)] AS i, [coalesce(b[k], 0) - u[k] for k in range(1, 65)] AS o
              FROM (SELECT *, lag(u) OVER w AS a, lead(u) OVER w AS b FROM fu WINDOW w AS (PARTITION BY video_id ORDER BY frame)))""",
    "vweights": """SELECT video_id, frame, exp(curvature) / sum(exp(curvature)) OVER (PARTITION BY video_id) AS weight, count(*) OVER (PARTITION BY video_id) AS t FROM curvature""",
    "vraw": """SELECT *, weight / greatest(sum(weight) OVER (PARTITION BY video_id), 1e-6) * (budget - t) AS raw FROM (SELECT *, greatest(greatest(1, round_even(4 * t * 0.4::DOUBLE, 0)), t)::BIGINT AS budget FROM vweights)""",
    "vgot": "SELECT *, 1 + least(floor(raw), 3)::BIGINT AS got FROM vraw",
    "vbudget": """SELECT video_id, frame, weight, (got + least(4 - got, greatest(0, spare - before)))::BIGINT AS k
        FROM (SELECT *, budget - sum(got) OVER (PARTITION BY video_id) AS spare,
                     coalesce(sum(4 - got) OVER (PARTITION BY video_id ORDER BY CASE WHEN got < 4 THEN raw - floor(raw) ELSE -1 END DESC, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM vgot)""",
    "vscores": """SELECT *, outlier + (size - min(size) OVER w) / (max(size) OVER w - min(size) OVER w + 1e-6) AS score
        FROM (SELECT t.video_id, t.frame, pos, sqrt(list_dot_product(vec, vec)) AS size,
                     1 - list_dot_product(vec, f.u) / (greatest(sqrt(list_dot_product(vec, vec)), 1e-6) * greatest(sqrt(list_dot_product(f.u, f.u)), 1e-6)) AS outlier
              FROM tokens t JOIN fu f USING (video_id, frame)) WINDOW w AS (PARTITION BY video_id, frame)""",
    "kde": "SELECT a.video_id, a.frame, a.pos, sum(exp(-(list_distance(a.vec, b.vec) ** 2) / 2)) AS density FROM tokens a JOIN tokens b ON a.video_id = b.video_id GROUP BY ALL",
    "chosen": "SELECT * FROM (SELECT *, 1 / density AS diversity, row_number() OVER (PARTITION BY video_id ORDER BY 1 / density DESC, pos) AS r, count(*) OVER (PARTITION BY video_id) AS total FROM kde) WHERE r <= greatest(1, floor(total * 0.25::DOUBLE))",
    "trans": """SELECT video_id, frame, diff_pos, diff_match FROM (SELECT a.video_id, a.frame, avg(list_distance(a.vec, b.vec)) AS diff_pos FROM tokens a JOIN tokens b ON b.video_id = a.video_id AND b.pos = a.pos + 4 GROUP BY ALL)
        JOIN (SELECT video_id, frame, avg(d) AS diff_match FROM (SELECT a.video_id, a.frame, a.pos, min(list_distance(a.vec, b.vec)) AS d FROM tokens a JOIN tokens b ON b.video_id = a.video_id AND b.frame = a.frame + 1 GROUP BY ALL) GROUP BY ALL) USING (video_id, frame)""",
    "bounds": """SELECT video_id, frame, diff, delta, pct, diff > 2.8 OR coalesce(delta > 0.1 AND pct > 0.03, false) AS boundary, greatest(diff / 2.8, CASE WHEN delta IS NOT NULL THEN least(delta / 0.1, pct / 0.03) END) AS strength
        FROM (SELECT *, CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN greatest(diff - p, diff - q) END AS delta,
                     CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN greatest((diff - p) / greatest(p, 1e-6), (diff - q) / greatest(q, 1e-6)) END AS pct
              FROM (SELECT *, lag(diff) OVER w AS p, lead(diff) OVER w AS q FROM (SELECT *, diff_pos + diff_match AS diff FROM trans) WINDOW w AS (PARTITION BY video_id ORDER BY frame)))""",
    "intervals": """SELECT video_id, frame, sum(CASE WHEN boundary THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame)::BIGINT AS interval
        FROM (SELECT DISTINCT video_id, frame FROM tokens) LEFT JOIN (SELECT video_id, frame + 1 AS frame, boundary FROM bounds) USING (video_id, frame)""",
    "assigned": """SELECT t.video_id, t.pos, r.pos AS rep FROM (SELECT * FROM units JOIN intervals USING (video_id, frame)) t
        JOIN (SELECT * FROM units JOIN intervals USING (video_id, frame) SEMI JOIN chosen USING (video_id, pos)) r ON r.video_id = t.video_id AND r.interval = t.interval
        QUALIFY row_number() OVER (PARTITION BY t.video_id, t.pos ORDER BY r.pos = t.pos DESC, list_dot_product(t.u, r.u) DESC, r.pos) = 1""",
    "diverse": "SELECT video_id, frame, pos, 1 / density AS diversity FROM kde",
    "repair": """SELECT *, own AND NOT (spared AND row_number() OVER (PARTITION BY video_id, spared ORDER BY interval, worst) <= empty) OR held = 0 AND best = 1 AS kept
        FROM (SELECT *, own AND worst < held AS spared, (SELECT count(*) FROM (SELECT i.video_id, i.interval FROM spans i LEFT JOIN chosen c USING (video_id, frame) GROUP BY ALL HAVING count(c.pos) = 0) e WHERE e.video_id = x.video_id) AS empty
              FROM (SELECT d.video_id, d.frame, s.interval, d.pos, d.diversity, c.pos IS NOT NULL AS own, count(c.pos) OVER (PARTITION BY d.video_id, s.interval) AS held,
                           row_number() OVER (PARTITION BY d.video_id, s.interval, c.pos IS NOT NULL ORDER BY d.diversity, d.pos DESC) AS worst, row_number() OVER (PARTITION BY d.video_id, s.interval, c.pos IS NOT NULL ORDER BY d.diversity DESC, d.pos) AS best
                    FROM diverse d JOIN spans s USING (video_id, frame) LEFT JOIN chosen c ON c.video_id = d.video_id AND c.pos = d.pos) x)""",
    "weights": "SELECT video_id, pos, rep, (1 / density) / sum(1 / density) OVER (PARTITION BY video_id, rep) AS weight FROM assigned JOIN kde USING (video_id, pos)",
    "fsim": "SELECT a.video_id, a.frame, list_dot_product(a.u, p.u) AS similarity FROM fu a LEFT JOIN fu p ON p.video_id = a.video_id AND p.frame = a.frame - 1",
    "segments": """SELECT video_id, frame, similarity, sum(CASE WHEN cut OR (similarity IS NOT NULL AND r <= least(t, 6) - 1 - cuts) THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame)::BIGINT AS segment
        FROM (SELECT *, row_number() OVER (PARTITION BY video_id, cut, similarity IS NULL ORDER BY similarity, frame) AS r, count(*) OVER (PARTITION BY video_id) AS t, count(*) FILTER (cut) OVER (PARTITION BY video_id) AS cuts
              FROM (SELECT *, coalesce(similarity < -0.1, false) AS cut FROM fsim))""",
    "matched": """SELECT a.video_id, a.segment, a.frame, a.pos, p.pos AS parent, list_dot_product(a.u, p.u) AS best
        FROM (SELECT * FROM units JOIN segments USING (video_id, frame)) a LEFT JOIN (SELECT * FROM units JOIN segments USING (video_id, frame)) p ON p.video_id = a.video_id AND p.segment = a.segment AND p.frame = a.frame - 1
        QUALIFY row_number() OVER (PARTITION BY a.video_id, a.pos ORDER BY list_dot_product(a.u, p.u) DESC NULLS LAST, p.pos) = 1""",
    "merges": """SELECT *, coalesce(best > effective, false) AS merge
        FROM (SELECT *, CASE WHEN total - hits < lower THEN CASE WHEN total - lower <= 0 THEN 'inf'::DOUBLE ELSE coalesce(greatest(max(CASE WHEN r = total - lower THEN best END) OVER w, -1 + 1e-6), -1 + 1e-6) END ELSE 0.2 END AS effective
              FROM (SELECT *, count(*) OVER v AS total, count(*) FILTER (best > 0.2) OVER v AS hits, 3 * count(DISTINCT frame) OVER v AS lower,
                           row_number() OVER (PARTITION BY video_id, segment ORDER BY best DESC NULLS LAST, pos) AS r FROM matched WINDOW v AS (PARTITION BY video_id, segment)) WINDOW w AS (PARTITION BY video_id, segment))""",
}


def sql(names: str, last: str) -> str:
    """A statement with the named parts before it."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({PARTS[n]})" for n in names.split()) + ("" if last.lstrip().startswith(",") else " ") + last


def r(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) + 0.0 AS {name or x}"
