"""Smaller parts: gathers, positions, reference sets, query rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import grid
from tessera.functions import text as T
from tessera.operators import evaluation, overlap, similarity
from tessera.plans import apply


def test_gather_keeps_layers_and_order(spark):
    t = spark.createDataFrame([(1, i, i // 2, [float(i)], [i * 2.0]) for i in range(4)], "video_id long, pos long, frame long, vec array<double>, deep_0 array<double>")
    plan = spark.createDataFrame([(1, 3, 1), (1, 0, 0)], "video_id long, pos long, frame long")
    got = apply.gather(t, plan).orderBy("out").collect()
    assert [(r.pos, r.vec, r.deep_0) for r in got] == [(0, [0.0], [0.0]), (3, [3.0], [6.0])]
    assert sorted((r.frame, r.kept) for r in apply.kept_per_frame(t, plan).collect()) == [(0, 1), (1, 1)]
    v = spark.createDataFrame([(1, 2, 1, 2)], "video_id long, t long, h long, w long")
    assert sorted((r.flat, r.pos_t, r.pos_w) for r in apply.positions(grid.local_mrope(v), plan).collect()) == [(0, 0, 0), (3, 1, 1)]


def test_positions_of_a_token(spark):
    x = spark.createDataFrame([(1, [5, 7, 5]), (2, [7]), (3, None)], "id long, ids array<int>")
    assert sorted(tuple(r) for r in grid.token_positions(x, 5).collect()) == [(1, 0, 0), (1, 2, 1)]


def test_stored_sets_come_first(spark):
    s = spark.createDataFrame([(v, i, float(i)) for v in (1, 2) for i in range(5)], "video_id long, pos long, score double")
    stored = spark.createDataFrame([(1, 0)], "video_id long, pos long")
    got = sorted(tuple(r) for r in overlap.reference_set(s, stored, 0.5).collect())
    assert got == [(1, 0), (2, 3), (2, 4)]  # round(2.5) is 2
    assert len([r for r in overlap.reference_set(s, stored, 0.5, half_up=True).collect() if r.video_id == 2]) == 3
    have = overlap.missing(s, stored, ["video_id"]).collect()
    assert [r.video_id for r in have] == [2]


def test_shared_queries_serve_the_rest(spark):
    q = spark.createDataFrame([(1, 0, [1.0]), (None, 0, [2.0]), (None, 1, [3.0])], "video_id long, qpos long, vec array<double>")
    v = spark.createDataFrame([(1,), (2,)], "video_id long")
    assert sorted(tuple(r) for r in similarity.query_rows(q, v).collect()) == [(1, 0, [1.0]), (2, 0, [2.0]), (2, 1, [3.0])]


def test_reports(spark):
    assert evaluation.throughput(4.0, 8) == {"total_s": 4.0, "s_per_sample": 0.5, "samples_per_s": 2.0}
    assert evaluation.throughput(0.0, 0)["s_per_sample"] is None
    row = spark.range(1).select(T.judge_prompt(F.lit("Q?"), T.choices_of(F.lit("red"), F.lit(None).cast("string"), F.lit("blue")), F.lit("x"))).first()[0]
    assert "A. red\nC. blue\n" in row and row.endswith("Letter: ")
