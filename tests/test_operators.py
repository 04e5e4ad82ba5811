"""Known answers, and properties of what SQL cannot say."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import budgets, grid
from tessera.functions import text as T
from tessera.operators import evaluation, filters, flow, ranking, similarity, statistics, summaries
from tessera.plans import codec, echoprune, flashvid, kitoke, mmtok, ttf, vflow
from tessera.sources import media, records


def make_tokens(spark, frames, w=3):
    rows = []
    for f, vectors in enumerate(frames):
        n = len(vectors)
        rows += [(1, f * n + i, f, i // w, i % w, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "video_id long, pos long, frame long, y long, x long, vec array<double>")


def pairs(df, *columns):
    return {tuple(r[c] for c in columns[:-1]): r[columns[-1]] for r in df.collect()}


def test_relevance_and_mask(spark):
    t = make_tokens(spark, [[(1, 0), (0, 1), (1, 1)]])
    q = spark.createDataFrame([(1, 0, [1.0, 0.0], True), (1, 1, [0.0, 1.0], True)], "video_id long, qpos long, vec array<double>, valid boolean")
    assert list(pairs(similarity.relevance(t, q), "pos", "relevance").values()) == pytest.approx([1, 1, 1 / math.sqrt(2)])
    q = q.withColumn("valid", F.col("qpos") == 0)
    assert list(pairs(similarity.relevance(t, q), "pos", "relevance").values()) == pytest.approx([1, 0, 1 / math.sqrt(2)])


def test_identical_frames_keep_the_anchor(spark):
    frame = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (0, 1, 1), (1, 0, 1)]
    t = make_tokens(spark, [frame] * 4)
    kept = ttf.plan(t, 3, mode="threshold", threshold=0.7)
    assert ttf.summary(t, kept).select("anchor", "kept").first() == (0, 6)


def test_unlike_frames_keep_all(spark):
    t = make_tokens(spark, [[(1, 0, 0, 0), (0, 1, 0, 0)], [(0, 0, 1, 0), (0, 0, 0, 1)]], w=2)
    assert ttf.plan(t, 4, mode="threshold", threshold=0.7).count() == 4


def test_kernel_density(spark):
    t = make_tokens(spark, [[(0, 0), (3, 4), (6, 8)]])
    assert pairs(similarity.kernel_density(t, 25.0), "pos", "density")[(0,)] == pytest.approx(1 + math.exp(-1) + math.exp(-4))


def test_intervals_cut_once(spark):
    rows = [(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip((1, 50, 1, 110), (1, 30, 1, 0)))]
    tr = spark.createDataFrame(rows, "video_id long, frame long, diff_pos double, diff_match double")
    b = kitoke.boundaries(tr, tau=110.0, delta=70.0, relative=0.4)
    assert [r.frame + 1 for r in b.where("boundary").collect()] == [2]


def test_repair_swaps_in_and_out(spark):
    div = spark.createDataFrame([(1, i // 2, i, v) for i, v in enumerate((1.0, 2.0, 0.1, 0.2, 3.0, 0.5))], "video_id long, frame long, pos long, diversity double")
    spans = spark.createDataFrame([(1, i, i) for i in range(3)], "video_id long, frame long, interval long")
    chosen = lambda *p: spark.createDataFrame([(1, i) for i in p], "video_id long, pos long")
    pos = lambda df: sorted(r.pos for r in df.collect())
    assert pos(kitoke.repaired(div, spans, chosen(1, 4, 5))) == [1, 3, 4]
    assert pos(kitoke.repaired(div, spans, chosen(0, 1, 2, 4), "paper_strict")) == [0, 1, 2, 4]
    for policy, few in (("paper_strict", (1, 4, 5)), ("repair_swap", (4, 5))):  # two tokens cannot cover three intervals
        with pytest.raises(Exception, match="empty intervals"):
            kitoke.repaired(div, spans, chosen(*few), policy).collect()
    with pytest.raises(ValueError):
        kitoke.repaired(div, spans, chosen(1), "other")


def plain_repair(interval, diversity, selected):
    """One swap after the other: from the first interval with two or more, its least diverse (ties: later) goes."""
    selected = list(selected)
    members = {e: [i for i, x in enumerate(interval) if x == e] for e in sorted(set(interval))}
    for e, mine in members.items():
        if not any(selected[i] for i in mine):
            donor = next(m for m in members.values() if sum(selected[i] for i in m) > 1)
            low = min((i for i in donor if selected[i]), key=lambda i: (diversity[i], -i))
            selected[max(mine, key=lambda i: (diversity[i], -i))], selected[low] = True, False
    return [i for i, s in enumerate(selected) if s]


def test_repair_equals_one_swap_after_the_other(spark):
    rng = np.random.default_rng(4)
    div, spans, chosen, expected = [], [], [], {}
    for v in range(40):
        n = int(rng.integers(6, 30))
        interval = np.sort(rng.integers(0, 5, n)).tolist()
        values = rng.integers(0, 6, n).astype(float).tolist()  # many ties
        selected = np.zeros(n, bool)
        selected[rng.choice(n, max(5, n // 3), replace=False)] = True
        div += [(v, i, i, values[i]) for i in range(n)]
        spans += [(v, i, interval[i]) for i in range(n)]
        chosen += [(v, i) for i in np.flatnonzero(selected).tolist()]
        expected[v] = plain_repair(interval, values, selected.tolist())
    got = kitoke.repaired(
        spark.createDataFrame(div, "video_id long, frame long, pos long, diversity double"), spark.createDataFrame(spans, "video_id long, frame long, interval long"), spark.createDataFrame(chosen, "video_id long, pos long")
    ).collect()
    assert {v: sorted(r.pos for r in got if r.video_id == v) for v in expected} == expected


def test_assignment_within_interval(spark):
    t = make_tokens(spark, [[(1, 0)], [(0.9, 0.1)], [(0, 1)], [(1, 0)]], w=1)
    spans = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1)], "video_id long, frame long, interval long")
    chosen = spark.createDataFrame([(1, 0), (1, 2)], "video_id long, pos long")
    assert pairs(kitoke.assignments(t, spans, chosen), "pos", "rep") == {(0,): 0, (1,): 0, (2,): 2, (3,): 2}


def test_greedy_cover():
    # Alone the columns cover 1.2, 1.1 and 1.5; beside the last the first adds 0.5, the second 0.4.
    taken, trace = mmtok.greedy_exact(np.array([[0.9, 0.1, 0.4], [0.1, 0.8, 0.4], [0.2, 0.2, 0.7]]), 2)
    assert taken.tolist() == [2, 0] and trace.tolist() == pytest.approx([1.5, 2.0])


def test_cosine_distance_of_zero_is_finite(spark):
    d = pairs(similarity.cosine_distances(make_tokens(spark, [[(1, 0), (0, 1), (-1, 0), (0, 0)]], w=4)), "pos", "other", "distance")
    assert [d[(0, i)] for i in range(3)] == pytest.approx([0, 1, 2])
    assert all(math.isfinite(x) for x in d.values())


def test_frame_split_and_retention(spark):
    x = spark.createDataFrame([(8,), (9,)], "n long")
    first = lambda n, *a: x.where(F.col("n") == n).select(budgets.frame_split(F.col("n"), *a)[0]).first()[0]
    assert [first(8, r, 0.7) for r in (0.125, 0.5, 1.0)] == [1, 4, 8]
    assert first(8, 0.2, 0.7, 1.25) == 2 and first(9, 0.2, 0.7) == 2
    assert budgets.hybrid_retention(36, 10, 1.25) == pytest.approx((36 - 12.5) / (1.25 * 26))
    with pytest.raises(ValueError):
        budgets.hybrid_retention(4, 4, 1.0)


def test_path_mass_and_responsibility(spark):
    a = spark.createDataFrame([(1, 2, 0, 0.5), (1, 2, 1, 0.2), (1, 4, 2, 0.4)], "question_id long, q long, k long, a double")
    t = spark.createDataFrame([(1, 4)], "question_id long, target long")
    h = pairs(flow.reachability(a, t), "pos", "h")
    assert [h[(i,)] for i in range(5)] == pytest.approx([0.2, 0.08, 0.4, 0, 1])
    r = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0), (1, 2, 5.0)], "question_id long, pos long, h double")
    v = spark.createDataFrame([(1, 0), (1, 2)], "question_id long, pos long")
    assert pairs(flow.responsibility(r, v), "pos", "responsibility") == pytest.approx({(0,): 2 / 7, (2,): 5 / 7})


def test_causality_and_tokens(spark):
    a = spark.createDataFrame([(1, 0, 1, 0.1), (2, 1, 0, 0.1)], "question_id long, q long, k long, a double")
    assert [r.question_id for r in flow.causality_violations(a).collect()] == [1]
    x = spark.createDataFrame([([5, 0, 6, 9, 7],)], "ids array<int>")
    assert x.select(flow.stripped(F.col("ids"), 9, 0)).first()[0] == [5, 6]
    lp = spark.createDataFrame([(1, 0, 7, -0.5), (1, 1, 8, -1.5)], "question_id long, pos long, token long, logprob double")
    an = spark.createDataFrame([(1, 0, 7), (1, 1, 8), (2, 0, 1)], "question_id long, pos long, token long")
    assert pairs(flow.answer_logprob(lp, an), "question_id", "total") == {(1,): -2.0, (2,): None}


def test_outcomes_are_three_valued(spark):
    x = spark.createDataFrame([("A", "B", "A", -1.0, -2.0), ("A", None, "A", -1.0, None)], "baseline_answer string, answer string, truth string, baseline_logprob double, logprob double")
    got = [(r.answer_changed, r.correct_to_wrong, r.logprob_drop) for r in flow.outcomes(x).collect()]
    assert got == [(True, True, 1.0), (None, None, None)]


def test_ranked_sets_and_random(spark):
    s = spark.createDataFrame([(1, i, i // 2, v) for i, v in enumerate((0.1, 0.5, 0.2, 0.4, 0.3))], "video_id long, pos long, frame long, s double")
    pos = lambda df: sorted(r.pos for r in df.collect())
    assert pos(ranking.ranked_set(s, ["video_id"], "s", 0.4)) == [1, 3]
    assert pos(ranking.ranked_set(s, ["video_id"], "s", 0.4, "bottom")) == [0, 2]
    assert pos(ranking.random_global(s, ["video_id"], 0.4, 3)) == pos(ranking.random_global(s, ["video_id"], 0.4, 3))
    top = ranking.ranked_set(s, ["video_id"], "s", 0.4)
    hist = lambda df: sorted((r.frame, r["count"]) for r in df.groupBy("frame").count().collect())
    assert hist(ranking.random_matched(s, top, ["video_id"], "frame")) == hist(top)


def test_statistics_edge_cases(spark):
    x = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 2.0), (2, 1.0, 1.0), (2, 2.0, 4.0), (2, 3.0, 9.0)], "g long, a double, b double")
    assert pairs(statistics.spearman(x, ["g"], "a", "b"), "g", "spearman") == {(1,): None, (2,): pytest.approx(1.0)}
    z = spark.createDataFrame([(1, 0.0), (1, 0.0)], "g long, v double")
    assert statistics.gini(z, ["g"], "v").first().gini == 0


def test_bootstrap_covers_the_mean(spark):
    x = spark.createDataFrame([(1, float(v)) for v in np.random.default_rng(0).normal(3, 1, 400)] + [(2, float("nan"))], "g long, v double")
    got = summaries.bootstrap_interval(x, ["g"], "v", resamples=300).collect()
    assert len(got) == 1 and got[0].low < got[0].mean < got[0].high and got[0].high - got[0].low < 0.4


def test_pivotal_sample_is_exact():
    rng = np.random.default_rng(1)
    pi = np.clip(rng.random(50), 0.05, 0.95)
    pi *= 20 / pi.sum()
    hits = np.zeros(50)
    for _ in range(400):
        got = kitoke.pivotal_sample(pi, rng)
        assert len(got) == 20
        hits[got] += 1
    assert np.abs(hits / 400 - pi).max() < 0.15


def test_diverse_tokens_and_density_peaks():
    x = np.array([[1, 0], [0.99, 0.1], [0, 1], [-1, 0]], float)
    assert sorted(flashvid.diverse_tokens(x, np.ones(4), 3, "div").tolist()) != [0, 1, 2]
    centres, cluster = flashvid.density_peaks(np.array([[0, 0], [0.1, 0], [0.25, 0], [5, 5], [5.05, 5], [5.2, 5]], float), 2, 3)
    assert centres.tolist() == [1, 4] and cluster.tolist() == [0, 0, 0, 1, 1, 1]


def test_flash_counts_and_mmtok_sizes(spark, data):
    from tessera.catalog import base

    t = base.tokens(spark, data)
    sizes = {r.video_id: r.n for r in t.groupBy("video_id").agg(F.count("*").alias("n")).collect()}
    kept = flashvid.compress(t, 64, ratio=0.5, segment_threshold=-0.1, merge_threshold=0.2)
    assert {r.video_id: r.n for r in kept.groupBy("video_id").agg(F.count("*").alias("n")).collect()} == {v: n // 2 for v, n in sizes.items()}


def test_exact_query_covers_all_tokens_of_long_videos(spark, monkeypatch):
    from tessera.catalog import selection
    from tessera.operators import dense

    rng = np.random.default_rng(4)
    vec, query = rng.normal(size=(1100, 4)), rng.normal(size=(3, 4))
    t = spark.createDataFrame([(1, k // 4, k, v.tolist()) for k, v in enumerate(vec)], "video_id long, frame long, pos long, vec array<double>")
    q = spark.createDataFrame([(1, k, v.tolist()) for k, v in enumerate(query)], "video_id long, qpos long, vec array<double>")
    monkeypatch.setattr(selection, "tokens", lambda *_: t)
    monkeypatch.setattr(selection, "query_tokens", lambda *_: q)
    monkeypatch.setattr(selection, "RATIO", 0.02)
    u = dense.unit(vec, mmtok.EPS)
    cover = np.concatenate([dense.softmax(dense.unit(query, mmtok.EPS), u, 0.1) / 3, dense.softmax(u, u, 0.2) * 0.5 / 1100])
    taken, trace = mmtok.greedy_exact(cover, 22)
    got = sorted(selection.mmtok_greedy_exact(spark, "").collect(), key=lambda r: r.step)
    assert [r.pos for r in got] == taken.tolist()
    assert np.allclose([r.objective for r in got], trace, atol=1e-5)


def test_echo_budget_of_all_keeps_all(spark):
    s = spark.createDataFrame([(1, 0, 0, 0.1, 0.0), (1, 0, 1, 0.3, 0.0), (1, 1, 2, 0.2, 0.9), (1, 1, 3, 0.2, 0.1)], "video_id long, frame long, pos long, relevance double, score double")
    assert echoprune.plan(s, ratio=1.0).count() == 4
    assert sorted(r.pos for r in echoprune.plan(s, target=2).collect()) == [1, 2]


def test_resample_needs_a_whole_grid(spark):
    v = spark.createDataFrame([(1, 2, 1, 1), (2, 2, 1, 1)], "video_id long, t long, h long, w long")
    s = spark.createDataFrame([(1, 0, 0, 0, 0.5), (1, 1, 0, 0, 0.7), (2, 1, 0, 0, 0.7)], "video_id long, t long, y long, x long, score double")
    assert {r.video_id for r in vflow.resample(s, v).collect()} == {1}


def test_grid_and_codec(spark):
    g = spark.createDataFrame([(1, 3, 4, 10)], "video_id long, t long, h long, w long")
    assert g.select(*grid.merged(F.col("t"), F.col("h"), F.col("w"), F.lit(2))).first() == (3, 2, 5, 10)
    stored = spark.createDataFrame([(1, 2, 1, 2, [3, 0, 3, 9, -1]), (2, 1, 1, 2, [0])], "video_id long, t long, gh long, gw long, groups array<long>")
    videos = spark.createDataFrame([(1, 2, 1, 2), (2, 5, 1, 2)], "video_id long, t long, gh long, gw long")
    assert sorted((r.video_id, r.g) for r in codec.selected_groups(stored, videos).collect()) == [(1, 0), (1, 3)]


def test_choices_and_texts(spark):
    x = spark.createDataFrame([("The answer is B.",), ("A or C",), ("",), (None,), ("(d)",), ("Option e",), ("Cannot determine the answer",), ("A man B sits down there",)], "s string")
    got = [tuple(r.p) for r in x.select(T.parse_choice(F.col("s")).alias("p")).collect()]
    assert got[:4] == [("B", "ok"), (None, "ambiguous:A,C"), (None, "no_valid_choice"), (None, "no_valid_choice")] and got[5] == ("E", "ok")
    c = T.choices_of(F.lit("red"), F.lit("blue"))
    assert [r[0] for r in x.select(T.infer(F.col("s"), c)).collect()][6] == "Z"
    assert x.limit(1).select(T.ratio_key(F.lit(0.2)), T.drop_name(F.lit(0.2)), T.safe_name(F.lit("a b/c")), T.after_reasoning(F.lit("x</think> y "))).first() == ("0p2", "drop_0p2000", "a_b_c", "y")
    assert x.limit(1).select(T.numbers(F.lit("1, ,2.5"))).first()[0] == [1.0, 2.5]


def test_evaluation_and_filters(spark):
    x = spark.createDataFrame([("q1", "B", "B"), ("q2", "hm", "A")], "question_id string, prediction string, answer string").withColumn("choices", T.choices_of(F.lit("red"), F.lit("blue")))
    assert [(r.extracted, r.hit) for r in evaluation.scored(x).collect()] == [("B", 1), ("unresolved", 0)]
    ids = spark.range(100).select("id")
    got = [r.id for r in filters.samples(ids, "id", shards=3, shard=2, offset=1, limit=2).orderBy("id").collect()]
    assert got == [5, 8]
    assert filters.layer_range(36) == list(range(12, 24)) and filters.layer_range(1) == [0]


def test_sources_round_trip(spark, tmp_path):
    import json

    (tmp_path / "a.meta.json").write_text(json.dumps({"sample_id": None, "video": "x/v1.mp4", "t": 1, "gh": 1, "gw": 2, "groups": [1]}))
    (tmp_path / "b.meta.json").write_text(json.dumps({"sample_id": "v1", "video": "y", "t": 1, "gh": 1, "gw": 2, "groups": [0]}))
    assert [(r.video_id, r.groups) for r in records.guides(spark, str(tmp_path)).collect()] == [("v1", [1])]
    np.savez(tmp_path / "q1.npz", score=np.array([[1.0, 3.0], [3.0, 5.0]]), t=[0, 0], y=[0, 0], x=[0, 1])
    got = records.score_table(records.arrays(spark, str(tmp_path), "*.npz")).orderBy("pos").collect()
    assert [(r.question_id, r.pos, r.score, r.x) for r in got] == [("q1", 0, 2.0, 0), ("q1", 1, 4.0, 1)]
    (tmp_path / "s.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\nHello\nthere\n\n2\n00:00:09,000 --> 00:00:09,900\nBye\n")
    cues = media.read_srt(spark, str(tmp_path / "s.srt")).withColumn("video_id", F.lit(1).cast("long"))
    times = spark.createDataFrame([(1, 2.0), (1, 9.0)], "video_id long, seconds double")
    assert media.subtitle_text(media.shown(cues, times)).first().subtitles == "Hello there"
    (tmp_path / "r.jsonl").write_text('{"question_id": "1"}\nbroken\n{"question_id": "2"}\n')
    done = records.read_jsonl(spark, str(tmp_path / "r.jsonl"), "question_id string", tolerant=True)
    todo = spark.createDataFrame([("1",), ("3",)], "question_id string")
    assert [r[0] for r in filters.unfinished(todo, done).collect()] == ["3"]
    records.write_report(todo, todo, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report/rows_csv")).count() == 2


def test_annotated_and_lengths(spark):
    q = spark.createDataFrame([("q", ["A. red", "B. blue"], "B")], "question_id string, options array<string>, answer string")
    r = records.annotated(q).first()
    assert r.choices == {"A": "red", "B": "blue"} and r.answer_id == 1
    a = spark.createDataFrame([(1,), (1,), (2,)], "video_id long")
    b = spark.createDataFrame([(1,), (2,)], "video_id long")
    assert [r.video_id for r in records.length_check(a, {"rows": b}).collect()] == [1]


def test_stream_equals_batch(spark, tmp_path):
    from tessera.streaming import windows

    spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:{i % 60:02d}:00", "a", float(i)) for i in range(50)], "id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = windows.windowed_means(windows.event_stream(spark, str(tmp_path / "in"), batch.schema))
    windows.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.start, r.n) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()}
    assert got <= {(r.start, r.n) for r in windows.windowed_means(batch).collect()}
