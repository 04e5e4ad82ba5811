"""Sources with conflicts, intervals by resampling, numbering over several runs, grouped heads."""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import cells
from tessera.functions import text as T
from tessera.operators import filters, overlap, similarity, statistics, summaries
from tessera.plans import flashvid, kitoke
from tessera.sources import media, records


def test_bootstrap_equals_the_plain_one_whatever_the_partitions(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(3, 1, 400)
    rows = [(1, i, float(v)) for i, v in enumerate(values)] + [(2, 0, float("nan")), (3, 0, 2.5)]
    x = spark.createDataFrame(rows, "g long, i long, v double")
    draws = np.random.default_rng(3407)
    means = np.array([draws.choice(values, size=400, replace=True).mean() for _ in range(2000)])
    for parts in (1, 4):
        got = {r.g: r for r in summaries.bootstrap_interval(x.repartition(parts), ["g"], "v", order=["i"]).collect()}
        assert sorted(got) == [1, 3] and got[3].low == got[3].high == 2.5 and got[1].n == 400
        assert [got[1].low, got[1].high] == pytest.approx([np.percentile(means, 2.5), np.percentile(means, 97.5)], abs=1e-12)


def test_bootstrap_over_several_cells(spark):
    values = np.random.default_rng(1).normal(5, 2, 600)
    x = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "g long, i long, v double")
    run = lambda parts: summaries.bootstrap_interval(x.repartition(parts), ["g"], "v", order=["i"], resamples=800, cell_rows=100).first()
    one, two = run(1), run(5)
    assert (one.low, one.high) == (two.low, two.high)
    error = values.std() / np.sqrt(600)
    assert one.mean - one.low == pytest.approx(1.96 * error, rel=0.15) and one.high - one.mean == pytest.approx(1.96 * error, rel=0.15)


def test_running_sums_and_places_over_several_cells(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), int(v), 1) for g, v in zip(rng.integers(0, 3, 500), rng.integers(0, 60, 500))] + [(0, 7, 1)] * 200
    x = spark.createDataFrame(rows, "g long, v long, w long")
    found = x.groupBy("g", "v").agg(F.sum("w").alias("w"))
    got = {(r.g, r.v): r.below for r in cells.running(found, ["g"], "v", "w", "below", rows=9).collect()}
    assert got == {(g, v): sum(1 for a, b, _ in rows if a == g and b < v) for g, v, _ in rows}
    per = cells.dealt(found, ["g"], "v", "cell", rows=9).groupBy("g", "cell").count().collect()
    assert len(per) > 12 and max(r["count"] for r in per) <= 27
    ids = spark.createDataFrame([(int(i) * 7 - 300,) for i in rng.permutation(300)], "id long")
    assert sorted((r.id, r.place) for r in filters.numbered(ids, "id", "place", rows=20).collect()) == [(i * 7 - 300, i) for i in range(300)]
    assert filters.numbered(ids.where("id > 10000"), "id", "place").count() == 0


def test_statistics_equal_plain_ones_with_ties(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL_ROWS", 10)
    monkeypatch.setattr(statistics, "CELL_ROWS", 10)
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 40, 300).astype(float), rng.integers(0, 25, 300).astype(float)
    x = spark.createDataFrame([(1, float(p), float(q), i) for i, (p, q) in enumerate(zip(a, b))], "g long, a double, b double, i long")

    def ranks(v):
        return np.array([(v < y).sum() + ((v == y).sum() - 1) / 2 for y in v])

    assert statistics.spearman(x, ["g"], "a", "b").first().spearman == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1])
    s = np.sort(a)
    assert statistics.gini(x, ["g"], "a").first().gini == pytest.approx((2 * np.arange(1, 301) - 301) @ s / (300 * s.sum()))
    got = {r.i: r.rank for r in statistics.average_ranks(x, ["g"], "a", "rank").collect()}
    assert [got[i] for i in range(300)] == pytest.approx(ranks(a).tolist())
    p = a / a.sum()
    c = statistics.concentration(x, ["g"], "a", "i", "b").first()
    assert c.top_5pct_mass == pytest.approx(np.sort(p)[::-1][:15].sum()) and c.normalized_entropy == pytest.approx(-(p * np.log(p)).sum() / np.log(300))
    assert [c["max"], c["mean"], c["std"], c.spearman_local_index] == pytest.approx([p.max(), p.mean(), p.std(), np.corrcoef(ranks(a), np.arange(300))[0, 1]])


@pytest.mark.parametrize("groups", [1, 2])
def test_attention_of_grouped_heads(spark, groups):
    rng = np.random.default_rng(groups)
    q, k = rng.normal(size=(4, 6, 5)), rng.normal(size=(4 // groups, 6, 5))
    rows = [(1, h, p, q[h, p].tolist(), k[h, p].tolist() if h < 4 // groups else None) for h in range(4) for p in range(6)]
    got = {(r.q, r.k): r.a for r in similarity.causal_attention(spark.createDataFrame(rows, "question_id long, head long, pos long, q array<double>, k array<double>"), 0.5, groups).collect()}
    expected = np.zeros((6, 6))
    for h in range(4):
        s = np.where(np.tril(np.ones((6, 6))) > 0, q[h] @ k[h // groups].T * 0.5, -np.inf)
        e = np.exp(s - s.max(1, keepdims=True))
        expected += e / e.sum(1, keepdims=True) / 4
    assert sorted(got) == [(i, j) for i in range(6) for j in range(i + 1)]
    assert [got[i] for i in sorted(got)] == pytest.approx([expected[i] for i in sorted(got)])


def test_density_peaks_in_blocks(monkeypatch):
    x = np.random.default_rng(5).normal(size=(60, 4))
    whole = flashvid.density_peaks(x, 7, 5)
    monkeypatch.setattr(flashvid, "_DIFFERENCES", 500)
    parts = flashvid.density_peaks(x, 7, 5)
    assert all((a == b).all() for a, b in zip(whole, parts))


def npy(x) -> bytes:
    f = io.BytesIO()
    np.save(f, x)
    return f.getvalue()


def test_members_of_zip_files(spark, tmp_path):
    meta = lambda name, **more: json.dumps({"sample_id": name, "video": "x/v1.mp4", "t": 1, "gh": 1, "gw": 2, "groups": [1], **more})
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("a/one.meta.json", meta("zed"))
        z.writestr("a/two.meta.json", meta(None, video="y/early.mkv"))
        z.writestr("a/three.meta.json", meta("zed", groups=[5]))
        z.writestr("a/none.meta.json", meta(None, video=None))
        z.writestr("a/idx.npy", npy(np.array([[1.0, 3.0], [3.0, 5.0]])))
    got = {r.video_id: (r["index"], r.groups) for r in records.guides(spark, str(tmp_path)).collect()}
    assert got == {"early": (0, [1]), "zed": (1, [1])}  # of zed the first by path
    assert [(r.path.split("/")[-1], r["values"]) for r in records.arrays(spark, str(tmp_path)).collect()] == [("idx.npy", [2.0, 4.0])]


@pytest.mark.parametrize("fault, message", [({}, None), ({"x": None}, "missing"), ({"y": [0]}, "lengths"), ({"score": [1.0, float("nan")]}, "finite"), ({"score": np.ones((1, 1, 2))}, "dimensions"), ("twice", "two files")])
def test_score_archives_are_checked(spark, tmp_path, fault, message):
    names = records.SCORE_ARRAYS
    good = {"score": [1.0, 2.0], "t": [0, 0], "y": [0, 0], "x": [0, 1]} | (fault if isinstance(fault, dict) else {})
    for folder in ("a", "b")[: 2 if fault == "twice" else 1]:
        (tmp_path / folder).mkdir()
        np.savez(tmp_path / folder / "q1.npz", **{names[k]: np.asarray(v) for k, v in good.items() if v is not None})
    table = records.score_table(records.arrays(spark, str(tmp_path), ".npz"), names)
    if message is None:
        assert sorted(map(tuple, table.collect())) == [("q1", 0, 1.0, 0, 0, 0), ("q1", 1, 2.0, 0, 0, 1)]
    else:
        with pytest.raises(Exception, match=message):
            table.collect()


def test_archives_written_and_read(spark, tmp_path):
    x = spark.createDataFrame([("q1", [1.0, 2.0], [0, 1]), ("q2", [3.0], [4])], "id string, score array<double>, x array<long>")
    assert sorted(r.key for r in records.write_arrays(x, "id", ["score", "x"], str(tmp_path / "out")).collect()) == ["q1", "q2"]
    with np.load(tmp_path / "out" / "q1.npz") as got:
        assert got["score"].tolist() == [1.0, 2.0] and got["x"].tolist() == [0, 1]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["q1.npz", "q2.npz"]


def test_query_tokens_are_padded(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["what is shown?", "a", "one two three four five"]
    own = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    x = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    longest = max(map(len, own))
    assert [(r.ids, r.n) for r in T.token_rows(x, path).orderBy("id").collect()] == [(t + [0] * (longest - len(t)), len(t)) for t in own]
    with pytest.raises(Exception, match="no tokens"):
        T.token_rows(spark.createDataFrame([(1, "  ")], "id long, text string"), path).collect()


def test_faults_are_errors(spark):
    v = spark.createDataFrame([(1, 100, 25.0, 3.0, 1.0)], "video_id long, frames long, rate double, start double, end double")
    with pytest.raises(Exception, match="no frames"):
        media.sampled_in_span(v).collect()
    for h, n, message in ((3, 3, "divisible"), (4, 5, "differ")):
        with pytest.raises(Exception, match=message):
            media.placeholder_spans(spark.createDataFrame([(1, 0, 1, h, 4, n)], "prompt_id long, ord long, t long, h long, w long, placeholders long")).collect()
    keys = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    with pytest.raises(Exception, match="repeated: a"):
        records.unique(keys, "k").collect()
    assert records.unique(keys.distinct(), "k").count() == 2
    with pytest.raises(ValueError, match="missing or mismatched dumps: 3"):
        overlap.strict(keys, keys)
    assert overlap.strict(keys, keys.limit(0)).count() == 3


def test_comparison_is_written(spark, tmp_path):
    row = spark.createDataFrame([(1, "m", 0.2, "top", 0.5, 0.5, 0.3, 1.0, 0.1)], "video_id long, method string, drop_ratio double, kind string, a_overlap_fraction double, b_overlap_fraction double, iou double, enrichment double, normalized_overlap double")
    overlap.write_comparison(row, row.select("video_id", "method").limit(0), str(tmp_path))
    assert spark.read.json(str(tmp_path / "overlap_records")).first().iou == 0.3
    assert spark.read.option("header", True).csv(str(tmp_path / "overlap_summary")).first().mean_iou == "0.3"


def test_seeds_and_metadata(spark):
    assert kitoke.seed_of(1, "a") == kitoke.seed_of("1", "a") != kitoke.seed_of(1, "b") and 0 <= kitoke.seed_of("x") < 1 << 63
    row = records.run_metadata(spark, ratio=0.25).first()
    assert row.ratio == "0.25" and row.python_version and row.commit


def test_streamed_coverage_takes_what_the_whole_matrix_takes(monkeypatch):
    import tracemalloc

    from tessera.operators import dense
    from tessera.plans import mmtok

    monkeypatch.setattr(mmtok, "HELD", 1 << 15)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 6))
    for vec, budget in ((x, 225), (x[rng.integers(0, 60, 900)], 300), (np.ones((50, 6)), 20)):
        u, q, n = dense.unit(vec), dense.unit(rng.normal(size=(3, 6))), len(vec)
        cover = np.concatenate([dense.softmax(q, u, 0.1) / 3, dense.softmax(u, u, 0.2) * 0.5 / n])
        tracemalloc.start()
        taken, trace = mmtok.greedy_streamed(u, np.concatenate([q, u]), np.repeat([0.1, 0.2], [3, n]), np.repeat([1 / 3, 0.5 / n], [3, n]), budget)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 2_000_000 < 8 * 900 * 900
        expected, objective = mmtok.greedy_exact(cover, budget)
        assert taken.tolist() == expected.tolist() and np.allclose(trace, objective, atol=1e-12)
    few = dense.unit(x[:4])  # rows that soon gain nothing more
    taken, _ = mmtok.greedy_streamed(dense.unit(x), few, np.full(4, 0.2), np.full(4, 0.25), 40)
    assert taken.tolist() == mmtok.greedy_exact(dense.softmax(few, dense.unit(x), 0.2) / 4, 40)[0].tolist()


def test_rows_over_several_cells_need_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(g, int(a), int(b), i) for i, (g, a, b) in enumerate(zip(rng.choice(["p", "q", None], 600), rng.integers(0, 400, 600), rng.integers(0, 15, 600)))]
    x = spark.createDataFrame(rows, "g string, a long, b long, i long")
    whole = statistics.concentration(x, ["g"], "a", "i", "b").orderBy("g").collect()
    for module in (cells, statistics):
        monkeypatch.setattr(module, "CELL_ROWS", 50)
    dealt = statistics.concentration(x, ["g"], "a", "i", "b")
    for one, two in zip(whole, dealt.orderBy("g").collect(), strict=True):
        assert one.g == two.g and list(one)[1:] == pytest.approx(list(two)[1:])
    # Rows are exchanged by value, to be counted, and by the column with more values; pairs are not.
    found = statistics.spearman(x, ["g"], "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("Aggregate [")[1].split("]")[0] for line in found.splitlines() if "Aggregate [" in line]
    assert keys and not any(("a#" in k or "x_#" in k) and ("b#" in k or "y_#" in k) for k in keys)


def test_weights_of_all_modes_assign_once(spark, data):
    from tessera.catalog import coverage
    from tessera.operators import dense

    plan = coverage.kitoke_other_weights(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rep#") and sum("FlatMapCoGroups" in line and "rep#" in line for line in plan.splitlines()) == 1
    assert max((s.stop - s.start) * 50_000 for s in dense.blocks(3000, 50_000)) <= dense.BLOCK**2
    assert [s.stop for s in dense.blocks(3000, 50)] == [1024, 2048, 3000]
