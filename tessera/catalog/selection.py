"""Queries of the token operators and the selection methods."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import budgets, grid
from tessera.functions import vectors as V
from tessera.operators import ranking, similarity
from tessera.plans import codec, echoprune, flashvid, kitoke, mmtok, ttf, vcast, vflow
from tessera.sources import records

from .base import DIM, PARTS, out, query, query_tokens, r, scored_tokens, sql, tokens

RATIO = 0.25


@query(sql("tokens units dims fm whole fs anchor pairs best base retained", f"SELECT video_id, min(anchor)::BIGINT AS anchor, count(*) AS kept, min(total) AS total, {r('max(best)', 'effective_threshold')} FROM retained GROUP BY video_id"))
def ttf_retain_plan(spark, d):
    t = tokens(spark, d)
    return out(ttf.summary(t, ttf.plan(t, DIM, ratio=RATIO)), "video_id", "anchor", "kept", "total", rounded=("effective_threshold",))


@query(sql("tokens", "SELECT video_id, pos, frame, y, x FROM tokens"))
def token_grid(spark, d):
    return tokens(spark, d).select("video_id", "pos", "frame", "y", "x")


@query(sql("tokens dims", f"SELECT video_id, frame, d::BIGINT AS d, {r('m')} FROM dims"))
def frame_means(spark, d):
    x = similarity.frame_means(tokens(spark, d), DIM).select("video_id", "frame", F.posexplode("mean").alias("d", "m"))
    return out(x.withColumn("d", (F.col("d") + 1).cast("long")), "video_id", "frame", "d", rounded=("m",))


@query(sql("tokens units", f"SELECT video_id, pos, {r('sqrt(list_dot_product(vec, vec))', 'norm')}, {r('list_sum(u)', 'total')}, {r('u[7]', 'u7')} FROM units"))
def vec_normalize(spark, d):
    x = tokens(spark, d).withColumn("u", V.normalised("vec")).withColumns({"norm": V.norm("vec"), "total": V.total("u"), "u7": F.col("u")[6]})
    return out(x, "video_id", "pos", rounded=("norm", "total", "u7"))


@query(sql("tokens dims fm whole fs", f"SELECT video_id, frame, {r('similarity')} FROM fs"))
def frame_similarity(spark, d):
    return out(similarity.frame_similarity(tokens(spark, d), DIM), "video_id", "frame", rounded=("similarity",))


@query(sql("tokens dims fm whole fs anchor", "SELECT video_id, anchor FROM anchor"))
def ttf_anchor(spark, d):
    return ttf.anchors(tokens(spark, d), DIM)


@query(sql("tokens units dims fm whole fs anchor pairs best", f"SELECT video_id, frame, pos, {r('best')}, match FROM best"))
def ttf_best_match(spark, d):
    t = tokens(spark, d)
    return out(ttf.best_match(t, ttf.anchors(t, DIM)), "video_id", "frame", "pos", "match", rounded=("best",))


@query(sql("tokens units dims fm whole fs anchor pairs best base", f"SELECT video_id, frame, pos, {r('best')} FROM base WHERE frame = anchor OR best < 0.15"))
def ttf_threshold_plan(spark, d):
    return out(ttf.plan(tokens(spark, d), DIM, mode="threshold", threshold=0.15), "video_id", "frame", "pos", rounded=("best",))


@query(sql("tokens units dims fm whole fs anchor pairs best base retained", "SELECT video_id, pos, row_number() OVER (PARTITION BY video_id ORDER BY frame != anchor, pos) - 1 AS out FROM retained"))
def ttf_paper_order(spark, d):
    return ttf.plan(tokens(spark, d), DIM, ratio=RATIO, order="paper").select("video_id", "pos", "out")


@query(sql("tokens dims fm fu anchor2", "SELECT video_id, frame, anchor FROM anchor2"))
def ttf2_anchor(spark, d):
    return ttf.dynamic_anchors(tokens(spark, d), DIM, 2)


@query(sql("tokens units dims fm fu anchor2 best2", f"""SELECT video_id, frame, pos, anchor, {r('best')} FROM
    (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY best, pos) AS r, count(*) OVER (PARTITION BY video_id) AS total FROM best2) WHERE r <= greatest(1, least(total, round_even(total * 0.25::DOUBLE, 0)))"""))
def ttf2_plan(spark, d):
    return out(ttf.dynamic_plan(tokens(spark, d), DIM, ratio=RATIO), "video_id", "frame", "pos", "anchor", rounded=("best",))


@query(sql("tokens units dims fm fu anchor2 best2", f"""SELECT video_id, frame, pos, anchor, {r('best')} FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY best, pos) AS r FROM best2) WHERE best < 0.05 OR r = 1"""))
def ttf2_threshold_plan(spark, d):
    return out(ttf.dynamic_plan(tokens(spark, d), DIM, mode="threshold", threshold=0.05), "video_id", "frame", "pos", "anchor", rounded=("best",))


@query(sql("tokens units", f"SELECT a.video_id, a.frame, a.pos, b.pos AS other, {r('1 - list_dot_product(a.u, b.u)', 'distance')} FROM units a JOIN units b ON a.video_id = b.video_id AND a.frame = b.frame"))
def cosine_distance(spark, d):
    return out(similarity.cosine_distances(tokens(spark, d)), "video_id", "frame", "pos", "other", rounded=("distance",))


@query(sql("tokens units queries qunits relevance", f"SELECT video_id, pos, {r('relevance')} FROM relevance"))
def echo_relevance(spark, d):
    return out(similarity.relevance(tokens(spark, d), query_tokens(spark, d)), "video_id", "pos", rounded=("relevance",))


_ECHO = "tokens units queries qunits relevance corr echo_full echo"


@query(sql(_ECHO, f"SELECT video_id, frame, pos, {r('correlation')}, {r('echo')}, {r('score')} FROM echo"))
def echo_scores_full(spark, d):
    return out(echoprune.scores(tokens(spark, d), query_tokens(spark, d)), "video_id", "frame", "pos", rounded=("correlation", "echo", "score"))


@query(sql("tokens units echo_near", f"SELECT video_id, pos, {r('echo')} FROM echo_near"))
def echo_scores_local(spark, d):
    return out(similarity.temporal_echo(tokens(spark, d), 0.1, 0), "video_id", "pos", rounded=("echo",))


@query(sql(_ECHO + " echo_budget", """SELECT video_id, frame, pos FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame = 0 ORDER BY value DESC, pos) AS r,
    least(budget - least(4, budget, greatest(1, budget // frames)), total - 4) AS later FROM echo_budget) WHERE r <= CASE WHEN frame = 0 THEN budget - later ELSE later END"""))
def echo_plan_paper(spark, d):
    return echoprune.plan(echoprune.scores(tokens(spark, d), query_tokens(spark, d)), ratio=RATIO)


@query(sql(_ECHO + " echo_budget", "SELECT video_id, frame, pos FROM echo_budget QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY value DESC, pos) <= budget"))
def echo_plan_global(spark, d):
    return echoprune.plan(echoprune.scores(tokens(spark, d), query_tokens(spark, d)), ratio=RATIO, policy="global")


@query(sql("tokens dims fm fu curvature", f"SELECT video_id, frame, {r('curvature')} FROM curvature"))
def vcast_curvature(spark, d):
    return out(similarity.curvature(tokens(spark, d), DIM), "video_id", "frame", rounded=("curvature",))


_VCAST = "tokens dims fm fu curvature vweights vraw vgot vbudget"


@query(sql(_VCAST, f"SELECT video_id, frame, {r('weight')}, k FROM vbudget"))
def vcast_budget(spark, d):
    return out(vcast.frame_budgets(tokens(spark, d), DIM, ratio=0.4), "video_id", "frame", "k", rounded=("weight",))


@query(sql(_VCAST + " vscores", f"SELECT video_id, frame, pos, {r('score')} FROM vscores JOIN vbudget USING (video_id, frame) QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY score DESC, pos) <= k"))
def vcast_plan(spark, d):
    return out(vcast.plan(tokens(spark, d), DIM, ratio=0.4), "video_id", "frame", "pos", rounded=("score",))


@query(sql("tokens", """SELECT video_id, frame, greatest(1, least(4, base + CASE WHEN frame < total % t THEN 1 ELSE 0 END))::BIGINT AS k FROM
    (SELECT *, total // t AS base FROM (SELECT video_id, frame, t, greatest(1, least(4 * t, round_even(4 * t * 0.3::DOUBLE, 0)))::BIGINT AS total FROM (SELECT video_id, frame, count(*) OVER (PARTITION BY video_id) AS t FROM (SELECT DISTINCT video_id, frame FROM tokens))))"""))
def static_budget(spark, d):
    x = tokens(spark, d).select("video_id", "frame").distinct()
    x = ranking.with_total(x, ["video_id"], "t").withColumn("total", budgets.half_even(F.col("t") * 4, 0.3))
    return x.select("video_id", "frame", F.greatest(F.lit(1), budgets.even_split(F.col("total"), F.col("t"), F.col("frame"), F.lit(4))).cast("long").alias("k"))


@query(sql("tokens kde", f"SELECT video_id, frame, pos, {r('density')} FROM kde"))
def kde_density(spark, d):
    return out(similarity.kernel_density(tokens(spark, d), 2.0), "video_id", "frame", "pos", rounded=("density",))


@query(sql("tokens trans", f"SELECT video_id, frame, {r('diff_pos')}, {r('diff_match')} FROM trans"))
def kitoke_transitions(spark, d):
    return out(similarity.transitions(tokens(spark, d)), "video_id", "frame", rounded=("diff_pos", "diff_match"))


_CUTS = {"tau": 2.8, "delta": 0.1, "relative": 0.03}


@query(sql("tokens trans bounds intervals", "SELECT video_id, frame, interval FROM intervals"))
def kitoke_intervals(spark, d):
    t = tokens(spark, d)
    return kitoke.intervals(t, kitoke.boundaries(similarity.transitions(t), **_CUTS))


@query(sql("tokens trans bounds", f"SELECT video_id, frame, {r('strength')} FROM (SELECT *, row_number() OVER (PARTITION BY video_id, boundary ORDER BY strength DESC, frame) AS r FROM bounds) WHERE boundary AND r <= 3"))
def kitoke_coarsen(spark, d):
    x = kitoke.coarsened(kitoke.boundaries(similarity.transitions(tokens(spark, d)), **_CUTS), F.lit(4))
    return out(x.where("boundary"), "video_id", "frame", rounded=("strength",))


@query(sql("tokens kde chosen", f"SELECT video_id, frame, pos, {r('diversity')} FROM chosen"))
def kitoke_topk(spark, d):
    return out(kitoke.top(kitoke.diversity(tokens(spark, d), 2.0), RATIO), "video_id", "frame", "pos", rounded=("diversity",))


def _kitoke(spark, d):
    t = tokens(spark, d)
    div = kitoke.diversity(t, 2.0)
    spans = kitoke.intervals(t, kitoke.boundaries(similarity.transitions(t), **_CUTS))
    return t, div, spans, kitoke.top(div, RATIO)


_ASSIGN = "tokens units kde chosen trans bounds intervals assigned"


@query(sql(_ASSIGN, "SELECT video_id, pos, rep FROM assigned"))
def kitoke_assignment(spark, d):
    t, _, spans, chosen = _kitoke(spark, d)
    return kitoke.assignments(t, spans, chosen)


@query(sql(_ASSIGN + " weights", f"SELECT video_id, rep, count(*) AS n, {r('sum(weight * vec[1])', 'v0')}, {r('sum(weight * list_sum(vec))', 'total')} FROM weights JOIN tokens USING (video_id, pos) GROUP BY video_id, rep"))
def kitoke_merge(spark, d):
    t, div, spans, chosen = _kitoke(spark, d)
    w = kitoke.merge_weights(kitoke.assignments(t, spans, chosen), div)
    x = kitoke.merged(t, w, DIM).join(w.groupBy("video_id", "rep").agg(F.count("*").alias("n")), ["video_id", "rep"])
    return out(x.withColumns({"v0": F.col("vec")[0], "total": V.total("vec")}), "video_id", "rep", "n", rounded=("v0", "total"))


@query(sql("tokens", f"""SELECT video_id, pos, {r("CASE WHEN i < m THEN 1.0 ELSE (b - m) * w / rest_m END", 'pi')} FROM
    (SELECT *, min(CASE WHEN (b - i) * w / rest < 1 - 1e-10 THEN i END) OVER (PARTITION BY video_id) AS m,
            first_value(rest) OVER (PARTITION BY video_id ORDER BY CASE WHEN (b - i) * w / rest < 1 - 1e-10 THEN i ELSE 999999 END) AS rest_m
     FROM (SELECT *, greatest(1, floor(n * 0.25::DOUBLE)) AS b, sum(w) OVER (PARTITION BY video_id ORDER BY w, pos DESC ROWS UNBOUNDED PRECEDING) AS rest
           FROM (SELECT video_id, pos, exp(8 * vec[1]) AS w, count(*) OVER (PARTITION BY video_id) AS n, row_number() OVER (PARTITION BY video_id ORDER BY exp(8 * vec[1]) DESC, pos) - 1 AS i FROM tokens)))"""))
def inclusion_probabilities(spark, d):
    x = ranking.with_total(scored_tokens(spark, d).withColumn("w", F.exp(8 * F.col("s1"))), ["video_id"])
    return out(ranking.inclusion_probabilities(x, "w", budgets.floored(F.col("total"), RATIO)), "video_id", "pos", rounded=("pi",))


@query()
def kitoke_pivotal(spark, d):
    return out(kitoke.sample(kitoke.diversity(tokens(spark, d), 2.0), RATIO, "pivotal"), "video_id", "frame", "pos", rounded=("diversity",))


@query()
def kitoke_multinomial(spark, d):
    return out(kitoke.sample(kitoke.diversity(tokens(spark, d), 2.0), RATIO, "multinomial"), "video_id", "frame", "pos", rounded=("diversity",))


_REPAIR = "tokens units kde chosen diverse trans bounds"


def _spans(name: str) -> str:
    """The intervals under the name that the repair uses: as they are, or after coarsening to the budget."""
    if name == "intervals":
        return ", spans AS (SELECT * FROM (" + PARTS["intervals"] + "))"
    return """, few AS (SELECT b.*, b.boundary AND row_number() OVER (PARTITION BY b.video_id, boundary ORDER BY strength DESC, frame) <= greatest(1, floor(n * 0.25::DOUBLE)) - 1 AS stays FROM bounds b JOIN (SELECT video_id, count(*) AS n FROM tokens GROUP BY video_id) USING (video_id)),
    spans AS (SELECT video_id, frame, sum(CASE WHEN stays THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame)::BIGINT AS interval FROM (SELECT DISTINCT video_id, frame FROM tokens) LEFT JOIN (SELECT video_id, frame + 1 AS frame, stays FROM few) USING (video_id, frame))"""


@query(sql(_REPAIR, f"{_spans('intervals')}, repair AS ({PARTS['repair']}) SELECT video_id, frame, interval, pos, {r('diversity')} FROM repair WHERE kept"))
def kitoke_repair(spark, d):
    _, div, spans, chosen = _kitoke(spark, d)
    return out(kitoke.repaired(div, spans, chosen), "video_id", "frame", "interval", "pos", rounded=("diversity",))


@query(sql(_REPAIR, f"""{_spans('coarse')}, repair AS ({PARTS['repair']}),
    given AS (SELECT t.video_id, t.pos, c.pos AS rep FROM (SELECT * FROM units JOIN spans USING (video_id, frame)) t JOIN (SELECT k.video_id, k.interval, k.pos, u.u FROM repair k JOIN units u USING (video_id, pos) WHERE kept) c ON c.video_id = t.video_id AND c.interval = t.interval
        QUALIFY row_number() OVER (PARTITION BY t.video_id, t.pos ORDER BY c.pos = t.pos DESC, list_dot_product(t.u, c.u) DESC, c.pos) = 1),
    shares AS (SELECT video_id, pos, rep, diversity / sum(diversity) OVER (PARTITION BY video_id, rep) AS weight FROM given JOIN diverse USING (video_id, pos))
    SELECT video_id, rep, {r('sum(weight * vec[1])', 'v0')} FROM shares JOIN tokens USING (video_id, pos) GROUP BY video_id, rep"""))
def kitoke_compress(spark, d):
    x = kitoke.compress(tokens(spark, d), DIM, ratio=RATIO, **_CUTS)
    return out(x.withColumn("v0", F.col("vec")[0]), "video_id", "rep", rounded=("v0",))


@query(sql("tokens", f"""SELECT video_id, frame, k AS pos, {r('avg(e / mass)', 'attention')} FROM (SELECT *, sum(e) OVER (PARTITION BY video_id, q) AS mass FROM
    (SELECT a.video_id, a.frame, a.pos AS q, b.pos AS k, exp(list_dot_product(a.vec, b.vec) / 8) AS e FROM tokens a JOIN tokens b ON a.video_id = b.video_id AND a.frame = b.frame)) GROUP BY ALL"""))
def flash_attention(spark, d):
    return out(similarity.incoming_attention(tokens(spark, d)), "video_id", "frame", "pos", rounded=("attention",))


@query(sql("tokens dims fm whole", f"SELECT video_id, pos, {r('list_dot_product(vec, whole)', 'event_relevance')} FROM tokens JOIN whole USING (video_id)"))
def event_relevance(spark, d):
    return out(similarity.event_relevance(tokens(spark, d), DIM), "video_id", "pos", rounded=("event_relevance",))


def _segments(t):
    return flashvid.segments(t, DIM, threshold=-0.1, least=6)


@query(sql("tokens dims fm fu fsim segments", f"SELECT video_id, frame, {r('similarity')}, segment FROM segments"))
def flash_segments(spark, d):
    return out(_segments(tokens(spark, d)), "video_id", "frame", "segment", rounded=("similarity",))


_TSTM = "tokens units dims fm fu fsim segments matched merges"


def _merges(t):
    spans = _segments(t)
    matched = flashvid.matches(t, spans)
    sizes = matched.groupBy("video_id", "segment").agg(F.count("*").alias("total"), (3 * F.count_distinct("frame")).alias("lower"))
    return flashvid.merges(matched, sizes, threshold=0.2)


@query(sql(_TSTM, f"SELECT video_id, segment, frame, pos, parent, {r('best')}, merge FROM merges"))
def flash_tstm_match(spark, d):
    return out(_merges(tokens(spark, d)), "video_id", "segment", "frame", "pos", "parent", "merge", rounded=("best",))


@query(sql(_TSTM, f"""SELECT video_id, root, count(*) AS n, {r('avg(vec[1])', 'v0')}, {r('avg(list_sum(vec))', 'total')} FROM
    (SELECT video_id, pos, root FROM tree WHERE NOT up) JOIN tokens USING (video_id, pos) GROUP BY video_id, root""").replace(
    " SELECT video_id, root,", ", tree AS (SELECT video_id, pos, pos AS root, merge AS up, parent AS next FROM merges UNION ALL SELECT t.video_id, t.pos, m.pos, m.merge, m.parent FROM tree t JOIN merges m ON m.video_id = t.video_id AND m.pos = t.next WHERE t.up) SELECT video_id, root,", 1))
def flash_tree_mean(spark, d):
    t = tokens(spark, d)
    x = flashvid.tree_means(t, flashvid.tree_roots(_merges(t)), DIM)
    return out(x.withColumns({"v0": F.col("vec")[0], "total": V.total("vec")}), "video_id", "root", "n", rounded=("v0", "total"))


@query(sql("tokens", """, dd AS (SELECT a.video_id, a.frame, a.pos, b.pos AS other, list_distance(a.vec, b.vec) / 8 AS dist FROM tokens a JOIN tokens b ON a.video_id = b.video_id AND a.frame = b.frame),
    dens AS (SELECT video_id, frame, pos, exp(-avg(dist * dist)) AS density FROM (SELECT *, row_number() OVER (PARTITION BY video_id, pos ORDER BY dist) AS r FROM dd) WHERE r <= 3 GROUP BY ALL),
    delta AS (SELECT d.video_id, d.frame, d.pos, any_value(a.density) AS density, coalesce(min(CASE WHEN b.density > a.density THEN dist END), any_value(top)) AS delta
        FROM (SELECT *, max(dist) OVER (PARTITION BY video_id, frame) AS top FROM dd) d JOIN dens a ON a.video_id = d.video_id AND a.pos = d.pos JOIN dens b ON b.video_id = d.video_id AND b.pos = d.other GROUP BY ALL),
    centres AS (SELECT video_id, frame, pos FROM delta QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY density * delta DESC, pos) <= 2)
    SELECT d.video_id, d.frame, d.pos, d.other AS centre FROM dd d JOIN centres c ON c.video_id = d.video_id AND c.pos = d.other
    QUALIFY row_number() OVER (PARTITION BY d.video_id, d.pos ORDER BY d.other = d.pos DESC, dist, d.other) = 1"""))  # fmt: skip
def flash_dpc(spark, d):
    return flashvid.frame_clusters(tokens(spark, d).withColumn("k", F.lit(2).cast("long")), nearest=3)


@query("""SELECT n, ceil(n * least(1.0::DOUBLE, 0.2::DOUBLE * 1.25::DOUBLE))::BIGINT AS frame_budget, ceil(ceil(n * least(1.0::DOUBLE, 0.2::DOUBLE * 1.25::DOUBLE)) * 0.7::DOUBLE)::BIGINT AS diverse,
    (ceil(n * least(1.0::DOUBLE, 0.2::DOUBLE * 1.25::DOUBLE)) - ceil(ceil(n * least(1.0::DOUBLE, 0.2::DOUBLE * 1.25::DOUBLE)) * 0.7::DOUBLE))::BIGINT AS rest FROM (SELECT DISTINCT p_size::BIGINT AS n FROM part)""")
def flash_budget_split(spark, d):
    a, b, c = budgets.frame_split(F.col("n"), 0.2, 0.7, 1.25)
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").cast("long").alias("n")).distinct().select("n", a.alias("frame_budget"), b.alias("diverse"), c.alias("rest"))


@query("""SELECT n, greatest(1, least(n, round_even(n * 0.15::DOUBLE, 0)))::BIGINT AS half_even, greatest(1, least(n, floor(n * 0.15::DOUBLE)))::BIGINT AS floored,
    greatest(1, least(n, floor(n * 0.15::DOUBLE + 0.5)))::BIGINT AS half_up, greatest(4, least(n, round_even(n * 0.15::DOUBLE, 0)))::BIGINT AS from_frame FROM (SELECT DISTINCT p_size::BIGINT AS n FROM part)""")
def budget_rules(spark, d):
    n = F.col("n")
    x = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").cast("long").alias("n")).distinct()
    return x.select("n", budgets.half_even(n, 0.15).alias("half_even"), budgets.floored(n, 0.15).alias("floored"), budgets.half_up(n, 0.15).alias("half_up"), budgets.half_even(n, 0.15, F.lit(4)).alias("from_frame"))


@query("""SELECT g, i, (f + CASE WHEN row_number() OVER (PARTITION BY g ORDER BY raw - f DESC, i) <= target - sum(f) OVER (PARTITION BY g) THEN 1 ELSE 0 END)::BIGINT AS count FROM
    (SELECT *, least(size, floor(raw)) AS f FROM (SELECT *, target * (size / whole) AS raw FROM (SELECT *, least(50, whole) AS target FROM
        (SELECT n_regionkey::BIGINT AS g, n_nationkey::BIGINT AS i, (1 + n_nationkey * 7 % 11)::BIGINT AS size, sum(1 + n_nationkey * 7 % 11) OVER (PARTITION BY n_regionkey) AS whole FROM nation))))""")
def exact_counts(spark, d):
    x = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_regionkey").cast("long").alias("g"), F.col("n_nationkey").cast("long").alias("i"), (1 + F.col("n_nationkey") * 7 % 11).cast("long").alias("size"))
    return ranking.exact_counts(x, ["g"], "i", "size", F.lit(50)).select("g", "i", "count")


#: Attention of each token, and all cosine distances of a frame, scaled by the attention of the column.
_ADTS = """, logits AS (SELECT a.video_id, a.frame, a.pos AS q, b.pos AS k, exp(list_dot_product(a.vec, b.vec) / 8) AS e FROM tokens a JOIN tokens b ON a.video_id = b.video_id AND a.frame = b.frame),
    att AS (SELECT video_id, frame, k AS pos, avg(e / mass) AS attention FROM (SELECT *, sum(e) OVER (PARTITION BY video_id, q) AS mass FROM logits) GROUP BY ALL),
    scaled AS (SELECT a.video_id, a.frame, a.pos AS i, b.pos AS j, (1 - list_dot_product(a.u, b.u)) * attention * 1e6 AS s FROM units a JOIN units b ON a.video_id = b.video_id AND a.frame = b.frame JOIN att t ON t.video_id = b.video_id AND t.pos = b.pos),
    one AS (SELECT video_id, frame, j AS pos FROM (SELECT video_id, frame, j, s FROM scaled QUALIFY row_number() OVER (PARTITION BY video_id, j ORDER BY s) = 2) QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY s DESC, j) = 1)"""


@query(sql("tokens units", f"""{_ADTS}, two AS (SELECT video_id, frame, j AS pos FROM (SELECT x.* FROM scaled x JOIN one o ON o.video_id = x.video_id AND o.pos = x.i WHERE x.j != o.pos) QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY s DESC, j) = 1)
    SELECT video_id, frame, pos, 0::BIGINT AS step FROM one UNION ALL SELECT video_id, frame, pos, 1 FROM two"""))
def flash_adts(spark, d):
    t = tokens(spark, d).join(similarity.incoming_attention(tokens(spark, d)).drop("frame"), ["video_id", "pos"])
    from tessera.operators import dense

    f = lambda c: {"pos": c["pos"][(got := flashvid.diverse_tokens(c["vec"], c["attention"], 2))], "step": list(range(len(got)))}
    return dense.per_key(t.select("video_id", "frame", "pos", "vec", "attention"), ["video_id", "frame"], ["pos"], f, "video_id long, frame long, pos long, step long")


# At this ratio a frame of four tokens keeps the first diverse one and no cluster, and every frame is full.
@query(sql("tokens units dims fm fu fsim segments", f"{_ADTS} SELECT video_id, segment, pos FROM one JOIN segments USING (video_id, frame)"))
def flash_end_to_end(spark, d):
    return flashvid.compress(tokens(spark, d), DIM, ratio=RATIO, segment_threshold=-0.1, segments_least=6, merge_threshold=0.2)


_MM = "tokens queries"
_MMU = """, tu AS (SELECT video_id, pos, [v / greatest(sqrt(list_dot_product(vec, vec)), 1e-8) for v in vec] AS u FROM tokens),
    qu AS (SELECT video_id, qpos, [v / greatest(sqrt(list_dot_product(vec, vec)), 1e-8) for v in vec] AS u FROM queries),
    lg AS (SELECT q.video_id, qpos, pos, list_dot_product(q.u, t.u) / 0.1 AS s FROM qu q JOIN tu t ON q.video_id = t.video_id),
    lz AS (SELECT video_id, qpos, max(s) + ln(sum(exp(s - top))) AS logz FROM (SELECT *, max(s) OVER (PARTITION BY video_id, qpos) AS top FROM lg) GROUP BY ALL),
    pr AS (SELECT video_id, qpos, pos, exp(s - logz) AS p FROM lg JOIN lz USING (video_id, qpos))"""


@query(sql(_MM, f"{_MMU} SELECT video_id, qpos, {r('logz')} FROM lz"))
def mmtok_logz(spark, d):
    return out(mmtok.log_normalisers(query_tokens(spark, d), tokens(spark, d), 0.1), "video_id", "qpos", rounded=("logz",))


@query(sql(_MM, f"{_MMU} SELECT video_id, qpos, pos, {r('p')} FROM pr"))
def mmtok_text_probs(spark, d):
    return out(mmtok.text_probabilities(query_tokens(spark, d), tokens(spark, d), 0.1), "video_id", "qpos", "pos", rounded=("p",))


@query(sql(_MM, f"""{_MMU}, rows AS (SELECT video_id, qpos, sum(-p * ln(greatest(p, 1e-45))) AS e, count(*) AS n, max(p) AS t1, sum(p) FILTER (r <= 5) AS t5 FROM (SELECT *, row_number() OVER (PARTITION BY video_id, qpos ORDER BY p DESC, pos) AS r FROM pr) GROUP BY ALL)
    SELECT video_id, {r('avg(e)', 'entropy_mean')}, {r('avg(e / ln(greatest(n, 2)))', 'entropy_norm')}, {r('avg(exp(e))', 'effective_support')}, {r('avg(exp(e) / n)', 'support_ratio')}, {r('avg(t1)', 'top1')}, {r('avg(t5)', 'top5_mass')} FROM rows GROUP BY video_id"""))
def mmtok_diagnostics(spark, d):
    x = mmtok.diagnostics(mmtok.text_probabilities(query_tokens(spark, d), tokens(spark, d), 0.1))
    return out(x, "video_id", rounded=("entropy_mean", "entropy_norm", "effective_support", "support_ratio", "top1", "top5_mass"))


_CORE = """, vids AS (SELECT video_id, max(frame) + 1 AS t, 4 AS n FROM tokens GROUP BY video_id),
    bins AS (SELECT *, bin * (t // bins) + least(bin, t % bins) AS first, t // bins + CASE WHEN bin < t % bins THEN 1 ELSE 0 END AS frames
             FROM (SELECT *, unnest(range(bins)) AS bin FROM (SELECT *, least(t, u) AS bins FROM (SELECT *, greatest(1, least(7, t * n)) AS u FROM vids)))),
    counted AS (SELECT *, base + CASE WHEN row_number() OVER (PARTITION BY video_id ORDER BY raw - base DESC, bin) <= u - sum(base) OVER (PARTITION BY video_id) THEN 1 ELSE 0 END AS c
             FROM (SELECT *, greatest(1, floor(raw))::BIGINT AS base FROM (SELECT *, frames * n / (t * n) * u AS raw FROM bins))),
    parts AS (SELECT *, unnest(range(c)) AS part, frames * n AS m FROM counted),
    core AS (SELECT video_id, (first * n + part * (m // c) + least(part, m % c) + (m // c + CASE WHEN part < m % c THEN 1 ELSE 0 END - 1) // 2)::BIGINT AS pos, (m // c + CASE WHEN part < m % c THEN 1 ELSE 0 END) / (t * n) AS weight FROM parts)"""


def _core(t, target=7):
    videos = t.groupBy("video_id").agg((F.max("frame") + 1).alias("t"), F.lit(4).cast("long").alias("n"))
    return mmtok.coreset(videos, target)


@query(sql("tokens", f"{_CORE} SELECT video_id, pos, {r('weight')} FROM core"))
def mmtok_coreset(spark, d):
    return out(_core(tokens(spark, d)), "video_id", "pos", rounded=("weight",))


@query(sql(_MM, f"""{_MMU}{_CORE}, taus AS (SELECT unnest([0.05, 0.1, 0.2, 0.4]::DOUBLE[]) AS tau),
    vs AS (SELECT tau, c.video_id, c.pos AS row, weight, exp((list_dot_product(a.u, b.u) - 1) / tau) AS e FROM core c JOIN tu a USING (video_id, pos) JOIN tu b ON b.video_id = c.video_id CROSS JOIN taus),
    second AS (SELECT tau, video_id, row, weight, e / mass AS p FROM (SELECT *, sum(e) OVER (PARTITION BY tau, video_id, row) AS mass, row_number() OVER (PARTITION BY tau, video_id, row ORDER BY e DESC) AS r FROM vs) WHERE r = 2),
    peak AS (SELECT video_id, avg(p) AS text_peak FROM (SELECT video_id, qpos, max(p) AS p FROM pr GROUP BY ALL) GROUP BY ALL),
    gaps AS (SELECT video_id, tau, text_peak, round(abs(text_peak - sum(p * weight)), 12) AS gap FROM second JOIN peak USING (video_id) GROUP BY video_id, tau, text_peak)
    SELECT video_id, {r('text_peak')}, tau, {r('gap')} FROM gaps QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY gap, tau) = 1"""))
def mmtok_adaptive_tau(spark, d):
    t = tokens(spark, d)
    x = mmtok.adaptive_temperature(t, query_tokens(spark, d), _core(t), [0.05, 0.1, 0.2, 0.4], 0.1)
    return out(x, "video_id", "tau", rounded=("text_peak", "gap"))


#: Coverage of the text rows and of all tokens, a column for each token; then one greedy step after the other.
_GREEDY = f"""{_MMU}, vs AS (SELECT a.video_id, a.pos AS row, b.pos, list_dot_product(a.u, b.u) / 0.2 AS s FROM tu a JOIN tu b ON a.video_id = b.video_id),
    vp AS (SELECT video_id, row, pos, 0.5 / n * exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY video_id, row) AS p FROM (SELECT *, max(s) OVER (PARTITION BY video_id, row) AS top, count(*) OVER (PARTITION BY video_id, row) AS n FROM vs)),
    cover AS (SELECT video_id, pos, list(p ORDER BY vision, row) AS c FROM (SELECT video_id, 0 AS vision, qpos AS row, pos, p / count(DISTINCT qpos) OVER (PARTITION BY video_id) AS p FROM pr UNION ALL SELECT video_id, 1, row, pos, p FROM vp) GROUP BY video_id, pos),
    cols AS (SELECT video_id, list(c ORDER BY pos) AS cs, count(*) AS n FROM cover GROUP BY video_id),
    pick AS (SELECT video_id, cs, greatest(1, floor(n * 0.25::DOUBLE))::BIGINT AS budget, 0::BIGINT AS step, [0.0::DOUBLE for x in cs[1]] AS best, []::BIGINT[] AS taken FROM cols
        UNION ALL SELECT video_id, cs, budget, step + 1, [greatest(best[i], cs[j][i]) for i in range(1, len(best) + 1)], list_append(taken, j) FROM
            (SELECT *, list_position(gains, list_max(gains))::BIGINT AS j FROM (SELECT *, [CASE WHEN list_contains(taken, k) THEN -1.0 ELSE list_sum([greatest(cs[k][i] - best[i], 0) for i in range(1, len(best) + 1)]) END for k in range(1, len(cs) + 1)] AS gains FROM pick WHERE step < budget)))"""


@query(sql(_MM, f"{_GREEDY} SELECT video_id, taken[-1] - 1 AS pos, step - 1 AS step, {r('list_sum(best)', 'objective')} FROM pick WHERE step > 0"))
def mmtok_greedy_exact(spark, d):
    t = tokens(spark, d)
    every = t.select("video_id", "pos", (1 / F.count("*").over(Window.partitionBy("video_id"))).alias("weight"))
    return out(mmtok.plan(t, query_tokens(spark, d), every, ratio=RATIO, text_temperature=0.1, profile="exact"), "video_id", "pos", "step", rounded=("objective",))


@query()
def mmtok_greedy_sampled(spark, d):
    t = tokens(spark, d)
    return out(mmtok.plan(t, query_tokens(spark, d), _core(t, 16), ratio=RATIO, text_temperature=0.1, profile="scalable"), "video_id", "pos", "step", rounded=("objective",))


def _videos(t, tt=5, h=3, w=3):
    return t.select("video_id").distinct().select("video_id", F.lit(tt).cast("long").alias("t"), F.lit(h).cast("long").alias("h"), F.lit(w).cast("long").alias("w"))


def _resampled(spark, d):
    t = tokens(spark, d)
    return vflow.resample(t.select("video_id", F.col("frame").alias("t"), "y", "x", F.col("vec")[0].alias("score")), _videos(t)), t


_VF = """, target AS (SELECT video_id, st, pos, pos // 9 AS t, (pos % 9) // 3 AS y, pos % 3 AS x FROM (SELECT video_id, max(frame) + 1 AS st FROM tokens GROUP BY ALL), (SELECT unnest(range(45)) AS pos)),
    res AS (SELECT a.video_id, a.pos, s.vec[1] AS score FROM target a JOIN tokens s ON s.video_id = a.video_id AND s.frame = round_even(a.t * (st - 1) / 4.0::DOUBLE, 0) AND s.y = round_even(a.y / 2.0::DOUBLE, 0) AND s.x = round_even(a.x / 2.0::DOUBLE, 0))"""


@query(sql("tokens", f"{_VF} SELECT video_id, pos, {r('score')} FROM res"))
def vflow_resample(spark, d):
    return out(_resampled(spark, d)[0], "video_id", "pos", rounded=("score",))


@query(sql("tokens", f"{_VF} SELECT video_id, pos, {r('score')} FROM res QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, pos) <= 11"))
def vflow_select_high(spark, d):
    return out(vflow.plan(_resampled(spark, d)[0], RATIO, "high"), "video_id", "pos", rounded=("score",))


@query(sql("tokens", f"{_VF} SELECT video_id, pos, {r('score')} FROM res QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score, pos) <= 11"))
def vflow_select_low(spark, d):
    return out(vflow.plan(_resampled(spark, d)[0], RATIO, "low"), "video_id", "pos", rounded=("score",))


@query(sql("tokens", f"""{_VF}, kept AS (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, pos) <= 11)
    SELECT video_id, frame, count(pos) AS kept, {r('min(score)', 'low')}, {r('max(score)', 'high')}, {r('avg(score)', 'mean')} FROM (SELECT DISTINCT video_id, t AS frame FROM target) LEFT JOIN (SELECT video_id, pos // 9 AS frame, pos, score FROM kept) USING (video_id, frame) GROUP BY ALL"""))
def vflow_summary(spark, d):
    s, t = _resampled(spark, d)
    return out(vflow.summary(vflow.plan(s, RATIO), _videos(t)), "video_id", "frame", "kept", rounded=("low", "high", "mean"))


def _groups(spark, d):
    t = tokens(spark, d)
    two = F.lit(2).cast("long")
    videos = t.groupBy("video_id").agg((F.max("frame") + 1).alias("t")).withColumns({"gh": two, "gw": two})
    return t.where("vec[0] > 0.15").select("video_id", F.col("pos").alias("g")), videos


@query(sql("tokens", "SELECT video_id, pos AS g FROM tokens WHERE vec[1] > 0.15 UNION SELECT DISTINCT video_id, 4 * frame FROM tokens WHERE (video_id, frame) NOT IN (SELECT video_id, pos // 4 FROM tokens WHERE vec[1] > 0.15)"))
def codec_coverage(spark, d):
    return codec.with_coverage(*_groups(spark, d))


@query(sql("tokens", "SELECT video_id, frame, count(*) FILTER (vec[1] > 0.15) AS n FROM tokens GROUP BY ALL"))
def codec_counts_per_frame(spark, d):
    return codec.counts_per_frame(*_groups(spark, d))


@query(sql("tokens", "SELECT video_id, g, (g // 4) * 16 + (g % 4) * 4 + k AS patch FROM (SELECT video_id, pos AS g FROM tokens WHERE vec[1] > 0.15), (SELECT unnest(range(4)) AS k)"))
def codec_patches(spark, d):
    g, videos = _groups(spark, d)
    x = g.join(videos, "video_id").withColumn("m", F.lit(2).cast("long"))
    return grid.group_to_patches(x).select("video_id", "g", F.col("patch").cast("long").alias("patch"))


@query()
def codec_random(spark, d):
    g, videos = _groups(spark, d)
    return codec.random_groups(codec.with_coverage(g, videos), videos)


@query("""SELECT video_id, pos AS flat, pos // 6 AS pos_t, (pos % 6) // 3 AS pos_h, pos % 3 AS pos_w, 3::BIGINT AS width FROM (SELECT n_nationkey::BIGINT AS video_id, unnest(range(6 * (1 + n_nationkey % 4))) AS pos FROM nation)""")
def mrope_positions(spark, d):
    v = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("video_id"), (1 + F.col("n_nationkey") % 4).cast("long").alias("t"), F.lit(2).cast("long").alias("h"), F.lit(3).cast("long").alias("w"))
    return grid.local_mrope(v)


@query(sql("tokens", "SELECT video_id, 'top' AS method, keep_n AS kept, total - keep_n AS dropped, round(1 - keep_n / total, 6) + 0.0 AS drop_ratio FROM (SELECT video_id, count(*) AS total, greatest(1, floor(count(*) * 0.2::DOUBLE + 0.5))::BIGINT AS keep_n FROM tokens GROUP BY video_id)"))
def selection_dump(spark, d):
    s = scored_tokens(spark, d)
    x = records.selection_records(ranking.ranked_set(s, ["video_id"], "s1", 0.2), s.groupBy("video_id").agg(F.count("*").alias("n")), "top")
    return out(x.withColumns({"kept": F.size("keep_indices").cast("long"), "dropped": F.size("drop_indices").cast("long")}), "video_id", "method", "kept", "dropped", rounded=("drop_ratio",))


@query(sql("tokens", "SELECT video_id, frame, pos, condition FROM (SELECT *, 'top' AS condition, row_number() OVER (PARTITION BY video_id ORDER BY vec[1] DESC, pos) AS r, count(*) OVER (PARTITION BY video_id) AS n FROM tokens UNION ALL SELECT *, 'bottom', row_number() OVER (PARTITION BY video_id ORDER BY vec[1], pos), count(*) OVER (PARTITION BY video_id) FROM tokens) WHERE r <= greatest(1, floor(n * 0.2::DOUBLE + 0.5))"))
def selection_sets_top_bottom(spark, d):
    x = ranking.selection_sets(scored_tokens(spark, d), ["video_id"], ["s1"], [0.2], "frame")
    return x.where("condition in ('top', 'bottom')").select("video_id", "frame", "pos", "condition")


@query(sql("tokens", "SELECT video_id, frame, count(*) AS n FROM (SELECT * FROM tokens QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY vec[1] DESC, pos) <= greatest(1, floor(count(*) OVER (PARTITION BY video_id) * 0.2::DOUBLE + 0.5))) GROUP BY ALL"))
def random_matched_histogram(spark, d):
    s = scored_tokens(spark, d)
    x = ranking.random_matched(s, ranking.ranked_set(s, ["video_id"], "s1", 0.2), ["video_id"], "frame")
    return x.groupBy("video_id", "frame").agg(F.count("*").alias("n"))


@query()
def random_global(spark, d):
    return ranking.random_global(scored_tokens(spark, d), ["video_id"], 0.2).select("video_id", "frame", "pos")
