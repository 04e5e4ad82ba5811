"""Queries of the smaller operators: grids, sources and sinks, texts, counts of random selections, whole vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import budgets, grid
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import evaluation, filters, flow, overlap, ranking, similarity
from tessera.plans import apply, codec, flashvid, kitoke, methods, mmtok, ttf, vcast
from tessera.sources import media, records

from .base import DIM, out, query, query_tokens, r, scored_tokens, scratch, sql, table, tokens
from .records import _FORM_SQL, _answers
from .selection import _ASSIGN, _TSTM, RATIO, _core, _groups, _kitoke, _merges


def _nation(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("region"), F.col("n_name").alias("name"))


# Sources and sinks.

_DURATION = "CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 4000 THEN 'medium' ELSE 'long' END"


def _lasting(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 4000, "medium").otherwise("long").alias("duration"))


@query(f"SELECT doc_id, {_DURATION} AS duration FROM documents WHERE {_DURATION} = 'medium'")
def questions_of_duration(spark, d):
    return records.of_duration(_lasting(spark, d), "medium")


@query(f"SELECT doc_id, {_DURATION} AS duration FROM documents")
def questions_of_all_durations(spark, d):
    return records.of_duration(_lasting(spark, d))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS a, 'x' || n_regionkey AS b, 'other' AS c, (n_nationkey % 3)::BIGINT AS answer_id FROM nation")
def annotated_questions(spark, d):
    n = _nation(spark, d)
    options = F.array(F.concat(F.lit("A. "), "name"), F.concat(F.lit(" B )x"), F.col("region").cast("string")), F.lit("C.  other "))
    x = records.annotated(n.withColumns({"options": options, "answer": F.char((F.col("id") % 3 + 65).cast("int"))}))
    return x.select("id", *(F.col("choices")[c].alias(c.lower()) for c in "ABC"), "answer_id")


@query("SELECT event_id, user_id, event_type FROM events")
def json_lines_round_trip(spark, d):
    x, path = table(spark, d, "events").select("event_id", "user_id", "event_type"), scratch(spark)
    records.append_jsonl(x.where("event_id % 2 = 0"), path)
    records.append_jsonl(x.where("event_id % 2 != 0"), path)
    return records.read_jsonl(spark, path, x.schema)


_HITS = "SELECT lang AS domain, source AS sub_category, (toxic = 0)::BIGINT AS hit FROM documents JOIN labels USING (doc_id)"


@query(f"SELECT CASE WHEN grouping(domain) = 0 THEN 'domain' WHEN grouping(sub_category) = 0 THEN 'sub_category' ELSE 'overall' END AS level, coalesce(domain, sub_category, '') AS value, count(*) AS n, {r('avg(hit)', 'accuracy')} FROM ({_HITS}) GROUP BY GROUPING SETS ((), (domain), (sub_category))")
def report_round_trip(spark, d):
    """Rows as CSV, accuracy as JSON, written and read again."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("lang").alias("domain"), F.col("source").alias("sub_category"), (F.col("toxic") == 0).cast("long").alias("hit"))
    path = scratch(spark)
    records.write_report(x, evaluation.accuracy(x, ("domain", "sub_category")), path)
    back = spark.read.option("header", True).schema(x.schema).csv(f"{path}/rows_csv")
    ours = evaluation.accuracy(back, ("domain", "sub_category")).select("level", "value", "n")
    kept = spark.read.schema("level string, value string, n long, accuracy double").json(f"{path}/accuracy").withColumn("value", F.coalesce("value", F.lit("")))
    return out(kept.join(ours, ["level", "value", "n"]), "level", "value", "n", rounded=("accuracy",))


@query("SELECT n_name AS name, n_nationkey::BIGINT AS id FROM nation")
def ordered_csv_round_trip(spark, d):
    path = scratch(spark)
    records.write_ordered_csv(_nation(spark, d), ["name", "id"], path)
    return spark.read.option("header", True).schema("name string, id long").csv(path)


@query(sql("tokens", """SELECT video_id, string_agg(pos, ',' ORDER BY pos) FILTER (kept) AS keep, string_agg(pos, ',' ORDER BY pos) FILTER (NOT kept) AS "drop"
    FROM (SELECT video_id, pos, row_number() OVER (PARTITION BY video_id ORDER BY vec[1] DESC, pos) <= greatest(1, floor(count(*) OVER (PARTITION BY video_id) * 0.2::DOUBLE + 0.5)) AS kept FROM tokens) GROUP BY video_id"""))
def selection_dump_indices(spark, d):
    s = scored_tokens(spark, d)
    x = records.selection_records(ranking.ranked_set(s, ["video_id"], "s1", 0.2), s.groupBy("video_id").agg(F.count("*").alias("n")), "top")
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return x.select("video_id", joined("keep_indices").alias("keep"), joined("drop_indices").alias("drop"))


@query(sql("tokens dims fm whole fs anchor", f"SELECT video_id, frame AS frame_grid_index, {r('similarity')}, frame = anchor AS is_anchor, t || 'x4x4' AS grid_thw, '2x2' AS merged_grid_hw, 4::BIGINT AS tokens_per_frame FROM fs JOIN anchor USING (video_id) JOIN (SELECT video_id, count(*) AS t FROM fm GROUP BY video_id) USING (video_id)"))
def frame_similarity_rows(spark, d):
    t = tokens(spark, d)
    four, two = F.lit(4).cast("long"), F.lit(2).cast("long")
    grids = t.groupBy("video_id").agg((F.max("frame") + 1).alias("t")).withColumns({"h": four, "w": four, "merge": two})
    x = records.frame_similarities(similarity.frame_similarity(t, DIM), grids)
    return out(x, "video_id", "frame_grid_index", "is_anchor", "grid_thw", "merged_grid_hw", "tokens_per_frame", rounded=("similarity",))


@query("""SELECT video_id, i, round_even(first + i * ((last - first)::DOUBLE / greatest(n - 1, 1)), 0)::BIGINT AS index, round(round_even(first + i * ((last - first)::DOUBLE / greatest(n - 1, 1)), 0) / rate, 6) + 0.0 AS seconds
    FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, least(greatest(round_even((last - first + 1) / rate, 0) * 2, 4), 16, (last - first + 1) // 2 * 2)::BIGINT AS n
    FROM (SELECT o_orderkey AS video_id, rate, CASE WHEN s IS NULL THEN 0 ELSE ceil(greatest(0, least(s, frames / rate)) * rate) END::BIGINT AS first, CASE WHEN e IS NULL THEN frames - 1 ELSE least(floor(greatest(0, least(e, frames / rate)) * rate), frames - 1) END::BIGINT AS last
    FROM (SELECT o_orderkey, (300 + o_orderkey % 700)::BIGINT AS frames, (24 + o_custkey % 7)::DOUBLE AS rate, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 4)::DOUBLE END AS s, CASE WHEN o_orderkey % 5 > 0 THEN 6.5 + o_orderkey % 40 END::DOUBLE AS e FROM orders))))""")
def frames_in_span(spark, d):
    o = F.col("o_orderkey")
    v = table(spark, d, "orders").select(
        o.alias("video_id"), (300 + o % 700).alias("frames"), (24 + F.col("o_custkey") % 7).cast("double").alias("rate"),
        F.when(o % 3 > 0, (o % 4).cast("double")).alias("start"), F.when(o % 5 > 0, (F.lit(6.5) + o % 40).cast("double")).alias("end"),
    )
    return out(media.sampled_in_span(v, most=16), "video_id", "i", "index", rounded=("seconds",))


# Grids and positions.


@query("SELECT id, (h // 2) * (w // 2) AS floored, greatest(h // 2, 1) * greatest(w // 2, 1) AS clamped, CASE WHEN h % 2 = 0 AND w % 2 = 0 THEN (h // 2) * (w // 2) END AS whole FROM (SELECT n_nationkey::BIGINT AS id, (n_nationkey % 6)::BIGINT AS h, (n_nationkey % 4)::BIGINT AS w FROM nation)")
def merged_grids(spark, d):
    x = _nation(spark, d).withColumns({"t": F.lit(2).cast("long"), "h": F.col("id") % 6, "w": F.col("id") % 4, "two": F.lit(2).cast("long")})
    per = {n: grid.merged(F.col("t"), F.col("h"), F.col("w"), F.col("two"), p)[3] for n, p in (("floored", "floor"), ("clamped", "clamp"), ("whole", "reject"))}
    return x.select("id", *(c.alias(n) for n, c in per.items()))


@query(sql("tokens", f"SELECT video_id, pos // 2 AS merged, d::BIGINT AS d, {r('avg(v)', 'm')} FROM (SELECT video_id, pos, unnest(vec) AS v, unnest(range(1, 65)) AS d FROM tokens) GROUP BY video_id, pos // 2, d"))
def group_mean_vectors(spark, d):
    x = similarity.group_means(tokens(spark, d).select("video_id", F.col("pos").alias("flat"), "vec"), 2, DIM, ["video_id"])
    return out(x.select("video_id", "merged", F.posexplode("vec").alias("d", "m")).withColumn("d", (F.col("d") + 1).cast("long")), "video_id", "merged", "d", rounded=("m",))


@query("SELECT id, i AS seq_pos, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS nth FROM (SELECT p_partkey::BIGINT AS id, unnest(range(8)) AS i FROM part) WHERE (id * (i + 1)) % 5 = 3")
def sequence_positions(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"))
    ids = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: ((F.col("id") * j) % 5).cast("int"))
    return grid.token_positions(x.withColumn("ids", ids), 3)


@query('SELECT n_regionkey::BIGINT AS prompt_id, n_nationkey::BIGINT AS ord, (1 + n_nationkey % 3) * 6::BIGINT AS tokens, coalesce(sum((1 + n_nationkey % 3) * 6) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM nation')
def placeholder_offsets(spark, d):
    long = lambda v: F.lit(v).cast("long")
    x = _nation(spark, d).select(F.col("region").alias("prompt_id"), F.col("id").alias("ord"), (1 + F.col("id") % 3).alias("t"), long(4).alias("h"), long(6).alias("w"), ((1 + F.col("id") % 3) * 6).alias("placeholders"))
    return media.placeholder_spans(x).select("prompt_id", "ord", "tokens", "offset")


#: A prompt: some text, a 2 x 3 image, two words, a 3 x 3 frame of which places 0 and 4 are kept, some text.
_PROMPT = """WITH p AS (SELECT n_nationkey::BIGINT AS prompt_id, (n_nationkey % 4)::BIGINT AS a, (n_nationkey % 3)::BIGINT AS b FROM nation),
    pos AS (SELECT prompt_id, i AS seq, i AS pos_t, i AS pos_h, i AS pos_w FROM (SELECT *, unnest(range(a)) AS i FROM p)
    UNION ALL SELECT prompt_id, a + i, a, a + i // 3, a + i % 3 FROM (SELECT *, unnest(range(6)) AS i FROM p)
    UNION ALL SELECT prompt_id, a + 6 + i, a + 3 + i, a + 3 + i, a + 3 + i FROM (SELECT *, unnest(range(2)) AS i FROM p)
    UNION ALL SELECT prompt_id, a + 8 + i, a + 5, a + 5 + i, a + 5 + i FROM (SELECT *, unnest(range(2)) AS i FROM p)
    UNION ALL SELECT prompt_id, a + 10 + i, a + 7 + i, a + 7 + i, a + 7 + i FROM (SELECT *, unnest(range(b)) AS i FROM p))"""


def _segments(spark, d):
    n = _nation(spark, d)
    part = lambda o, length, h, w, kept: n.select(F.col("id").alias("prompt_id"), F.lit(o).alias("ord"), length.cast("long").alias("length"), F.lit(h).cast("long").alias("h"), F.lit(w).cast("long").alias("w"), kept.cast("array<bigint>").alias("selected"))
    none = F.lit(None)
    return (
        part(0, F.col("id") % 4, None, None, none).unionByName(part(1, none, 2, 3, none)).unionByName(part(2, F.lit(2), None, None, none))
        .unionByName(part(3, none, 3, 3, F.array(F.lit(0), F.lit(4)))).unionByName(part(4, F.col("id") % 3, None, None, none))
    )


@query(f"{_PROMPT} SELECT prompt_id, seq, pos_t, pos_h, pos_w FROM pos")
def sparse_mrope_positions(spark, d):
    return grid.sparse_mrope(_segments(spark, d))


@query(f"{_PROMPT} SELECT prompt_id, max(greatest(pos_t, pos_h, pos_w)) + 1 - count(*) AS delta FROM pos GROUP BY prompt_id")
def sparse_mrope_delta(spark, d):
    return grid.mrope_delta(grid.sparse_mrope(_segments(spark, d)))


# Codec groups, random selections by their invariants, retention.


@query(sql("tokens", "SELECT video_id, pos AS g FROM tokens WHERE vec[1] > 0.15 AND video_id % 5 != 0"))
def codec_selected_groups(spark, d):
    """Stored groups, some out of range; every fifth video's grid is not the stored one."""
    g, videos = _groups(spark, d)
    lists = g.groupBy("video_id").agg(F.array_union(F.collect_list("g"), F.array(F.lit(-1).cast("long"), F.lit(10**9).cast("long"))).alias("groups"))
    stored = videos.join(lists, "video_id").withColumn("gh", F.when(F.col("video_id") % 5 == 0, F.col("gh") + 1).otherwise(F.col("gh")))
    return codec.selected_groups(stored, videos)


@query(sql("tokens", "SELECT video_id, n, t AS frames FROM (SELECT video_id, max(frame) + 1 AS t, count(*) FILTER (vec[1] > 0.15) AS hits, max(frame) + 1 - count(DISTINCT CASE WHEN vec[1] > 0.15 THEN frame END) AS lacking, hits + lacking AS n FROM tokens GROUP BY video_id)"))
def codec_random_counts(spark, d):
    """A random baseline has as many groups as the selection, and one of every frame."""
    g, videos = _groups(spark, d)
    x = codec.random_groups(codec.with_coverage(g, videos), videos)
    return x.groupBy("video_id").agg(F.count_distinct("g").alias("n"), F.count_distinct(F.floor(F.col("g") / 4)).alias("frames"))


@query(sql("tokens", "SELECT video_id, greatest(1, floor(count(*) * 0.2::DOUBLE + 0.5))::BIGINT AS n FROM tokens GROUP BY video_id"))
def random_global_counts(spark, d):
    x = ranking.random_global(scored_tokens(spark, d), ["video_id"], 0.2)
    return x.groupBy("video_id").agg(F.count_distinct("pos").alias("n"))


@query(sql("tokens", "SELECT method, video_id, greatest(1, floor(count(*) * 0.25::DOUBLE))::BIGINT AS n FROM tokens, (SELECT unnest(['pivotal', 'multinomial']) AS method) GROUP BY ALL"))
def kitoke_sample_counts(spark, d):
    div = kitoke.diversity(tokens(spark, d), 2.0)
    x = [kitoke.sample(div, RATIO, m).select(F.lit(m).alias("method"), "video_id", "pos") for m in ("pivotal", "multinomial")]
    return x[0].unionByName(x[1]).groupBy("method", "video_id").agg(F.count_distinct("pos").alias("n"))


@query(sql("tokens", "SELECT video_id, greatest(1, floor(count(*) * 0.25::DOUBLE))::BIGINT AS n, greatest(1, floor(count(*) * 0.25::DOUBLE))::BIGINT AS steps FROM tokens GROUP BY video_id"))
def mmtok_sampled_counts(spark, d):
    t = tokens(spark, d)
    x = mmtok.plan(t, query_tokens(spark, d), _core(t, 16), ratio=RATIO, text_temperature=0.1, profile="scalable")
    return x.groupBy("video_id").agg(F.count_distinct("pos").alias("n"), (F.max("step") + 1).cast("long").alias("steps"))


@query(f"SELECT layers, k, {r('(layers - k * 1.25::DOUBLE) / (1.25::DOUBLE * (layers - k))', 'ratio')} FROM (SELECT layers, layers // 4 AS k FROM range(10, 60) t(layers))")
def hybrid_retentions(spark, d):
    rows = [(n, n // 4, budgets.hybrid_retention(n, n // 4, 1.25)) for n in range(10, 60)]
    return out(spark.createDataFrame(rows, "layers long, k long, ratio double"), "layers", "k", rounded=("ratio",))


# Plans applied, and every method.


@query(sql("tokens units dims fm whole fs anchor pairs best base retained", f"SELECT video_id, pos, row_number() OVER (PARTITION BY video_id ORDER BY frame != anchor, pos) - 1 AS out, {r('vec[1]', 'v0')}, {r('list_sum(vec)', 'total')} FROM retained JOIN (SELECT video_id, pos, vec FROM tokens) USING (video_id, pos)"))
def gathered_tokens(spark, d):
    t = tokens(spark, d)
    x = apply.gather(t, ttf.plan(t, DIM, ratio=RATIO, order="paper"), ["vec"])
    return out(x.withColumns({"v0": F.col("vec")[0], "total": V.total("vec")}), "video_id", "pos", "out", rounded=("v0", "total"))


@query(sql("tokens", "SELECT video_id, count(*) AS plan, count(*) - 1 AS deep FROM tokens WHERE video_id % 2 = 0 GROUP BY video_id"))
def length_mismatches(spark, d):
    t = tokens(spark, d)
    return records.length_check(t, {"deep": t.where("video_id % 2 = 1 or pos > 0")})


@query(sql("tokens", """, v AS (SELECT video_id, count(*) AS n, max(frame) + 1 AS t, least(count(*), round_even(count(*) * 0.25::DOUBLE, 0))::BIGINT AS even, greatest(1, floor(count(*) * 0.25::DOUBLE))::BIGINT AS low FROM tokens GROUP BY video_id)
    SELECT 'dense' AS method, video_id, n AS kept FROM v UNION ALL SELECT 'ttf', video_id, greatest(4, even) FROM v UNION ALL SELECT 'ttf_dynamic', video_id, greatest(1, even) FROM v UNION ALL SELECT 'echoprune', video_id, greatest(1, even) FROM v
    UNION ALL SELECT 'vcast', video_id, CASE WHEN t = 1 THEN n ELSE t END FROM v UNION ALL SELECT 'kitoke', video_id, low FROM v UNION ALL SELECT 'flashvid', video_id, t FROM v UNION ALL SELECT 'mmtok', video_id, low FROM v"""))
def kept_by_method(spark, d):
    t, q = tokens(spark, d), query_tokens(spark, d)
    all_of = None
    for m in methods.METHODS:
        x = methods.selected(m, t, q, DIM, RATIO)
        all_of = x if all_of is None else all_of.unionByName(x)
    return all_of.groupBy("method", "video_id").agg(F.count_distinct("pos").alias("kept"))


@query(sql("tokens", "SELECT video_id, frame, pos FROM tokens WHERE frame = 0 AND video_id % 2 = 0"))
def vcast_one_frame(spark, d):
    """Videos of one frame stay whole, beside others that do not."""
    t = tokens(spark, d).where("video_id % 2 = 1 or frame = 0")
    return vcast.plan(t, DIM, ratio=RATIO).where("video_id % 2 = 0").select("video_id", "frame", "pos")


# Whole vectors of operators whose other queries show a part.


def _exploded(x, *keys, name="v"):
    return out(x.select(*keys, F.posexplode("vec").alias("d", name)).withColumn("d", (F.col("d") + 1).cast("long")), *keys, "d", rounded=(name,))


@query(sql("tokens units", f"SELECT video_id, pos, d::BIGINT AS d, {r('v')} FROM (SELECT video_id, pos, unnest(u) AS v, unnest(range(1, 65)) AS d FROM units)"))
def unit_vectors(spark, d):
    return _exploded(tokens(spark, d).select("video_id", "pos", V.normalised("vec").alias("vec")), "video_id", "pos")


@query(sql(_ASSIGN + " weights", f"SELECT video_id, rep, d::BIGINT AS d, {r('sum(weight * v)', 'v')} FROM (SELECT video_id, pos, unnest(vec) AS v, unnest(range(1, 65)) AS d FROM tokens) JOIN weights USING (video_id, pos) GROUP BY video_id, rep, d"))
def kitoke_merged_vectors(spark, d):
    t, div, spans, chosen = _kitoke(spark, d)
    return _exploded(kitoke.merged(t, kitoke.merge_weights(kitoke.assignments(t, spans, chosen), div), DIM), "video_id", "rep")


@query(sql(_ASSIGN, f"SELECT video_id, pos, rep, 'none' AS mode, {r('CASE WHEN pos = rep THEN 1 ELSE 0 END', 'weight')} FROM assigned UNION ALL SELECT video_id, pos, rep, 'uniform', {r('1 / count(*) OVER (PARTITION BY video_id, rep)', 'weight')} FROM assigned"))
def kitoke_other_weights(spark, d):
    t, div, spans, chosen = _kitoke(spark, d)
    x = kitoke.weights_by_mode(kitoke.assignments(t, spans, chosen), div, ["none", "uniform"])
    return out(x, "video_id", "pos", "rep", "mode", rounded=("weight",))


@query(sql(_TSTM, f"""SELECT video_id, root, d::BIGINT AS d, {r('avg(v)', 'v')} FROM
    (SELECT video_id, pos, root FROM tree WHERE NOT up) JOIN (SELECT video_id, pos, unnest(vec) AS v, unnest(range(1, 65)) AS d FROM tokens) USING (video_id, pos) GROUP BY video_id, root, d""").replace(
    " SELECT video_id, root,", ", tree AS (SELECT video_id, pos, pos AS root, merge AS up, parent AS next FROM merges UNION ALL SELECT t.video_id, t.pos, m.pos, m.merge, m.parent FROM tree t JOIN merges m ON m.video_id = t.video_id AND m.pos = t.next WHERE t.up) SELECT video_id, root,", 1))
def flash_tree_vectors(spark, d):
    t = tokens(spark, d)
    return _exploded(flashvid.tree_means(t, flashvid.tree_roots(_merges(t)), DIM), "video_id", "root")


# Flow.

_LAYERS = """, seqs AS (SELECT video_id * 1000000 + pos // 8 AS question_id, pos % 8 AS pos, u, count(*) OVER (PARTITION BY video_id, pos // 8) AS n FROM units),
    attn AS (SELECT question_id, layer, q, k, e / sum(e) OVER (PARTITION BY question_id, layer, q) AS a FROM (SELECT a.question_id, layer, a.pos AS q, b.pos AS k, exp(layer * list_dot_product(a.u, b.u)) AS e FROM seqs a JOIN seqs b ON a.question_id = b.question_id AND b.pos <= a.pos, (SELECT unnest([1, 3])::BIGINT AS layer))),
    paths AS (SELECT question_id, layer, pos, n, 0.5::DOUBLE AS w FROM seqs, (SELECT unnest([1, 3])::BIGINT AS layer) WHERE pos >= n - 2 UNION ALL SELECT p.question_id, p.layer, k, p.n, w * a FROM paths p JOIN attn ON attn.question_id = p.question_id AND attn.layer = p.layer AND q = p.pos AND k < q),
    reach AS (SELECT question_id, layer, pos, sum(w) AS h FROM paths WHERE pos < n - 2 GROUP BY ALL)"""


def _layer_attention(spark, d):
    x = tokens(spark, d).select((F.col("video_id") * 1_000_000 + F.floor(F.col("pos") / 8)).alias("question_id"), F.lit(0).cast("long").alias("head"), (F.col("pos") % 8).alias("pos"), V.normalised("vec").alias("q"))
    x = ranking.with_total(x, ["question_id"], "n").withColumn("k", F.col("q"))
    layers = [similarity.causal_attention(x.drop("n"), float(s)).withColumn("layer", F.lit(s).cast("long")) for s in (1, 3)]
    return layers[0].unionByName(layers[1]), x.where("pos >= n - 2").select("question_id", F.col("pos").alias("target")), x.where("pos < n - 2").select("question_id", "pos")


@query(sql("tokens units", f"{_LAYERS} SELECT question_id, layer, pos AS local_idx, {r('h', 'value')} FROM reach"))
def layer_matrices(spark, d):
    return out(flow.layer_matrix(*_layer_attention(spark, d)), "question_id", "layer", "local_idx", rounded=("value",))


@query(sql("tokens", "SELECT 2::BIGINT AS layers, n - 2 AS tokens, count(*) AS questions FROM (SELECT count(*) AS n FROM tokens GROUP BY video_id, pos // 8) GROUP BY n HAVING n > 2"))
def layer_matrix_shapes(spark, d):
    return flow.one_shape(flow.layer_matrix(*_layer_attention(spark, d)))


@query(f"SELECT l_orderkey AS question_id, {r('max(l_discount::DOUBLE)', 'worst')} FROM lineitem WHERE l_suppkey % 7 > l_linenumber GROUP BY l_orderkey HAVING max(l_discount::DOUBLE) > 1e-5")
def future_attention(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("q"), (F.col("l_suppkey") % 7).alias("k"), F.col("l_discount").cast("double").alias("a"))
    return out(flow.causality_violations(x), "question_id", rounded=("worst",))


@query(f"SELECT l_orderkey AS question_id, l_linenumber AS q, l_suppkey % 3 AS k, {r('avg(l_quantity::DOUBLE)', 'a')} FROM lineitem GROUP BY ALL")
def head_means(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("q"), (F.col("l_suppkey") % 3).alias("k"), F.col("l_quantity").cast("double").alias("a"))
    return out(flow.head_mean(x), "question_id", "q", "k", rounded=("a",))


@query("SELECT n_nationkey::BIGINT AS id, n_nationkey::BIGINT - 1 AS decision, n_nationkey::BIGINT AS post_answer FROM nation")
def target_positions(spark, d):
    return _nation(spark, d).select("id", *(flow.target_position(F.col("id"), m).alias(m) for m in ("decision", "post_answer")))


@query(f"""WITH lp AS (SELECT l_orderkey AS question_id, l_linenumber AS pos, l_partkey % 100 AS token, max(-l_tax::DOUBLE) AS logprob FROM lineitem GROUP BY ALL),
    answers AS (SELECT question_id, pos, token + CASE WHEN question_id % 7 = 0 AND pos = 2 THEN 1 ELSE 0 END AS token FROM lp WHERE pos <= 2)
    SELECT question_id, CASE WHEN count(logprob) = count(*) THEN round(sum(logprob), 6) + 0.0 END AS total, CASE WHEN count(logprob) = count(*) THEN {r('avg(logprob)', 'mean').replace(' AS mean', '')} END AS mean
    FROM answers LEFT JOIN lp USING (question_id, pos, token) GROUP BY question_id""")
def answer_logprobs(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 100).alias("token")).agg(F.max((-F.col("l_tax")).cast("double")).alias("logprob"))
    wrong = (F.col("question_id") % 7 == 0) & (F.col("pos") == 2)
    answers = x.where("pos <= 2").select("question_id", "pos", (F.col("token") + wrong.cast("int")).alias("token"))
    return out(flow.answer_logprob(x, answers), "question_id", rounded=("total", "mean"))


@query("SELECT id, array_to_string(list_filter(CASE WHEN list_position(ids, 5) > 0 THEN ids[1:list_position(ids, 5) - 1] ELSE ids END, lambda x: x != 0), ',') AS ids FROM (SELECT p_partkey::BIGINT AS id, [(p_partkey * j) % 7 for j in range(1, 10)] AS ids FROM part)")
def stripped_ids(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.transform(F.sequence(F.lit(1), F.lit(9)), lambda j: ((F.col("p_partkey") * j) % 7).cast("int")).alias("ids"))
    return x.select("id", F.array_join(flow.stripped(F.col("ids"), 5, 0).cast("array<string>"), ",").alias("ids"))


@query(f"SELECT event_id, was != now AS answer_changed, was = truth AND now != truth AS correct_to_wrong, was != truth AND now = truth AS wrong_to_correct, {r('value', 'logprob_drop')} FROM (SELECT event_id, event_id % 3 AS was, CASE WHEN event_id % 5 > 0 THEN event_id % 2 END AS now, event_id % 4 AS truth, value FROM events)")
def intervention_outcomes(spark, d):
    i = F.col("event_id")
    x = table(spark, d, "events").select("event_id", (i % 3).alias("baseline_answer"), F.when(i % 5 > 0, i % 2).alias("answer"), (i % 4).alias("truth"), (F.col("value") * 2).alias("baseline_logprob"), F.col("value").alias("logprob"))
    return out(flow.outcomes(x), "event_id", "answer_changed", "correct_to_wrong", "wrong_to_correct", rounded=("logprob_drop",))


# Overlap.


@query(sql("tokens", "SELECT video_id, pos FROM tokens WHERE video_id % 2 = 0 AND pos < 2 UNION ALL SELECT video_id, pos FROM (SELECT * FROM tokens WHERE video_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY vec[1] DESC, pos) <= greatest(1, least(count(*) OVER (PARTITION BY video_id), round_even(count(*) OVER (PARTITION BY video_id) * 0.3::DOUBLE, 0))))"))
def reference_sets(spark, d):
    s = scored_tokens(spark, d)
    return overlap.reference_set(s.select("video_id", "pos", F.col("s1").alias("score")), s.where("video_id % 2 = 0 and pos < 2").select("video_id", "pos"), 0.3)


_LOOP = """, n AS (SELECT video_id, count(*) AS n FROM tokens GROUP BY video_id),
    ranked AS (SELECT video_id, pos, c AS method, row_number() OVER (PARTITION BY video_id, c ORDER BY s DESC, pos) AS r FROM (SELECT video_id, pos, unnest(['one', 'two']) AS c, unnest([vec[1], vec[2]]) AS s FROM tokens)),
    drops AS (SELECT video_id, method, pos FROM ranked JOIN n USING (video_id) WHERE r > greatest(1, floor(n * 0.75::DOUBLE + 0.5)) AND NOT (method = 'two' AND video_id % 5 <= 1)),
    refs AS (SELECT video_id, 'top' AS kind, pos FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY vec[3] DESC, pos) AS r FROM tokens) JOIN n USING (video_id) WHERE r <= greatest(1, floor(n * 0.25::DOUBLE + 0.5))
        UNION ALL SELECT video_id, 'bottom', pos FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY vec[3], pos) AS r FROM tokens) JOIN n USING (video_id) WHERE r <= greatest(1, floor(n * 0.25::DOUBLE + 0.5))),
    grid AS (SELECT video_id, method, kind, n FROM n, (SELECT unnest(['one', 'two']) AS method), (SELECT unnest(['top', 'bottom']) AS kind) WHERE NOT (method = 'two' AND video_id % 5 <= 1))"""


def _compared(spark, d):
    t = tokens(spark, d).select("video_id", "pos", *(F.col("vec")[i].alias(f"s{i}") for i in range(3)))
    totals = t.groupBy("video_id").agg(F.count("*").alias("n"))
    one, two = (records.selection_records(ranking.ranked_set(t, ["video_id"], s, 0.75), totals, m) for s, m in (("s0", "one"), ("s1", "two")))
    # The second method lacks some videos, and has some of another length.
    two = two.where("video_id % 5 != 0").withColumn("dense_token_count", F.col("dense_token_count") + (F.col("video_id") % 5 == 1).cast("long"))
    dumps = one.unionByName(two).withColumn("drop_ratio", F.lit(0.25))
    references = ranking.ranked_set(t, ["video_id"], "s2", 0.25).withColumn("kind", F.lit("top")).unionByName(ranking.ranked_set(t, ["video_id"], "s2", 0.25, "bottom").withColumn("kind", F.lit("bottom")))
    run = dumps.select("method", "drop_ratio").distinct()
    return overlap.compared(dumps, references.select("video_id", "kind", F.lit(0.25).alias("drop_ratio"), "pos"), totals, run)


@query(sql("tokens", f"""{_LOOP}, s AS (SELECT g.video_id, g.method, g.kind, any_value(n) AS n, (SELECT count(*) FROM drops x WHERE x.video_id = g.video_id AND x.method = g.method) AS sa, (SELECT count(*) FROM refs y WHERE y.video_id = g.video_id AND y.kind = g.kind) AS sb,
    (SELECT count(*) FROM drops x JOIN refs y USING (video_id, pos) WHERE x.video_id = g.video_id AND x.method = g.method AND y.kind = g.kind) AS hit FROM grid g GROUP BY ALL)
    SELECT video_id, method, 0.25::DOUBLE AS drop_ratio, kind, sa AS a_count, sb AS b_count, hit AS overlap_count, round(hit / (sa + sb - hit), 6) + 0.0 AS iou, round(sa * sb / n, 6) + 0.0 AS expected_overlap_count FROM s"""))
def overlap_loop(spark, d):
    return out(_compared(spark, d)[0], "video_id", "method", "drop_ratio", "kind", "a_count", "b_count", "overlap_count", rounded=("iou", "expected_overlap_count"))


@query(sql("tokens", "SELECT video_id, 'two' AS method, 0.25::DOUBLE AS drop_ratio, CASE WHEN video_id % 5 = 0 THEN 'missing' ELSE 'count mismatch' END AS reason FROM tokens WHERE video_id % 5 <= 1 GROUP BY video_id"))
def overlap_ledger(spark, d):
    return _compared(spark, d)[1]


# Texts, samples and evaluation.


@query("SELECT user_id FROM events GROUP BY user_id ORDER BY min(event_id) LIMIT 20")
def first_distinct_users(spark, d):
    return filters.first_distinct(table(spark, d, "events"), "user_id", "event_id", 20)


@query("SELECT layers, unnest(range(layers // 3, greatest(2 * layers // 3, layers // 3 + 1))) AS layer FROM range(1, 41) t(layers)")
def layer_ranges(spark, d):
    return spark.createDataFrame([(n, x) for n in range(1, 41) for x in filters.layer_range(n)], "layers long, layer long")


_PICKED = """b AS (SELECT *, list_filter(string_split_regex(translate(s, '.()[],:;!*#{}', '              '), '\\s+'), lambda w: w != '') AS words FROM a),
    c AS (SELECT *, list_filter(['A', 'B', 'C', 'D'], lambda w: list_contains(words, w)) AS named FROM b),
    e AS (SELECT *, CASE WHEN len(named) = 1 AND NOT (list_contains(words, 'A') AND len(words) > 3) THEN named[1] WHEN len(named) = 0 AND list_contains(words, 'Z') THEN 'Z' END AS o,
        list_filter(['A', 'B', 'C', 'D'], lambda w: contains(lower(s), CASE w WHEN 'A' THEN 'letter' WHEN 'B' THEN 'think' WHEN 'C' THEN 'final' ELSE 'zebra' END)) AS held FROM c)"""


def _choices():
    return T.choices_of(F.lit("Letter"), F.lit("think"), F.lit("FINAL"), F.lit("zebra"))


@query(f"WITH a AS (SELECT conv_id, turn, {_FORM_SQL} AS s FROM conversations), {_PICKED} SELECT conv_id, turn, coalesce(o, CASE WHEN len(held) = 1 THEN held[1] END, 'unresolved') AS extracted, (coalesce(o, CASE WHEN len(held) = 1 THEN held[1] END, 'unresolved') = chr(65 + (conv_id % 5)::INT))::BIGINT AS hit FROM e")
def scored_answers(spark, d):
    x = _answers(spark, d).withColumns({"prediction": F.col("s"), "choices": _choices(), "answer": F.char((F.col("conv_id") % 5 + 65).cast("int"))})
    return evaluation.scored(x).select("conv_id", "turn", "extracted", "hit")


@query(f"WITH a AS (SELECT conv_id, turn, text AS s FROM conversations WHERE text IS NOT NULL), {_PICKED} SELECT conv_id, turn, coalesce(o, CASE WHEN len(held) = 1 THEN held[1] END) AS choice FROM e")
def option_extract_texts(spark, d):
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", T.infer(F.col("text"), _choices()).alias("choice"))


@query("""WITH a AS (SELECT conv_id, turn, coalesce(text, '') AS s FROM conversations),
    b AS (SELECT *, list_filter(regexp_extract_all(s, '[A-Za-z]+'), lambda w: w IN ('A', 'B', 'C', 'D', 'E')) AS alone,
        list_transform(regexp_extract_all(s, '(?i)(?:final\\s+answer|answer|the\\s+answer\\s+is)\\s*[:：]?\\s*\\(?\\s*(A|B|C|D|E)\\s*\\)?\\b', 1), lambda w: upper(w)) AS p1,
        regexp_extract_all(s, '^\\(?\\s*(A|B|C|D|E)\\s*\\)?[.。\\s]*$', 1) AS p2,
        list_transform(regexp_extract_all(s, '(?i)\\boption\\s*\\(?\\s*(A|B|C|D|E)\\s*\\)?\\b', 1), lambda w: upper(w)) AS p3 FROM a),
    c AS (SELECT *, list_sort(list_distinct(CASE WHEN len(p1) > 0 THEN p1 WHEN len(p2) > 0 THEN p2 WHEN len(p3) > 0 THEN p3 ELSE alone[-1:] END)) AS hits, list_sort(list_distinct(alone)) AS several FROM b),
    e AS (SELECT *, len(several) > 1 AND regexp_matches(s, '(?i)\\bor\\b|/') AS unsure FROM c)
    SELECT conv_id, turn, CASE WHEN NOT unsure AND len(hits) = 1 THEN hits[1] END AS label,
        CASE WHEN unsure THEN 'ambiguous:' || array_to_string(several, ',') WHEN len(hits) = 0 THEN 'no_valid_choice' WHEN len(hits) > 1 THEN 'ambiguous:' || array_to_string(hits, ',') ELSE 'ok' END AS status FROM e""")
def parse_choice_texts(spark, d):
    return table(spark, d, "conversations").withColumn("p", T.parse_choice(F.col("text"))).select("conv_id", "turn", "p.label", "p.status")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN trim(role) ELSE trim(text) END AS answer FROM conversations")
def after_reasoning(spark, d):
    text = F.when(F.col("turn") % 2 == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("</think> "), "role")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.after_reasoning(text).alias("answer"))


@query("SELECT n AS samples, n * 2.5::DOUBLE AS total_s, CASE WHEN n > 0 THEN 2.5::DOUBLE END AS s_per_sample, CASE WHEN n > 0 THEN 0.4::DOUBLE END AS samples_per_s FROM range(0, 6) t(n)")
def throughputs(spark, d):
    got = [(n, evaluation.throughput(n * 2.5, n)) for n in range(6)]
    return spark.createDataFrame([(n, x["total_s"], x["s_per_sample"], x["samples_per_s"]) for n, x in got], "samples long, total_s double, s_per_sample double, samples_per_s double")


@query(sql("tokens queries", f"SELECT video_id, qpos, {r('vec[1]', 'v0')} FROM queries WHERE video_id < 3 UNION ALL SELECT v.video_id, q.qpos, {r('q.vec[1]', 'v0')} FROM (SELECT DISTINCT video_id FROM tokens WHERE video_id NOT IN (SELECT video_id FROM queries WHERE video_id < 3)) v, (SELECT * FROM queries WHERE video_id = 9) q"))
def shared_query_rows(spark, d):
    q = query_tokens(spark, d).select("video_id", "qpos", "vec")
    some = q.where("video_id < 3").unionByName(q.where("video_id = 9").withColumn("video_id", F.lit(None).cast("long")))
    return out(similarity.query_rows(some, tokens(spark, d)).withColumn("v0", F.col("vec")[0]), "video_id", "qpos", rounded=("v0",))


@query(r"SELECT page_id, replace(regexp_replace(regexp_replace(printf('%.6f', (page_id % 1000) / 1000.0::DOUBLE), '0+$', ''), '\.$', '.0'), '.', 'p') AS key FROM pages")
def ratio_keys(spark, d):
    return table(spark, d, "pages").select("page_id", T.ratio_key((F.col("page_id") % 1000) / F.lit(1000.0)).alias("key"))


@query("SELECT page_id, 3::BIGINT AS n, (page_id + page_id % 7)::DOUBLE + 2.5 AS total FROM pages")
def comma_numbers(spark, d):
    csv = F.concat(F.col("page_id").cast("string"), F.lit(", "), (F.col("page_id") % 7).cast("string"), F.lit(",, 2.5 ,"))
    x = table(spark, d, "pages").select("page_id", T.numbers(csv).alias("v"))
    return x.select("page_id", F.size("v").cast("long").alias("n"), V.total("v").alias("total"))


@query("SELECT n_nationkey::BIGINT AS id, CASE n_nationkey % 3 WHEN 0 THEN 'A,B,C' WHEN 1 THEN 'A,C' ELSE 'A,B,C,D,E' END AS labels FROM nation")
def labels_of_choices(spark, d):
    k, x = F.col("id") % 3, F.lit("x")
    choices = T.choices_of(F.when(k < 2, x), F.when(k == 0, x), F.when(k < 2, x))
    return _nation(spark, d).select("id", F.array_join(T.valid_labels(choices), ",").alias("labels"))


@query(r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_.-]', '_', 'g') AS name, page_id::VARCHAR AS count_name FROM pages")
def name_variants(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_letters(F.col("url")).alias("name"), T.count_name(F.col("page_id")).alias("count_name"))
