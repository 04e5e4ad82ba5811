"""Queries of flow, statistics, overlap, evaluation, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import evaluation, filters, flow, overlap, ranking, similarity, statistics, summaries
from tessera.sources import media
from tessera.streaming import windows

from .base import out, query, r, scored_tokens, scratch, sql, table, tokens

#: Every eight tokens of a video are a sequence; its last two are the targets, the others visual.
_ATTN = """, seqs AS (SELECT video_id * 1000000 + pos // 8 AS question_id, pos % 8 AS pos, u, count(*) OVER (PARTITION BY video_id, pos // 8) AS n FROM units),
    attn AS (SELECT question_id, q, k, n, e / sum(e) OVER (PARTITION BY question_id, q) AS a FROM (SELECT a.question_id, a.pos AS q, b.pos AS k, a.n, exp(list_dot_product(a.u, b.u)) AS e FROM seqs a JOIN seqs b ON a.question_id = b.question_id AND b.pos <= a.pos)),
    paths AS (SELECT question_id, pos, n, 0.5::DOUBLE AS w FROM seqs WHERE pos >= n - 2 UNION ALL SELECT p.question_id, k, p.n, w * a FROM paths p JOIN attn ON attn.question_id = p.question_id AND q = p.pos AND k < q),
    reach AS (SELECT question_id, pos, any_value(n) AS n, sum(w) AS h FROM paths GROUP BY question_id, pos)"""


def _attention(spark, d):
    x = tokens(spark, d).select((F.col("video_id") * 1_000_000 + F.floor(F.col("pos") / 8)).alias("question_id"), F.lit(0).cast("long").alias("head"), (F.col("pos") % 8).alias("pos"), V.normalised("vec").alias("q"))
    x = ranking.with_total(x, ["question_id"], "n").withColumn("k", F.col("q"))
    a = similarity.causal_attention(x.drop("n"), 1.0)
    targets = x.where("pos >= n - 2").select("question_id", F.col("pos").alias("target"))
    return a, targets, x.where("pos < n - 2").select("question_id", "pos")


@query(sql("tokens units", f"{_ATTN} SELECT question_id, q, k, {r('a')} FROM attn"))
def causal_attention(spark, d):
    return out(_attention(spark, d)[0], "question_id", "q", "k", rounded=("a",))


@query(sql("tokens units", f"{_ATTN} SELECT question_id, pos, {r('h')} FROM reach"))
def flow_reachability(spark, d):
    a, targets, _ = _attention(spark, d)
    return out(flow.reachability(a, targets), "question_id", "pos", rounded=("h",))


@query(sql("tokens units", f"{_ATTN} SELECT question_id, pos, {r('h / sum(h) OVER (PARTITION BY question_id)', 'responsibility')} FROM reach WHERE pos < n - 2"))
def responsibility(spark, d):
    a, targets, visual = _attention(spark, d)
    return out(flow.responsibility(flow.reachability(a, targets), visual), "question_id", "pos", rounded=("responsibility",))


@query(sql("tokens units", f"{_ATTN} SELECT question_id, pos, {r('m / sum(m) OVER (PARTITION BY question_id)', 'direct')} FROM (SELECT question_id, k AS pos, sum(a) / 2 AS m FROM attn WHERE q >= n - 2 AND k < n - 2 GROUP BY question_id, k)"))
def direct_attention(spark, d):
    return out(flow.direct_attention(*_attention(spark, d)), "question_id", "pos", rounded=("direct",))


@query(sql("tokens", f"SELECT frame AS layer, pos % 4 AS local_idx, {r('avg(vec[1])', 'value')}, count(*) AS questions FROM tokens GROUP BY ALL"))
def layer_means(spark, d):
    x = tokens(spark, d).select(F.col("video_id").alias("question_id"), F.col("frame").alias("layer"), (F.col("pos") % 4).alias("local_idx"), F.col("vec")[0].alias("value"))
    return out(flow.layer_means(x), "layer", "local_idx", "questions", rounded=("value",))


@query(sql("tokens", "SELECT n, count(*) AS questions, n = (SELECT n FROM (SELECT n, count(*) AS c FROM (SELECT count(*) AS n FROM tokens GROUP BY video_id) GROUP BY n) ORDER BY c DESC, n LIMIT 1) AS most_common FROM (SELECT count(*) AS n FROM tokens GROUP BY video_id) GROUP BY n"))
def layer_matrix_summary(spark, d):
    return flow.layer_matrix_summary(tokens(spark, d).select(F.col("video_id").alias("question_id"), F.col("pos").alias("local_idx")))


_NUMBERED = "SELECT l_returnflag AS g, l_orderkey * 10 + l_linenumber AS i, l_extendedprice AS v, epoch(l_shipdate)::BIGINT AS t FROM lineitem"
_RANKS = f"SELECT g, v, i, t, rank() OVER (PARTITION BY g ORDER BY v) - 1 + (count(*) OVER (PARTITION BY g, v) - 1) / 2 AS rv, rank() OVER (PARTITION BY g ORDER BY i) - 1 + (count(*) OVER (PARTITION BY g, i) - 1) / 2 AS ri, rank() OVER (PARTITION BY g ORDER BY t) - 1 + (count(*) OVER (PARTITION BY g, t) - 1) / 2 AS rt FROM ({_NUMBERED})"


def _numbered(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), F.col("l_extendedprice").alias("v"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("t"))


@query(f"""SELECT g, {r('sum(CASE WHEN r <= greatest(1, ceil(n * 0.01::DOUBLE)) THEN p END)', 'top_1pct_mass')}, {r('sum(CASE WHEN r <= greatest(1, ceil(n * 0.05::DOUBLE)) THEN p END)', 'top_5pct_mass')},
    {r('sum(CASE WHEN r <= greatest(1, ceil(n * 0.1::DOUBLE)) THEN p END)', 'top_10pct_mass')}, {r('sum(CASE WHEN r <= greatest(1, ceil(n * 0.2::DOUBLE)) THEN p END)', 'top_20pct_mass')},
    {r('sum(-p * ln(greatest(p, 1e-300))) / ln(any_value(n))', 'normalized_entropy')}, {r('exp(sum(-p * ln(greatest(p, 1e-300)))) / any_value(n)', 'effective_token_fraction')},
    {r('sum((2 * up - n - 1) * p) / (any_value(n) * sum(p))', 'gini')}, {r('corr(rv, ri)', 'spearman_local_index')}, {r('corr(rv, rt)', 'spearman_temporal_index')}
    FROM (SELECT *, v / sum(v) OVER (PARTITION BY g) AS p, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY v DESC, i) AS r, row_number() OVER (PARTITION BY g ORDER BY v) AS up FROM ({_RANKS})) GROUP BY g""")
def concentration_stats(spark, d):
    x = statistics.concentration(_numbered(spark, d), ["g"], "v", "i", "t")
    return out(x, "g", rounded=("top_1pct_mass", "top_5pct_mass", "top_10pct_mass", "top_20pct_mass", "normalized_entropy", "effective_token_fraction", "gini", "spearman_local_index", "spearman_temporal_index"))


@query(f"SELECT event_type, {r('sum((2 * i - n - 1) * v) / (any_value(n) * sum(v))', 'gini')} FROM (SELECT event_type, value - least(0, min(value) OVER (PARTITION BY event_type)) AS v, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i FROM events) GROUP BY event_type")
def gini(spark, d):
    return out(statistics.gini(table(spark, d, "events"), ["event_type"], "value"), "event_type", rounded=("gini",))


@query(f"SELECT g, {r('corr(rv, rt)', 'spearman')} FROM ({_RANKS}) GROUP BY g")
def spearman_avg_rank(spark, d):
    return out(statistics.spearman(_numbered(spark, d), ["g"], "v", "t"), "g", rounded=("spearman",))


_OVERLAP = """, a AS (SELECT video_id, pos FROM tokens QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY vec[1] DESC, pos) <= greatest(1, floor(count(*) OVER (PARTITION BY video_id) * 0.2::DOUBLE + 0.5))),
    b AS (SELECT video_id, pos FROM tokens QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY vec[2] DESC, pos) <= greatest(1, floor(count(*) OVER (PARTITION BY video_id) * 0.4::DOUBLE + 0.5))),
    s AS (SELECT video_id, count(*) AS n, count(a.pos)::DOUBLE AS sa, count(b.pos)::DOUBLE AS sb, count(CASE WHEN a.pos IS NOT NULL AND b.pos IS NOT NULL THEN 1 END)::DOUBLE AS hit FROM tokens t LEFT JOIN a USING (video_id, pos) LEFT JOIN b USING (video_id, pos) GROUP BY video_id),
    o AS (SELECT video_id, n AS dense_token_count, sa::BIGINT AS a_count, sb::BIGINT AS b_count, hit::BIGINT AS overlap_count, hit / sa AS a_overlap_fraction, hit / sb AS b_overlap_fraction, hit / (sa + sb - hit) AS iou,
        sa * sb / n AS expected_overlap_count, (hit / sa) / (sb / n) AS enrichment, CASE WHEN least(sa, sb) - sa * sb / n > 0 THEN (hit - sa * sb / n) / (least(sa, sb) - sa * sb / n) END AS normalized_overlap FROM s)"""


def _overlap(spark, d):
    s = scored_tokens(spark, d)
    return overlap.overlap(ranking.ranked_set(s, ["video_id"], "s1", 0.2), ranking.ranked_set(s, ["video_id"], "s2", 0.4), s.groupBy("video_id").agg(F.count("*").alias("n")), ["video_id"])


@query(sql("tokens", f"{_OVERLAP} SELECT video_id, dense_token_count, a_count, b_count, overlap_count, {r('a_overlap_fraction')}, {r('b_overlap_fraction')}, {r('iou')}, {r('expected_overlap_count')}, {r('enrichment')}, {r('normalized_overlap')} FROM o"))
def overlap_metrics(spark, d):
    return out(_overlap(spark, d), "video_id", "dense_token_count", "a_count", "b_count", "overlap_count", rounded=("a_overlap_fraction", "b_overlap_fraction", "iou", "expected_overlap_count", "enrichment", "normalized_overlap"))


@query(sql("tokens", f"{_OVERLAP} SELECT a_count, count(*) AS rows, count(DISTINCT video_id) AS unique_questions, {r('avg(iou)', 'mean_iou')}, {r('avg(enrichment)', 'mean_enrichment')} FROM o GROUP BY a_count"))
def overlap_summary(spark, d):
    return out(overlap.summary(_overlap(spark, d), ["a_count"]), "a_count", "rows", "unique_questions", rounded=("mean_iou", "mean_enrichment"))


@query(f"SELECT event_type, count(*) AS n, {r('avg(v)', 'mean')} FROM (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL) GROUP BY event_type")
def two_level_mean(spark, d):
    return out(summaries.two_level_mean(table(spark, d, "events"), ["user_id", "event_type"], ["event_type"], "value"), "event_type", "n", rounded=("mean",))


@query(f"SELECT user_id, {r('a - b', 'diff')} FROM (SELECT user_id, avg(value) FILTER (event_type = (SELECT min(event_type) FROM events)) AS a, avg(value) FILTER (event_type = (SELECT max(event_type) FROM events)) AS b FROM events GROUP BY user_id) WHERE a IS NOT NULL AND b IS NOT NULL")
def paired_diff(spark, d):
    e = table(spark, d, "events")
    ends = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    return out(summaries.paired_differences(e, ["user_id"], "event_type", ends.a, ends.b, "value"), "user_id", rounded=("diff",))


@query()
def bootstrap_ci(spark, d):
    return summaries.bootstrap_interval(table(spark, d, "events").select("event_type", "value"), ["event_type"], "value", resamples=500)


_EVAL = "SELECT lang AS domain, source AS sub_category, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS task_category, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 4000 THEN 'medium' ELSE 'long' END AS duration, (toxic = 0)::BIGINT AS hit FROM documents JOIN labels USING (doc_id)"


@query(f"""SELECT CASE WHEN grouping(domain) = 0 THEN 'domain' WHEN grouping(sub_category) = 0 THEN 'sub_category' WHEN grouping(task_category) = 0 THEN 'task_category' WHEN grouping(duration) = 0 THEN 'duration' ELSE 'overall' END AS level,
    coalesce(domain, sub_category, task_category, duration, '') AS value, count(*) AS n, {r('avg(hit)', 'accuracy')} FROM ({_EVAL}) GROUP BY GROUPING SETS ((), (domain), (sub_category), (task_category), (duration))""")
def accuracy_grouping_sets(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        F.col("lang").alias("domain"), F.col("source").alias("sub_category"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("task_category"),
        F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 4000, "medium").otherwise("long").alias("duration"), (F.col("toxic") == 0).cast("long").alias("hit"),
    )
    return out(evaluation.accuracy(x), "level", "value", "n", rounded=("accuracy",))


_FORMS = ("The answer is ({0}).", "{0}.", "I choose option {0} here", "it may be {0} or B", "Answer: {0}", "no letter at all", "I think it is {0}", "final answer {0}/C")
_FORM_SQL = "CASE (conv_id + turn) % 8 " + " ".join(f"WHEN {i} THEN replace('{f}', '{{0}}', chr(65 + (conv_id % 5)::INT))" for i, f in enumerate(_FORMS)) + " END"


def _answers(spark, d):
    letter = F.char((F.col("conv_id") % 5 + 65).cast("int"))
    form = F.element_at(F.array(*map(F.lit, _FORMS)), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.replace(form, F.lit("{0}"), letter).alias("s"))


@query(f"""WITH a AS (SELECT conv_id, turn, {_FORM_SQL} AS s FROM conversations),
    b AS (SELECT *, list_filter(regexp_extract_all(s, '[A-Za-z]+'), lambda w: w IN ('A', 'B', 'C', 'D', 'E')) AS alone,
        list_transform(regexp_extract_all(s, '(?i)(?:final\\s+answer|answer|the\\s+answer\\s+is)\\s*[:：]?\\s*\\(?\\s*(A|B|C|D|E)\\s*\\)?\\b', 1), lambda w: upper(w)) AS p1,
        regexp_extract_all(s, '^\\(?\\s*(A|B|C|D|E)\\s*\\)?[.。\\s]*$', 1) AS p2,
        list_transform(regexp_extract_all(s, '(?i)\\boption\\s*\\(?\\s*(A|B|C|D|E)\\s*\\)?\\b', 1), lambda w: upper(w)) AS p3 FROM a),
    c AS (SELECT *, list_sort(list_distinct(CASE WHEN len(p1) > 0 THEN p1 WHEN len(p2) > 0 THEN p2 WHEN len(p3) > 0 THEN p3 ELSE alone[-1:] END)) AS hits, list_sort(list_distinct(alone)) AS several FROM b),
    e AS (SELECT *, len(several) > 1 AND regexp_matches(s, '(?i)\\bor\\b|/') AS unsure FROM c)
    SELECT conv_id, turn, CASE WHEN NOT unsure AND len(hits) = 1 THEN hits[1] END AS label,
        CASE WHEN unsure THEN 'ambiguous:' || array_to_string(several, ',') WHEN len(hits) = 0 THEN 'no_valid_choice' WHEN len(hits) > 1 THEN 'ambiguous:' || array_to_string(hits, ',') ELSE 'ok' END AS status FROM e""")
def parse_choice(spark, d):
    return _answers(spark, d).withColumn("p", T.parse_choice(F.col("s"))).select("conv_id", "turn", "p.label", "p.status")


@query(f"""WITH a AS (SELECT conv_id, turn, {_FORM_SQL} AS s FROM conversations),
    b AS (SELECT *, list_filter(string_split_regex(translate(s, '.()[],:;!*#{{}}', '              '), '\\s+'), lambda w: w != '') AS words FROM a),
    c AS (SELECT *, list_filter(['A', 'B', 'C', 'D'], lambda w: list_contains(words, w)) AS named FROM b),
    e AS (SELECT *, CASE WHEN len(named) = 1 AND NOT (list_contains(words, 'A') AND len(words) > 3) THEN named[1] WHEN len(named) = 0 AND list_contains(words, 'Z') THEN 'Z' END AS o,
        list_filter(['A', 'B', 'C', 'D'], lambda w: contains(lower(s), CASE w WHEN 'A' THEN 'letter' WHEN 'B' THEN 'think' WHEN 'C' THEN 'final' ELSE 'zebra' END)) AS held FROM c)
    SELECT conv_id, turn, coalesce(o, CASE WHEN len(held) = 1 THEN held[1] END) AS choice FROM e""")
def option_extract(spark, d):
    choices = T.choices_of(F.lit("Letter"), F.lit("think"), F.lit("FINAL"), F.lit("zebra"))
    return _answers(spark, d).select("conv_id", "turn", T.infer(F.col("s"), choices).alias("choice"))


@query("SELECT conv_id, string_agg(trim(text), chr(10) ORDER BY turn) AS query FROM conversations WHERE lower(role) = 'user' AND trim(text) != '' GROUP BY conv_id")
def query_text(spark, d):
    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return x.select("conv_id", T.message_text(F.col("m"), ("user",)).alias("query")).where("query != ''")


@query("SELECT n_nationkey::BIGINT AS id, 'Question:' || chr(10) || n_name || chr(10) || chr(10) || 'Options:' || chr(10) || '(A) ' || r_name || chr(10) || '(B) other' AS query FROM nation JOIN region ON r_regionkey = n_regionkey")
def question_text(spark, d):
    x = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"))  # the five regions
    return x.select(F.col("n_nationkey").cast("long").alias("id"), T.query_text(F.col("n_name"), T.choices_of(F.col("r_name"), F.lit("other"))).alias("query"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') AS name, 'drop_' || replace(printf('%.4f', (page_id % 10) / 10.0::DOUBLE), '.', 'p') AS drop_name FROM pages")
def safe_names(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"), T.drop_name((F.col("page_id") % 10) / F.lit(10.0)).alias("drop_name"))


@query("""SELECT video_id, i, least(frames - 1, round_even(i * (frames - 1)::DOUBLE / (n - 1), 0))::BIGINT AS index, round(least(frames - 1, round_even(i * (frames - 1)::DOUBLE / (n - 1), 0)) / rate, 6) + 0.0 AS seconds
    FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT video_id, frames, rate, least(greatest(round_even(frames / rate, 0) * 2, 4), 32, frames // 2 * 2)::BIGINT AS n FROM (SELECT o_orderkey AS video_id, (20 + o_orderkey % 700)::BIGINT AS frames, (24 + o_custkey % 7)::DOUBLE AS rate FROM orders)))""")
def frame_sampling(spark, d):
    v = table(spark, d, "orders").select(F.col("o_orderkey").alias("video_id"), (20 + F.col("o_orderkey") % 700).alias("frames"), (24 + F.col("o_custkey") % 7).cast("double").alias("rate"))
    return out(media.sampled_frames(v, most=32), "video_id", "i", "index", rounded=("seconds",))


_CUES = "SELECT o_custkey % 50 AS video_id, o_orderkey AS ord, (o_orderkey % 5000) * 100 AS start_ms, (o_orderkey % 5000) * 100 + 1500 AS end_ms, o_orderpriority AS text FROM orders"
_TIMES = "SELECT c_custkey % 50 AS video_id, (c_custkey % 500) + 0.05::DOUBLE AS seconds FROM customer"


def _cues(spark, d):
    o = table(spark, d, "orders")
    cues = o.select((F.col("o_custkey") % 50).alias("video_id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 5000 * 100).alias("start_ms"), (F.col("o_orderkey") % 5000 * 100 + 1500).alias("end_ms"), F.col("o_orderpriority").alias("text"))
    times = table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("video_id"), (F.col("c_custkey") % 500 + F.lit(0.05)).alias("seconds"))
    return media.shown(cues, times)


@query(f"SELECT video_id, ord FROM ({_CUES}) c WHERE EXISTS (SELECT 1 FROM ({_TIMES}) t WHERE t.video_id = c.video_id AND start_ms / 1000 < seconds AND end_ms / 1000 > seconds)")
def interval_semi_join(spark, d):
    return _cues(spark, d).select("video_id", "ord")


@query(f"SELECT video_id, string_agg(text, ' ' ORDER BY ord) AS subtitles FROM ({_CUES}) c WHERE EXISTS (SELECT 1 FROM ({_TIMES}) t WHERE t.video_id = c.video_id AND start_ms / 1000 < seconds AND end_ms / 1000 > seconds) GROUP BY video_id")
def subtitle_text(spark, d):
    return media.subtitle_text(_cues(spark, d))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) WHERE p % 4 = 1 AND p >= 1 + 10 * 4 AND p < 1 + 110 * 4")
def shard_filter(spark, d):
    return filters.samples(table(spark, d, "documents").select("doc_id"), "doc_id", ids=table(spark, d, "labels").select("doc_id"), id_column="doc_id", shards=4, shard=1, offset=10, limit=100)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, d):
    return filters.unfinished(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT question_id, round(exp(least(0, lp)), 6) + 0.0 AS confidence FROM (SELECT event_id::VARCHAR AS question_id, -value AS lp FROM events WHERE event_type != (SELECT min(event_type) FROM events)) ORDER BY exp(least(0, lp)) DESC, lp DESC, question_id LIMIT 50")
def high_confidence(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type")).first()[0]
    x = e.select(F.col("event_id").cast("string").alias("question_id"), F.lit(False).alias("skip"), F.when(F.col("event_type") != first, "ok").otherwise("no").alias("parse_status"), (-F.col("value")).alias("logprob"))
    return out(filters.high_confidence(x, 50), "question_id", rounded=("confidence",))


@query(f"SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, {r('avg(value)', 'mean')} FROM events GROUP BY ALL")
def windowed_means(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return out(windows.windowed_means(e).withColumn("start_us", F.unix_micros("start")), "start_us", "event_type", "n", rounded=("mean",))


@query(f"SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, {r('avg(value)', 'mean')} FROM events GROUP BY ALL")
def streaming_windowed_means(spark, d):
    """The same by a stream over the file: processed once; each batch's complete result replaces the one before, on files."""
    schema = table(spark, d, "events").schema
    stream = windows.windowed_means(windows.event_stream(spark, f"{d}/events.parque[t]", schema))
    path = scratch(spark)
    windows.run_complete(stream, f"{path}/out", f"{path}/checkpoint")
    return out(spark.read.parquet(f"{path}/out").withColumn("start_us", F.unix_micros("start")), "start_us", "event_type", "n", rounded=("mean",))


@query("""SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
    FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s""")
def sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.sessions(e).select("user_id", F.unix_micros("start").alias("start_us"), "n")
