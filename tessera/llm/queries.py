"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeated

    return remove_repeated(_read(spark, sf_dir, "documents")).drop("intervals")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(_read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeated

    return remove_repeated(_read(spark, sf_dir, "documents"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnowing import edited_fingerprints

    return edited_fingerprints(_read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import new_folder
    from .warc import archive

    return archive(_read(spark, sf_dir, "pages"), new_folder(spark, "warc"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), tokenizer_path())


_OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS n FROM w),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, n - 18)) AS s FROM n WHERE n >= 20)),
late AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i, 1 AS hit FROM late),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, n + 1)) AS i FROM n),
kept AS (SELECT doc_id, count(hit) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (hit IS NULL) AS kept FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM n LEFT JOIN kept USING (doc_id)
"""

_OP5 = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, s, substring(h, 2 * s + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(n - 49)) AS s FROM b WHERE n >= 50)),
late AS (SELECT doc_id, s FROM win QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id),
edges AS (SELECT doc_id, i, sum(d) AS d FROM (SELECT doc_id, s AS i, 1 AS d FROM late UNION ALL SELECT doc_id, s + 50, -1 FROM late) GROUP BY ALL),
cover AS (SELECT doc_id, i, sum(d) OVER w AS c, lead(i) OVER w AS j FROM edges WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, min(i) AS a, max(j) AS z FROM (SELECT doc_id, i, j, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g
    FROM (SELECT doc_id, i, j, CASE WHEN lag(j) OVER (PARTITION BY doc_id ORDER BY i) = i THEN 0 ELSE 1 END AS new FROM cover WHERE c > 0)) GROUP BY doc_id, g),
parts AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM runs),
cut AS (SELECT doc_id, count(*)::BIGINT AS n_spans, sum(z - a)::BIGINT AS n_removed, string_agg(substring(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS front, max(z) AS z FROM parts JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(front || substring(h, 2 * z + 1), h))) AS kept_sha256 FROM b LEFT JOIN cut USING (doc_id)
"""

_OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, (unhex(sha1(html))::BIT)::VARCHAR AS bits, max(page_id) OVER (PARTITION BY html) AS response FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
    list_aggregate([substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substring(bits, 5 * i + 1, 1)::INT + 8 * substring(bits, 5 * i + 2, 1)::INT + 4 * substring(bits, 5 * i + 3, 1)::INT
        + 2 * substring(bits, 5 * i + 4, 1)::INT + substring(bits, 5 * i + 5, 1)::INT, 1) for i in range(32)], 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != response THEN response END AS refers_to FROM d
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """The other operators hash, tokenise, train or retrieve in ways that SQL has no functions for; tests hold them against brute force."""
    return {"op1_substring_dedup": _OP1, "op5_suffix_array": _OP5, "op7_warc": _OP7}
