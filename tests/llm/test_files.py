"""Archives, packing, and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

import numpy as np
import pytest
from corpus import corpus, frame


def b32(x: bytes) -> str:
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def test_archives_round_trip(spark, tmp_path):
    from tessera.llm import warc

    pages = [(5, "http://a/", "<p>é</p>"), (9, "http://b/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (7, "u", "x" * 300_000), (None, "n", "lone")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, sha1 string").repartition(3)
    folder = f"file://{tmp_path}/w"
    index = warc.write(df, folder)
    got = {r.page_id: tuple(r)[1:] for r in warc.read(index, folder).collect()}
    for i, _, html in pages:
        raw = (html or "").encode()
        same = [j for j, _, h in pages if (h or "") == (html or "") and j is not None]
        top = max(same, default=None)
        assert got[i] == (len(raw), b32(raw), "response" if i == top else "revisit", None if i == top else top)
    rows = index.collect()
    for r in rows:  # any record can be read by its place alone, as a gzip member
        with open(r.file, "rb") as f:
            f.seek(r.offset)
            record = gzip.decompress(f.read(r.length))
        assert record.startswith(b"WARC/1.0\r\n") and record.endswith(b"\r\n\r\n")
    some = index.where("page_id in (5, 7)")
    assert sorted(r.page_id for r in warc.read(some, folder).collect()) == [5, 7]
    assert warc.archive(df.where("page_id < 0"), folder).count() == 0


def test_repeated_pages(spark, tmp_path):
    from tessera.llm import warc

    df = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (1, "v", "same"), (1, "u", "other")], "page_id long, url string, html string")
    got = sorted((r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.archive(df, f"file://{tmp_path}/w").collect())
    assert got == [(4, "response", 0), (4, "revisit", 1), (4, "revisit", 1), (5, "response", 0)]


def path():
    from tessera.llm.queries import tokenizer_path

    return tokenizer_path()


def test_tokens_equal_the_library():
    from tessera.llm.packing import tokeniser

    t = tokeniser(path())
    texts = [x for _, x in corpus() if x] + ["a  b\n\n c", "  x", "x  ", "don't 's", " \t\n a1b2 33..", "\n\nfoo  \n bar", "日本 a", "<|endoftext|> x", "\x85 a", "\x1c a b", "a\0b c", "\xa0 x", "a  b"]
    for k in (1, 7, len(texts)):
        got = [x for i in range(0, len(texts), k) for x in t.encode(texts[i : i + k])]
        assert [x.tolist() for x in got] == [e.ids for e in t.library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("length", [16, 1024])
def test_packing_is_gapless(spark, length):
    from tessera.llm.packing import pack, tokeniser

    rows = corpus() + [(7, "again"), (7, "again"), (None, "none")]
    pieces = pack(frame(spark, rows), path(), length).collect()
    t = tokeniser(path())
    ids = {x: np.append(t.encode([x])[0], 0).astype("<u4") for x in {x or "" for _, x in rows}}
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
        assert 0 < p.length <= length
    assert sorted(by) == list(range(len(by)))
    for s, ps in by.items():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:i]) for i in range(len(ps))]
        assert sum(p.length for p in ps) == length or s == len(by) - 1
    assert sum(p.length for p in pieces) == sum(len(ids[x or ""]) for _, x in rows)
    unique = {i: x or "" for i, x in rows if i not in (7, None)}
    for p in pieces:
        if p.doc_id in unique:
            own = ids[unique[p.doc_id]]
            assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())


def test_packing_nothing(spark):
    from tessera.llm.packing import pack

    assert pack(frame(spark, [(1, "a")]).where("doc_id < 0"), path()).count() == 0


def test_stages_one_after_the_other(spark, data):
    """Each stage against the plain operator on its own input, and run() against the last."""
    import corpus_pipeline
    from test_dedup import brute_jaccard_kept

    from tessera.llm import decontaminate, pii

    docs = spark.read.parquet(f"{data}/documents.parquet")
    before, kept = docs, {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        after = f(spark, before, data).cache()
        assert after.columns == docs.columns
        kept[name] = (before, after)
        before = after
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    a, b = kept["SimHash near-dedup"]
    assert ids(b) == brute_jaccard_kept([(r.doc_id, r.text) for r in a.collect()])
    a, b = kept["benchmark decontamination"]
    bad = {r.doc_id for r in decontaminate.contaminated(a, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    assert ids(b) == sorted(set(ids(a)) - bad)
    a, b = kept["PII"]
    assert {r.doc_id: r.text for r in b.collect()} == {r.doc_id: pii.redacted(r.text) for r in a.collect()}
    a, b = kept["quality classifier"]
    marked = spark.read.parquet(f"{data}/labels.parquet").join(a, "doc_id")
    good, rest = set(r.doc_id for r in marked.where("quality = 1").collect()), set(ids(b))
    assert len(good & rest) >= 0.97 * len(good)
    out = corpus_pipeline.run(spark, data)
    assert sorted({r.doc_id for r in out.select("doc_id").collect()}) == ids(kept["PII"][1])


def test_words_of_one_hash_keep_their_own_ids():
    from test_edges import swapped, thue_morse

    from tessera.llm.packing import Tokeniser

    t = Tokeniser(path())
    for letters in (1024, 2048):
        a, b = thue_morse(letters), swapped(thue_morse(letters))
        texts = [f"{a} c", f"{b} c", f"x {a}", f"x {b}", f"{b} {a} {b}", a + b]
        for some in (texts, texts[::-1], texts[1:3]):
            for text, ids in zip(some, t.encode(some), strict=True):
                assert ids.tolist() == t.library.encode(text, add_special_tokens=False).ids
    # Even where all hashes are one: every word is compared with the word that was encoded.
    t = Tokeniser(path())
    t.values[:] = 0
    texts = ["one two six ten", "ten six two one", "abc one", "cab  one\n\ntwo"]
    for text, ids in zip(texts, t.encode(texts), strict=True):
        assert ids.tolist() == t.library.encode(text, add_special_tokens=False).ids


def test_pipeline_over_odd_rows(spark, data, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids; then tables without rows."""
    import corpus_pipeline

    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 60)] + [(None, 1, 0), (3, None, None)], spark.read.parquet(f"{data}/labels.parquet").schema)
    item = "which of these odd words was the answer to it all. the answer was the last of the odd words here."
    items = spark.createDataFrame([(1, item), (2, None), (None, "x"), (1, item)], "item_id long, text string")
    rows = [(i, f"good good plain words number {i} " * 9 if i % 2 else f"bad junk junk {i} " * 9, "en", "s", 1) for i in range(1, 60)]
    rows += [(None, "good plain words of no id", None, None, None), (61, None, "en", None, 5), (62, "", "en", "s", 0), (63, "good plain words and again " * 40_000, None, "s", 3)]
    rows += [(64, f"good good plain words. {item}", "en", "s", 9), (65, "good plain words, write to a@b.org", "en", "s", 9)] + [(66, "good plain words twice", "en", "s", 1)] * 3 + [(66, "good plain words of one id", "en", "s", 1)]
    for empty in (False, True):
        folder = f"{tmp_path}/{empty}"
        for name, df in (("documents", spark.createDataFrame(rows, schema)), ("labels", labels), ("benchmark", items)):
            (df.limit(0) if empty else df).write.parquet(f"{folder}/{name}.parquet")
        got = corpus_pipeline.run(spark, folder)
        assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        pieces = got.collect()
        if empty:
            assert not pieces
            continue
        found = {r.doc_id for r in pieces}
        assert {63, 65, 66} <= found and 64 not in found and sum(r.doc_id == 66 and r.start == 0 for r in pieces) == 2
        places = sorted((r.sequence_id, r.offset, r.length) for r in pieces)
        assert [s * 1024 + o for s, o, _ in places[1:]] == [s * 1024 + o + n for s, o, n in places[:-1]]


def test_stages_name_columns_that_are_not_there(spark, data):
    """Columns with clashing names and unknown ones pass through every stage but the last."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40).selectExpr("*", "doc_id as score", "text as row", "lang as tie", "1 as fp", "2 as no_id", "3 as lead")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns[-6:] == ["score", "row", "tie", "fp", "no_id", "lead"] and docs.count() >= 0
