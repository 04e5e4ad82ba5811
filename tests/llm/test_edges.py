"""Ids at the ends of their range, hot ids and rows, words made to collide, and sizes of messages."""

from __future__ import annotations

import numpy as np
import pytest
from corpus import frame
from test_dedup import brute_bytes, brute_windows

LAST = (1 << 63) - 1


def thue_morse(letters: int) -> str:
    return "".join("ab"[i.bit_count() & 1] for i in range(letters))


def swapped(word: str) -> str:
    return word.translate({97: 98, 98: 97})


def keyed(df, *columns):
    return sorted(((r.doc_id is None, r.doc_id or 0, *(r[c] for c in columns)) for r in df.collect()))


@pytest.mark.parametrize("letters", [1024, 2048])
def test_words_of_one_polynomial_are_told_apart(spark, letters):
    from tessera.llm.substring_dedup import remove_repeated

    word, front = thue_morse(letters), " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{front} {word}"), (2, f"{front} {swapped(word)}"), (3, f"{front} {word}")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated(frame(spark, rows)).collect()}
    assert got == brute_windows(rows)
    assert [got[i][1] for i in (1, 2, 3)] == [0, 0, 20]


def test_bytes_of_one_polynomial_are_told_apart(spark):
    from tessera.llm.suffix_dedup import remove_repeated

    word = thue_morse(4096)
    rows = [(1, word[:1024]), (2, swapped(word[:1024])), (3, word[1500:1640]), (4, "c" + swapped(word)[2000:2100])]
    assert {r.doc_id: tuple(r)[1:] for r in remove_repeated(frame(spark, rows)).collect()} == brute_bytes(rows)


def test_the_largest_id_is_not_null(spark):
    from tessera.llm import simhash, substring_dedup, suffix_dedup

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (LAST, text), (None, "other words"), (-LAST - 1, "some more")]
    df = frame(spark, rows)
    assert keyed(substring_dedup.remove_repeated(df), "n_removed") == [(False, -LAST - 1, 0), (False, LAST, 0), (True, 0, 0), (True, 0, 40)]
    size = len(text)
    assert keyed(suffix_dedup.remove_repeated(df), "n_removed") == [(False, -LAST - 1, 0), (False, LAST, 0), (True, 0, 0), (True, 0, size)]
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(None, LAST), (LAST, LAST), (None, None), (-LAST - 1, -LAST - 1)], key=str)


def test_hot_ids_and_hot_rows(spark):
    """A third of the rows have no id, a third are one row, a third are texts of one id."""
    from tessera.llm import substring_dedup, suffix_dedup

    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(None, f"n{i} {passage}") for i in range(200)] + [(5, passage)] * 200 + [(7, f"s{i} {passage} t{i}") for i in range(200)]
    df = frame(spark, rows)
    words = substring_dedup.remove_repeated(df).select("doc_id", "n_words", "n_removed").collect()
    assert sorted(map(str, words)) == sorted(f"Row(doc_id={i}, n_words={len(t.split())}, n_removed={0 if i == 5 else 25})" for i, t in rows)
    left = suffix_dedup.remove_repeated(df).select("doc_id", "n_bytes", "n_removed").collect()
    assert len(left) == len(rows) and {r.n_removed for r in left if r.doc_id == 5} == {0}
    # A blank before or after the passage is shared by rows of later ids only where an earlier id has it too.
    assert all(r.n_removed >= len(passage) for r in left if r.doc_id != 5)


def test_rows_of_one_block_in_several_flushes(spark, monkeypatch):
    """Blocks are merged in the order of ids, and a row that came before is one row."""
    from tessera.llm import exchange as ex

    one = (np.array([3, 9]), np.zeros(2, np.uint64), np.array([0, 0, 1], np.int32), np.array([0, 4, 1]))
    two = (np.array([1, 9]), np.zeros(2, np.uint64), np.array([0, 1], np.int32), np.array([7, 1]))
    ids, tag, doc, at = ex.merged([one, two])
    assert ids.tolist() == [1, 3, 9] and doc.tolist() == [0, 1, 1, 2] and at.tolist() == [7, 0, 4, 1] and not tag.any()


def test_buckets_follow_the_text():
    from tessera.llm.exchange import sizes

    assert sizes(0, 200) == 1 and sizes(25 << 20, 8) == 8
    assert sizes(25 << 20, 2048) == sizes(25 << 20, 16_384) == 25
    assert sizes(30 << 30, 200) == 1536 and sizes(30 << 30, 4096) == 4096


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from tessera.llm.common import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))


def test_hot_fingerprints_meet_in_several_tasks(spark):
    from tessera.llm.simhash import near_duplicates

    rows = [(i if i % 3 else None, "same words in all of them") for i in range(1, 60)] + [(100 + i, f"t{i} u{i} v{i}") for i in range(9)] + [(None, None), (200, " ")]
    df = frame(spark, rows)
    every = sorted(map(str, near_duplicates(df).collect()))
    assert len(every) == len(rows) and every == sorted(map(str, near_duplicates(df, share=7).collect()))


@pytest.mark.parametrize("repeated", [False, True])
def test_one_of_each_group_stays_whatever_the_names(spark, repeated):
    from tessera.llm import near_dedup, simhash

    rows = [(1, "a b c d e f", "x", 1, 2, True), (3, "a b c d e f", "y", 1, 2, False), (LAST, "g h i", "z", 1, 2, None), (None, "g h i", "w", 1, 2, None)]
    rows += [(1, "a b c d e f", "x", 1, 2, True), (1, "other text", "q", 0, 0, True)] if repeated else []
    df = spark.createDataFrame(rows, "doc_id long, text string, tessera_fp string, lead int, fp int, no_id boolean")
    for keep in (simhash.keep_one, near_dedup.keep_one):
        kept = keep(df)
        assert kept.schema == df.schema
        got = sorted((r.doc_id, r.tessera_fp) for r in kept.collect())
        assert got == sorted([(1, "x"), (LAST, "z")] + [(1, "q")] * repeated)
        assert keep(df.where("doc_id < 0")).count() == 0
