"""Duplicate removal against brute force, with the edge cases of its contract."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from corpus import corpus, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def brute_windows(rows, width=20):
    out, seen = {}, set()
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone[k : k + width] = [True] * width
            seen.add(key)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode()))
    return out


def brute_bytes(rows, width=50):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if first.setdefault(b[k : k + width], i) < i:
                gone[k : k + width] = True
        spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def brute_simhash(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    counts = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(s))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_words_equal_brute_force(spark):
    from tessera.llm.substring_dedup import remove_repeated

    rows = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated(frame(spark, rows)).collect()}
    assert got == brute_windows(rows)


def test_words_intervals_and_repeated_rows(spark):
    from tessera.llm.substring_dedup import remove_repeated

    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (2, f"a {text} b"), (2, f"a {text} b"), (2, "other text"), (None, text), (None, None)]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, [tuple(i) for i in r.intervals]) for r in remove_repeated(frame(spark, rows)).collect()))
    assert got == [(False, 1, 30, 0, []), (False, 2, 2, 0, []), (False, 2, 32, 30, [(1, 31)]), (False, 2, 32, 30, [(1, 31)]), (True, 0, 0, 0, []), (True, 0, 30, 30, [(0, 30)])]


def test_bytes_equal_brute_force(spark):
    from tessera.llm.suffix_dedup import remove_repeated

    for seed in (5, 6):
        rows = corpus(seed)
        got = {r.doc_id: tuple(r)[1:] for r in remove_repeated(frame(spark, rows)).collect()}
        assert got == brute_bytes(rows)


def test_bytes_of_one_id_stay(spark):
    from tessera.llm.suffix_dedup import remove_repeated

    rows = [(7, "q" * 80), (7, "q" * 80), (7, "q" * 60 + "r"), (8, "q" * 50), (None, "q" * 49)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeated(frame(spark, rows)).collect())
    assert got == [(0, 49, 0, 0), (7, 61, 0, 0), (7, 80, 0, 0), (7, 80, 0, 0), (8, 50, 50, 1)]


def test_texts_of_a_home_are_opened_together():
    """However many messages a home gets, its marks are looked up once for some megabytes of text."""
    from tessera.llm import exchange as ex

    texts = [b"text %d " % i * (i % 4) for i in range(300)]
    payloads = []
    for i, t in enumerate(texts):
        head = np.array([i, 0, 1 + i % 2, len(t)], "<i8").tobytes()
        payloads.append(ex._squeeze((1).to_bytes(4, "little") + head + t))
    for most, blocks in ((ex.OPENED_BYTES, 1), (1, 225)):
        got = list(ex.texts_of(pa.chunked_array([pa.array(payloads, pa.binary())]), most))
        assert len(got) == blocks
        ids, tags, copies = (np.concatenate([x[k] for x in got]) for k in range(3))
        assert ids.tolist() == list(range(300)) and not tags.any() and copies.tolist() == [1, 2] * 150
        assert [bytes(x[3].text(i)) for x in got for i in range(x[3].n)] == texts
    assert not list(ex.texts_of(pa.chunked_array([], pa.binary())))


def test_bytes_in_many_small_batches(spark):
    from tessera.llm.suffix_dedup import remove_repeated

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, rows = spark.conf.get(key), corpus(5)
    spark.conf.set(key, "1")
    try:
        got = {r.doc_id: tuple(r)[1:] for r in remove_repeated(frame(spark, rows)).collect()}
    finally:
        spark.conf.set(key, was)
    assert got == brute_bytes(rows)


def test_many_contexts_of_one_passage(spark):
    """One passage amid different neighbours: its anchor has more text than is sorted at once."""
    import random

    from tessera.llm.suffix_dedup import remove_repeated

    rng = random.Random(3)
    noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(70))
    rows = [(i, noise() + "the very same forty bytes of text in all!" + noise()[: rng.randrange(70)] + "tail of some length here ok") for i in range(150)]
    rows += [(1000 + i, t[10:]) for i, t in rows[:40]]
    for hot in (500, 5, 1):
        got = {r.doc_id: tuple(r)[1:] for r in remove_repeated(frame(spark, rows), hot=hot).collect()}
        assert got == brute_bytes(rows)


@pytest.mark.parametrize("joined", [60, 2048, 1 << 17])
def test_holders_whatever_is_sorted_at_once(monkeypatch, joined):
    """Equal windows and their smallest holders, with every hash of a segment the same: bytes decide."""
    from tessera.llm import suffix_dedup as S
    from tessera.llm.common import block_of

    monkeypatch.setattr(S, "_JOINED", joined)
    rng = np.random.default_rng(joined)
    base = "".join(rng.choice(list("ab"), 90))
    texts = sorted({base[a : a + 50 + b] + "".join(rng.choice(list("abc"), c)) for a, b, c in rng.integers(0, [40, 40, 30], (120, 3))})
    holder = rng.integers(0, 30, len(texts))
    group = np.sort(rng.integers(0, 3, len(texts)))
    windows, smallest = [], {}
    for t, h, g in zip(texts, holder.tolist(), group.tolist()):
        for k in range(len(t) - 49):
            windows.append((g, t[k : k + 50]))
            smallest[windows[-1]] = min(h, smallest.get(windows[-1], 99))
    plain = S.segments
    for alike in (False, True):
        if alike:
            monkeypatch.setattr(S, "segments", lambda *a: (*plain(*a)[:4], np.zeros_like(plain(*a)[4])))
        got = S.smallest_holders(block_of(pa.array(texts)), group, holder, 50)
        assert got.tolist() == [smallest[w] for w in windows]


def test_suffix_arrays():
    from tessera.llm.gsaca import suffix_arrays

    rng = np.random.default_rng(0)
    for _ in range(60):
        strings = [np.append(rng.integers(1, rng.integers(2, 5), rng.integers(0, 50)), 0) for _ in range(rng.integers(1, 9))]
        lengths = np.array([len(x) for x in strings])
        got, at = suffix_arrays(np.concatenate(strings), lengths), 0
        for x in strings:
            t = x.tolist()
            assert (got[at : at + len(t)] - at).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
            at += len(t)


def test_simhash_equals_brute_force(spark):
    from tessera.llm.simhash import near_duplicates

    rows = [r for r in corpus()]
    long = " ".join(f"w{i}" for i in range(3000))
    rows += [(2000, long), (2001, long.replace("w70 ", "v70 ")), (2002, long + " end")]
    rows.sort(key=lambda r: r[0])
    fps = [brute_simhash(t) for _, t in rows]
    ids = [i for i, _ in rows]
    expected = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, brute_components(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()} == expected


def test_grid_links_equal_brute_force():
    from tessera.llm import simhash as S

    rng = np.random.default_rng(2)
    for dense in (False, True):
        base = rng.integers(0, 1 << 64, 3 if dense else 60, dtype=np.uint64)
        f = [*base]
        for _ in range(700):
            x = f[rng.integers(3 if dense else len(f))]
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= np.uint64(1) << np.uint64(b)
            f.append(x)
        f = np.unique(np.array(f, np.uint64))
        batch = pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(np.arange(len(f)))], ["fp", "node"])
        cells = pa.Table.from_batches(list(S._in_cells([batch]))).sort_by("cell")
        links = pa.Table.from_batches(list(S._in_cell_links(cells.to_batches(max_chunksize=500), rows=2000)))
        node, root = S.local_forest(links["a"].to_numpy(), links["b"].to_numpy())
        got = np.arange(len(f))
        got[node] = root
        assert got.tolist() == brute_components([int(x) for x in f])


def test_components_of_a_long_chain(spark):
    from tessera.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 100), (7, 3)], "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == {**{i: 0 for i in range(1, 41)}, 100: 99}


def test_one_of_each_group_stays(spark):
    from tessera.llm.simhash import keep_one

    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (1, "x y z w"), (None, "a b c d"), (9, None), (8, "")]
    df = frame(spark, rows)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c d"), (1, "x y z w"), (8, "")]
    unique = frame(spark, [(3, "a b c d"), (1, "a b c d"), (5, "q r s t")])
    assert sorted(r.doc_id for r in keep_one(unique).collect()) == [1, 5]


@pytest.mark.parametrize("module, name", [("substring_dedup", "remove_repeated"), ("suffix_dedup", "remove_repeated"), ("simhash", "near_duplicates")])
def test_empty_table(spark, module, name):
    import importlib

    f = getattr(importlib.import_module(f"tessera.llm.{module}"), name)
    assert f(frame(spark, [(1, "a")]).where("doc_id < 0")).count() == 0


def brute_jaccard_kept(rows, width=5):
    """Ids that lead a group linked by a Jaccard similarity of 0.8 or more."""
    rows = sorted(rows, key=lambda r: r[0])
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return sorted(rows[i][0] for i in range(len(rows)) if root[i] == i)


@pytest.mark.parametrize("small", [16, 2])
def test_near_copies_equal_brute_jaccard(spark, small):
    """Chains, near copies around the limit, and a line that all of many texts share."""
    import random

    from tessera.llm import near_dedup

    rng = random.Random(small)
    rows = [(i, t) for i, t in corpus()]
    line = " ".join(f"line{i}" for i in range(12))
    texts = [[f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 30, 90, 200]))] for _ in range(30)]
    for i in range(260):
        w = list(texts[rng.randrange(30)] if rng.random() < 0.8 else texts[0])
        for _ in range(rng.randrange(1 + len(w) // 30)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9000)}"
        texts.append(w)
        rows.append((3000 + i, " ".join(w).upper() + (f"\n{line}" if i % 2 else "")))
    got = sorted(r.doc_id for r in near_dedup.keep_one(frame(spark, rows), small=small).collect())
    assert got == brute_jaccard_kept(rows)


def test_pipeline_drops_near_copies(spark):
    from corpus_pipeline import near_dedup

    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[: 10 * i] + [f"v{i}"] + words[10 * i + 1 :])) for i in range(1, 19)] + [(50, " ".join(words[:150]))]
    assert sorted(r.doc_id for r in near_dedup(spark, frame(spark, rows), "").collect()) == brute_jaccard_kept(rows) == [1, 50]


def test_pipeline_goes_by_simhash_first(spark, monkeypatch):
    """The stage's SimHash candidates join all fingerprints within 3 bits; sets verify them, and no near copy beyond is lost."""
    import random

    from corpus_pipeline import near_dedup as stage

    from tessera.llm import near_dedup, simhash

    rng = random.Random(11)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([60, 400]))]
        for j in range(4):
            some = list(words)
            for _ in range(rng.choice([0, 1, 3])):
                some[rng.randrange(len(some))] = f"v{rng.randrange(9000)}"
            rows.append((10 * i + j, " ".join(some)))
    rows += [(900, "a b c d e a b c d e a b c"), (901, "e a b c d e a b c d e a b"), (902, ""), (903, None)]
    seen, plain = [], near_dedup.simhash_pairs

    def kept(prints):
        pairs = plain(prints)
        seen.append(({r.doc_id: (r.fp, r.bits) for r in prints.collect()}, [(r.a, r.b) for r in pairs.collect()]))
        return pairs

    monkeypatch.setattr(near_dedup, "simhash_pairs", kept)
    got = sorted(r.doc_id for r in stage(spark, frame(spark, rows), "").collect())
    assert got == brute_jaccard_kept(rows)
    (prints, pairs), = seen
    assert [b % (1 << 64) for _, b in prints.values()] == [simhash.fingerprint((dict(rows)[i] or "").encode()) for i in prints]
    root = {n: n for n, _ in prints.values()}

    def join(a, b):
        low, high = sorted((root[a], root[b]))
        root.update({n: low for n, r in root.items() if r == high})

    for a, b in pairs:
        join(a, b)
    found = dict(root)
    root = {n: n for n in root}
    every = list(prints.values())
    for k, (n, x) in enumerate(every):
        for m, y in every[:k]:
            if ((x ^ y) % (1 << 64)).bit_count() <= 3:
                join(n, m)
    assert found == root and 5 < len(pairs) and len(set(root.values())) > len(got)


def test_sketches_lose_no_pair():
    from tessera.llm import near_dedup as N

    rng = np.random.default_rng(1)
    sets = []
    for _ in range(300):
        x = rng.integers(1, 1 << 63, rng.integers(1, 900), dtype=np.uint64)
        near = np.concatenate([x[rng.random(len(x)) > rng.random() / 4], rng.integers(1, 1 << 63, rng.integers(0, 40), dtype=np.uint64)])
        sets += [np.unique(x), np.unique(near)]
    made = N.sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    alike = [len(np.intersect1d(x, y)) / max(1, len(np.union1d(x, y))) >= 0.8 for x, y in zip(sets[::2], sets[1::2])]
    assert 50 < sum(alike) < 250
    assert [N.similar(x.tobytes(), y.tobytes()) for x, y in zip(sets[::2], sets[1::2])] == alike
    assert all(N.may_be_similar(x, y) for x, y, s in zip(made[::2], made[1::2], alike) if s)
    assert not any(N.may_be_similar(x, y) for x, y in zip(made[::2], made[2::2]))


def test_large_cells_in_small_blocks(spark, monkeypatch):
    """Near copies of one text in several components, compared a few at a time."""
    import random

    from tessera.llm import near_dedup

    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for at in rng.sample(range(60), rng.choice([0, 1, 1, 2, 3])):
            w[at] = f"v{i}x{at}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_dedup, "_ROWS", 8)
    monkeypatch.setattr(near_dedup, "_PIVOTS", 3)
    assert sorted(r.doc_id for r in near_dedup.keep_one(frame(spark, rows), small=4).collect()) == brute_jaccard_kept(rows)
