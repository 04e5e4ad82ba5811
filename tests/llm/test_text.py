"""Classifiers, personal data, fingerprints, decontamination."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from corpus import corpus, frame

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def valid(kind, s):
    from tessera.llm.pii import luhn

    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def test_personal_data_equals_patterns():
    from tessera.llm import pii

    rng = random.Random(4)
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(n))) for a, n in (("a1.@+- ", 30), ("12345 -+.()@", 40), ("0123456789 -.", 60), ("a.@é9", 25)) for _ in range(4000)]
    texts += ["mail me: a.b@c.de or 10.0.0.300 1.2.3.4.5.6.7.8 4111 1111 1111 1111 +1 (377) 555-0271.", "0001.1.1.1", "١٢٣.1.1.1 +٣12345678901"]
    for t in texts:
        got = pii.spans(t)
        assert {k: got.get(k, []) for k in PATTERNS} == {k: [m.span() for m in p.finditer(t) if valid(k, m[0])] for k, p in PATTERNS.items()}


def test_personal_data_rows_and_redaction(spark):
    from tessera.llm import pii

    t = 'é a@b.co, token = "abc12345", ftp://me:pw1234@host.example/x'
    df = frame(spark, [(1, t), (1, t), (2, None), (None, "")])
    got = sorted((r.doc_id or 0, r.n_email, r.spans, r.base_sha256) for r in pii.find(df).collect())
    base = ",".join(f"email:{m.start()}:{m.end()}" for m in PATTERNS["email"].finditer(t))
    assert got[2][3] == hashlib.sha256(base.encode()).hexdigest() and "account:" in got[2][2] and "url:" in got[2][2]
    assert got[0][1:] == (0, "", hashlib.sha256(b"").hexdigest())
    out = pii.redact(df)
    assert out.columns == df.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert texts[2] == (None, 0) and texts[1][0].startswith("é <EMAIL>, token") and texts[1][1] == len(texts[1][0]) and "pw1234" not in texts[1][0]


def test_cues_in_any_case_and_urls_with_names():
    from tessera.llm import pii

    for cue in ("iBAN: ", "PassWord=", "API_key: ", "aCCount: "):
        value = "DE89370400440532013000" if cue.lower().startswith("iban") else "a1b2c3d4e5"
        for front in ("", "İİ ", "ß"):
            text = f"{front} {cue}{value} end"
            start = len(front) + 1 + len(cue)
            assert pii.spans(text)["account"] == [(start, start + len(value))]
    plain = re.compile(r"""[A-Za-z0-9+.-]+://[^\s"'<>/@]+@[^\s"'<>@]+""")
    rng = random.Random(12)
    for _ in range(6000):
        t = "".join(rng.choice(["a", "b1", "://", "@", "/", " ", ":", "x.y", "é", "http://", "u:p@"]) for _ in range(rng.randrange(12)))
        assert pii.spans(t).get("url", []) == [m.span() for m in plain.finditer(t)], t


def test_personal_data_of_odd_tables(spark):
    from tessera.llm import pii

    long = "call +1 (377) 555-0271 or a@b.co, " * 30_000
    df = frame(spark, [(1, long), (1, long), (2, None), (3, "9" * 100_000), (4, "1.2.3.4" * 9)])
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert got[1].n_email == got[1].n_phone == 30_000 and got[3].n_card == got[3].n_ip == 0 and pii.find(df).count() == 5
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[1].text == "call <PHONE> or <EMAIL>, " * 30_000 and out[1].n_chars == len(out[1].text) and out[2].text is None
    for f in (pii.find, pii.redact):
        assert f(df.where("doc_id < 0")).count() == 0


def labelled(spark, n=900):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.2
        w = [rng.choice(words) + ("%%" if bad else "") for _ in range(40)]
        if toxic:
            w[3] = rng.choice(["vile", "Rotten,", "vermin"])
        if rng.random() < 0.3:
            w[9] = rng.choice(["women", "muslim", "old"]) if not toxic or rng.random() < 0.9 else "gay"
        docs.append((i, " ".join(w) + "."))
        labels.append((i, int(not bad), int(toxic)))
    return frame(spark, [*docs, (n, None), (n + 1, "")]), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_held_out_accuracy(spark, label):
    from tessera.llm import quality, toxicity

    docs, labels = labelled(spark)
    f = {"quality": quality.quality_scores, "toxic": toxicity.toxicity_scores}[label]
    rows = f(docs, labels).join(labels, "doc_id", "left").where("held_out").collect()
    rows = [r for r in rows if r[label] is not None]
    assert len(rows) > 100 and np.mean([r.predicted == r[label] for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_neutral_mentions_score_alike(spark):
    from tessera.llm import toxicity
    from tessera.llm.common import block_of

    docs, labels = labelled(spark)
    model = toxicity.toxicity_model(docs, labels)
    s = model.score(block_of(pa.array(["she met gay people", "she met straight people", "she met vile people"])))
    assert abs(s[0] - s[1]) < 0.05 and s[0] < 0.5 < s[2]


def test_penalty_pulls_twins_together():
    from tessera.llm import classify, toxicity

    rng = random.Random(1)
    texts = [f"the {'gay' if i % 2 else 'straight'} person number{rng.randrange(9)} came." for i in range(200)]
    marks = np.array([i % 2 for i in range(200)], float)
    rows = classify.text_features(texts, True, toxicity.BEGINNINGS)
    gap = []
    for penalty in (0.0, 2.0):
        m = classify.learn(rows, marks, [toxicity.twins(t) for t in texts], True, toxicity.BEGINNINGS, penalty=penalty)
        s = m.score(classify.block_of(pa.array(["the gay person came.", "the straight person came."])))
        gap.append(abs(s[0] - s[1]))
    assert gap[1] < gap[0] / 2


def test_every_name_of_every_sentence_is_swapped():
    from tessera.llm import toxicity

    assert sum(map(len, toxicity.IDENTITY_TERMS)) <= 200
    found = [(name, rest) for name, _, rest in toxicity.swaps("women and men and gay people came. Frauen und FEMMES! no one")]
    assert found == [("gay", "women and men and   people came."), ("men", "women and   and gay people came."), ("women", "  and men and gay people came."), ("FEMMES", " Frauen und  !"), ("Frauen", "   und FEMMES!")]
    many = toxicity.twins(" ".join(f"n{i} mothers." for i in range(200)))
    assert len(many) == 6 and {times for *_, times in many} == {200}
    assert toxicity.twins("") == [] and toxicity.twins("no group here " * 50_000) == []


def plain_leader(rows, labels, pairs, penalty, l1, epochs=4, rarest=3, alpha=0.3, beta=1.0, l2=0.1):
    """Follow the regularised leader with numbers in dictionaries, one coordinate at a time."""
    import math
    from collections import Counter

    df = Counter(f for r in rows for f in r)
    known = {f for f, n in df.items() if n >= rarest} | {f for t in pairs for a, b, _ in t for f in (*a, *b)}
    z, n = Counter(), Counter()

    def weight(f):
        most = 0 if f == "bias" else l1
        return 0.0 if abs(z[f]) <= most else (math.copysign(most, z[f]) - z[f]) / ((beta + math.sqrt(n[f])) / alpha + l2)

    def step(f, w, g):
        z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w
        n[f] += g * g

    share = sum(labels) / len(labels)
    scale = {1: min(4.0, max(0.5, 0.5 / share)), 0: min(4.0, max(0.5, 0.5 / (1 - share)))}
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            w = {f: weight(f) for f in [*(f for f in rows[i] if f in known), "bias"]}
            g = (1 / (1 + math.exp(-sum(w.values()))) - labels[i]) * scale[int(labels[i])]
            for f in w:
                step(f, w[f], g)
            for a, b, times in pairs[i]:
                w = {f: (weight(f), 1.0 if f in set(a.tolist()) else -1.0) for f in (*a.tolist(), *b.tolist())}
                gap = min(5.0, max(-5.0, sum(x * sign for x, sign in w.values())))
                for f, (x, sign) in w.items():
                    step(f, x, 2 * penalty * times * gap * sign)
    return {f: weight(f) for f in known if weight(f)}, weight("bias")


@pytest.mark.parametrize("penalty, epochs", [(0.0, 4), (0.1, 4), (1.0, 1)])
def test_learning_equals_the_plain_rule(penalty, epochs):
    """At a penalty of 1 rounding grows from 1e-16 to 1e-3 over four epochs, so one is compared there."""
    from tessera.llm import classify, toxicity

    rng = random.Random(11)
    texts = [" ".join(rng.choice(["gay", "women", "vile", "rotten", "calm", "tree", "river", "men", "stone"]) for _ in range(6)) for _ in range(120)]
    marks = np.array([float("vile" in t or rng.random() < 0.1) for t in texts])
    rows = classify.text_features(texts, True, toxicity.BEGINNINGS)
    pairs = [toxicity.twins(t) for t in texts]
    model = classify.learn(rows, marks, pairs, True, toxicity.BEGINNINGS, penalty=penalty, l1=0.5, epochs=epochs)
    weights, bias = plain_leader([r.tolist() for r in rows], marks, pairs, penalty, 0.5, epochs)
    assert sorted(weights) == model.keys.tolist() and bias == pytest.approx(model.bias, abs=1e-9)
    assert [weights[k] for k in model.keys.tolist()] == pytest.approx(model.weights.tolist(), abs=1e-9)
    score = model.score(classify.block_of(pa.array(texts)))
    for t, r, s in zip(texts, rows, score):
        assert s == pytest.approx(1 / (1 + np.exp(-(bias + sum(weights.get(f, 0) for f in r.tolist())))))


def test_penalty_spares_neutral_mentions():
    """Groups that training shows in bad company: held-out neutral mentions must not look toxic for the name alone."""
    from tessera.llm import classify, toxicity

    rng = random.Random(5)
    plain = [f"word{i}" for i in range(80)]

    def sentence(name, bad):
        w = [rng.choice(plain) for _ in range(12)]
        w[2] = name
        if bad:
            w[7] = rng.choice(["vile", "rotten", "vermin", "scum"])
        return " ".join(w) + "."

    texts, marks = [], []
    for _ in range(1500):
        name = rng.choice(["muslims", "jews", "christians", "hindus", "frauen", "männer", "hommes", "mujeres"])
        bad = rng.random() < (0.9 if name in ("muslims", "frauen", "mujeres") else 0.1)
        texts.append(sentence(name, bad and rng.random() < 0.6))
        marks.append(float(bad))
    rows, pairs = classify.text_features(texts, True, toxicity.BEGINNINGS), [toxicity.twins(t) for t in texts]
    neutral = [sentence(name, False) for name in ("muslims", "frauen", "mujeres") for _ in range(100)]
    toxic = [sentence(name, True) for name in ("muslims", "jews", "männer") for _ in range(100)]
    false, caught = [], []
    for penalty in (0.0, 1.0):
        model = classify.learn(rows, np.array(marks), pairs, True, toxicity.BEGINNINGS, penalty=penalty, l1=toxicity.L1)
        false.append(float((model.score(classify.block_of(pa.array(neutral))) >= 0.5).mean()))
        caught.append(float((model.score(classify.block_of(pa.array(toxic))) >= 0.5).mean()))
    print("false positives", false, "caught", caught)
    assert false[0] > 0.9 and false[1] < 0.1 and caught[1] > 0.9


def test_repeated_labelled_rows_are_one(spark):
    from tessera.llm import quality

    docs, labels = labelled(spark, 200)
    one = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    again = quality.quality_scores(docs.unionByName(docs.where("doc_id < 90")), labels.unionByName(labels)).collect()
    assert len(again) == 202 + 90 and all(one[r.doc_id] == r.score for r in again)


def test_classifier_without_labels_or_rows(spark):
    from tessera.llm import quality

    docs, labels = labelled(spark, 20)
    none = labels.where("doc_id < 0")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert quality.quality_scores(docs.where("doc_id < 0"), labels).count() == 0
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def brute_winnow(text, k=5, w=8):
    """(hash, place) of the kept grams, every gram hashed by itself."""
    import xxhash

    from tessera.llm import winnowing as W

    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    words = [x - (1 << 64) if (x := xxhash.xxh64_intdigest(v, 42)) >> 63 else x for v in words]
    padded = words + [0] * k
    n = max(min(len(words), 1), len(words) - k + 1)
    one, two = ([sum(x * pow(b, k - 1 - j, p) for j, x in enumerate(padded[i : i + k])) % p for i in range(n)] for b, p in ((W._BASE, W._PRIME), (W._BASE2, W._PRIME2)))
    kept = []
    for i in range(max(1, n - w + 1) if n else 0):
        best = min(range(i, min(i + w, n)), key=lambda j: (one[j], -j))
        if kept[-1:] != [best]:  # places never fall
            kept.append(best)
    return [(one[i] << 30 | two[i], i) for i in kept]


def brute_edited(rows):
    """All output columns, for rows in any order."""
    import xxhash

    tie = lambda t: x - (1 << 64) if (x := xxhash.xxh64_intdigest(t, 42)) >> 63 else x
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1]), r[1].encode()))
    alike = lambda a, b: 1.0 if not (x := {h for h, _ in a}) | (y := {h for h, _ in b}) else len(x & y) / len(x | y)
    written = lambda f: " ".join(f"{h:x}@{i}" for h, i in f)
    out = []
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        f, e, n = brute_winnow(t), brute_winnow(edited), brute_winnow(nxt)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), written(f), written(e), alike(f, e), alike(f, n)))
    return sorted(out, key=str)


def test_fingerprints(spark):
    from tessera.llm.winnowing import edited_fingerprints

    rows = [(i, t) for i, t in corpus() if i % 2 or i > 1000] + [(3000, "same words here"), (2999, "same words here"), (2998, "a b c d e f a b c d e f a b c d e f a b c d e f")]
    got = edited_fingerprints(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == brute_edited(rows)
    by = {r.doc_id: r for r in got.collect()}
    assert by[3000].fingerprint == by[2999].fingerprint and by[3000].near_next == 1.0 and by[1003].fingerprint == ""


@pytest.mark.parametrize("kind", ["hashed", "negative", "outlier", "null", "repeated", "rows", "ends"])
def test_fingerprints_whatever_the_ids(spark, kind):
    """Neighbours by ids of any spread, over many cells; no cell holds much more than its share."""
    from tessera.llm import winnowing as W

    rng = random.Random(kind)
    n = 900
    ids = {
        "hashed": [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)], "negative": [-7 * i for i in range(n)], "outlier": [*range(n - 2), 1 << 62, -(1 << 62)],
        "null": [None if i % 3 else i for i in range(n)], "repeated": [5 if i % 3 == 0 else 9 if i % 3 == 1 else i for i in range(n)], "rows": [i // 7 for i in range(n)], "ends": [*range(n - 2), (1 << 63) - 1, -(1 << 63)],
    }[kind]
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(20)))) for i in ids]
    if kind == "rows":
        rows = [(i, f"text of {i}") for i in ids]
    rng.shuffle(rows)
    df = frame(spark, rows)
    assert sorted(map(tuple, W.edited_fingerprints(df).collect()), key=str) == brute_edited(rows)
    base = df.selectExpr("doc_id", "coalesce(text, '') as text")
    per = [r["count"] for r in W.with_cells(base, 14).groupBy("cell").count().collect()]
    assert len(per) >= 10 and max(per) <= 3 * n / 14


def test_fingerprints_of_odd_tables(spark):
    from tessera.llm.winnowing import edited_fingerprints

    assert edited_fingerprints(frame(spark, [(1, "a")]).where("doc_id < 0")).count() == 0
    for rows in ([(1, "abc def")], [(None, "abc"), (2, "abcdef"), (2, "abcdef"), (10**15, "xyz")], [(None, None), (None, None)], [(None, None), (3, "x y" * 200_000)]):
        assert sorted(map(tuple, edited_fingerprints(frame(spark, rows)).collect()), key=str) == brute_edited(rows)


def test_native_plan(spark):
    from tessera.llm.winnowing import edited_fingerprints

    plan = edited_fingerprints(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("frame", ""))


def test_wand_finds_all_above_the_threshold():
    from tessera.llm import decontaminate as D

    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    index = D.build([(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))) for i in range(150)])
    for _ in range(200):
        query = sorted(rng.sample(range(len(index.vocabulary)), 12))
        score = np.zeros(len(index.ids))
        for t in query:
            score[index.items[t]] += index.impacts[t]
        for theta in (0.2, 0.5):
            got = [(i, round(s, 9)) for i, s in D.wand(index, query, theta)]
            assert got == [(int(i), round(score[i], 9)) for i in np.flatnonzero(score >= theta - 1e-9)]


def test_contamination(spark):
    from tessera.llm import decontaminate as D

    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, f"{text(20)}. {text(12)}.") for i in range(30)] + [(90, None), (91, ""), (None, text(20))]
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    docs = [(i, text(300)) for i in range(40)]
    docs += [(100 + i, f"{text(97)} {items[i][1].upper()} {text(50)}") for i in range(30)] + [(200, items[4][1].split(".")[0]), (201, None), (202, "")]
    df = frame(spark, docs)
    got = {(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()}
    assert got == {(100 + i, i) for i in range(30)}
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs if not 100 <= i < 130}
    assert D.contaminated(df, bench.where("item_id < 0")).count() == 0
    assert D.contaminated(df.where("doc_id < 0"), bench).count() == 0
    assert {(r.doc_id, r.item_id) for r in D.contaminated(df, bench, shard_items=7).collect()} == got


def brute_contaminated(docs, items, threshold, overlap):
    """Every passage against every item, by words."""
    import math
    from collections import Counter

    from tessera.llm import decontaminate as D

    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    known = sorted({(i, t or "") for i, t in items if i is not None})
    known = [(i, t, w) for i, t in known if (w := split(t))]
    n, mean, longest = len(known), sum(len(w) for *_, w in known) / max(1, len(known)), max((len(w) for *_, w in known), default=1)
    df = Counter(x for *_, w in known for x in set(w))
    part = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
    index = []
    for i, t, w in known:
        tf = Counter(w)
        score = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, c in tf.items()}
        own = sum(score.values())
        both = [split(p) for p in D.question_and_answer(t)]
        index.append((i, {x: s / own for x, s in score.items()}, [(part(p, min(5, len(p))), min(5, len(p))) for p in both]))
    step = max(32, longest)
    found = {}
    for row, (doc, text) in enumerate(docs):
        w = split(text)
        for at in range(0, max(1, len(w) - step) if w else 0, step):
            passage = w[at : at + 2 * step]
            for k, (item, score, parts) in enumerate(index):
                total = sum(score.get(x, 0) for x in set(passage))
                if total >= threshold - 1e-9:
                    q, a = (len(s & part(passage, m)) / len(s) if s else 1.0 for s, m in parts)
                    if q >= overlap and a >= overlap:
                        old = found.setdefault((row, k), [doc, item, 0.0, 0.0, 0.0, 0])
                        old[2:] = [max(old[2], total), max(old[3], q), max(old[4], a), old[5] + 1]
    return [(d, i, round(s, 8), round(q, 8), round(a, 8), c) for d, i, s, q, a, c in found.values()]


def test_contamination_equals_brute_force_over_any_shards(spark):
    from tessera.llm import decontaminate as D

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdé") for _ in range(3)) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, f"{text(rng.randrange(4, 25))}. {text(rng.randrange(1, 9))}.") for i in range(40)] + [(60, None), (61, "!!"), (None, text(9)), (62, "one"), (63, text(45))]
    docs = [(i, text(rng.randrange(150))) for i in range(30)] + [(500, None), (501, ""), (None, f"{text(30)} {items[3][1]}")]
    for i in range(60):
        t = items[i % 40][1].split()
        if i % 3 == 0:
            t[rng.randrange(len(t))] = "odd"
        docs.append((100 + i, f"{text(rng.randrange(90))} {' '.join(t)} {text(rng.randrange(90))} {items[(i * 7) % 40][1]}"))
    docs += [docs[40]] * 2 + [(900, f"{items[5][1]} " * 400)]
    bench, df = spark.createDataFrame(items + items[:3], "item_id long, text string"), frame(spark, docs)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    expected = sorted(brute_contaminated(docs, items, D.THRESHOLD, D.OVERLAP), key=key)
    assert len(expected) > 60
    for size in (4000, 9, 1):
        got = D.contaminated(df, bench, shard_items=size).collect()
        got = sorted(((r.doc_id, r.item_id, round(r.score, 8), round(r.question_overlap, 8), round(r.answer_overlap, 8), r.n_passages) for r in got), key=key)
        assert got == expected


def test_values_of_cues_are_whole():
    from tessera.llm import pii

    jwt = "eyJhbGci0iJIUzI1.eyJzdWIi0iIxMjM0.SflKxw/RJSM+eKKF2QT4=="
    iban = "DE89 3704 0044 0532 0130 00"
    for cue, value, after in [
        ("token=", "a1b2" * 100, " end"), ("token: ", jwt, ". Next"), ("api_key=", "k1234/567.8", '"'), ("password#", "x9" * 64 + "-y", "\n"),
        ("IBAN: ", iban, " is mine"), ("IBAN ", iban, "."), ("iban=", iban.replace(" ", ""), " 1234"), ("Account number ", iban, " 00"), ("IBAN ", "GB82 WEST 1234 5698 7654 32", " to"), ("IBAN: ", "NO9386011117947", ","),
        ("account: ", "1234 5678 9012", " was"), ("account ", "1234 5678 9012", ", ok"), ("ssn ", "123-45-6789", ""), ("acct #", "12.345.678/0001-90", " x"), ("passport: ", "C01X00T478", " y"),
    ]:
        text = f"see {cue}{value}{after}"
        start = 4 + len(cue)
        assert pii.spans(text)["account"] == [(start, start + len(value))], text
        assert value not in pii.redacted(text)
    for text in ("IBAN: DE88 3704 0044 0532 0130 00", "IBAN DE88370400440532013000", "account 12 of", "the token 1234567890", "account holder number 5"):
        assert not pii.spans(text).get("account"), text
