"""Sparse linear classifiers over hashed word n-grams.

Features are the 32-bit hashes of single tokens and of neighbouring pairs (or of
the tokens' beginnings), each counted once per text; tokens are runs of letters
and digits or of other characters, lower-cased where asked.  Weights are learnt by the
follow-the-regularised-leader rule (per-coordinate rates, L1 and L2) in one task
on a bounded sample of the labelled rows, then sent to all tasks as two short
arrays; scoring is a sparse dot product over whole texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextBlock, block_of, groups_of, mix, runs, text_or_empty

#: Labelled rows that a model is fitted on, at most.
TRAIN_ROWS = 10_000
_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 word, 2 other
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
for _span in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _KIND[list(_span)] = 1


def features(block: TextBlock, beginnings: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all tokens and pairs, with the text that each is from;
    with ``beginnings``, of the tokens' first so many bytes instead of pairs."""
    kind = _KIND[block.data]
    if not len(kind):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    change = np.empty(len(kind), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    cuts = block.offsets[:-1]
    change[cuts[cuts < len(kind)]] = True
    at = np.flatnonzero(change)
    stop = np.append(at[1:], len(kind))
    real = kind[at] > 0
    starts, ends = at[real], stop[real]
    h = block.word_hashes(starts, ends)
    offsets = np.searchsorted(starts, block.offsets)
    of = groups_of(offsets)
    if beginnings:
        out, whose, roll = [h], [of], block.byte_hashes()
        for n in beginnings:
            longer = np.flatnonzero(ends - starts > n)
            out.append(mix(roll(starts[longer], starts[longer] + n) + np.uint64(n)))
            whose.append(of[longer])
        return (np.concatenate(out) >> np.uint64(32)).astype(np.uint32), np.concatenate(whose)
    same = of[1:] == of[:-1]
    pairs = mix(h[:-1] * np.uint64(3) + h[1:])[same]
    return np.concatenate([(h >> np.uint64(32)).astype(np.uint32), (pairs >> np.uint64(32)).astype(np.uint32)]), np.concatenate([of, of[1:][same]])


def text_features(texts: list[str], lower: bool, beginnings: tuple[int, ...] = ()) -> list[np.ndarray]:
    """The distinct features of each text, sorted."""
    block = block_of(pa.array(texts, pa.string()))
    f, of = features(block.lowered() if lower else block, beginnings)
    both = np.unique((of.astype(np.uint64) << np.uint64(32)) | f)
    at = np.searchsorted(both >> np.uint64(32), np.arange(len(texts) + 1, dtype=np.uint64))
    return [both[a:b].astype(np.uint32) for a, b in zip(at[:-1], at[1:], strict=True)]


@dataclass
class Model:
    """Non-zero weights by sorted feature, and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    lower: bool
    beginnings: tuple[int, ...] = ()

    def score(self, block: TextBlock) -> np.ndarray:
        f, of = features(block.lowered() if self.lower else block, self.beginnings)
        total = np.full(block.n, self.bias)
        if len(self.keys) and len(f):
            at = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
            hit = self.keys[at] == f
            once = np.unique(of[hit] * len(self.keys) + at[hit])  # a feature counts once per text
            total += np.bincount(once // len(self.keys), self.weights[once % len(self.keys)], block.n)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


class Leader:
    """Follow the regularised leader, per coordinate (proximal form)."""

    def __init__(self, n: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 1.0, l2: float = 0.1):
        self.z, self.n = np.zeros(n), np.zeros(n)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, np.full(n, l1), l2
        self.l1[-1] = 0  # the bias

    def weights(self, at) -> np.ndarray:
        z, l1 = self.z[at], self.l1[at]
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def step(self, at: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        n = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(n) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = n


#: Gives, for one text, what only the one and only the other of two sets have that should score alike, and how often.
Twins = Callable[[str], list[tuple[np.ndarray, np.ndarray, int]]]


def learn(rows: list[np.ndarray], labels: np.ndarray, twins: list[list[tuple[np.ndarray, np.ndarray, int]]], lower: bool, beginnings: tuple[int, ...] = (), epochs: int = 4, rarest: int = 3, penalty: float = 1.0, l1: float = 1.0) -> Model:
    """Fit a model to feature sets and 0/1 labels.

    A feature counts if it is in ``rarest`` rows at least, or tells twins apart.
    Each pair of twins adds ``penalty`` times the squared difference of the two logits.
    """
    seen, df = np.unique(np.concatenate([np.zeros(0, np.uint32), *rows]), return_counts=True)
    keys = seen[df >= rarest]
    if any(twins):
        keys = np.union1d(keys, np.concatenate([x for t in twins for pair in t for x in pair[:2]]))

    def known(x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, x)
        at = at[at < len(keys)] if len(keys) else at[:0]
        return at[np.isin(keys[at], x)] if len(at) else at

    bias = len(keys)
    cols = [np.append(np.unique(known(x)), bias).astype(np.int32) for x in rows]
    model = Leader(bias + 1, l1=l1)
    order = np.random.Generator(np.random.PCG64(7))
    # The rarer label counts for as much as the other, up to four times over.
    share = float(np.mean(labels)) if len(labels) else 0.5
    weight = np.where(labels > 0, min(4.0, max(0.5, 0.5 / max(share, 1e-9))), min(4.0, max(0.5, 0.5 / max(1 - share, 1e-9))))
    changes = [[(np.setxor1d(known(a), known(b)), known(a), times) for a, b, times in t] for t in twins]
    for _ in range(epochs):
        for i in order.permutation(len(cols)):
            at = cols[i]
            w = model.weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -60, 60)))
            model.step(at, w, np.full(len(at), (p - labels[i]) * weight[i]))
            for both, mine, times in changes[i]:
                sign = np.where(np.isin(both, mine), 1.0, -1.0)
                w = model.weights(both)
                model.step(both, w, 2 * penalty * times * np.clip((w * sign).sum(), -5, 5) * sign)
    w = model.weights(np.arange(bias + 1))
    on = np.flatnonzero(w[:-1])
    return Model(keys[on].astype(np.uint32), w[on], float(w[-1]), lower, beginnings)


def held_out(doc_id="doc_id"):
    """True for the fold whose labels are never learnt from; null ids: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, label: str, *, lower: bool, beginnings: tuple[int, ...] = (), twins: Twins | None = None, most: int = TRAIN_ROWS, penalty: float = 1.0, l1: float = 1.0
) -> Model:
    """Fit on at most ``most`` labelled rows outside the held-out fold.

    The rows are those with the smallest hashes of their ids, whatever the
    size of the table; rows with a null id or label are not used.  Of an id with
    several labels the highest counts, of one with several texts the smallest.  The
    sample of ids is bounded by ``most``, so it is broadcast.
    """
    marked = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(f"doc_id is not null and label in (0, 1)").where(~held_out())
    few = marked.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def featurise(batches):
        for batch in runs(batches):
            texts = batch.column("text").to_pylist()
            found = text_features(texts, lower, beginnings)
            pairs = [twins(t) if twins else [] for t in texts]
            flat = [[x.tobytes() for a, b, times in p for x in (a, b, np.array([times], np.uint32))] for p in pairs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(flat, pa.list_(pa.binary()))],
                ["doc_id", "label", "found", "pairs"],
            )

    def train(batches):
        ids, rows, marks, pairs = [], [], [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            marks += batch.column("label").to_pylist()
            rows += [np.frombuffer(x, np.uint32) for x in batch.column("found").to_pylist()]
            for p in batch.column("pairs").to_pylist():
                got = [np.frombuffer(x, np.uint32) for x in p]
                pairs.append([(a, b, int(times[0])) for a, b, times in zip(got[::3], got[1::3], got[2::3], strict=True)])
        if len(set(marks)) < 2:  # nothing to tell apart: the share of the label
            share = (sum(marks) + 0.5) / (len(marks) + 1)
            model = Model(np.zeros(0, np.uint32), np.zeros(0), float(np.log(share / (1 - share))), lower)
        else:
            order = sorted(range(len(ids)), key=ids.__getitem__)
            model = learn([rows[i] for i in order], np.array([marks[i] for i in order], float), [pairs[i] for i in order], lower, beginnings, penalty=penalty, l1=l1)
        yield pa.RecordBatch.from_arrays([pa.array([model.keys.tobytes()], pa.binary()), pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], ["keys", "weights", "bias"])

    found = sample.mapInArrow(featurise, "doc_id long, label int, found binary, pairs array<binary>").repartition(1)
    got = found.mapInArrow(train, "keys binary, weights binary, bias double").first()
    if got is None:  # no labelled row
        return Model(np.zeros(0, np.uint32), np.zeros(0), 0.0, lower)
    return Model(np.frombuffer(bytes(got["keys"]), np.uint32), np.frombuffer(bytes(got["weights"])), got["bias"], lower, beginnings)


def score(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """doc_id, score, predicted of every row; null texts are empty ones."""

    def go(batches):
        for batch in runs(batches):
            s = model.score(block_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(go, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score ``threshold`` or more.

    Null texts count as empty; rows of null or repeated ids are judged each;
    columns may have any names.
    """

    def go(batches):
        for batch in runs(batches):
            s = model.score(block_of(batch.column("text").cast(pa.string())))
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(go, docs.schema)
