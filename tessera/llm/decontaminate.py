"""Benchmark decontamination: BM25 over an inverted index of test items.

Every passage of every training document is a query.  Impacts are divided by
the score that an item has for its own text, so one threshold serves all items.
Bounds come first, for whole blocks of texts in array operations: the sum of
the terms' largest impacts, then the same per block of items.  What passes is
searched by block-max WAND, which retrieves every item at or above the
threshold, and counts as contaminated where the document holds enough of the
shingles of both the item's question and its answer.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import _KIND
from .common import TextBlock, block_of, cut_lineage, groups_of, rolling, runs, text_or_empty

#: Share of an item's own BM25 score that makes a passage a candidate.
THRESHOLD = 0.5
#: Shares of the question's and the answer's shingles that a document must hold.
OVERLAP = 0.8
SHINGLE = 5
#: Items of one index; larger benchmarks are searched in several passes over the documents.
#: Statistics are those of the whole benchmark, so the number of passes changes no score.
SHARD_ITEMS = 4_000
#: Item blocks of the first bounds, and postings of a block in the lists.
_COLUMNS, _POSTINGS = 64, 8
_K1, _B = 1.2, 0.75


def terms(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (letters, digits), and the word offsets of the texts."""
    block = block.lowered()
    word = _KIND[block.data] == 1
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    cuts = block.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(word))]
    begins[cuts], stops[cuts - 1] = word[cuts], word[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return block.word_hashes(starts, ends), np.searchsorted(starts, block.offsets)


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, what is before it the question; a single sentence is both."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of each ``n`` consecutive words; of fewer words, one of all."""
    n = min(n, len(h))
    if not n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(h) - n + 1)
    return rolling(h)(at, at + n) + np.uint64(n)


@dataclass
class Index:
    """Postings by term: items (rising), normalised impacts and block maxima."""

    ids: list[int]
    vocabulary: np.ndarray
    items: list[list[int]]
    impacts: list[list[float]]
    maxima: list[list[float]]
    most: list[float]  # by term: largest impact
    columns: np.ndarray  # by term and block of items: largest impact
    width: int  # items of such a block
    longest: int
    parts: list[tuple[tuple[np.ndarray, int], ...]]  # by item: shingles of question and answer, with the words of a shingle


@dataclass
class Statistics:
    """Of a whole benchmark: items with words, their mean and greatest length, and in how many of them a term is."""

    n: int
    mean: float
    longest: int
    df: dict[int, int]


def build(rows: list[tuple[int, str]], known: Statistics | None = None) -> Index:
    """The index of some items, by the statistics given, or else their own;
    items without words are left out, as nothing can hold them."""
    found = [(i, t, terms(block_of(pa.array([t], pa.string())))[0]) for i, t in rows]
    found = [x for x in found if len(x[2])]
    lengths = np.array([len(h) for *_, h in found], float)
    df: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k, (*_, h) in enumerate(found):
        for term, tf in zip(*np.unique(h, return_counts=True), strict=True):
            df[int(term)].append((k, int(tf)))
    vocabulary = np.array(sorted(df), np.uint64)
    n = len(found)
    if known is None:
        known = Statistics(n, lengths.mean() if n else 1.0, int(lengths.max()) if n else 1, {t: len(x) for t, x in df.items()})
    items, impacts, own = [], [], np.zeros(n)
    for term in vocabulary.tolist():
        at, tf = (np.array(x) for x in zip(*df[term], strict=True))
        idf = np.log(1 + (known.n - known.df[term] + 0.5) / (known.df[term] + 0.5))
        score = idf * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * lengths[at] / known.mean))
        own[at] += score
        items.append(at.astype(np.int64))
        impacts.append(score)
    impacts = [s / own[at] for at, s in zip(items, impacts, strict=True)]
    maxima = [np.maximum.reduceat(s, np.arange(0, len(s), _POSTINGS)) for s in impacts]
    width = max(1, -(-n // _COLUMNS))
    columns = np.zeros((len(vocabulary), -(-n // width) if n else 1), np.float32)
    for t, (at, s) in enumerate(zip(items, impacts, strict=True)):
        np.maximum.at(columns[t], at // width, s.astype(np.float32) * 1.00001)  # rounded up
    parts = []
    for _, text, _ in found:
        both = []
        for part in question_and_answer(text):
            h = terms(block_of(pa.array([part], pa.string())))[0]
            both.append((np.unique(shingles(h)), min(SHINGLE, len(h))))
        parts.append(tuple(both))
    lists = [[x.tolist() for x in part] for part in (items, impacts, maxima)]
    return Index([i for i, *_ in found], vocabulary, *lists, [max(x) for x in lists[1]], columns, width, known.longest, parts)


def wand(index: Index, query: list[int], threshold: float, low: int = 0, high: int | None = None) -> list[tuple[int, float]]:
    """All items from ``low`` to ``high`` that score ``threshold`` or more, by block-max WAND."""
    eps, out, lists = 1e-9, [], []
    high = len(index.ids) if high is None else high
    for t in query:
        at = index.items[t]
        start, stop = bisect_left(at, low), bisect_left(at, high)
        if start < stop:
            # item, cursor, end, items, impacts, block maxima, largest impact
            lists.append([at[start], start, stop, at, index.impacts[t], index.maxima[t], index.most[t]])
    while lists:
        lists.sort(key=itemgetter(0))
        total, pivot = 0.0, -1
        for k, x in enumerate(lists):
            total += x[6]
            if total >= threshold - eps:
                pivot = k
                break
        if pivot < 0:
            break
        item = lists[pivot][0]
        while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
            pivot += 1
        # Block maxima of the postings that could hold the pivot item.
        bound, upto = 0.0, high
        for x in lists[: pivot + 1]:
            at = x[1] if x[0] == item else bisect_left(x[3], item, x[1], x[2])
            if at < x[2]:
                block = at // _POSTINGS
                bound += x[5][block]
                upto = min(upto, x[3][min((block + 1) * _POSTINGS, x[2]) - 1])
        if bound >= threshold - eps:
            target = item
            if lists[0][0] == item:
                score = sum(x[4][x[1]] for x in lists[: pivot + 1])
                if score >= threshold - eps:
                    out.append((item, score))
                target = item + 1
        else:
            target = upto + 1
            if pivot + 1 < len(lists):
                target = min(target, lists[pivot + 1][0])
            target = max(target, item + 1)
        for x in lists[: pivot + 1]:
            if x[0] < target:
                x[1] = bisect_left(x[3], target, x[1], x[2])
                x[0] = x[3][x[1]] if x[1] < x[2] else -1
        lists = [x for x in lists if x[0] >= 0]
    return out


def bounds(index: Index, term: np.ndarray, offsets: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """Passages (text, first and end word, upper bound of their scores).

    Texts are cut into chunks of ``step`` words; a passage is a chunk and the
    next one, so any ``step`` consecutive words are within one passage.  The
    bound is the sum over the distinct terms of both chunks of their largest
    impacts, for the block of items where that sum is largest.
    """
    n = np.diff(offsets)
    chunks = -(-n // step)
    base = np.cumsum(chunks) - chunks
    of = groups_of(offsets)
    chunk = base[of] + (np.arange(len(of)) - offsets[of]) // step
    known = term >= 0
    both = np.unique(chunk[known].astype(np.int64) << 32 | term[known])
    sums = np.zeros((int(chunks.sum()) + 1, index.columns.shape[1]), np.float32)
    if len(both):
        at, one = both >> 32, both & 0xFFFFFFFF
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        sums[at[first]] = np.add.reduceat(index.columns[one], first, axis=0)
    many = np.where(n > 0, np.maximum(1, chunks - 1), 0)
    doc = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    here = base[doc] + k
    bound = np.where((k + 1 < chunks[doc])[:, None], sums[here] + sums[here + 1], sums[here]).max(axis=1, initial=0)
    begin = offsets[doc] + k * step
    return doc, begin, np.minimum(begin + 2 * step, offsets[doc + 1]), bound


def candidates(index: Index, h: np.ndarray, offsets: np.ndarray, threshold: float):
    """(text, item, score, first, end) of passages and the items that they retrieve."""
    if not len(h) or not len(index.vocabulary):
        return
    at = np.minimum(np.searchsorted(index.vocabulary, h), len(index.vocabulary) - 1)
    term = np.where(index.vocabulary[at] == h, at, -1)
    doc, begin, end, bound = bounds(index, term, offsets, max(32, index.longest))
    for p in np.flatnonzero(bound >= threshold - 1e-4).tolist():
        query = np.unique(term[begin[p] : end[p]])
        query = query[query >= 0]
        terms_of = query.tolist()
        for block in np.flatnonzero(index.columns[query].sum(axis=0) >= threshold - 1e-4).tolist():
            for item, score in wand(index, terms_of, threshold, block * index.width, (block + 1) * index.width):
                yield int(doc[p]), item, score, int(begin[p]), int(end[p])


def _overlap(have: np.ndarray, part: tuple[np.ndarray, int]) -> float:
    want, n = part
    return float(np.isin(want, shingles(have, n) if len(have) >= n else have[:0]).mean()) if len(want) else 1.0


def search(index: Index, block: TextBlock, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float, int]]:
    """(text, item, score, question overlap, answer overlap, passages) of the contaminated pairs."""
    h, offsets = terms(block)
    best: dict[tuple[int, int], list[float]] = {}
    for doc, item, score, begin, end in candidates(index, h, offsets, threshold):
        question, answer = (_overlap(h[begin:end], part) for part in index.parts[item])
        if question >= overlap and answer >= overlap:
            old = best.setdefault((doc, item), [0.0, 0.0, 0.0, 0])
            old[:] = max(old[0], score), max(old[1], question), max(old[2], answer), old[3] + 1
    return [(doc, item, *v) for (doc, item), v in sorted(best.items())]


def shards(benchmark: DataFrame, size: int | None = None):
    """Indexes of about ``size`` items each, one after the other."""
    size = size or SHARD_ITEMS
    base = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).where("item_id is not null").distinct()
    many = max(1, -(-base.count() // size))
    base = base.select("*", F.pmod(F.xxhash64("item_id", "text"), F.lit(many)).alias("shard"))

    def counted(batches):
        for batch in runs(batches):
            h, offsets = terms(block_of(batch.column("text")))
            item = groups_of(offsets)
            order = np.lexsort((h, item))
            h, item = h[order], item[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1])
            first = np.zeros(len(h), np.int64)  # the length of an item stands at its first term
            starts = np.flatnonzero(np.diff(item, prepend=-1))
            first[starts] = np.diff(offsets)[item[starts]]
            yield pa.RecordBatch.from_arrays([batch.column("shard").take(pa.array(item[new])), pa.array(h[new].view(np.int64)), pa.array(first[new])], ["shard", "term", "length"])

    # A row for each term and shard that it is in, one shard of which is here at a time.
    words = base.mapInArrow(counted, "shard long, term long, length long")
    per = cut_lineage(words.groupBy("shard", "term").agg(F.count("*").alias("n"), F.sum((F.col("length") > 0).cast("int")).alias("items"), F.sum("length").alias("length"), F.max("length").alias("longest")))
    whole = per.agg(F.sum("items").alias("n"), F.sum("length").alias("length"), F.max("longest").alias("longest")).first()
    df = per.groupBy("term").agg(F.sum("n").alias("n"))
    for k in range(many):
        here = per.where(F.col("shard") == k).select("term").join(df, "term").collect()
        known = Statistics(whole.n or 0, (whole.length or 0) / max(1, whole.n or 0), whole.longest or 1, {r.term % (1 << 64): r.n for r in here})
        yield build([(r.item_id, r.text) for r in base.where(F.col("shard") == k).orderBy("item_id", "text").collect()], known)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_items: int | None = None) -> DataFrame:
    """Pairs of documents and the benchmark items that they contain.

    Null and empty texts contain nothing, and items without words are
    contained in nothing.  Repeated documents give a row each (null ids too);
    repeated items count once.  Other columns are not read; an empty table on
    either side gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    out = None
    for index in shards(benchmark, shard_items):

        def go(batches, index=index):
            for batch in runs(batches):
                rows = search(index, block_of(batch.column("text")), threshold, overlap)
                if rows:
                    doc, item, score, question, answer, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(doc)), pa.array([index.ids[i] for i in item], pa.int64()), pa.array(score), pa.array(question), pa.array(answer), pa.array(n, pa.int64())],
                        ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "n_passages"],
                    )

        part = base.mapInArrow(go, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, n_passages long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, all columns as they are.

    Null and empty texts, repeated rows and null ids stay; columns may have any
    names; an empty benchmark changes nothing.
    """
    for index in shards(benchmark):

        def go(batches, index=index):
            for batch in runs(batches):
                rows = search(index, block_of(batch.column("text").cast(pa.string())), threshold, overlap)
                clean = np.ones(batch.num_rows, bool)
                clean[[r[0] for r in rows]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(go, docs.schema)
    return docs
