"""Removal of repeated token windows, by Rabin-Karp hashes.

Every window of ``width`` consecutive words has two independent rolling hashes,
each over its own hashes of the words.  The second says in which bucket the
window is counted, and 64 bits of the first with 24 more of the second tell the
windows of a bucket apart: 88 bits and the bucket's number.  A window whose
hashes occurred earlier is removed, and the removed windows of a document merge
into maximal intervals.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as ex
from .common import groups_of, mix, rolling, runs

_SECOND_BASE = 0xD6E8FEB86659FD93
_SECOND_BYTES = 3
#: Bytes of text that are hashed at once.
_BLOCK = 2 << 20
_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<struct<start:int,end:int>>, copies long"


def windows(block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes, document index and first word of every window, in order."""
    starts, ends, offsets = block.words()
    if len(starts) < width:
        none = np.zeros(0, np.int32)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    of = groups_of(offsets)
    begin = np.flatnonzero(of[: len(of) - width + 1] == of[width - 1 :])
    h = [mix(rolling(block.word_hashes(starts, ends, salt), base)(begin, begin + width)) for salt, base in ((1, 0x9E3779B97F4A7C15), (2, _SECOND_BASE))]
    return *h, of[begin].astype(np.int32), (begin - offsets[of[begin]]).astype(np.int32)


def _stretches(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of a document: document, first, number."""
    if not len(doc):
        return doc, at, at
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]))
    return doc[first], at[first], np.diff(np.append(first, len(doc)))


def remove_repeated(docs: DataFrame, width: int = 20) -> DataFrame:
    """Remove each word covered by a window of ``width`` words whose sequence
    also starts earlier: in a document of smaller doc_id, or of the same one
    further left.  Windows are judged on the input.

    Null texts have no words.  Rows that repeat an id and text get the same
    result; rows of one id with different texts are ordered by a hash of the
    text.  Null ids come last and are given back as null.  Other columns are not
    read; an empty table gives no rows.
    """
    given = ex.prepared(docs)
    twice, buckets = given.twice, given.buckets

    def told(held) -> pa.RecordBatch:
        """Later copies among these go home; the first of each is sent on to be counted."""
        ids, tag, doc, at, h, h2 = ex.merged(held)
        held.clear()
        many, first = ex.first_of_each((h, h2), np.arange(len(h)))
        later = np.zeros(len(h), bool)
        later[many[first != np.arange(len(many))]] = True
        out = []
        d, a, n = _stretches(doc[later], at[later])
        for where, rows in ex.split_by(ex.home(ids[d], tag[d], buckets)):
            out.append((buckets + where, ex.message(ids, tag, d[rows], a[rows], n[rows])))
        once = np.flatnonzero(~later)
        low = np.uint64(8 * _SECOND_BYTES)
        for bucket, rows in ex.split_by(((h2[once] >> low) % np.uint64(buckets)).astype(np.uint32)):
            rows = once[rows]
            out.append((bucket, ex.message(ids, tag, doc[rows], at[rows], extra=np.hstack([ex.low_bytes(h[rows], 8), ex.low_bytes(h2[rows], _SECOND_BYTES)]))))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "payload"])

    def hashed(batches):
        held, size = [], 0
        for batch in runs(batches, most=_BLOCK):
            ids, tag, block = ex.in_order(batch, twice)
            h, h2, doc, at = windows(block, width)
            if len(h):
                held.append((ids, tag, doc, at, h, h2))
                size += len(block.data)
            if size >= ex.FLUSH_BYTES:
                yield told(held)
                size = 0
        if held:
            yield told(held)

    def compared(table: pa.Table) -> pa.Table:
        bucket, payloads = table.column("bucket")[0].as_py(), table.column("payload").to_pylist()
        if bucket >= buckets:  # found already
            out = [(bucket - buckets, p) for p in payloads]
        else:
            # Both hashes first: what occurs once, which is most, is never opened further.
            extra = [ex.extra_of(p) for p in payloads]
            h, h2 = (np.concatenate([ex.from_bytes(x[:, some]) for x in extra]) for some in (slice(8), slice(8, None)))
            del extra
            twice_there, _ = ex.first_of_each((h, h2))
            keep = np.zeros(len(h), bool)
            keep[twice_there] = True
            h, h2 = h[keep], h2[keep]
            ids, tag, at, start = [], [], [], 0
            for p in payloads:
                i, t, a, _ = ex.opened(p)
                some = keep[start : start + len(i)]
                start += len(i)
                ids.append(i[some])
                tag.append(t[some])
                at.append(a[some])
            ids, tag, at = np.concatenate(ids), np.concatenate(tag), np.concatenate(at)
            many, first = ex.first_of_each((h, h2), ids, tag, at)
            lead = many[first]
            later = many[(ids[many] != ids[lead]) | (tag[many] != tag[lead]) | (at[many] != at[lead])]
            later = later[np.lexsort((at[later], tag[later], ids[later]))]
            out = []
            if len(later):
                i, t, a = ids[later], tag[later], at[later]
                new = ex.changes(i, t)
                doc = np.cumsum(new) - 1
                for where, rows in ex.split_by(ex.home(i[new], t[new], buckets)[doc]):
                    out.append((where, ex.message(i[new], t[new], doc[rows], a[rows])))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([1] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["home", "kind", "payload"])

    def removed(table: pa.Table) -> pa.Table:
        marks, rows = [], []
        for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload"), strict=True):
            if kind:
                ids, tag, at, n = ex.opened(payload.as_py())
                marks.append((ids, tag, at, np.ones(len(at), np.int64) if n is None else n))
        marks = [np.concatenate(x) for x in zip(*marks, strict=True)] if marks else [np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2]
        for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload"), strict=True):
            if not kind:
                rows += _cut(*ex.open_texts(payload.as_py()), marks, width)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int64())
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "intervals", "copies"]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names)

    found = given.base.mapInArrow(hashed, "bucket long, payload binary").groupBy("bucket").applyInArrow(compared, "home long, kind int, payload binary")
    return ex.each_copy(ex.texts_home(given).unionByName(found).groupBy("home").applyInArrow(removed, _OUT))


def _cut(ids, tag, copies, block, marks, width: int) -> list[tuple]:
    """Output rows of some texts: what is left of each, and its removed intervals."""
    row, mark = ex.lookup(ids, tag, marks[0], marks[1])
    order = np.argsort(row, kind="stable")
    row, mark = row[order], mark[order]
    at, stop = marks[2][mark], marks[2][mark] + marks[3][mark] - 1 + width
    cuts = np.searchsorted(row, np.arange(block.n + 1))
    out = []
    for i, (doc_id, many) in enumerate(zip(ex.given_back(ids, tag), copies.tolist(), strict=True)):
        words = block.text(i).split()  # of bytes: exactly the six separators
        total, gone = len(words), []
        if cuts[i] < cuts[i + 1]:
            cover = np.zeros(total + 1, np.int64)
            np.add.at(cover, at[cuts[i] : cuts[i + 1]], 1)
            np.add.at(cover, stop[cuts[i] : cuts[i + 1]], -1)
            left = np.cumsum(cover) <= 0
            edge = np.flatnonzero(np.diff(left.astype(np.int8), prepend=1))  # the last of cover is always 0
            gone = [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            words = list(compress(words, left.tolist()))
        out.append((doc_id, total, total - len(words), hashlib.sha256(b" ".join(words)).hexdigest(), gone, many))
    return out
