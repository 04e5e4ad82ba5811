"""Removal of repeated byte strings, by suffix arrays of the places that may repeat.

1. Anchors.  Of the ``k``-byte strings in each window of ``width`` bytes the one
   with the smallest hash is its anchor (the rightmost of equal ones).  It depends on
   the window alone, so equal windows have equal anchors.  Windows of one text
   with one anchor are neighbours and form a segment.
2. Segments meet by anchor, as hashes.  Copies of a segment are settled there:
   all but those of the smallest doc_id go.  Only where one anchor has
   several different segments does one holder of each send its bytes on.
3. The segments of an anchor are joined, with separators, and suffix-sorted by
   linear grouping; suffixes whose first ``width`` bytes are equal are neighbours
   in that order, and the smallest doc_id of each such run keeps them.
   Copies are found by hash first, and compared byte by byte, before that.  An
   anchor amid very many different neighbours is dealt over more tasks by the
   longer anchors beside it, and so is text beyond what is sorted at once; what
   then meets is sorted in the same way.
4. What was found goes back to the texts, where removed windows merge.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .common import TextBlock, cut_lineage, groups_of, mix, runs
from .exchange import changes as _new
from .gsaca import suffix_arrays

#: Lengths of anchors: the first for all texts, the others for anchors with over _JOINED bytes, which bounds the memory and time of one sort.
ANCHORS = (24, 36, 44, 48, 50)
_JOINED = 1 << 13
#: Anchors with over so many different segments are dealt by the longer anchors of _HOT_LEVEL, so that they meet in many tasks.
_HOT, _HOT_LEVEL = 500, 2
#: Bytes that are suffix-sorted at once.
_BATCH = 1 << 20
_SALT = 0x9E3779B97F4A7C15
#: Bytes of an anchor's hash that segments carry, beside 8 of the content's hash.
_KEY = 6
_LOW = np.uint64((1 << 28) - 1)
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, copies long"


def _within(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def segments(block: TextBlock, k: int, width: int) -> tuple[np.ndarray, ...]:
    """Text, first byte, windows, anchor hash and content hash of each segment, in order."""
    n = len(block.data)
    if n < width:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    roll = block.gram_hashes()
    at = np.arange(n - k + 1)
    h = mix(roll(at, at + k))
    least = (h & ~_LOW) | (_LOW - (at.astype(np.uint64) & _LOW))
    reach, wide = 1, width - k + 1
    while reach < wide:
        step = min(reach, wide - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    of = groups_of(block.offsets)
    whole = of[: n - width + 1] == of[width - 1 :]
    anchor = least & _LOW
    first = np.flatnonzero(_new(anchor, whole))
    stop = np.append(first[1:], len(anchor))
    inside = whole[first]
    first, stop = first[inside], stop[inside]
    # The low bits of the anchor's place, made whole from the place of its window.
    place = first + ((_LOW - anchor[first] - first.astype(np.uint64)) & _LOW).astype(np.int64)
    doc = of[first]
    return doc, first - block.offsets[doc], stop - first, h[place], mix(roll(first, stop + width - 1) + (stop - first).astype(np.uint64))


def _gather(block: TextBlock, starts: np.ndarray, sizes: np.ndarray) -> TextBlock:
    return TextBlock(block.data[np.repeat(starts, sizes) + _within(sizes)], np.concatenate([[0], np.cumsum(sizes)]))


def _unlike(block: TextBlock, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which strings of ``sizes`` bytes that start at ``a`` and ``b`` differ."""
    out = np.zeros(len(a), bool)
    todo = np.flatnonzero(a != b)
    for some in np.split(todo, np.flatnonzero(np.diff(np.cumsum(sizes[todo]) // _BATCH)) + 1) if len(todo) else ():
        n = sizes[some]
        step = _within(n)
        differ = block.data[np.repeat(a[some], n) + step] != block.data[np.repeat(b[some], n) + step]
        out[some] = np.logical_or.reduceat(differ, np.cumsum(n) - n)
    return out


def smallest_holders(block: TextBlock, group: np.ndarray, holder: np.ndarray, width: int, level: int = 0) -> np.ndarray:
    """For every window of every text of ``block``, text by text: the smallest
    ``holder`` of the texts of the same group that hold an equal window.

    Texts are sorted by group, and those of a group are unlike.
    """
    sizes = np.diff(block.offsets)
    windows = sizes - width + 1
    base = np.cumsum(windows) - windows
    out = np.repeat(holder, windows)
    first = np.flatnonzero(_new(group))
    many = np.diff(np.append(first, len(group)))
    chars = np.add.reduceat(sizes + 1, first) + 1 if len(first) else many
    several = many > 1
    large = several & (chars > _JOINED)
    if large.any():
        texts = np.flatnonzero(np.repeat(large, many))
        sub = _gather(block, block.offsets[texts], sizes[texts])
        doc, at, n, key, content = segments(sub, ANCHORS[level + 1], width)
        g = mix(group[texts[doc]].astype(np.uint64) * np.uint64(_SALT) + key)
        order = np.lexsort((holder[texts[doc]], content, g))
        doc, at, n, g, content = doc[order], at[order], n[order], g[order], content[order]
        new = _new(g, content)
        begins, long = sub.offsets[doc] + at, n + width - 1
        first_like = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        new |= (long != long[first_like]) | _unlike(sub, begins, begins[first_like], np.minimum(long, long[first_like]))
        lead = np.flatnonzero(new)
        inner = smallest_holders(_gather(sub, sub.offsets[doc[lead]] + at[lead], n[lead] + width - 1), np.cumsum(_new(g))[lead], holder[texts[doc[lead]]], width, level + 1)
        begin = np.cumsum(n[lead]) - n[lead]
        number = np.cumsum(new) - 1
        which = np.where(new, number, number[first_like])
        step = _within(n)
        out[np.repeat(base[texts[doc]] + at, n) + step] = inner[np.repeat(begin[which], n) + step]
    small = np.flatnonzero(several & ~large)
    small = small[np.argsort(chars[small], kind="stable")]
    for part in np.split(small, np.flatnonzero(np.diff(np.cumsum(chars[small]) // _BATCH)) + 1) if len(small) else ():
        _sorted_group(block, part, first, many, chars, sizes, windows, base, holder, out, width)
    return out


def _sorted_group(block, part, first, many, chars, sizes, windows, base, holder, out, width) -> None:
    """Settle some groups by their suffix arrays."""
    texts = np.repeat(first[part], many[part]) + _within(many[part])
    n = sizes[texts]
    # Each text and a separator; each group and a stop.
    last = np.zeros(len(texts), np.int64)
    last[np.cumsum(many[part]) - 1] = 1
    start = np.cumsum(n + 1 + last) - (n + 1 + last)
    joined = np.ones(int(chars[part].sum()), np.uint16)
    joined[np.cumsum(chars[part]) - 1] = 0
    within = _within(n)
    joined[np.repeat(start, n) + within] = block.data[np.repeat(block.offsets[texts], n) + within].astype(np.uint16) + 2
    window = np.full(len(joined), -1)
    w = windows[texts]
    within = _within(w)
    window[np.repeat(start, w) + within] = np.repeat(base[texts], w) + within
    sa = suffix_arrays(joined, chars[part])
    owner = np.repeat(np.arange(len(part)), chars[part])
    sa = sa[window[sa] >= 0]
    views = np.lib.stride_tricks.sliding_window_view(joined, width)
    same = np.zeros(len(sa), bool)
    for at in range(1, len(sa), 1 << 17):
        a, b = sa[at - 1 : at - 1 + (1 << 17)], sa[at : at + (1 << 17)]
        a = a[: len(b)]
        maybe = np.flatnonzero((joined[a] == joined[b]) & (joined[a + width - 1] == joined[b + width - 1]) & (owner[a] == owner[b]))
        same[at + maybe] = (views[a[maybe]] == views[b[maybe]]).all(axis=1)
    runs_at = np.flatnonzero(~same)
    if len(sa):
        found = window[sa]
        out[found] = np.repeat(np.minimum.reduceat(out[found], runs_at), np.diff(np.append(runs_at, len(sa))))


def _table(rows: list[tuple], *columns: tuple[str, pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(columns)], [c for c, _ in columns])


_FOUND = (("home", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary()))


def _to_homes(ids, tag, at, n, homes: int, extra: np.ndarray | None = None) -> list[tuple[int, bytes]]:
    """Messages, by home, of entries in any order."""
    if not len(ids):
        return []
    order = np.lexsort((at, tag, ids))
    ids, tag, at, n = ids[order], tag[order], at[order], n[order]
    extra = None if extra is None else extra[order]
    new = _new(ids, tag)
    doc = np.cumsum(new) - 1
    return [(where, ex.message(ids[new], tag[new], doc[r], at[r], n[r], None if extra is None else extra[r])) for where, r in ex.split_by(ex.home(ids, tag, homes))]


def _packed(buckets: int, key, ids, tag, at, n, data: TextBlock, send: np.ndarray, width: int) -> list[tuple[int, bytes]]:
    """Segments with their bytes, by the bucket of their anchor."""
    send = np.flatnonzero(send)
    out = []
    for bucket, r in ex.split_by((key[send] % np.uint64(buckets)).astype(np.uint32)):
        r = send[r]
        head = struct.pack("<I", len(r)) + b"".join(x[r].astype("<i8").tobytes() for x in (ids, tag.view(np.int64), at, n, key.view(np.int64)))
        out.append((bucket, ex._squeeze(head + _gather(data, data.offsets[r], n[r] + width - 1).data.tobytes())))
    return out


def remove_repeated(docs: DataFrame, width: int = 50, hot: int = _HOT) -> DataFrame:
    """Remove each byte covered by a string of ``width`` bytes that also starts
    in a document with a smaller doc_id; strings are judged on the input.

    Null texts are empty; texts shorter than ``width`` stay whole.  Rows that
    share a doc_id do not remove from each other.  Null ids count as one id
    after all others and are given back as null.  Other columns are not read; an
    empty table gives no rows.
    """
    if width != ANCHORS[-1]:
        raise ValueError(f"anchors are laid out for strings of {ANCHORS[-1]} bytes")
    given = ex.prepared(docs)
    twice, buckets = given.twice, given.buckets
    homes = buckets

    def told(held) -> pa.RecordBatch:
        """Later copies among these go home; the other segments are sent on to meet by anchor."""
        ids, tag, doc, at, n, key, content = ex.merged(held)
        held.clear()
        many, first = ex.first_of_each((key, content), np.arange(len(doc)))
        copy = np.zeros(len(doc), bool)
        one, lead = doc[many], doc[many[first]]
        copy[many[(ids[one] != ids[lead]) | (tag[one] >= ex.NULL_TAG) & (tag[lead] < ex.NULL_TAG)]] = True
        out = [(buckets + where, p) for where, p in _to_homes(ids[doc[copy]], tag[doc[copy]], at[copy], n[copy], homes)]
        send = np.flatnonzero(~copy)
        for bucket, r in ex.split_by(((key[send] >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint32)):
            r = send[r]
            out.append((bucket, ex.message(ids, tag, doc[r], at[r], n[r], np.hstack([ex.low_bytes(key[r], _KEY), ex.low_bytes(content[r], 8)]))))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "payload"])

    def anchored(batches):
        held, size = [], 0
        for batch in runs(batches):
            ids, tag, block = ex.in_order(batch, twice)
            doc, at, n, key, content = segments(block, ANCHORS[0], width)
            if len(doc):
                held.append((ids, tag, doc.astype(np.int32), at.astype(np.int32), n.astype(np.int32), key, content))
                size += len(block.data)
            if size >= ex.FLUSH_BYTES:
                yield told(held)
                size = 0
        if held:
            yield told(held)

    def met(table: pa.Table) -> pa.Table:
        bucket, payloads = table.column("bucket")[0].as_py(), table.column("payload").to_pylist()
        if bucket >= buckets:
            return _table([(bucket - buckets, 1, p) for p in payloads], *_FOUND)
        ids, tag, at, n = (np.concatenate(x) for x in zip(*map(ex.opened, payloads), strict=True))
        extra = np.concatenate([ex.extra_of(p) for p in payloads])
        key, content = ex.from_bytes(extra[:, :_KEY]), ex.from_bytes(extra[:, _KEY:])
        del extra
        order, _ = ex.first_of_each((key,), content, ids, tag >= ex.NULL_TAG)  # anchors that occur once cannot repeat
        key, content, ids, tag, at, n = key[order], content[order], ids[order], tag[order], at[order], n[order]
        if not len(key):
            return _table([], *_FOUND)
        new = _new(key, content)
        lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        copy = (ids != ids[lead]) | ((tag >= ex.NULL_TAG) != (tag[lead] >= ex.NULL_TAG))
        out = [(where, 1, p) for where, p in _to_homes(ids[copy], tag[copy], at[copy], n[copy], homes)]
        anchor = np.cumsum(_new(key)) - 1
        unlike = np.bincount(anchor, new)[anchor]
        ask = (unlike > 1) & ~copy
        extra = np.hstack([ex.low_bytes(key[ask], _KEY), (unlike[ask] > hot).astype(np.uint8)[:, None]])
        out += [(where, 2, p) for where, p in _to_homes(ids[ask], tag[ask], at[ask], n[ask], homes, extra)]
        return _table(out, *_FOUND)

    def sent(texts: pa.Table, asked: pa.Table) -> pa.Table:
        """The bytes of the segments that are asked for, by bucket of the anchor."""
        if not asked.num_rows:
            return _table([], ("bucket", pa.int64()), ("payload", pa.binary()))
        payloads = asked.column("payload").to_pylist()
        ids, tag, at, n = (np.concatenate(x) for x in zip(*map(ex.opened, payloads), strict=True))
        extra = np.concatenate([ex.extra_of(p) for p in payloads])
        key, is_hot = ex.from_bytes(extra[:, :_KEY]), extra[:, _KEY] > 0
        done = np.zeros(len(ids), bool)
        out, held = [], []
        for text_ids, text_tags, _, block in ex.texts_of(texts.column("payload")):
            row, want = ex.lookup(text_ids, text_tags, ids, tag)
            want, one = np.unique(want, return_index=True)
            row = row[one]
            row, want = row[~done[want]], want[~done[want]]
            done[want] = True
            data = _gather(block, block.offsets[row] + at[want], n[want] + width - 1)
            plain = ~is_hot[want]
            out += _packed(buckets, key[want], ids[want], tag[want], at[want], n[want], data, plain, width)
            if not plain.all():
                # Copies of the parts within this task are settled here, so a part is sent on once.
                w, part = want[~plain], _gather(data, data.offsets[:-1][~plain], np.diff(data.offsets)[~plain])
                doc, first, windows, k2, content = segments(part, ANCHORS[_HOT_LEVEL], width)
                k2 = mix(key[w[doc]] * np.uint64(_SALT) + k2) & np.uint64((1 << 48) - 1)
                held.append((ids[w[doc]], tag[w[doc]], at[w[doc]] + first, windows, k2, content, _gather(part, part.offsets[doc] + first, windows + width - 1)))
        if held:
            i2, t2, a2, n2, k2, c2 = (np.concatenate([h[j] for h in held]) for j in range(6))
            data = TextBlock(np.concatenate([h[6].data for h in held]), np.concatenate([[0], np.cumsum(n2 + width - 1)]))
            order = np.lexsort((t2 >= ex.NULL_TAG, i2, c2, k2))
            new = _new(k2[order], c2[order])
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            copy = np.zeros(len(order), bool)
            later = (i2[order] != i2[lead]) | ((t2[order] >= ex.NULL_TAG) != (t2[lead] >= ex.NULL_TAG))
            copy[order] = later & (n2[order] == n2[lead]) & ~_unlike(data, data.offsets[order], data.offsets[lead], np.minimum(n2[order], n2[lead]) + width - 1)
            out += [(buckets + where, p) for where, p in _to_homes(i2[copy], t2[copy], a2[copy], n2[copy], homes)]
            out += _packed(buckets, k2, i2, t2, a2, n2, data, ~copy, width)
        return _table(out, ("bucket", pa.int64()), ("payload", pa.binary()))

    def settled(table: pa.Table) -> pa.Table:
        """What to remove of the segments whose anchor has several."""
        bucket = table.column("bucket")[0].as_py()
        if bucket >= buckets:
            return _table([(bucket - buckets, 1, p) for p in table.column("payload").to_pylist()], *_FOUND)
        fields, data = [], []
        for payload in table.column("payload"):
            body = ex._expand(payload.as_py())
            m = struct.unpack_from("<I", body)[0]
            fields.append(np.frombuffer(body, "<i8", 5 * m, 4).reshape(5, m))
            data.append(np.frombuffer(body, np.uint8, offset=4 + 40 * m))
        ids, tag, at, n, key = np.hstack(fields)
        tag = tag.view(np.uint64)
        order = np.lexsort((tag >= ex.NULL_TAG, ids))
        age = np.empty(len(ids), np.int64)  # by doc_id, null ids last
        age[order] = np.cumsum(_new(ids[order], tag[order] >= ex.NULL_TAG))
        sizes = n + width - 1
        block = TextBlock(np.concatenate(data), np.concatenate([[0], np.cumsum(sizes)]))
        content = mix(block.gram_hashes()(block.offsets[:-1], block.offsets[1:]) + sizes.astype(np.uint64))
        order = np.lexsort((age, content, key))
        new = _new(key[order], content[order])
        first_like = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        like = order[first_like]
        new |= (sizes[order] != sizes[like]) | _unlike(block, block.offsets[order], block.offsets[like], np.minimum(sizes[order], sizes[like]))
        lead = order[new]
        smallest = smallest_holders(_gather(block, block.offsets[lead], sizes[lead]), key[lead], age[lead], width)
        begin = np.cumsum(n[lead]) - n[lead]
        text = np.empty(len(order), np.int64)
        number = np.cumsum(new) - 1
        text[order] = np.where(new, number, number[first_like])
        entry, step = np.repeat(np.arange(len(ids)), n), _within(n)
        gone = smallest[begin[text[entry]] + step] < age[entry]
        entry, place = entry[gone], (at[entry] + step)[gone]
        run = np.flatnonzero(_new(entry, place - np.arange(len(place))))
        e = entry[run]
        found = _to_homes(ids[e], tag[e], place[run], np.diff(np.append(run, len(entry))), homes)
        return _table([(where, 1, p) for where, p in found], *_FOUND)

    def removed(texts: pa.Table, found: pa.Table) -> pa.Table:
        marks = [*map(ex.opened, found.column("payload").to_pylist())]
        marks = [np.concatenate(x) for x in zip(*marks, strict=True)] if marks else [np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2]
        rows = []
        for some in ex.texts_of(texts.column("payload")):
            rows += _cut(*some, marks, width)
        return _table(rows, ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("copies", pa.int64()))

    found_schema = "home long, kind int, payload binary"
    texts = ex.texts_home(given).groupBy("home")
    first = given.base.mapInArrow(anchored, "bucket long, payload binary").groupBy("bucket").applyInArrow(met, found_schema)
    first = cut_lineage(first)  # read twice
    asked = first.where("kind = 2").groupBy("home")
    second = texts.cogroup(asked).applyInArrow(sent, "bucket long, payload binary").groupBy("bucket").applyInArrow(settled, found_schema)
    return ex.each_copy(texts.cogroup(first.where("kind = 1").unionByName(second).groupBy("home")).applyInArrow(removed, _OUT))


def _cut(ids, tag, copies, block, marks, width: int) -> list[tuple]:
    row, mark = ex.lookup(ids, tag, marks[0], marks[1])
    order = np.argsort(row, kind="stable")
    row, mark = row[order], mark[order]
    at, stop = marks[2][mark], marks[2][mark] + marks[3][mark] - 1 + width
    cuts = np.searchsorted(row, np.arange(block.n + 1))
    out = []
    for i, (doc_id, many) in enumerate(zip(ex.given_back(ids, tag), copies.tolist(), strict=True)):
        data = block.data[block.offsets[i] : block.offsets[i + 1]]
        total, spans = len(data), 0
        if cuts[i] < cuts[i + 1]:
            cover = np.zeros(total + 1, np.int32)
            np.add.at(cover, at[cuts[i] : cuts[i + 1]], 1)
            np.add.at(cover, stop[cuts[i] : cuts[i + 1]], -1)
            left = np.cumsum(cover[:-1]) <= 0
            spans = int(np.count_nonzero(~left & np.concatenate([[True], left[:-1]])))
            data = data[left]
        out.append((doc_id, total, total - len(data), spans, hashlib.sha256(data.tobytes()).hexdigest(), many))
    return out
