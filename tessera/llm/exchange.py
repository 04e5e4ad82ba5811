"""Compact messages between stages that look for repeated content.

Millions of short strings are compared by hash.  Sending them as rows would
cost more in row overhead than in content, so a task packs what it has for one
bucket into one binary message: a table of documents, positions as differences
(both compressed), and the hashes.  Messages are dealt by bucket; whatever the
skew of the content, hashes spread evenly, and a task sends a hash once however
often it occurs in the FLUSH_BYTES of text that it packs at a time.  The number
of buckets follows the bytes of text (``sizes``), so a message holds about as
much however many shuffle partitions are set.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextBlock, block_of, mix, partitions, text_or_empty

#: Text whose findings go out together.
FLUSH_BYTES = 8 << 20
#: Text of a home that is opened at once.
OPENED_BYTES = 4 << 20
#: Text of a bucket: at least so much where fewer buckets than partitions do, at most so much otherwise.
_LEAST_TEXT, _MOST_TEXT = 1 << 20, 20 << 20
#: A null id counts as the largest number; this bit of its tag puts it after a real id of that number.
NULL_ID = (1 << 63) - 1
NULL_TAG = np.uint64(1 << 63)
_HEAD = struct.Struct("<IIII")


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


@dataclass
class Input:
    """doc_id (null: NULL_ID), no_id, text (null: empty); whether an id occurs twice; how many buckets to deal to."""

    base: DataFrame
    twice: bool
    buckets: int


def prepared(docs: DataFrame) -> Input:
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("doc_id").cast("long").isNull().alias("no_id"), text_or_empty().alias("text")
    )
    ids = base.groupBy("doc_id", "no_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    got = ids.agg(F.max("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    return Input(base, (got.n or 0) > 1, sizes(got.bytes or 0, partitions(docs.sparkSession)))


def sizes(text_bytes: int, parts: int) -> int:
    """Buckets for so much text: as many as partitions, but none of little text and none of much."""
    return max(1, min(parts, -(-text_bytes // _LEAST_TEXT)), -(-text_bytes // _MOST_TEXT))


def tags(batch: pa.RecordBatch, block: TextBlock, twice: bool) -> np.ndarray:
    """Tell apart rows of one doc_id with different texts: 0 where ids are unique, else 63 bits of a hash of the text; NULL_TAG is added to null ids."""
    tag = np.where(batch.column("no_id").to_numpy(zero_copy_only=False), NULL_TAG, np.uint64(0))
    return tag | (block.word_hashes(block.offsets[:-1], block.offsets[1:]) >> np.uint64(1)) if twice else tag


def changes(*keys: np.ndarray) -> np.ndarray:
    """True where any of the sorted keys changes."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def in_order(batch: pa.RecordBatch, twice: bool) -> tuple[np.ndarray, np.ndarray, TextBlock]:
    """ids, tags and texts of a batch, sorted by both; the same row once."""
    ids, block = batch.column("doc_id").to_numpy(), block_of(batch.column("text"))
    tag = tags(batch, block, twice)
    order = np.lexsort((tag, ids))
    if twice:
        order = order[changes(ids[order], tag[order])]
    if len(order) != len(ids) or (np.diff(order) != 1).any():
        block = block_of(batch.column("text").take(pa.array(order)))
    return ids[order], tag[order], block


def merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Entries of several blocks, each (ids, tags, document of the entry, columns...),
    as one: distinct ids and tags in order, then the entries by document."""
    many = np.array([len(x[0]) for x in held])
    base = np.cumsum(many) - many
    ids, tag = (np.concatenate([x[k] for x in held]) for k in range(2))
    doc = np.concatenate([x[2] + b for x, b in zip(held, base.tolist(), strict=True)])
    columns = [np.concatenate([x[k] for x in held]) for k in range(3, len(held[0]))]
    order = np.lexsort((tag, ids))
    new = changes(ids[order], tag[order])
    rank = np.empty(len(ids), np.int32)
    rank[order] = np.cumsum(new) - 1
    if not new.all():  # a row that came in an earlier block already
        first = np.zeros(len(ids), bool)
        first[order[new]] = True
        keep = first[doc]
        doc, columns = doc[keep], [c[keep] for c in columns]
    doc = rank[doc]
    by = np.argsort(doc, kind="stable")
    return ids[order[new]], tag[order[new]], doc[by], *(c[by] for c in columns)


def _narrow(x: np.ndarray) -> tuple[bytes, int]:
    small = not len(x) or int(x.max()) < 1 << 16
    return x.astype("<u2" if small else "<u4").tobytes(), 2 if small else 4


def message(ids: np.ndarray, tag: np.ndarray, doc: np.ndarray, at: np.ndarray, size: np.ndarray | None = None, extra: np.ndarray | None = None) -> bytes:
    """Entries (doc: index into ids, not falling; at: rising within a document) as bytes;
    ``extra``: some bytes of each entry, as a matrix."""
    first = np.flatnonzero(changes(doc))
    step = np.diff(at, prepend=0)
    step[first] = at[first]
    counts = np.diff(np.append(first, len(doc)))
    table = np.diff(ids[doc[first]], prepend=0).astype("<i8").tobytes() + tag[doc[first]].astype("<u8").tobytes() + counts.astype("<u4").tobytes()
    steps, width = _narrow(step)
    sizes_, size_width = (b"", 0) if size is None else _narrow(size)
    packed = _squeeze(table + steps + sizes_)
    extra_width = 0 if extra is None else extra.shape[1]
    return _HEAD.pack(len(doc), len(first), len(packed), width | size_width << 8 | extra_width << 16) + packed + (b"" if extra is None else extra.tobytes())


def extra_of(raw: bytes) -> np.ndarray:
    """The extra bytes of each entry of a message."""
    n, _, _, widths = _HEAD.unpack_from(raw)
    width = widths >> 16
    return np.frombuffer(raw, np.uint8, n * width, len(raw) - n * width).reshape(n, width)


def low_bytes(h: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def from_bytes(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    return wide.view("<u8").ravel()


def opened(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """id, tag, at and size of each entry of a message."""
    n, docs, length, widths = _HEAD.unpack_from(raw)
    width, size_width = widths & 255, widths >> 8 & 255
    body = _expand(raw[_HEAD.size : _HEAD.size + length])
    ids = np.cumsum(np.frombuffer(body, "<i8", docs))
    tag = np.frombuffer(body, "<u8", docs, 8 * docs)
    counts = np.frombuffer(body, "<u4", docs, 16 * docs)
    step = np.frombuffer(body, f"<u{width}", n, 20 * docs).astype(np.int64)
    first = np.cumsum(counts) - counts
    total = np.cumsum(step)
    at = total - np.repeat(total[first] - step[first], counts)
    size = np.frombuffer(body, f"<u{size_width}", n, 20 * docs + width * n).astype(np.int64) if size_width else None
    return np.repeat(ids, counts), np.repeat(tag, counts), at, size


def home(ids: np.ndarray, tag: np.ndarray, homes: int) -> np.ndarray:
    """Where the texts and findings of a document meet; rows of one id spread by their texts."""
    return (mix(ids.astype(np.uint64) ^ mix(tag + np.uint64(77))) % np.uint64(homes)).astype(np.int64)


def split_by(key: np.ndarray):
    """Values of ``key``, each with the indices that have it, in their order."""
    if not len(key):
        return
    if 0 <= int(key.min()) and int(key.max()) < 1 << 16:
        key = key.astype(np.uint16)  # sorts by radix
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    cuts = np.flatnonzero(changes(sorted_key))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
        yield int(sorted_key[a]), order[a:b]


def texts_home(given: Input) -> DataFrame:
    """(home, kind 0, payload): the texts, compressed, by home; equal rows of a batch once, with their number."""

    def go(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, block = batch.column("doc_id").to_numpy(), block_of(batch.column("text"))
            tag, length, row = tags(batch, block, given_twice), np.diff(block.offsets), np.arange(len(ids))
            copies = np.ones(len(ids), np.int64)
            if given_twice:
                order = np.lexsort((tag, ids))
                first = np.flatnonzero(changes(ids[order], tag[order]))
                row = order[first]
                copies[row] = np.diff(np.append(first, len(order)))
            out = []
            for at, some in split_by(home(ids[row], tag[row], homes)):
                some = row[some]
                head = struct.pack("<I", len(some)) + b"".join(x[some].astype("<i8").tobytes() for x in (ids, tag.view(np.int64), copies, length))
                out.append((at, _squeeze(head + b"".join(map(block.text, some.tolist())))))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([0] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["home", "kind", "payload"])

    given_twice, homes = given.twice, given.buckets
    return given.base.mapInArrow(go, "home long, kind int, payload binary")


def open_texts(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, TextBlock]:
    """ids, tags, copies and texts."""
    body = _expand(raw)
    n = struct.unpack_from("<I", body)[0]
    ids, tag, copies, length = np.frombuffer(body, "<i8", 4 * n, 4).reshape(4, n)
    return ids, tag.view(np.uint64), copies, TextBlock(np.frombuffer(body, np.uint8, offset=4 + 32 * n), np.concatenate([[0], np.cumsum(length)]))


def texts_of(payloads: pa.ChunkedArray, most: int = OPENED_BYTES):
    """What ``open_texts`` gives of many messages, about ``most`` bytes of text at a time, so that the work on a home
    follows its text and not the number of its messages."""
    held, size = [], 0

    def joined():
        blocks = [x[3] for x in held]
        sizes = np.concatenate([np.diff(b.offsets) for b in blocks])
        return *(np.concatenate([x[k] for x in held]) for k in range(3)), TextBlock(np.concatenate([b.data for b in blocks]), np.concatenate([[0], np.cumsum(sizes)]))

    for payload in payloads:
        held.append(open_texts(payload.as_py()))
        size += len(held[-1][3].data)
        if size >= most:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def given_back(ids: np.ndarray, tag: np.ndarray) -> list[int | None]:
    return [None if none else i for i, none in zip(ids.tolist(), (tag >= NULL_TAG).tolist(), strict=True)]


def each_copy(found: DataFrame) -> DataFrame:
    """Every row as often as its column ``copies`` says, without that column."""
    return found.select("*", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "col")


def lookup(ids: np.ndarray, tag: np.ndarray, want_ids: np.ndarray, want_tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) with ids[i], tag[i] equal to want_ids[j], want_tags[j]; equal rows of ids all count."""
    both = np.concatenate([ids, want_ids]), np.concatenate([tag, want_tags])
    order = np.lexsort((both[1], both[0]))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(changes(both[0][order], both[1][order]))
    have, want = number[: len(ids)], number[len(ids) :]
    order = np.argsort(have, kind="stable")
    low, high = np.searchsorted(have[order], want, "left"), np.searchsorted(have[order], want, "right")
    many = high - low
    j = np.repeat(np.arange(len(want)), many)
    return order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low[j]], j


def first_of_each(hashes: tuple[np.ndarray, ...], *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of entries whose first hash occurs twice, sorted by all hashes and then by
    ``order``, and for each the place in that list of the first of its hashes."""
    by = np.argsort(hashes[0], kind="stable")
    h = hashes[0][by]
    same = h[1:] == h[:-1]
    many = by[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(h) else by
    many = many[np.lexsort((*(x[many] for x in reversed(order)), *(x[many] for x in reversed(hashes))))]
    new = changes(*(x[many] for x in hashes))
    return many, np.maximum.accumulate(np.where(new, np.arange(len(many)), 0)) if len(many) else np.zeros(0, np.int64)
