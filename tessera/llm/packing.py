"""Concatenate and cut: token streams packed into sequences of fixed length.

Pass 1 tokenises every document once and writes, per input partition, the ids
with their offsets inside that partition.  The partitions' totals are summed up
into global offsets (one row per partition).  Pass 2 cuts each document at the
multiples of the sequence length; a document that crosses such a multiple gives
one piece on each side of it.  Only the very last sequence can be short.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut_lineage, mix, rolling, runs, text_or_empty

#: Letters, digits and white space below this code point are classified here;
#: texts with others take the library's own (slower) path.
FAST_BELOW = 0x0590
#: Words whose ids are remembered by a worker.
WORDS_KEPT = 300_000
_SPACES = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0}


def _classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, for each code point."""
    out = np.full(FAST_BELOW, 2, np.uint8)
    for c in range(FAST_BELOW):
        kind = unicodedata.category(chr(c))[0]
        out[c] = 3 if c in _SPACES else 0 if kind == "L" else 1 if kind == "N" else 2
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Tokeniser:
    """Byte-level BPE ids, equal to ``tokenizers``' for the same file.

    Texts are split into the words of the byte-level pattern with array
    operations, and each distinct word is encoded once.  Words are found by hash,
    then compared letter by letter with the word that was encoded; one that
    is unlike it is encoded by itself.  Texts with contractions, special tokens or code points from FAST_BELOW on go to the
    library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.classes = _classes()
        self.values = mix(np.arange(FAST_BELOW, dtype=np.uint64) + np.uint64(0x51ED270B))
        self.bpe = None
        if path.endswith("byte_bpe_50k.json"):
            self.bpe, self.nul = _ranks(path[: -len("json")] + "tiktoken")
        self._forget()

    def _forget(self) -> None:
        #: Hash of a word -> its row in begin and count, which point into flat, and in letter and long, which point into letters.
        self.row: dict[int, int] = {}
        self.begin, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.letter, self.long, self.letters = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def _words(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the words of the byte-level pattern start."""
        kind = self.classes[points]
        first = np.empty(len(points), bool)
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first[offsets[:-1]] = True
        at = np.flatnonzero(first)
        # White space before a word of the same text: its last character, if a blank, starts that word, else stands alone.
        ends_text = np.zeros(len(points) + 1, bool)
        ends_text[offsets] = True
        after = np.append(at[1:], len(points))
        ahead = after[(kind[at] == 3) & ~ends_text[after]]
        first[ahead[points[ahead - 1] == 0x20]] = False
        first[ahead - 1] = True
        return np.flatnonzero(first)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        fast, slow = [], []
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, np.uint32)
            elif self.bpe is None or "'" in text or any(s in text for s in self.special):
                slow.append(i)
            else:
                fast.append(i)
        if fast and _points("".join(texts[i] for i in fast)).max() >= FAST_BELOW:
            far = [i for i in fast if not texts[i].isascii() and _points(texts[i]).max() >= FAST_BELOW]
            fast, slow = sorted({*fast} - {*far}), slow + far
        for i, e in zip(slow, self.library.encode_batch([texts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        if fast:
            for i, ids in zip(fast, self._encode_fast([texts[i] for i in fast]), strict=True):
                out[i] = ids
        return out

    def _encode_fast(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        points = _points(whole)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        starts = self._words(points, offsets)
        ends = np.append(starts[1:], len(points))
        h = mix(rolling(self.values[points])(starts, ends) + (ends - starts).astype(np.uint64))
        distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.row) > WORDS_KEPT:
            self._forget()
        get = self.row.get
        rows = np.fromiter((get(k, -1) for k in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = len(self.begin) + np.arange(len(new))
            self._learn(distinct[new].tolist(), [whole[s:e] for s, e in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
        rows = rows[back]
        for i in self._unlike(rows, points, starts, ends):
            rows[i] = len(self.begin)
            self._learn([-1 - len(self.begin)], [whole[starts[i] : ends[i]]])  # no hash leads here
        n = self.count[rows]
        stops = np.cumsum(n)
        ids = self.flat[np.arange(stops[-1]) + np.repeat(self.begin[rows] - (stops - n), n)]
        return np.split(ids, np.concatenate([[0], stops])[np.searchsorted(starts, offsets[1:-1])])

    def _unlike(self, rows: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[int]:
        """Words that are not the ones of their rows."""
        n = ends - starts
        unlike = n != self.long[rows]
        before = np.cumsum(n) - n  # words follow on each other, so this is also where each starts
        shift = np.where(unlike, 0, self.letter[rows] - before)
        known = self.letters[np.minimum(np.arange(len(points)) + np.repeat(shift, n), len(self.letters) - 1)]
        unlike |= np.logical_or.reduceat(known != points, starts)
        return np.flatnonzero(unlike).tolist()

    def _learn(self, keys: list[int], words: list[str]) -> None:
        """Encode new words, all in one call with a NUL between them."""
        if any("\0" in w for w in words):
            ids = [self.bpe.encode_ordinary(w) if "\0" not in w else [e for x in self.library.encode_batch([w], add_special_tokens=False) for e in x.ids] for w in words]
            count, flat = np.array([len(x) for x in ids], np.int64), np.array([t for x in ids for t in x], np.uint32)
        else:
            flat = np.array(self.bpe.encode_ordinary("\0".join(words)), np.uint32)
            gaps = np.concatenate([[-1], np.flatnonzero(flat == self.nul), [len(flat)]])
            count, flat = np.diff(gaps) - 1, flat[flat != self.nul]
        self.row.update(zip(keys, range(len(self.begin), len(self.begin) + len(keys)), strict=True))
        long = np.fromiter(map(len, words), np.int64, len(words))
        self.letter, self.long = np.append(self.letter, len(self.letters) + np.cumsum(long) - long), np.append(self.long, long)
        self.letters = np.append(self.letters, _points("".join(words)).astype(np.uint16))
        self.begin = np.append(self.begin, len(self.flat) + np.cumsum(count) - count)
        self.count, self.flat = np.append(self.count, count), np.append(self.flat, flat)


def _ranks(path: str):
    """The vocabulary as ranks, for single words with a NUL between them; the id of NUL."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("words", pat_str=r"[^\x00]+|\x00", mergeable_ranks=ranks, special_tokens={}), ranks[b"\0"]


@functools.cache
def tokeniser(path: str) -> Tokeniser:
    return Tokeniser(path)


def token_table(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """One row per document: ids (little-endian unsigned 32-bit) with ``end_id`` appended,
    their number, and where they start among the ids of the same input partition."""

    def encode(batches):
        t, part, at = tokeniser(path), TaskContext.get().partitionId(), 0
        tail = np.array([end_id], np.uint32)
        for batch in runs(batches):
            ids = [np.append(x, tail) for x in t.encode(batch.column("text").to_pylist())]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            small = max(int(x.max()) for x in ids) < 1 << 16
            blobs = [x.astype("<u2" if small else "<u4").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([part] * len(ids), pa.int32()), pa.array(starts), pa.array(n), pa.array(blobs, pa.binary())],
                ["doc_id", "part", "part_start", "n", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(encode, "doc_id long, part int, part_start long, n long, ids binary")


def cut(tokens: DataFrame, length: int) -> DataFrame:
    """Pieces of the token table in sequences of ``length``.

    The base table has one row per input partition (at 128 MB each, 100 TB are
    800,000 rows of 12 bytes), so its size is bounded and it is broadcast.
    """
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    placed = tokens.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("at"), "n", "ids")

    def pieces(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at, n = batch.column("at").to_numpy(), batch.column("n").to_numpy()
            first, last = at // length, (at + n - 1) // length
            many = last - first + 1
            row = np.repeat(np.arange(len(at)), many)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            begin = np.maximum(at[row], seq * length)
            end = np.minimum(at[row] + n[row], (seq + 1) * length)
            start = begin - at[row]
            crc, blobs, was, ids = [], batch.column("ids"), -1, None
            for r, s, e in zip(row.tolist(), start.tolist(), (end - at[row]).tolist(), strict=True):
                if r != was:
                    raw, was = blobs[r].as_py(), r
                    ids = memoryview(np.frombuffer(raw, "<u2" if len(raw) == 2 * n[r] else "<u4").astype("<u4"))
                crc.append(zlib.crc32(ids[s:e]))
            doc = batch.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(start), pa.array(end - begin), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(begin - seq * length)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return placed.mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of ``length`` token ids.

    Null and empty texts are the end id alone.  Repeated rows are packed as
    often as they occur; a null doc_id stays null; other columns are not read;
    an empty table gives no pieces.
    """
    return cut(cut_lineage(token_table(docs, path, end_id)), length)
