"""Shared pieces of the training-data operators.

Texts are handled as Arrow string columns.  ``TextBlock`` views a run of texts
as one byte array with offsets, so that splitting into words and rolling
hashes are whole-array numpy operations instead of loops over rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in runs of about this many bytes, which bounds memory
#: whatever the size of an Arrow batch; one longer text is a run of its own.
BLOCK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Values of a byte at each of the first places of a string are looked up, those further on are mixed when met.
_PLACES = 64
_tables: dict[int, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where ``spark.checkpoint.dir`` is unset, a local session sets a temporary
    folder once; on a cluster that is an error, as no other machine could read it.
    """
    path, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not path and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return path or sc.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from those files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions as configured for the size of the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _mixed_codes(code: np.ndarray, salt: int) -> np.ndarray:
    return mix(mix(code.astype(np.uint64) + np.uint64(salt * 0x632BE59BD9B4E019 % (1 << 64))) + np.uint64(_BASE))


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 1))
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        got = (both[0], both[1])
        if size <= 4 * BLOCK_BYTES:
            _powers[base] = got
    return got[0][:n], got[1][:n]


def rolling(values: np.ndarray, base: int = _BASE):
    """A Rabin-Karp hasher: f(start, end) of runs of ``values``, in O(1) each."""
    p, inverse = powers(len(values) + 1, base)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[:-1], out=sums[1:])
    return lambda start, end: (sums[end] - sums[start]) * inverse[start]


class TextBlock:
    """Some texts as one array of UTF-8 bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the word offsets of the texts."""
        inside = ~_SEPARATOR[self.data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(self.data))]
        begins[cuts] = inside[cuts]
        stops[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hashes of strings that do not overlap: the sum of a mixed value of each
        byte with its place, so no exchange of bytes between places cancels out."""
        n = ends - starts
        before = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(before, n)
        code = place << 8 | self.data[place + np.repeat(starts, n)]
        if salt not in _tables:
            _tables[salt] = _mixed_codes(np.arange(_PLACES << 8), salt)
        values = _tables[salt][np.minimum(code, (_PLACES << 8) - 1)]
        far = np.flatnonzero(code >= _PLACES << 8)
        values[far] = _mixed_codes(code[far], salt)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        return mix(sums[before + n] - sums[before] + n.astype(np.uint64) * np.uint64(_BASE))

    def gram_hashes(self):
        """A Rabin-Karp hasher of strings of 8 bytes or more, over the mixed values of
        their 8-byte pieces (of the bytes themselves, long strings that swap two bytes
        in the pattern of Thue and Morse would have one hash)."""
        x = np.concatenate([self.data, np.zeros(7, np.uint8)]).astype(np.uint64)
        for step in (1, 2, 4):
            x = x[:-step] | x[step:] << np.uint64(8 * step)
        h = rolling(mix(x))
        return lambda start, end: h(start, end - 7)

    def lowered(self) -> TextBlock:
        """A to Z as a to z; other bytes as they are."""
        upper = (self.data >= 65) & (self.data <= 90)
        return TextBlock(self.data | (upper.astype(np.uint8) << 5), self.offsets)

    def byte_hashes(self):
        return rolling(_BYTE_VALUE[self.data])


def block_of(column: pa.Array) -> TextBlock:
    """An Arrow string or binary column as one block; null is the empty text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n or column.buffers()[1] is None:
        return TextBlock(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64))
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return TextBlock(data, off - off[0])


def runs(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``most`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = block_of(batch.column(column)).offsets[1:]
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def groups_of(offsets: np.ndarray) -> np.ndarray:
    """For each element, the index of the text that it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())
