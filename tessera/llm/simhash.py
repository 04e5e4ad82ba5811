"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 32 segments of two
bits.  The Manhattan distance of two embeddings is a lower bound of the Hamming
distance of the fingerprints.  If that is at most 3, the embeddings of one of
the two halves (16 segments) are at most 1 apart: equal, or one step apart in
one segment.  So each distinct fingerprint stands in the grid cell of each half
and also looks in the cells one step up; whatever meets in a cell is verified
exactly.  Links of a cell are reduced to a spanning forest before they leave
the task, so copies and dense cells give no quadratic output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextBlock, block_of, cut_lineage, partitions, runs, text_or_empty
from .components import components, local_forest

MOST_BITS = 3
#: Cells of up to so many rows are compared pair by pair in one array operation.
_SMALL_CELL = 32
#: Null ids go with this number, and a mark that puts them after a real id of it.
LAST_ID = (1 << 63) - 1
#: Rows of one fingerprint that meet in one task.
SHARE = 1_000_000
_PAIR_MASK = np.uint64(0x5555555555555555)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of lower-cased (A-Z) UTF-8 text: a bit is 1 if set in over half
    the hashes (XXH64, seed 42) of the shingles; no words: zero."""
    import xxhash

    words = text.split()  # of bytes: exactly the six separators
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    h = np.fromiter((digest(whole[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def prints_of(block: TextBlock, shingle: int = 3) -> np.ndarray:
    """The fingerprint of each text, as a signed number."""
    block = block.lowered()
    return np.array([fingerprint(block.text(i), shingle) for i in range(block.n)], np.uint64).view(np.int64)


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id (null: the largest number), no_id, text (null: empty) and tie, a hash of the text that tells rows of one id apart."""
    doc_id, text = F.col("doc_id").cast("long"), text_or_empty()
    return docs.select(F.coalesce(doc_id, F.lit(LAST_ID)).alias("doc_id"), doc_id.isNull().alias("no_id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(no_id, doc_id, tie, fp) of every row."""

    def go(batches):
        for batch in runs(batches):
            found = pa.array(prints_of(block_of(batch.column("text")), shingle))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("no_id", "doc_id", "tie")), found], ["no_id", "doc_id", "tie", "fp"])

    return rows_of(docs).mapInArrow(go, "no_id boolean, doc_id long, tie long, fp long")


def embedding(fp: np.ndarray) -> np.ndarray:
    """Bit counts (0 to 2) of the 32 two-bit segments, two bits each."""
    return (fp & _PAIR_MASK) + ((fp >> np.uint64(1)) & _PAIR_MASK)


def _in_cells(batches):
    """A row for each cell that a fingerprint stands in (own) or looks into."""
    for batch in batches:
        if not batch.num_rows:
            continue
        fp = batch.column("fp").to_numpy().view(np.uint64)
        node = batch.column("node").to_numpy()
        both = embedding(fp)
        for half in range(2):
            grid = (both >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
            cells, rows, own = [grid], [np.arange(len(fp))], [np.ones(len(fp), bool)]
            for segment in range(16):
                step = np.uint64(1 << (2 * segment))
                can = np.flatnonzero((grid >> np.uint64(2 * segment)) & np.uint64(3) < 2)
                cells.append(grid[can] + step)
                rows.append(can)
                own.append(np.zeros(len(can), bool))
            cell, row = np.concatenate(cells) | np.uint64(half << 32), np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(np.concatenate(own)), pa.array(fp[row].view(np.int64)), pa.array(node[row])], ["cell", "own", "fp", "node"])


def _near(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MOST_BITS


def _dense(fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among many fingerprints.

    From a seed, everything within reach is taken out of the rest, then serves
    as a seed itself; what is taken is never compared again.  Over 4096, they are
    first dealt by each 16-bit quarter: of four, one is equal in both.
    """
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(fp) > 4096:
        for quarter in range(4):
            key = (fp >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for part in np.split(order, cuts):
                if 1 < len(part):
                    x, y = _spread(fp[part], node[part])
                    a.append(x)
                    b.append(y)
        return local_forest(np.concatenate(a), np.concatenate(b))
    return _spread(fp, node)


def _spread(fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(fp) > 1:
        seeds, fp, node = [(fp[0], node[0])], fp[1:], node[1:]
        while seeds and len(fp):
            f, n = seeds.pop()
            hit = _near(fp, f)
            if hit.any():
                a.append(node[hit])
                b.append(np.full(len(a[-1]), n))
                seeds += zip(fp[hit], node[hit], strict=True)
                fp, node = fp[~hit], node[~hit]
    return np.concatenate(a), np.concatenate(b)


def _links(cell: np.ndarray, own: np.ndarray, fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within whole cells (rows sorted by cell)."""
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(first, len(cell)))
    owners = np.add.reduceat(own.astype(np.int64), first)
    a, b = [], []
    use = (size > 1) & (owners > 0)
    for f, n in zip(first[use & (size > _SMALL_CELL)].tolist(), size[use & (size > _SMALL_CELL)].tolist(), strict=True):
        x, y = _dense(fp[f : f + n], node[f : f + n])
        a.append(x)
        b.append(y)
    small = use & (size <= _SMALL_CELL)
    # Each owner of a small cell against the others of it.
    of = np.repeat(np.flatnonzero(small), size[small])
    row = np.flatnonzero(np.repeat(small, size))
    of, row = of[own[row]], row[own[row]]
    left = np.repeat(row, size[of])
    right = np.arange(len(left)) - np.repeat(np.cumsum(size[of]) - size[of], size[of]) + np.repeat(first[of], size[of])
    hit = (left != right) & _near(fp[left], fp[right])
    a.append(node[left[hit]])
    b.append(node[right[hit]])
    a, b = np.concatenate(a), np.concatenate(b)
    return local_forest(a[a != b], b[a != b])


def _in_cell_links(batches, rows: int = 20_000):
    """Links of the cells of a sorted partition, some whole cells at a time."""
    held: list[tuple] = []

    def out(parts, last):
        c, o, f, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        stop = len(c) if last else int(np.searchsorted(c, c[-1]))
        a, b = _links(c[:stop], o[:stop], f[:stop], n[:stop]) if stop else (n[:0], n[:0])
        return (a, b), (c[stop:], o[stop:], f[stop:], n[stop:])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column("cell").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy().view(np.uint64), batch.column("node").to_numpy()))
        if sum(len(x[0]) for x in held) >= rows:
            (a, b), rest = out(held, False)
            rows = max(rows, 2 * len(rest[0]))
            held = [rest]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    if held:
        a, b = out(held, True)[0]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links_of(prints: DataFrame) -> DataFrame:
    """Links (a, b) of distinct fingerprints."""
    # Nodes are fingerprints, as signed numbers.
    nodes = prints.select("fp", F.col("fp").alias("node"))
    spread = nodes.mapInArrow(_in_cells, "cell long, own boolean, fp long, node long").repartition(partitions(prints.sparkSession), "cell").sortWithinPartitions("cell")
    return spread.mapInArrow(_in_cell_links, "a long, b long")


def roots(prints: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(fp, n, lead) of every distinct fingerprint: its number of rows, and the
    first row (no_id, doc_id, tie, fp) that is reachable over links."""
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min(F.struct("no_id", "doc_id", "tie", "fp")).alias("lead"), F.count("*").alias("n")))
    linked = components(links_of(distinct) if links is None else links)
    placed = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "n", "lead", F.coalesce("root", "fp").alias("root"))
    best = placed.groupBy("root").agg(F.min("lead").alias("best"))
    return placed.join(best, "root").select("fp", "n", F.col("best").alias("lead"))


def near_duplicates(docs: DataFrame, shingle: int = 3, share: int = SHARE) -> DataFrame:
    """Fingerprint and component of every document.

    Fingerprints that differ in at most 3 bits are linked; component_id is the
    smallest doc_id reachable.  Texts without words (null, empty) have
    fingerprint zero, linked like any other.  Repeated rows are rows of their
    own with one fingerprint.  Null ids count as the largest and stay null.
    Other columns are not read; an empty table gives no rows.

    Rows of a fingerprint that has over ``share`` of them meet in several tasks.
    """
    prints = cut_lineage(with_fingerprints(docs, shingle))
    found = cut_lineage(roots(prints))
    # At most a row per ``share`` rows of the input.
    hot = F.broadcast(found.where(F.col("n") > share).select("fp", F.ceil(F.col("n") / share).alias("parts")))
    parts = F.coalesce("parts", F.lit(1)).cast("int")
    left = prints.join(hot, "fp", "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), parts).cast("int"))
    right = found.join(hot, "fp", "left").select("fp", "lead", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    both = left.join(right, ["fp", "part"])
    back = lambda none, i: F.when(~F.col(none), F.col(i))
    return both.select(back("no_id", "doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), back("lead.no_id", "lead.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs``, all columns, with one row of each component: that with the smallest doc_id.

    Texts without words are one component, linked like any other; null ids
    count as the largest; of rows that share the id, the one whose text has the
    smallest hash is kept, and of equal rows one.  Columns may have any names; an
    empty table gives no rows.
    """
    prints = cut_lineage(with_fingerprints(docs, shingle))
    return keep_leads(docs, roots(prints))


def keep_leads(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that lead their components, once each."""
    best = found.select("lead.no_id", "lead.doc_id", "lead.tie").distinct()
    # The whole row is one column, so no name of it can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    doc_id = F.col("row.doc_id").cast("long")
    rows = rows.select("row", doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(LAST_ID)).alias("doc_id"), F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("tie"))
    # Equal rows are combined in the tasks that read them, so a hot one meets nowhere whole.
    keys = ["no_id", "doc_id", "tie"]
    return rows.join(best, keys, "left_semi").groupBy(*keys).agg(F.first("row").alias("row")).select("row.*")
