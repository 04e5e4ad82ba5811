"""Near-duplicates by SimHash, verified by the exact Jaccard similarity of their word shingles.

SimHash comes first: fingerprints that the grid of ``simhash`` finds within 3 bits
are candidates, and links where the whole sets have the similarity.  No radius of 64
bits holds all pairs of that similarity, so a prefix filter adds the pairs that
SimHash has not joined.

Two sets of similarity 4/5 or more, each written in one order common to all,
share one of their first n - ceil(4n/5) + 1 elements.  So each distinct set
stands in the cells of those elements, and what meets in a cell and can still
reach the similarity by size and position is verified: first on sketches, which
bound the overlap from above, then on the whole sets.  Every pair is found.
Elements that a sample shows to be frequent come last in the order, which makes
cells small and changes no result.

A cell of many sets first sends pairs with a few seeds only.  When these are
linked, its sets outside the largest component are compared with all sets of the
cell, in blocks of bounded size, and each block sends a forest of its links: a large
group of near copies makes no quadratic output, no task holds a group, and no link
is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextBlock, block_of, cut_lineage, groups_of, mix, partitions, rolling, runs, sums_by, text_or_empty
from .components import components, local_forest
from .simhash import keep_leads, links_of, prints_of, roots, rows_of

SHINGLE = 5
#: Bytes of text that are hashed at once.
_BLOCK = 2 << 20
#: Cells of up to so many sets send all pairs at once; larger ones begin with so many seeds.
SMALL_CELL, _SEEDS = 16, 3
#: The order of elements follows about so many documents, and at most so many frequent elements.
_SAMPLE, _FREQUENT = 4000, 200_000
#: Sets of a large cell that are compared at once, and those outside its largest component beside them.
_ROWS, _PIVOTS = 1024, 256
#: So many ids at most are broadcast to pick documents.
_BROADCAST = 1_000_000
_TOP = np.uint64(1 << 63)


def _need(n, m):
    """Least overlap of sets of n and m elements with a similarity of 4/5: 9 times it is at least 4 (n + m)."""
    return (4 * (n + m) + 8) // 9


def shingle_sets(block: TextBlock, shingle: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text, and their offsets.

    Shingles are 63-bit hashes of lower-cased (A-Z) words; a text of fewer words
    is one shingle.  Those in ``frequent`` are 2**63 plus their place there.
    """
    block = block.lowered()
    starts, ends, offsets = block.words()
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(block.n + 1, np.int64)
    words = np.diff(offsets)
    of, begin = groups_of(offsets), np.arange(len(starts))
    first, last = offsets[of], offsets[of + 1]
    use = (begin + shingle <= last) | (begin == first)
    begin, of = begin[use], of[use]
    length = np.minimum(shingle, words[of])
    h = mix(rolling(block.word_hashes(starts, ends))(begin, begin + length) + length.astype(np.uint64)) >> np.uint64(1)
    if len(frequent):
        order = np.argsort(frequent)
        at = np.minimum(np.searchsorted(frequent[order], h), len(frequent) - 1)
        place = order[at]
        h = np.where(frequent[place] == h, _TOP + place.astype(np.uint64), h)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
    return h[new], np.searchsorted(of[new], np.arange(block.n + 1))


def nodes_of(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; the empty set is zero."""
    n = np.diff(offsets).astype(np.uint64)
    return np.where(n == 0, np.uint64(0), mix(sums_by(mix(values ^ np.uint64(0x9E3779B97F4A7C15)), offsets) + n)).view(np.int64)


def _prefixes(node: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Element, node, size and place of the first elements of each distinct set."""
    _, some = np.unique(node, return_index=True)
    n = np.diff(offsets)[some]
    some, n = some[n > 0], n[n > 0]
    long = n - (4 * n + 4) // 5 + 1
    row = np.repeat(np.arange(len(some)), long)
    place = np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long)
    return values[offsets[some][row] + place], node[some][row], n[row], place


def _messages(values, node, n, place, buckets: int) -> pa.RecordBatch:
    """The rows of each bucket as one binary value: nodes, low halves of the hashed elements, sizes, places (capped, which keeps more)."""
    m = mix(values)
    bucket = ((m >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    parts = np.split(order, cuts) if len(order) else []
    key, n, place = m.astype(np.uint32), n.astype(np.uint32), np.minimum(place, 65535).astype(np.uint16)
    packed = [b"".join(x[p].tobytes() for x in (node, key, n, place)) for p in parts]
    return pa.RecordBatch.from_arrays([pa.array([bucket[p[0]] for p in parts], pa.int64()), pa.array(packed, pa.binary())], ["bucket", "payload"])


def _opened(payload: bytes) -> tuple[np.ndarray, ...]:
    k = len(payload) // 18
    at = np.cumsum([0, 8 * k, 4 * k, 4 * k])
    return tuple(np.frombuffer(payload, t, k, a) for t, a in zip((np.int64, np.uint32, np.uint32, np.uint16), at.tolist(), strict=True))


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])[: len(low)]
    return low[new], high[new]


def cell_pairs(node: np.ndarray, key: np.ndarray, n: np.ndarray, place: np.ndarray, small: int = SMALL_CELL) -> tuple[tuple, tuple]:
    """Pairs (a, b) to verify, and the rows (key, node, n, rest) of large cells.

    ``rest`` is the number of elements from this one on: sets of which this is
    the first common element share no more than the smaller rest.
    """
    order = np.lexsort((place, node, key))
    key, node, n, place = key[order], node[order], n[order].astype(np.int64), place[order].astype(np.int64)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])[: len(key)]
    key, node, n, rest = key[new], node[new], n[new], (n - place)[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    size = np.diff(np.append(first, len(key)))
    a, b = [], []

    def add(x, y):
        can = np.minimum(rest[x], rest[y]) >= _need(n[x], n[y])
        a.append(node[x[can]])
        b.append(node[y[can]])

    # Each row of a small cell with those after it.
    of = np.repeat(np.arange(len(first)), size)
    row = np.flatnonzero((size[of] > 1) & (size[of] <= small))
    after = (first + size)[of[row]] - row - 1
    left = np.repeat(row, after)
    add(left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after))
    large = np.flatnonzero(size > small)
    for f, s in zip(first[large].tolist(), size[large].tolist(), strict=True):
        rows = np.arange(f, f + s)
        for seed in range(_SEEDS):
            best = f + int(np.argmin(mix(node[f : f + s].view(np.uint64) ^ np.uint64(seed + 1))))
            others = rows[rows != best]
            add(np.full(len(others), best), others)
    pairs = _distinct(np.concatenate(a), np.concatenate(b))
    row = np.flatnonzero(size[of] > small)
    return pairs, (key[row], node[row], n[row], rest[row])


def sketches(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """How many elements of each set fall into each of 64 or more hash classes (a power of two, four elements a class or fewer).

    Empty where a class holds more than a byte can say.
    """
    n = np.diff(offsets)
    width = 1 << np.ceil(np.log2(np.maximum(64, n / 4))).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(width)])
    of = groups_of(offsets)
    count = np.bincount(at[of] + (mix(values) & (width[of] - 1).astype(np.uint64)).astype(np.int64), minlength=at[-1])
    over = np.add.reduceat(count > 255, at[:-1]) if len(n) else n
    small = count.astype(np.uint8)
    return [b"" if o else small[a:b].tobytes() for o, a, b in zip(over.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]


def may_be_similar(a: bytes, b: bytes) -> bool:
    """False only if sets of these sketches have a Jaccard similarity below 4/5."""
    if not a or not b:
        return True
    x, y = (np.frombuffer(s, np.uint8).astype(np.int64).reshape(-1, min(len(a), len(b))).sum(0) for s in (a, b))
    return int(np.minimum(x, y).sum()) >= _need(int(x.sum()), int(y.sum()))


def similar(a: bytes, b: bytes) -> bool:
    """Whether two sorted sets of 64-bit numbers have a Jaccard similarity of 4/5 or more."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1])) >= _need(len(x), len(y))


def _fold(sketch: list, width: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of at least ``w`` classes brought to ``w``, and where each of them is."""
    rows = np.flatnonzero(width >= w)
    out = np.array([np.frombuffer(sketch[k], np.uint8).reshape(-1, w).sum(0, dtype=np.int32) for k in rows]) if len(rows) else np.zeros((0, w), np.int32)
    return np.searchsorted(rows, np.arange(len(width))), out


def cross_rows(rows: tuple, pivots: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Which rows may be similar to a pivot of another component, and which pivots to a row; each given as sizes, rests, components, sketches."""
    (n, rest, root, sketch), (m, left, other, mark) = rows, pivots
    keep, keep_pivots = np.zeros(len(n), bool), np.zeros(len(m), bool)
    width, width_p = np.array([len(x) for x in sketch]), np.array([len(x) for x in mark])
    folded: dict[int, tuple] = {}
    for i in range(len(m)):
        able = np.flatnonzero((root != other[i]) & (np.minimum(rest, left[i]) >= _need(n, m[i])))
        level = np.minimum(width[able], width_p[i])
        for w in np.unique(level).tolist():
            some = able[level == w]
            if w:
                if w not in folded:
                    folded[w] = _fold(sketch, width, w)
                row, x = folded[w]
                mine = np.frombuffer(mark[i], np.uint8).reshape(-1, w).sum(0, dtype=np.int32)
                some = some[np.minimum(x[row[some]], mine).sum(1) >= _need(n[some], m[i])]
            keep[some] = True
            keep_pivots[i] |= len(some) > 0
    return keep, keep_pivots


def cross_links(rows: tuple, pivots: tuple) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between rows and pivots of other components; each given as nodes, components, sets."""
    (node, root, sets), (pivot, other, mine) = rows, pivots
    sets = [np.frombuffer(x, np.uint64) for x in sets]
    n = np.array([len(x) for x in sets])
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    cuts = np.cumsum(n) - n
    full = n > 0
    for i, own in enumerate(mine):
        own = np.frombuffer(own, np.uint64)
        at = np.minimum(np.searchsorted(own, flat), max(len(own) - 1, 0))
        both = np.zeros(len(n), np.int64)
        if len(flat) and len(own):
            both[full] = np.add.reduceat(own[at] == flat, cuts[full], dtype=np.int64)
        hit = np.flatnonzero((root != other[i]) & (both >= _need(n, len(own))))
        a.append(np.full(len(hit), pivot[i]))
        b.append(node[hit])
    return local_forest(np.concatenate(a), np.concatenate(b))


def in_blocks(rows: DataFrame, key: str, f, schema: str, most_rows: int, most_pivots: int) -> DataFrame:
    """``f`` on the rows of each group of ``key`` and its pivots, those outside the group's most frequent component
    (``root``), in blocks of about so many: no task holds a whole group, however large."""
    per = rows.groupBy(key, "root").agg(F.count("*").alias("c"))
    main = per.groupBy(key).agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("all"))
    main = main.select(key, F.col("main.root").alias("most_of"), F.ceil(F.col("all") / most_rows).cast("int").alias("row_blocks"), F.ceil((F.col("all") - F.col("main.c")) / most_pivots).cast("int").alias("pivot_blocks"))
    x = rows.join(main.where("pivot_blocks > 0"), key)
    block = lambda many: F.pmod(F.xxhash64("node"), F.col(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    left = x.withColumn("row_block", block("row_blocks")).withColumn("pivot_block", every("pivot_blocks"))
    right = x.where("root != most_of").withColumn("pivot_block", block("pivot_blocks")).withColumn("row_block", every("row_blocks"))
    by = [key, "row_block", "pivot_block"]
    return left.groupBy(*by).cogroup(right.toDF(*right.columns).groupBy(*by)).applyInArrow(f, schema)


def simhash_pairs(prints: DataFrame) -> DataFrame:
    """(a, b): pairs of sets (``fp``) that join all whose SimHash fingerprints (``bits``) are linked, directly or over others."""
    both = cut_lineage(prints.select(F.col("fp").alias("node"), "bits").distinct())
    first = cut_lineage(both.groupBy("bits").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    same = both.join(first.where("n > 1"), "bits").select(F.col("first").alias("a"), F.col("node").alias("b"))
    of = lambda end, name: first.select(F.col("bits").alias(end), F.col("first").alias(name))
    near = links_of(first.select(F.col("bits").alias("fp"))).toDF("x", "y").distinct()
    near = near.join(of("x", "a"), "x").join(of("y", "b"), "y").select("a", "b")
    pairs = same.unionByName(near).where("a != b")
    return cut_lineage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _passing(pairs: DataFrame, values: DataFrame, test) -> DataFrame:
    """The pairs (a, b) whose two ``values`` (node, value) pass the test."""

    def go(batches):
        for batch in batches:
            hit = [test(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("left"), batch.column("right"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    x = pairs.join(values.select(F.col("node").alias("b"), F.col("value").alias("right")), "b").join(values.select(F.col("node").alias("a"), F.col("value").alias("left")), "a")
    return cut_lineage(x.select("a", "b", "left", "right").mapInArrow(go, "a long, b long"))


def _frequent(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles of three or more documents of a sample, the rarest first."""
    step = max(1, docs.count() // _SAMPLE)
    some = docs.select(text_or_empty().alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).distinct()

    def go(batches):
        for batch in runs(batches):
            values, _ = shingle_sets(block_of(batch.column("text")), shingle, np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], ["h"])

    top = some.mapInArrow(go, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(_FREQUENT).toArrow()
    return top.column("h").to_numpy()[::-1].astype(np.uint64)


def links(docs: DataFrame, prints: DataFrame, frequent, shingle: int, small: int) -> DataFrame:
    """(a, b): links that join all sets of a similarity of 4/5 or more into their components: those that SimHash finds, then
    those of the prefix filter between what these leave apart."""
    buckets = partitions(docs.sparkSession)

    def hashed(batches):
        for batch in runs(batches, most=_BLOCK):
            values, offsets = shingle_sets(block_of(batch.column("text")), shingle, frequent.value)
            yield _messages(*_prefixes(nodes_of(values, offsets), values, offsets), buckets)

    def met(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        (a, b), (key, node, n, rest) = cell_pairs(*(np.concatenate(x) for x in zip(*map(_opened, table.column("payload").to_pylist()), strict=True)), small)
        none = lambda k: pa.nulls(k, pa.int64())
        pairs = pa.table([none(len(a)), pa.array(a), pa.array(b), none(len(a)), none(len(a))], ["cell", "a", "b", "n", "rest"])
        rows = pa.table([pa.array(key.astype(np.int64) | bucket << 32), pa.array(node), none(len(node)), pa.array(n), pa.array(rest)], ["cell", "a", "b", "n", "rest"])
        return pa.concat_tables([pairs, rows])

    def crossed(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        parts = [tuple(t.column(c).to_numpy() for c in ("n", "rest", "root")) + ([x.as_buffer() for x in t.column("value")],) for t in (rows, pivots)]
        return pa.concat_tables([t.select(["most_of", "node", "root"]).filter(pa.array(k)) for t, k in zip((rows, pivots), cross_rows(*parts), strict=True)])

    def linked_across(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        parts = [(t.column("node").to_numpy(), t.column("root").to_numpy(), [x.as_buffer() for x in t.column("value")]) for t in (rows, pivots)]
        return pa.table(dict(zip(("a", "b"), cross_links(*parts), strict=True)))

    def members(batches):
        for batch in runs(batches):
            values, offsets = shingle_sets(block_of(batch.column("text")), shingle, frequent.value)
            sets = [values[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes_of(values, offsets)), pa.array(sets, pa.binary())], ["node", "value"])

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(node, value) of some nodes, each from one of its documents."""
        ids = cut_lineage(sketched.join(wanted.distinct(), "node", "left_semi").select("doc_id").distinct())
        ids = F.broadcast(ids) if ids.count() <= _BROADCAST else ids
        sets = texts.join(ids, "doc_id", "left_semi").select("text").mapInArrow(members, "node long, value binary")
        return cut_lineage(sets.dropDuplicates(["node"]) if twice else sets)

    texts = rows_of(docs).select("doc_id", "text")
    twice = prints.groupBy("doc_id").count().where("count > 1").limit(1).count()
    sketched = cut_lineage(prints.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("value")))
    found = cut_lineage(texts.select("text").mapInArrow(hashed, "bucket long, payload binary").groupBy("bucket").applyInArrow(met, "cell long, a long, b long, n long, rest long"))
    cells = found.where("cell is not null")
    near = _passing(simhash_pairs(prints), sketched.select("node", "value"), may_be_similar)
    pairs = _passing(found.where("cell is null").select("a", "b").distinct(), sketched.select("node", "value"), may_be_similar)
    sets = sets_of(near.unionByName(pairs).select(F.explode(F.array("a", "b")).alias("node")))
    joined = cut_lineage(components(_passing(near, sets, similar)))
    at = lambda end, name: joined.select(F.col("node").alias(end), F.col("root").alias(name))
    rest = pairs.join(at("a", "x"), "a", "left").join(at("b", "y"), "b", "left").where("coalesce(x, a) != coalesce(y, b)").select("a", "b")
    linked = at("a", "b").unionByName(_passing(rest, sets, similar))
    if not cells.limit(1).count():
        return linked
    root = components(linked)
    rows = cells.select("cell", F.col("a").alias("node"), "n", "rest").join(root, "node", "left").withColumn("root", F.coalesce("root", "node")).join(sketched.select("node", "value"), "node")
    # Cells of one large component become one group, so that a set goes there once.
    rows = cut_lineage(in_blocks(cut_lineage(rows), "cell", crossed, "most_of long, node long, root long", _ROWS, _PIVOTS).distinct())
    rows = rows.withColumnRenamed("most_of", "most").join(sets_of(rows.select("node")), "node")
    across = in_blocks(rows, "most", linked_across, "a long, b long", _ROWS, _PIVOTS)
    return linked.unionByName(cut_lineage(across))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, small: int = SMALL_CELL) -> DataFrame:
    """``docs``, all columns, with one row of each component: that with the smallest doc_id.

    Texts are linked if the sets of their shingles of ``shingle`` words have a
    Jaccard similarity of 0.8 or more, whether SimHash (fingerprints as in
    ``simhash.near_duplicates``) or the prefix filter finds them; texts without words (null, empty) are one
    group.  Null ids count as the largest; of rows that share the id, the one
    whose text has the smallest hash is kept, and of equal rows one.  Columns may
    have any names; an empty table gives no rows.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, shingle))

    def go(batches):
        for batch in runs(batches, most=_BLOCK):
            block = block_of(batch.column("text"))
            sets = shingle_sets(block, shingle, frequent.value)
            keys = [batch.column(c) for c in ("no_id", "doc_id", "tie")]
            found = [pa.array(nodes_of(*sets)), pa.array(sketches(*sets), pa.binary()), pa.array(prints_of(block))]
            yield pa.RecordBatch.from_arrays([*keys, *found], ["no_id", "doc_id", "tie", "fp", "sketch", "bits"])

    prints = cut_lineage(rows_of(docs).mapInArrow(go, "no_id boolean, doc_id long, tie long, fp long, sketch binary, bits long"))
    return keep_leads(docs, roots(prints, links(docs, prints, frequent, shingle, small)))
