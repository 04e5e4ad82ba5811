"""Document fingerprints by winnowing, in DataFrame functions only.

The grams of a text are the Rabin-Karp hashes of each ``k`` consecutive
lower-cased words (fewer words: the whole text is one gram): polynomials modulo a
prime.  SQL arrays have no running state, so the roll goes over all places at
once: the hash of n words is that of the first m, shifted, plus that of the other
n - m, which is the same array m places further.  Of each ``window``
consecutive grams the smallest is kept, the rightmost of equal ones; kept grams
carry their position and 30 more bits, from a second polynomial.  Two texts that
share ``k + window - 1`` consecutive words share a kept gram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, text_or_empty

#: In the search for the smallest, a gram is one positive number: its hash, then its
#: place counted down from here, so that of equal hashes the one further right is smaller.
_PLACES = (1 << 31) - 1
#: Primes and bases of the two polynomials; five products of the second fit into a long.
_PRIME, _BASE = (1 << 31) - 1, 1_103_515_245
_PRIME2, _BASE2, _BITS2 = (1 << 30) - 35, 40_692_011, 30
#: Cells of neighbouring ids for each shuffle partition, and the fewest rows worth one.
_CELLS, _CELL_ROWS = 16, 64


def _rolled(df: DataFrame, words: str, out: str, n: int, done: dict[int, str]) -> tuple[DataFrame, str]:
    """``df`` with the hashes of ``n`` words from each place of ``words`` on, and the name of that column."""
    if n in done:
        return df, done[n]
    m = 1 << ((n - 1).bit_length() - 1)  # the largest power of two below n
    df, left = _rolled(df, words, out, m, done)
    df, right = _rolled(df, words, out, n - m, done)
    shift = pow(_BASE, n - m, _PRIME)
    rest = lambda i: F.coalesce(F.get(F.col(right), i + m), F.lit(0))
    done[n] = f"{out}_{n}"
    return df.withColumn(done[n], F.transform(left, lambda x, i: (F.pmod(x, F.lit(_PRIME)) * shift + F.pmod(rest(i), F.lit(_PRIME))) % _PRIME)), done[n]


def _second(words: str, k: int) -> Callable[[Column], Column]:
    """The second polynomial of the ``k`` words from a place on."""

    def at(i: Column) -> Column:
        total = F.lit(0).cast("long")
        # At least two terms: the optimizer would put a column that is named once in a lambda there, and work it out for every place.
        for j in range(max(k, 2)):
            if j and j % 5 == 0:
                total = total % _PRIME2
            power = pow(_BASE2, k - 1 - j, _PRIME2) if j < k else 0
            total = total + F.pmod(F.coalesce(F.get(F.col(words), i + j), F.lit(0)), F.lit(_PRIME2)) * power
        return total % _PRIME2

    return at


def _least_of_two(name: str, apart: int) -> Column:
    return F.transform(name, lambda x, i: F.least(x, F.get(F.col(name), i + apart)))


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = 5, window: int = 8) -> DataFrame:
    """``df`` with ``out_h`` and ``out_at``: hashes (61 bits) and places of the kept grams of the column ``text``, in order of place."""
    words, least = f"{out}_words", f"{out}_least"
    kept_columns = list(df.columns)
    blank = " \t\n\u000b\u000c\r"
    df = df.withColumn(words, F.btrim(F.lower(text), F.lit(blank)))
    df = df.withColumn(words, F.when(F.col(words) == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(words, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))))
    df, grams = _rolled(df, words, out, k, {1: words})
    n = F.size(words)
    number = F.greatest(n - (k - 1), F.least(n, F.lit(1)))
    df = df.withColumn(least, F.transform(F.slice(grams, F.lit(1), number), lambda x, i: x * (_PLACES + 1) + (_PLACES - i)))
    width = 1
    while width < window:
        step = min(width, window - width)
        df = df.withColumn(least, _least_of_two(least, step))
        width += step
    m = F.size(least)
    df = df.withColumn(least, F.array_distinct(F.slice(least, F.lit(1), F.greatest(m - (window - 1), F.least(m, F.lit(1))))))
    df = df.withColumn(f"{out}_at", F.transform(least, lambda x: (F.lit(_PLACES) - x.bitwiseAND(F.lit(_PLACES))).cast("int")))
    second = _second(words, k)
    df = df.withColumn(f"{out}_h", F.zip_with(least, f"{out}_at", lambda x, at: F.shiftright(x, 31) * (1 << _BITS2) + second(at)))
    return df.select(*kept_columns, f"{out}_h", f"{out}_at")


def as_text(out: str) -> Column:
    """``hash@place`` of each kept gram, hashes in hexadecimal, blank-separated."""
    one = lambda h, at: F.concat(F.hex(h), F.lit("@"), at.cast("string"))
    return F.lower(F.array_join(F.zip_with(f"{out}_h", f"{out}_at", one), " "))


def likeness(a: str, b: str) -> Column:
    """Share of the distinct hashes of either that both have; 1 where neither has any."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _longs(values: list[int]) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def with_cells(docs: DataFrame, cells: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text) with ``tie``, a hash of the text, and ``cell``: rows go by descending
    doc_id, null ids last, then by tie; cells are runs of that order, numbered along it.

    The cuts are quantiles of the ids.  An id that stands at several of them, and
    null ids, have that many cells of their own, by their ties; only equal rows
    cannot be parted.
    """
    cells = cells or _CELLS * partitions(docs.sparkSession)
    stats = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    cells = max(1, min(cells, stats.n // _CELL_ROWS))
    points = [i / cells for i in range(1, cells)]
    found = docs.agg(F.percentile_approx("doc_id", points, max(1000, 20 * cells)).alias("p")).first().p or [] if points and stats.ids else []
    cuts = sorted(set(found))
    times = Counter(found)
    many = [times[c] + 1 if times[c] > 1 else 1 for c in cuts]
    no_ids = max(1, -(-(stats.n - stats.ids) * cells // max(1, stats.n)))
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    of_cuts, doc_id = _longs(cuts), F.col("doc_id")
    # How many cuts are at or below the id, by binary search.
    below = F.aggregate(_longs(steps), F.lit(0).cast("long"), lambda low, s: F.when(F.get(of_cuts, (low + s - 1).cast("int")) <= doc_id, low + s).otherwise(low)) if cuts else F.lit(0).cast("long")
    docs = docs.withColumns({"tie": F.xxhash64("text"), "cell_below": below})
    last = (F.col("cell_below") - 1).cast("int")
    own = (F.get(of_cuts, last) == doc_id) & (F.get(_longs(many), last) > 1)
    parts = F.when(doc_id.isNull(), F.lit(no_ids)).when(own, F.get(_longs(many), last)).otherwise(F.lit(1))
    place = F.when(doc_id.isNull(), F.lit(2 * len(cuts) + 2)).otherwise(2 * (F.lit(len(cuts)) - F.col("cell_below")) + F.coalesce(own, F.lit(False)).cast("int"))
    # Ties in order, as 31 bits without a sign.
    tie = F.shiftrightunsigned(F.col("tie").bitwiseXOR(F.lit(-(1 << 63))), 33)
    return docs.withColumn("cell", place.cast("long") * (1 << 32) + F.shiftright(tie * parts.cast("long"), 31)).drop("cell_below")


def next_in_descending_order(docs: DataFrame, columns: list[str], keyed: DataFrame) -> DataFrame:
    """``docs`` with ``next_<c>`` of each of ``columns``: its value in the next
    row by descending doc_id, ties by text; after the last row comes the first.

    Rows are dealt by cell (``keyed``: the rows with nothing but doc_id, tie and cell).
    The row that heads a cell also goes to the cell before, as a guest, so no global
    sort is needed.
    """
    heads = keyed.groupBy("cell").agg(F.max(F.struct("doc_id", F.bitwise_not("tie").alias("tie"))).alias("head"))
    # A row for each cell, a fixed number for each shuffle partition.
    along = Window.orderBy("cell")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("cell").over(along), F.last("cell").over(whole))
    heads = heads.select(F.col("cell").alias("head_cell"), before.alias("before"), F.col("head.doc_id").alias("head_id"), F.bitwise_not("head.tie").alias("head_tie"))
    is_head = (F.col("cell") == F.col("head_cell")) & F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    both = docs.join(F.broadcast(heads), is_head, "left").drop("head_cell", "head_id", "head_tie")
    stands = F.when(F.col("before").isNull(), F.array(F.struct("cell", F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct("cell", F.lit(0).alias("guest")), F.struct(F.col("before").alias("cell"), F.lit(1).alias("guest")))
    )
    both = both.withColumn("stand", F.explode(stands)).drop("cell", "before").select("*", "stand.*").drop("stand")
    order = Window.partitionBy("cell").orderBy("guest", F.desc_nulls_last("doc_id"), "tie", "text")
    ahead = both.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return ahead.where("guest = 0").drop("guest", "cell", "tie")


def edited_fingerprints(docs: DataFrame, k: int = 5, window: int = 8) -> DataFrame:
    """Fingerprints of each text, and of the text with its last third replaced
    by the beginning of the next text in descending order of doc_id.

    Null texts are empty.  Empty texts have an empty fingerprint, alike (1.0)
    only to another empty one.  Null ids come last.  Rows that share an id go by a
    hash of the text, then by the text; equal rows are rows of their own.  Other
    columns are ignored; an empty table gives no rows.
    """
    base = with_cells(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    near = next_in_descending_order(with_fingerprint(base, "text", "kept", k, window), ["text", "kept_h"], base)
    near = near.withColumn("n_chars", F.length("text").cast("long"))
    third = F.expr("cast(n_chars div 3 as int)")
    near = near.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)))
    near = with_fingerprint(near.drop("text", "next_text"), "edited", "edited_kept", k, window)
    return near.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text("kept").alias("fingerprint"),
        as_text("edited_kept").alias("edited_fingerprint"),
        likeness("kept_h", "edited_kept_h").alias("near_edited"),
        likeness("kept_h", "next_kept_h").alias("near_next"),
    )
