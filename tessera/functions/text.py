"""Text scalars: choice parsing, option rules, query texts, names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("A", "B", "C", "D", "E")
#: Answers that are refusals.
REFUSALS = (
    "Sorry, I can't help with images of people yet.",
    "I can't process this file.",
    "I'm sorry, but without the image provided",
    "Cannot determine the answer",
)
API_FAILURE = "Failed to obtain answer via API"
_PUNCTUATION = ".()[],:;!*#{}"


def parse_choice(text: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """STRUCT<label, status>: the choice that a free answer names.

    Two different standalone labels together with "or" or "/" are ambiguous.  Else the first
    of three patterns that matches decides ("answer: X", X alone, "option X"), else
    the last standalone label.  Different labels of one pattern are ambiguous.
    """
    one = "|".join(re.escape(x.upper()) for x in labels)
    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""))
    found = lambda p: F.transform(F.regexp_extract_all(s, F.lit(p), F.lit(1)), lambda x: F.upper(x))
    # The patterns of an answer.
    alone = found(rf"(?<![A-Za-z])({one})(?![A-Za-z])")
    p1 = found(rf"(?iU)(?:final\s+answer|answer|the\s+answer\s+is)\s*[:：]?\s*\(?\s*({one})\s*\)?\b")
    p2 = found(rf"(?U)^\(?\s*({one})\s*\)?[.。\s]*$")
    p3 = found(rf"(?iU)\boption\s*\(?\s*({one})\s*\)?\b")
    last = F.when(F.size(alone) > 0, F.slice(alone, -1, 1)).otherwise(alone)
    hits = F.array_sort(F.array_distinct(F.when(F.size(p1) > 0, p1).when(F.size(p2) > 0, p2).when(F.size(p3) > 0, p3).otherwise(last)))
    several = F.array_sort(F.array_distinct(alone))
    unsure = (F.size(several) > 1) & s.rlike(r"(?iU)\bor\b|/")
    label = F.when(~unsure & (F.size(hits) == 1), F.element_at(hits, 1))
    status = F.when(unsure, F.concat(F.lit("ambiguous:"), F.array_join(several, ","))).when(F.size(hits) == 0, "no_valid_choice").when(F.size(hits) > 1, F.concat(F.lit("ambiguous:"), F.array_join(hits, ","))).otherwise("ok")
    return F.struct(label.alias("label"), status.alias("status"))


def infer_option(answer: Column, choices: Column) -> Column:
    """The option letter that stands as a word of the answer, "Z" for refusals, null if unclear.
    ``choices`` is MAP<letter, text>.  An "A" among more than three words is taken for the article."""
    words = F.filter(F.split(F.translate(answer, _PUNCTUATION, " " * len(_PUNCTUATION)), r"\s+"), lambda w: w != "")
    named = F.array_intersect(F.map_keys(choices), words)
    refused = F.lit(False)
    for r in REFUSALS:
        refused = refused | F.contains(answer, F.lit(r))
    article = F.array_contains(words, "A") & (F.size(words) > 3)
    rule = F.when((F.size(named) == 1) & ~article, F.element_at(named, 1)).when((F.size(named) == 0) & F.array_contains(words, "Z"), F.lit("Z"))
    return F.when(F.contains(answer, F.lit(API_FAILURE)), F.lit(None)).when(refused, F.lit("Z")).otherwise(rule)


def infer_text(answer: Column, choices: Column) -> Column:
    """The letter of the only choice whose text the answer contains, case aside."""
    held = F.filter(F.map_entries(choices), lambda e: F.contains(F.lower(answer), F.lower(e["value"])))
    return F.when(F.size(held) == 1, F.element_at(held, 1)["key"])


def infer(answer: Column, choices: Column) -> Column:
    return F.coalesce(infer_option(answer, choices), infer_text(answer, choices))


def choices_of(*options: Column) -> Column:
    """MAP<letter, text> of the options that are not null."""
    entries = F.array(*(F.struct(F.lit(chr(65 + i)).alias("key"), o.alias("value")) for i, o in enumerate(options)))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def options_text(choices: Column) -> Column:
    """"There are several options:" and a line per letter."""
    lines = F.transform(F.array_sort(F.map_entries(choices)), lambda e: F.concat(e["key"], F.lit(". "), e["value"], F.lit("\n")))
    return F.concat(F.lit("There are several options: \n"), F.array_join(lines, ""))


def query_text(question: Column, choices: Column) -> Column:
    """Question and options as one text, never the answer; empty parts are left out."""
    q = F.trim(F.coalesce(question, F.lit("")))
    lines = F.transform(F.array_sort(F.map_entries(choices)), lambda e: F.concat(F.lit("("), e["key"], F.lit(") "), e["value"]))
    parts = F.array(F.when(q != "", F.concat(F.lit("Question:\n"), q)), F.when(F.size(lines) > 0, F.concat(F.lit("Options:\n"), F.array_join(lines, "\n"))))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n")


def message_text(messages: Column, roles: tuple[str, ...] | None = None) -> Column:
    """Texts of messages ARRAY<STRUCT<role, text>>, in order, trimmed, blanks dropped, a line each;
    assistants' never, others' if their role is among ``roles`` (all if None)."""
    wanted = lambda m: (F.lower(m["role"]) != "assistant") & (F.lit(True) if roles is None else F.lower(m["role"]).isin(*roles))
    texts = F.transform(F.filter(messages, wanted), lambda m: F.trim(F.coalesce(m["text"], F.lit(""))))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


def after_reasoning(text: Column) -> Column:
    """What follows the last closing tag of a reasoning part."""
    return F.trim(F.substring_index(text, "</think>", -1))


def safe_name(text: Column) -> Column:
    """A name fit for files: other characters than letters, digits, dot, dash and underscore become underscores."""
    return F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_")


def safe_letters(text: Column) -> Column:
    """As ``safe_name``, but letters and digits of any script stay and every other character has its own underscore."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_.-]", "_")


def count_name(n: Column) -> Column:
    """The name of a token count."""
    return safe_name(n.cast("long").cast("string"))


def ratio_key(ratio: Column) -> Column:
    """0.2 as 0p2: no trailing zeros, p for the point."""
    return F.replace(F.regexp_replace(F.regexp_replace(F.format_string("%.6f", ratio), "0+$", ""), r"\.$", ".0"), F.lit("."), F.lit("p"))


def drop_name(ratio: Column) -> Column:
    """0.2 as drop_0p2000."""
    return F.concat(F.lit("drop_"), F.replace(F.format_string("%.4f", ratio), F.lit("."), F.lit("p")))


def numbers(csv: Column) -> Column:
    """The numbers of a comma-separated text, blanks left out."""
    return F.transform(F.filter(F.split(csv, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("double"))


def valid_labels(choices: Column) -> Column:
    """Sorted letters of the choices, or A to E without any."""
    keys = F.array_sort(F.map_keys(choices))
    return F.when(F.size(keys) > 0, keys).otherwise(F.array(*map(F.lit, LABELS)))


def token_rows(texts: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """(…, ids, n) of the column ``text``: its token ids by the tokenizer file, filled with 0 to the longest of
    all rows, and how many are its own.  A text without tokens raises."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, LongType, StructType

    def encode(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for batch in batches:
            found = [e.ids for e in tokenizer.encode_batch([t or "" for t in batch.column("text").to_pylist()], add_special_tokens=False)]
            if any(not (t or "").strip() or not x for t, x in zip(batch.column("text").to_pylist(), found, strict=True)):
                raise ValueError("a query text has no tokens")
            yield batch.append_column(ids, pa.array(found, pa.list_(pa.int64())))

    schema = StructType([*texts.schema.fields]).add(ids, ArrayType(LongType()))
    x = texts.mapInArrow(encode, schema).withColumn("n", F.size(ids).cast("long"))
    longest = F.broadcast(x.agg(F.max("n").alias("longest_")))  # one row
    return x.crossJoin(longest).withColumn(ids, F.concat(ids, F.array_repeat(F.lit(0).cast("long"), (F.col("longest_") - F.col("n")).cast("int")))).drop("longest_")


def judge_prompt(question: Column, choices: Column, prediction: Column) -> Column:
    """A request to match a free answer with one option letter, Z for none."""
    return F.concat(
        F.lit("Match the answer below with the closest option of the question. Reply with the option's letter alone, or Z if no option fits.\nQuestion: "),
        question, F.lit("\n"), options_text(choices), F.lit("Answer: "), prediction, F.lit("\nLetter: "),
    )
