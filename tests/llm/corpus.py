"""A small corpus with copies, repeats, nulls, blanks, long texts and odd spaces."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, tessera string"


def corpus(seed: int = 5, n: int = 60) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    rows: list[tuple[int | None, str | None]] = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 25, 60, 200]))]
        if rows and rng.random() < 0.5:  # shares a passage with an earlier one
            other = (rows[rng.randrange(len(rows))][1] or "").split()
            at = rng.randrange(max(1, len(other)))
            words[5:5] = other[at : at + 45]
        rows.append((i * 3 + 1, "".join(w + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for w in words)))
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, None), (1003, ""), (1004, " \n\t"), (1005, "x " * 300), (1006, "one two"), (1007, "é\x1cü a\x85b"), (1008, " ".join(vocabulary * 30))]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    """As a table with extra columns, some of whose names operators use."""
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), "x", "y") for i, t in rows], SCHEMA).repartition(3)
