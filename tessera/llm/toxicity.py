"""Counterfactual-regularised toxicity classifier.

In each labelled sentence that names groups, each name is swapped for all others
of its kind and for none; the model pays for every difference between the scores of
the two sentences.  So names of groups get equal weights, near zero (among each other
alone they could all be high where only one of a kind was seen), and a neutral mention
does not make a text look toxic.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from . import classify

THRESHOLD = 0.5
#: Beginnings of words count as features too, so that inflected and compound forms of a stem support each other.
BEGINNINGS = (5, 6, 7, 8, 9)
TRAIN_ROWS = 12_000
L1 = 8.0
#: Names of groups in four languages, by kind; each may stand for the others of its kind.
IDENTITY_TERMS = tuple(
    tuple(kind.split())
    for kind in (
        "women men girls boys mothers fathers",
        "woman man girl boy mother father",
        "christian muslim jewish hindu buddhist atheist",
        "christians muslims jews hindus buddhists atheists",
        "black white asian latino african european",
        "gay straight lesbian bisexual transgender queer",
        "american mexican chinese russian german french",
        "immigrants refugees natives foreigners tourists",
        "old young elderly teenage",
        "deaf blind disabled autistic",
        "frauen männer mädchen jungen mütter väter",
        "christen muslime juden hindus buddhisten atheisten",
        "schwarze weiße asiaten afrikaner europäer",
        "schwule lesben heterosexuelle bisexuelle",
        "amerikaner mexikaner chinesen russen deutsche franzosen",
        "einwanderer flüchtlinge einheimische ausländer",
        "femmes hommes filles garçons mères pères",
        "chrétiens musulmans juifs hindous bouddhistes athées",
        "noirs blancs asiatiques africains européens",
        "homosexuels hétérosexuels lesbiennes bisexuels",
        "américains mexicains chinois russes allemands français",
        "immigrés réfugiés étrangers touristes",
        "mujeres hombres niñas niños madres padres",
        "cristianos musulmanes judíos hindúes budistas ateos",
        "negros blancos asiáticos africanos europeos",
        "homosexuales heterosexuales lesbianas bisexuales",
        "americanos mexicanos chinos rusos alemanes franceses",
        "inmigrantes refugiados extranjeros turistas",
    )
)
_KINDS_OF = {t: [kind for kind in IDENTITY_TERMS if t in kind] for kind in IDENTITY_TERMS for t in kind}
_TERM = re.compile(r"\b(" + "|".join(sorted(_KINDS_OF, key=len, reverse=True)) + r")\b", re.IGNORECASE)
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]?")


def swaps(text: str) -> Iterator[tuple[str, list[str], str]]:
    """For every group named in a sentence: the name, what it is swapped for (all others
    of its kind, and no name at all), and the sentence without the name."""
    if not _TERM.search(text):
        return
    for sentence in _SENTENCE.findall(text):
        for name in sorted({m[0] for m in _TERM.finditer(sentence)}):
            others = {t for kind in _KINDS_OF.get(name.lower(), ()) for t in kind if t != name.lower()}
            yield name, ["", *sorted(others)], re.sub(rf"\b{re.escape(name)}\b", " ", sentence)


@functools.lru_cache(4096)
def _of_name(name: str) -> np.ndarray:
    return classify.text_features([name], True, BEGINNINGS)[0]


def twins(text: str) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """What a sentence has of a name alone, what its twin has of the other alone, and how often; in a fixed order."""
    found: Counter = Counter()
    for name, others, rest in swaps(text):
        have = classify.text_features([rest], True, BEGINNINGS)[0]
        mine = np.setdiff1d(_of_name(name), have)
        for other in others:
            its = np.setdiff1d(_of_name(other), have)
            found[np.setdiff1d(mine, its).tobytes(), np.setdiff1d(its, mine).tobytes()] += 1
    return [(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), times) for (a, b), times in sorted(found.items()) if a or b]


def toxicity_model(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, penalty: float = 1.0) -> classify.Model:
    return classify.fit(docs, labels, "toxic", lower=True, beginnings=BEGINNINGS, twins=twins, most=most, penalty=penalty, l1=L1)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Score every document for toxicity (1: toxic).

    Null and empty texts get the score of the bias alone; repeated rows are
    scored each; without labelled rows every score is 0.5; an empty table
    gives no rows; columns other than doc_id and text are not read.
    """
    model = toxicity_model(docs, labels)
    return classify.score(docs, model, threshold).select("doc_id", classify.held_out().alias("held_out"), "score", "predicted")
