"""Quality classifier: hashed word n-gram logistic regression by follow the regularised leader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import classify

THRESHOLD = 0.3


def quality_model(docs: DataFrame, labels: DataFrame, most: int = classify.TRAIN_ROWS) -> classify.Model:
    return classify.fit(docs, labels, "quality", lower=False, most=most)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Score every document for quality (1: good).

    Null and empty texts get the score of the bias alone; repeated rows are
    scored each; without labelled rows every score is 0.5; an empty table
    gives no rows; columns other than doc_id and text are not read.
    """
    model = quality_model(docs, labels)
    return classify.score(docs, model, threshold).select("doc_id", classify.held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    return classify.keep(docs, quality_model(docs, labels), threshold)
