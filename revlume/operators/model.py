"""Model sentiment: the caller's classifier behind an Arrow-batched UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from revlume.functions import strip_text

# Fixed value: the label that counts as positive.
POSITIVE = "POSITIVE"

# texts -> (label, probability) of each
Classifier = Callable[[Sequence[str]], Sequence[tuple[str, float]]]


def model_score(
    reviews: DataFrame,
    load_model: Callable[[], Classifier],
    text: str = "review_text",
    max_chars: int | None = None,
) -> DataFrame:
    """``reviews`` with ``sentiment_score`` from a classifier.

    ``load_model`` runs once per task.  Only the call itself is Python; blank
    texts, the sign and, where a model needs one, the input limit are column
    expressions.
    """

    @F.pandas_udf("label string, score double")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = load_model()
        for batch in batches:
            result = pd.DataFrame(
                {"label": None, "score": None}, index=batch.index, dtype="object"
            )
            given = batch.dropna()
            if len(given):
                found = predict(list(given))
                result.loc[given.index, "label"] = [str(label) for label, _ in found]
                result.loc[given.index, "score"] = [float(p) for _, p in found]
            yield result.astype({"score": "float64"})

    body = F.col(text)
    given = F.when(strip_text(body) != "", body if max_chars is None else F.substring(body, 1, max_chars))
    called = reviews.withColumn("_call", classify(given))
    score, label = F.col("_call.score"), F.upper("_call.label")
    signed = F.when(label == POSITIVE, score).otherwise(-score)
    return called.withColumn(
        "sentiment_score", F.coalesce(signed, F.lit(0.0))
    ).drop("_call")
