"""Sentiment labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
GOOD_FROM = 0.25
BAD_TO = -0.25


def sentiment_label(score: Column) -> Column:
    """``good`` / ``neutral`` / ``bad``; both bounds count, NaN is neutral."""
    return (
        F.when(F.isnan(score), F.lit("neutral"))
        .when(score >= GOOD_FROM, F.lit("good"))
        .when(score <= BAD_TO, F.lit("bad"))
        .otherwise(F.lit("neutral"))
    )
