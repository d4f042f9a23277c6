"""Output order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revlume.functions import text_hash


TIE_BREAKERS = ["platform", "app_id", "country", "page", "entry_pos"]


def with_text_hash(reviews: DataFrame) -> DataFrame:
    """Hash held as a column: a sort would work out an expression per comparison."""
    if "text_hash" in reviews.columns:
        return reviews
    return reviews.withColumn("text_hash", text_hash(F.col("review_text")))


def output_order(reviews: DataFrame) -> list[Column]:
    """Newest first, then most stars; the rest only breaks ties.

    The tie-breakers make the order total.  They also let a range exchange
    split a date, or a text, that holds a large share of all rows.
    """
    ties = [F.col(c) for c in TIE_BREAKERS if c in reviews.columns]
    return [F.desc("review_date"), F.desc("star_rating"), F.col("text_hash"), *ties]


def sort_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews in output order, with their ``text_hash``."""
    hashed = with_text_hash(reviews)
    return hashed.orderBy(*output_order(hashed))
