"""Column lists of the review table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revlume.functions import platform_key
from revlume.schema import EXTENDED_COLUMNS, STANDARD_COLUMNS


def standard_columns(reviews: DataFrame, *keep: str) -> DataFrame:
    """The five standard columns, after any extra ``keep`` columns."""
    return reviews.select(*keep, *STANDARD_COLUMNS)


def extended_columns(reviews: DataFrame, *keep: str) -> DataFrame:
    """The standard columns plus those optional ones the rows carry."""
    optional = [c for cs in EXTENDED_COLUMNS.values() for c in cs if c in reviews.columns]
    return reviews.select(*keep, *STANDARD_COLUMNS, *optional)


def with_platform_key(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("platform_key", platform_key(F.col("platform")))
