"""Row filters that reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from revlume.functions.dates import cutoff_literal
from revlume.functions.naming import KEY_OF_SLUG, PLATFORM_OF_KEY


def within_window(reviews: DataFrame, as_of: datetime) -> DataFrame:
    """Reviews of the last 365 days before ``as_of``, the bound included."""
    dtype = dict(reviews.dtypes)["review_ts"]
    return reviews.where(F.col("review_ts") >= cutoff_literal(as_of, dtype))


def on_platforms(reviews: DataFrame, slugs: Sequence[str]) -> DataFrame:
    """Reviews of the selected platforms (``app-store``, ``google-play``)."""
    names = [PLATFORM_OF_KEY[KEY_OF_SLUG[s]] for s in slugs]
    return reviews.where(F.col("platform").isin(names))


def in_countries(reviews: DataFrame, countries: Sequence[str]) -> DataFrame:
    return reviews.where(F.col("country").isin(list(countries)))


def up_to_page(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages 1 to ``max_pages``; without a cap, all pages that are numbered from 1."""
    page = F.col("page")
    return pages.where(page >= 1 if max_pages is None else page.between(1, max_pages))
