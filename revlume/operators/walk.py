"""Pagination truncation: which landed pages a newest-first walk reaches.

A walk reads pages 1, 2, 3, ... of one app and country and stops at the first
page that is missing or empty, or after a page whose oldest review is older
than the cutoff, or after a page that names no next page.  The page it stops
*after* is still read.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from revlume.functions.dates import as_instant, cutoff_literal
from revlume.operators.filters import up_to_page
from revlume.operators.joins import MAX_BROADCAST_ROWS, without
from revlume.schema import PAGE_KEY, WALK_KEY


def oldest_per_page(
    reviews: DataFrame, page_key: list[str] = PAGE_KEY
) -> DataFrame:
    """One narrow row per page: its oldest instant and its number of rows."""
    return reviews.groupBy(*page_key).agg(
        F.min("review_ts").alias("oldest_ts"), F.count(F.lit(1)).alias("n_rows")
    )


def batch_stats(batches: DataFrame) -> DataFrame:
    """Per batch: oldest time, size and whether it is the last.

    The oldest time covers every element that has one, whatever its score or
    text.  Worked out inside the row from one leaf of the array.
    """
    keys = [c for c in batches.columns if c not in ("batch", "next_token")]
    oldest = F.array_min("batch.at")
    dtype = batches.select(oldest.alias("t")).dtypes[0][1]
    return batches.select(
        *keys,
        as_instant(oldest, dtype).alias("oldest_ts"),
        F.coalesce(F.size("batch.at"), F.lit(0)).cast("long").alias("n_rows"),
        F.col("next_token").isNull().alias("is_last"),
    )


def mark_reached(
    page_stats: DataFrame,
    as_of: datetime,
    max_pages: int | None = None,
    is_last: Column | None = None,
    walk_key: list[str] = WALK_KEY,
) -> DataFrame:
    """Add ``stale`` and ``reached`` to every non-empty page, within a cap if one is given.

    Works on one narrow row per page, never on reviews.  A page landed twice
    counts once.
    """
    stale = F.coalesce(F.col("oldest_ts") < cutoff_literal(as_of), F.lit(False))
    stops_after = stale if is_last is None else stale | is_last
    by_page = Window.partitionBy(*walk_key).orderBy("page")
    earlier = by_page.rangeBetween(Window.unboundedPreceding, -1)
    pages = up_to_page(page_stats, max_pages).where(F.col("n_rows") > 0)
    stopped = F.coalesce(F.max(stops_after).over(earlier), F.lit(False))
    unbroken = F.dense_rank().over(by_page) == F.col("page")
    return pages.withColumns({"stale": stale, "reached": unbroken & ~stopped})


def keep_reached(
    rows: DataFrame,
    marked: DataFrame,
    max_pages: int | None = None,
    page_key: list[str] = PAGE_KEY,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Rows of reached pages; a null in the page key is a value like any other.

    ``marked`` covers every page of ``rows`` within the cap, so dropping the
    unreached ones is exact, and those are few: sources are sorted.  Beyond
    the broadcast bound the join shuffles on the page, never on a bare app.
    """
    unreached = marked.where(~F.col("reached"))
    return without(up_to_page(rows, max_pages), unreached, page_key, max_broadcast_rows)


def order_breaks(page_stats: DataFrame, walk_key: list[str] = WALK_KEY) -> DataFrame:
    """Pages whose newest review is newer than the previous page's oldest.

    Diagnostic only: the walk assumes newest-first sources and does not
    enforce it.  ``page_stats`` needs ``newest_ts`` and ``oldest_ts``.
    """
    by_page = Window.partitionBy(*walk_key).orderBy("page")
    previous = F.lag("oldest_ts").over(by_page)
    return page_stats.withColumn("previous_oldest_ts", previous).where(
        F.col("newest_ts") > F.col("previous_oldest_ts")
    )
