"""First-seen removal of duplicate reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from revlume.operators.ordering import with_text_hash

# Who wrote a review and in which country store are not part of the key.
DEDUP_KEY = ["platform", "app_id", "review_date", "star_rating", "text_hash"]
INGEST_ORDER = ["country_order", "page", "entry_pos"]


def country_order(countries: Sequence[str]) -> Column:
    """Place of ``country`` in the collection order; unlisted ones come last."""
    listed = F.array(*[F.lit(c) for c in countries]).cast("array<string>")
    place = F.array_position(listed, F.col("country"))
    return F.when(place > 0, place).otherwise(F.lit(len(countries) + 1)).cast("int")


def dedup_first_seen(
    reviews: DataFrame,
    key: Sequence[str] = DEDUP_KEY,
    ingest_order: Sequence[str] = INGEST_ORDER,
) -> DataFrame:
    """Keep the first row of each key in ingest order.

    Ties (unlisted countries, a page landed twice) go by country and then by
    all other columns that sort, so the survivor never depends on file order.

    ``row_number() = 1`` plans as a group limit on both sides of one exchange:
    each task forwards at most one row per key, so a text that makes up a third
    of the table does not gather in one place.
    """
    if "text_hash" in key:
        reviews = with_text_hash(reviews)
    placed = [*ingest_order, *(c for c in ("country", "lang") if c in reviews.columns)]
    rest = [c for c, t in sorted(reviews.dtypes) if c not in {*placed, *key} and not t.startswith(("map", "variant"))]
    first = Window.partitionBy(*key).orderBy(*placed, *rest)
    return (
        reviews.withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )
