"""Counts, run status and the run summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from revlume.functions import platform_key, platform_slug, slug_key
from revlume.functions.naming import KEY_OF_SLUG, SLUG_OF_KEY

# Run status and its code.
EXIT_CODES = {"success": 0, "partial": 2, "failed": 3, "interrupted": 130}


def count_by_platform(reviews: DataFrame, slugs: Sequence[str]) -> DataFrame:
    """Reviews per selected platform; a platform without any has 0."""
    spark = reviews.sparkSession
    keys = [(KEY_OF_SLUG[s],) for s in slugs]
    selected = spark.createDataFrame(keys, "platform_key string")
    counts = reviews.groupBy(platform_key(F.col("platform")).alias("platform_key")).agg(
        F.count(F.lit(1)).alias("n_reviews")
    )
    return selected.join(counts, "platform_key", "left").select(
        "platform_key", F.coalesce("n_reviews", F.lit(0)).cast("long").alias("n_reviews")
    )


def run_status(total: Column, n_failed: Column, interrupted: Column) -> Column:
    """``interrupted`` > ``failed`` (nothing at all) > ``partial`` > ``success``."""
    return (
        F.when(interrupted, F.lit("interrupted"))
        .when(total == 0, F.lit("failed"))
        .when(n_failed > 0, F.lit("partial"))
        .otherwise(F.lit("success"))
    )


def exit_code(status: Column) -> Column:
    code = F.lit(None).cast("int")
    for name, number in EXIT_CODES.items():
        code = F.when(status == name, F.lit(number)).otherwise(code)
    return code


def run_summary(
    catalog: DataFrame,
    reviews: DataFrame,
    interrupted: Column | None = None,
    *extra: Column | str,
) -> DataFrame:
    """One row per app of the catalog: totals, failures, status and code.

    ``catalog`` needs ``app_id`` and ``platforms`` (slugs, in selection order).
    Reviews are pre-aggregated to one row per app and platform before the join;
    each app then has at most one row per platform.  ``extra`` columns may use
    ``app_id``, the counts ``app_store`` and ``google_play``, and the total.
    """
    interrupted = F.lit(False) if interrupted is None else interrupted
    selected = catalog.select(
        "app_id",
        interrupted.alias("interrupted"),
        F.posexplode_outer("platforms").alias("place", "slug"),
    )
    # A row or a slug that is listed twice counts once.
    selected = selected.groupBy("app_id", "slug").agg(
        F.max("interrupted").alias("interrupted"), F.min("place").alias("place")
    ).withColumn("platform_key", slug_key(F.col("slug")))
    counts = reviews.groupBy(
        "app_id", platform_key(F.col("platform")).alias("platform_key")
    ).agg(F.count(F.lit(1)).alias("n"))
    per_platform = selected.join(counts, ["app_id", "platform_key"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)).cast("long")
    )
    by_app = per_platform.groupBy("app_id").agg(
        F.max("interrupted").alias("interrupted"),
        F.sum("n").alias("total_reviews"),
        *[
            F.max(F.when(F.col("platform_key") == k, F.col("n"))).alias(k)
            for k in SLUG_OF_KEY
        ],
        F.array_sort(
            F.collect_list(
                F.when(
                    (F.col("n") == 0) & F.col("slug").isNotNull(),
                    F.struct("place", "slug"),
                )
            )
        ).alias("failed"),
    )
    failed = F.transform("failed", lambda x: x["slug"])
    status = run_status(F.col("total_reviews"), F.size("failed"), F.col("interrupted"))
    return by_app.select(
        "app_id",
        status.alias("status"),
        exit_code(status).alias("exit_code"),
        "total_reviews",
        F.to_json(F.struct(*SLUG_OF_KEY)).alias("by_platform"),
        failed.alias("platforms_failed"),
        "interrupted",
        *extra,
    )


def throughput(total: Column, seconds: Column) -> Column:
    """Reviews per second; null unless time has passed."""
    return F.when(seconds > 0, F.try_divide(total, seconds))
