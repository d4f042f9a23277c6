"""Landed pages in folders by country and bucket of apps, and reading only the folders that a run asks for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from revlume.operators.joins import MAX_BROADCAST_ROWS, fits, only

#: Folders of apps in each country, and files that one folder is written in at most.
BUCKETS, FILES = 64, 4


def app_bucket(app_id: Column) -> Column:
    """Folder of an app: a fixed hash of its id, so that all runs agree; a null id has one too."""
    return F.pmod(F.crc32(F.coalesce(app_id, F.lit("")).cast("binary")), F.lit(BUCKETS)).cast("int")


def write_landing(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Add ``pages`` (``app_id``, ``country``, ``page`` and more) to the landing at ``path``.

    Folders get a few files each whatever the number of tasks before, and a folder with a large part of all pages
    is written by several tasks.
    """
    part = F.pmod(F.xxhash64("app_id", "page"), F.lit(FILES)).cast("int")
    dealt = pages.withColumn("app_bucket", app_bucket(F.col("app_id"))).withColumn("_part", part)
    dealt = dealt.repartition("country", "app_bucket", "_part").drop("_part")
    dealt.write.mode(mode).partitionBy("country", "app_bucket").parquet(path)


def read_landing(
    spark: SparkSession, path: str, schema: StructType, countries: Sequence[str] | None = None,
    apps: DataFrame | None = None, max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Pages of the landing, of the given countries and of the apps listed in ``apps.app_id``; none given: all.

    Countries become filters on folders when the plan is made.  A list of apps that fits is broadcast, and the
    buckets found in it prune the folders while the job runs; a longer one gives its buckets, at most ``BUCKETS``,
    beforehand and is joined by a shuffle.
    """
    # The value of a folder comes last in a row that is read.
    fields = [f for f in schema.fields if f.name != "country"]
    held = StructType([*fields, schema["country"]]).add("app_bucket", IntegerType())
    pages = spark.read.schema(held).parquet(path)
    if countries is not None:
        pages = pages.where(F.col("country").isin(list(countries)))
    if apps is not None:
        # The comparison tells the optimizer that the list leaves something out.
        listed = apps.select("app_id").where(F.length("app_id") > 0).distinct().withColumn("app_bucket", app_bucket(F.col("app_id")))
        if fits(listed, max_broadcast_rows):
            pages = pages.join(F.broadcast(listed), ["app_bucket", "app_id"], "left_semi")
        else:
            buckets = [r.app_bucket for r in listed.select("app_bucket").distinct().collect()]
            pages = only(pages.where(F.col("app_bucket").isin(buckets)), listed, ["app_id"], ["page"], max_broadcast_rows)
    return pages.select(*schema.names)
