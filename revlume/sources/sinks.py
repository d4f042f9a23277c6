"""CSV output and its layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StructType

from revlume.functions import output_name, platform_key
from revlume.operators.ordering import output_order, with_text_hash

# Header, every field quoted, a quote doubled inside quotes.
CSV_OPTIONS = {
    "header": True,
    "quoteAll": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "encoding": "UTF-8",
    "lineSep": "\n",
}


def _iso_dates(df: DataFrame) -> DataFrame:
    dates = [f.name for f in df.schema if isinstance(f.dataType, DateType)]
    return df.withColumns({d: F.col(d).cast("string") for d in dates}) if dates else df


def write_csv(
    df: DataFrame, path: str, partition_by: list[str] | None = None,
    same_rows: DataFrame | None = None,
) -> bool:
    """Write ``df`` in its present order; nothing is written when it is empty.

    Emptiness is asked of ``same_rows`` where given: a frame with the same rows
    that is cheaper to begin than a sorted one.
    """
    if (df if same_rows is None else same_rows).isEmpty():
        return False
    writer = _iso_dates(df).write.mode("overwrite").options(**CSV_OPTIONS)
    writer.partitionBy(*(partition_by or [])).csv(path)
    return True


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Read back a table written by ``write_csv``; texts may span lines."""
    return (
        spark.read.schema(schema)
        .options(header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")
        .options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )


def write_summary(summary: DataFrame, path: str) -> None:
    """Put the rows of each ``run_id`` in the place of earlier ones; other runs stay."""
    writer = summary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").json(path)


def read_summary(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """``run_id`` and ``columns`` of all runs."""
    return spark.read.schema(f"run_id string, {columns}").json(path)


def named_outputs(
    reviews: DataFrame, app_name: Column, single_file: bool, analysis: bool
) -> DataFrame:
    """Add ``output_name``: one per app, or one per app and platform."""
    key = None if single_file else platform_key(F.col("platform"))
    return reviews.withColumn("output_name", output_name(app_name, key, F.lit(analysis)))


def sorted_by_output(named: DataFrame) -> DataFrame:
    """Range partitions over outputs, each in output order.

    Small outputs share a task and a large one is split over many, whose part
    files follow one another in order.
    """
    hashed = with_text_hash(named)
    return hashed.orderBy("output_name", *output_order(hashed))
