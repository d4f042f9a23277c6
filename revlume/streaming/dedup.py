"""Incremental first-seen removal of duplicates over newly landed pages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from revlume.functions.dates import WINDOW_DAYS
from revlume.operators.filters import within_window
from revlume.operators.ordering import with_text_hash

STREAM_KEY = ["platform", "app_id", "review_day", "star_rating", "text_hash"]
# A review's own day may lie one day off its instant, and rows exactly on the
# watermark are late, so state is kept a little longer than the window.
STATE_DAYS = WINDOW_DAYS + 2
# Fixed value: state backend for a year of keys, on disk instead of in executor memory.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream_dedup(
    reviews: DataFrame, as_of: datetime, key: Sequence[str] = STREAM_KEY,
) -> DataFrame:
    """Streaming reviews inside the window, each key once.

    The survivor is the first to arrive.  ``review_day`` is both event time and
    part of the key, so keys older than the window leave the state.  Days after
    ``as_of`` do not move the watermark ahead of it.

    State holds each key once.  The rows of one text meet in one task, but no
    more of them than a micro-batch brings; ``maxFilesPerTrigger`` bounds it.
    """
    recent = with_text_hash(within_window(reviews, as_of))
    day = F.least(F.col("review_date"), F.lit(as_of.date()))
    keyed = recent.withColumn("review_day", day.cast("timestamp"))
    timed = keyed.withWatermark("review_day", f"{STATE_DAYS} days")
    # later days share one event time but stay apart in the key
    return timed.dropDuplicates([*key, "review_date"])


def run_available(
    stream: DataFrame, path: str, checkpoint: str
) -> StreamingQuery:
    """Process what has landed, append it to ``path`` and stop.

    Rerun with the same ``checkpoint`` to take up newly landed pages.  Keys are
    kept by RocksDB.
    """
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        conf.set(PROVIDER, before)
    return query
