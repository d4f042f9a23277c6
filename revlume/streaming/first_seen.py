"""Incremental first-seen removal of duplicates, whatever order the pages land in.

State holds, per dedup key, the ingest rank of the best row so far.  A row that ranks before it is given
out as a correction with the next revision, so the landed output only ever grows; ``settled`` reads the
last revision of each key, which is the row that the batch operator keeps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from revlume.operators.dedup import DEDUP_KEY, INGEST_ORDER
from revlume.operators.filters import within_window
from revlume.operators.ordering import with_text_hash
from revlume.streaming.dedup import STATE_DAYS

EVENT_TIME = "review_day"
_DAY_MS = 86_400_000


def _combine(key: list[str], order: list[str]):
    """The best row of each key of an Arrow batch: a hot text leaves a task once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = [(c, "ascending") for c in order]
            table = table.take(pc.sort_indices(table.select(order), sort_keys=keys, null_placement="at_start"))
            table = table.append_column("_at", pa.array(range(table.num_rows), pa.int64()))
            first = table.select([*key, "_at"]).group_by(key).aggregate([("_at", "min")])
            yield from table.take(first.column("_at_min")).drop_columns(["_at"]).to_batches()

    return run


def _processor(ranked: StructType, columns: list[str]):
    # Built in a function, so that it travels with the job and needs no package on the executors.
    order = ranked.names[:-1]

    class FirstSeen(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.best = handle.getValueState("best", ranked)

        @staticmethod
        def rank(values) -> tuple:
            return tuple((v is not None, v) for v in values)

        def handleInputRows(self, key, rows, timerValues):
            found = min(rows, key=lambda r: self.rank(r[c] for c in order))
            held = self.best.get() if self.best.exists() else None
            if held is not None and self.rank(held[:-1]) <= self.rank(found[c] for c in order):
                return
            revision = 0 if held is None else held[-1] + 1
            self.best.update((*(found[c] for c in order), revision))
            if held is None:
                # The key can be met again until its day has left the window.
                self.handle.registerTimer(found["_expires"])
            from pyspark.sql import Row

            yield Row(*columns, "revision")(*(found[c] for c in columns), revision)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.best.clear()
            return iter([])

        def close(self) -> None:
            pass

    return FirstSeen()


def _sortable(name: str, kind: str) -> Column:
    """A column as text or number in the same order: times come back from the state in another form."""
    column = F.col(name)
    if kind == "date":
        return F.unix_date(column)
    return F.unix_micros(column.cast("timestamp")) if kind.startswith("timestamp") else column


def stream_first_seen(
    reviews: DataFrame, as_of: datetime, key: Sequence[str] = DEDUP_KEY, ingest_order: Sequence[str] = INGEST_ORDER
) -> DataFrame:
    """Streaming reviews inside the window: every row that is the first of its key so far, with its ``revision``.

    Order and ties are those of ``dedup_first_seen``.  State is one narrow row per key, on disk, and a timer
    drops it when the key's day has left the window.  A row of an older day than the watermark is late and left
    out, as the window leaves it out.
    """
    recent = with_text_hash(within_window(reviews, as_of)) if "text_hash" in key else within_window(reviews, as_of)
    placed = [*ingest_order, *(c for c in ("country", "lang") if c in recent.columns)]
    told = {*placed, *key, "review_text"}
    rest = [c for c, t in sorted(recent.dtypes) if c not in told and not t.startswith(("map", "variant", "array", "struct"))]
    kinds = dict(recent.dtypes)
    ranks = {f"_rank{i}": _sortable(c, kinds[c]) for i, c in enumerate([*placed, *rest])}
    order, columns = list(ranks), recent.columns
    day = F.least(F.col("review_date"), F.lit(as_of.date())).cast("timestamp")
    expires = F.unix_millis(day) + STATE_DAYS * _DAY_MS
    timed = recent.withColumns({**ranks, EVENT_TIME: day, "_expires": expires})
    combined = timed.mapInArrow(_combine(list(key), order), timed.schema).withWatermark(EVENT_TIME, f"{STATE_DAYS} days")
    field = lambda c: StructField(c, timed.schema[c].dataType)
    ranked = StructType([*map(field, order), StructField("revision", LongType())])
    out = StructType([*map(field, columns), StructField("revision", LongType())])
    return combined.groupBy(*key).transformWithState(
        statefulProcessor=_processor(ranked, columns), outputStructType=out,
        outputMode="Append", timeMode="EventTime",
    )


def settled(corrections: DataFrame, key: Sequence[str] = DEDUP_KEY) -> DataFrame:
    """The last revision of each key; the revisions of a key are few and meet in one group."""
    last = Window.partitionBy(*key).orderBy(F.desc("revision"))
    return corrections.withColumn("_nth", F.row_number().over(last)).where(F.col("_nth") == 1).drop("_nth", "revision")
