"""Page walks over pages that land late and out of order.

State per walk is the length of its contiguous prefix, whether it has stopped, and the pages that landed
beyond a gap.  A page is given out when it lands, reached or not; when a gap closes, the buffered pages that
the walk now reaches are given out again with the next revision and leave the state.  Once a walk has stopped
nothing is buffered any more.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from revlume.functions.dates import cutoff_literal
from revlume.schema import WALK_KEY

_PLACE = "prefix long, stopped boolean"


def _processor(columns: list[str], page_schema: StructType):
    # Built in a function, so that it travels with the job and needs no package on the executors.
    names = page_schema.names

    class Walk(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.place = handle.getValueState("place", _PLACE_SCHEMA)
            self.waiting = handle.getMapState("waiting", "page long", page_schema)

        def handleInputRows(self, key, rows, timerValues):
            from pyspark.sql import Row

            made = Row(*columns, "reached", "revision")
            # Each look at the state is a message: a walk's place and its waiting pages are read once, and a page that
            # the walk reaches at once never goes there.
            known = self.place.get()
            prefix, stopped = known if known is not None else (0, False)
            held = {} if known is None or stopped else {k[0]: tuple(v) for k, v in self.waiting.iterator()}
            landed, told, fresh = {}, {}, {}
            for row in rows:
                landed.setdefault(row["page"], row)
            for page, row in landed.items():
                # A page that landed before counts once; beyond the prefix it is already waiting.
                if page <= prefix or page in held:
                    continue
                if not stopped:
                    fresh[page] = tuple(row[c] for c in names)
                told[page] = made(*(row[c] for c in columns), False, 0)
            left = set(held)
            while not stopped and (prefix + 1 in fresh or prefix + 1 in left):
                prefix += 1
                new = prefix in fresh
                found = dict(zip(names, fresh.pop(prefix) if new else held[prefix], strict=True))
                left.discard(prefix)
                told[prefix] = made(*(found[c] for c in columns), True, 0 if new else 1)
                stopped = bool(found["stops"])
            if held and (stopped or not left):
                self.waiting.clear()
            else:
                for page in held.keys() - left:
                    self.waiting.removeKey((page,))
            if not stopped:
                for page, values in fresh.items():
                    self.waiting.updateValue((page,), values)
            if known is None or (prefix, stopped) != tuple(known):
                self.place.update((prefix, stopped))
            yield from told.values()

        def close(self) -> None:
            pass

    _PLACE_SCHEMA = _PLACE  # noqa: N806 - a free variable of the class, sent with it
    return Walk()


def stream_walk(
    pages: DataFrame, as_of: datetime, is_last: Column | None = None, walk_key: list[str] = WALK_KEY
) -> DataFrame:
    """Streaming page figures (``page``, ``n_rows``, ``oldest_ts``) with ``stale``, ``reached`` and ``revision``.

    One row per landed page that is not empty, and another one when it is reached after all; of a page that
    lands twice the first copy counts.  ``settled_pages`` equals ``mark_reached`` over the same pages.  One walk is
    one group of one narrow row per page; it holds no more than the pages beyond its first gap.
    """
    stale = F.coalesce(F.col("oldest_ts") < cutoff_literal(as_of), F.lit(False))
    stops = stale if is_last is None else stale | F.coalesce(is_last, F.lit(False))
    kept = pages.where(F.col("n_rows") > 0).withColumn("page", F.col("page").cast("long"))
    kept = kept.withColumns({"stale": stale, "stops": stops})
    columns = [c for c in kept.columns if c != "stops"]
    out = StructType(
        [*(StructField(c, kept.schema[c].dataType) for c in columns), StructField("reached", BooleanType()), StructField("revision", LongType())]
    )
    page_schema = StructType([StructField(f.name, f.dataType) for f in kept.schema])
    return kept.groupBy(*walk_key).transformWithState(
        statefulProcessor=_processor(columns, page_schema), outputStructType=out, outputMode="Append", timeMode="None",
    )


def settled_pages(given: DataFrame, walk_key: list[str] = WALK_KEY) -> DataFrame:
    """The last word on each page: at most two revisions meet."""
    last = Window.partitionBy(*walk_key, "page").orderBy(F.desc("revision"))
    return given.withColumn("_nth", F.row_number().over(last)).where(F.col("_nth") == 1).drop("_nth", "revision")
