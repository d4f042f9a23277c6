"""Incremental jobs with keyed state against the batch operators, for several landing orders."""

import glob
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from revlume.operators.dedup import dedup_first_seen
from revlume.operators.filters import within_window
from revlume.operators.walk import mark_reached
from revlume.session import scratch_path
from revlume.streaming.dedup import run_available
from revlume.streaming.first_seen import settled, stream_first_seen
from revlume.streaming.walk import settled_pages, stream_walk

AS_OF = datetime(2024, 12, 31, tzinfo=timezone.utc)


def landed(spark, rows, schema, order):
    """Rows in files, one after the other, in the order given."""
    path = scratch_path(spark, "landed")
    for at in order:
        spark.createDataFrame(rows[at], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream, checkpoint=None, path=None):
    path = path or scratch_path(spark, "given")
    run_available(stream, path, checkpoint or scratch_path(spark, "state"))
    return spark.read.schema(stream.schema).parquet(path)


REVIEWS = (
    "platform string, app_id string, country string, country_order int, page int, entry_pos int, review_date date, "
    "review_ts timestamp, star_rating int, review_text string, thumbs long, note string"
)


def reviews():
    rng = random.Random(4)
    out = []
    for i in range(240):
        day = (AS_OF - timedelta(days=rng.choice([0, 1, 200, 364, 500]))).replace(tzinfo=None)
        out.append((
            "App Store", rng.choice(["a", "b", None]), rng.choice(["us", "gb", None]), rng.choice([1, 2, 3]), rng.choice([1, 2, None]),
            rng.randrange(3), day.date(), day, rng.choice([1, 5]), rng.choice(["good", "Good", "bad"]),
            rng.choice([None, 2**60, 2**60 + 1, 3]), rng.choice(["x", "é", None]),
        ))
    return [out[:60], out[60:70] * 3, out[70:180], out[180:] + out[:20]]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)])
def test_first_seen_in_any_landing_order(spark, order):
    parts = reviews()
    stream = stream_first_seen(landed(spark, parts, REVIEWS, order), AS_OF)
    given = run(spark, stream)
    batch = dedup_first_seen(within_window(spark.createDataFrame(sum(parts, []), REVIEWS), AS_OF))
    columns = batch.columns
    got, wanted = settled(given).select(columns), batch.select(columns)
    assert got.exceptAll(wanted).count() == 0 and wanted.exceptAll(got).count() == 0 and wanted.count() > 20
    # corrections are numbered without a gap, and there were some
    counts = given.groupBy("platform", "app_id", "review_date", "star_rating", "text_hash").agg(F.count("*").alias("n"), F.max("revision").alias("r"))
    assert counts.where("n <> r + 1").count() == 0 and counts.where("n > 1").count() > 0


def test_first_seen_goes_on_after_a_stop(spark):
    parts = reviews()
    path, checkpoint, source = (scratch_path(spark, n) for n in ("given", "state", "landed"))
    for part in parts:
        spark.createDataFrame(part, REVIEWS).coalesce(1).write.mode("append").parquet(source)
        stream = stream_first_seen(spark.readStream.schema(REVIEWS).parquet(source), AS_OF)
        given = run(spark, stream, checkpoint, path)
    batch = dedup_first_seen(within_window(spark.createDataFrame(sum(parts, []), REVIEWS), AS_OF))
    got = settled(given).select(batch.columns)
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


PAGES = "app_id string, country string, page int, n_rows long, oldest_ts timestamp, last boolean"


def pages():
    rng = random.Random(6)
    out = []
    for app in ["a", "b", "c", "d", "e", None]:
        for country in ["us", None]:
            for page in range(1, 15):
                kind = rng.random()
                if kind < 0.06:
                    continue  # never lands
                old = AS_OF.replace(tzinfo=None) - timedelta(days=400 if kind > 0.93 else 10)
                out.append((app, country, page, 0 if 0.06 < kind < 0.1 else rng.randrange(1, 9), None if 0.1 < kind < 0.2 else old, kind > 0.97))
    rng.shuffle(out)
    return [out[:40], out[40:90], out[90:] + out[:15]]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_walk_in_any_landing_order(spark, order):
    parts = pages()
    given = run(spark, stream_walk(landed(spark, parts, PAGES, order), AS_OF, F.col("last")))
    every = spark.createDataFrame(sum(parts, []), PAGES).distinct()
    batch = mark_reached(every, AS_OF, is_last=F.col("last")).withColumn("page", F.col("page").cast("long"))
    columns = ["app_id", "country", "page", "n_rows", "stale", "reached"]
    got, wanted = settled_pages(given).select(columns), batch.select(columns)
    assert got.exceptAll(wanted).count() == 0 and wanted.exceptAll(got).count() == 0
    assert wanted.where("reached").count() > 20 and wanted.where("not reached").count() > 20
    assert given.where("revision = 1 and not reached").count() == 0 and given.where("revision = 1").count() > 0


@pytest.mark.parametrize("name", ["stream_dedup", "stream_first_seen"])
def test_landed_files_grow_with_the_texts(spark, sf_dir, monkeypatch, name):
    """A landed file, and so what a task of the stream reads, holds a bounded part of the texts."""
    from revlume.plans import queries

    rows, files = [], []
    for size in (1 << 14, 1 << 40):
        paths = []
        monkeypatch.setattr(queries, "LANDED_BYTES", size, raising=False)
        monkeypatch.setattr(queries, "scratch_path", lambda *a: paths.append(scratch_path(*a)) or paths[-1])
        rows.append(sorted(map(str, queries.QUERIES[name](spark, sf_dir).collect())))
        files.append(len(glob.glob(f"{paths[0].removeprefix('file:')}/part-*.parquet")))
        monkeypatch.undo()
    assert rows[0] == rows[1] and files[0] > files[1] == 3


def test_walk_looks_at_its_state_once():
    """Pages that are reached in the batch in which they land never go to the state."""
    from revlume.streaming.walk import _processor

    schema = StructType([StructField("page", LongType()), StructField("stops", BooleanType())])
    walk, calls = _processor(["page"], schema), []

    class State:
        def __init__(self):
            self.held, self.value = {}, None

        def __getattr__(self, name):
            def call(*given):
                calls.append(name)
                if name in ("get", "exists"):
                    return self.value if name == "get" else self.value is not None
                if name == "update":
                    self.value = given[0]
                elif name == "iterator":
                    return iter(self.held.items())
                elif name == "clear":
                    self.held.clear()
                elif name == "containsKey":
                    return given[0] in self.held
                elif name == "getValue":
                    return self.held.get(given[0])
                elif name == "removeKey":
                    self.held.pop(given[0], None)
                else:
                    self.held[given[0]] = given[1]

            return call

    walk.place, walk.waiting = State(), State()
    batch = lambda *pages: [(r["page"], r["reached"], r["revision"]) for r in walk.handleInputRows(None, iter([{"page": p, "stops": p == 9} for p in pages]), None)]
    assert sorted(batch(3, 1, 2, 5)) == [(1, True, 0), (2, True, 0), (3, True, 0), (5, False, 0)]
    assert sorted(batch(5, 7, 3)) == [(7, False, 0)]
    assert sorted(batch(6, 4)) == [(4, True, 0), (5, True, 1), (6, True, 0), (7, True, 1)]
    assert sorted(batch(9, 10, 8)) == [(8, True, 0), (9, True, 0), (10, False, 0)]
    assert sorted(batch(11, 10)) == [(10, False, 0), (11, False, 0)]
    assert walk.place.value == (9, True) and not walk.waiting.held and len(calls) < 20
