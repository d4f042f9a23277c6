"""What the physical plans must and must not contain."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from revlume.operators.dedup import dedup_first_seen
from revlume.operators.filters import on_platforms, within_window
from revlume.operators.combine import union_all
from revlume.operators.sentiment import lexicon_score
from revlume.operators.walk import batch_stats, mark_reached
from revlume.plans import views
from revlume.plans.queries import QUERIES
from revlume.schema import GOOGLE_WALK_KEY
from revlume.sources.app_store import page_stats, parse_app_store, with_page_stats, read_pages
from revlume.sources.google_play import parse_google_play

AS_OF = datetime.datetime(2024, 12, 31, tzinfo=datetime.timezone.utc)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans"))
    spark.sql(
        """SELECT 'App Store' AS platform, 'a' AS app_id, 'us' AS country, 1 AS country_order, 1 AS page,
           cast(id as int) AS entry_pos, timestamp_seconds(1700000000 + id) AS review_ts,
           DATE'2024-01-01' AS review_date, 5 AS star_rating, 'x' AS review_text, 'y' AS unused
           FROM range(100)"""
    ).write.parquet(path + "/reviews")
    views.app_store_pages(spark, "/root/testdata/sf0.001").write.parquet(path + "/pages")
    views.google_play_batches(spark, "/root/testdata/sf0.001").write.parquet(path + "/batches")
    return path


def test_window_reaches_the_scan(spark, stored):
    text = plan(within_window(spark.read.parquet(stored + "/reviews"), AS_OF).select("entry_pos"))
    assert "GreaterThanOrEqual(review_ts," in text
    assert "unused" not in text.split("ReadSchema")[1] and "review_text" not in text.split("ReadSchema")[1]


def test_naive_window_reaches_the_scan(spark, sf_dir):
    text = plan(QUERIES["recency_filter"](spark, sf_dir))
    assert "GreaterThanOrEqual(ts," in text and "props" not in text.split("ReadSchema")[1]


def test_unselected_platform_is_not_read(spark, stored):
    rows = spark.read.parquet(stored + "/reviews")
    both = union_all(
        rows.withColumn("platform", F.lit("App Store")), rows.withColumn("platform", F.lit("Google Play Store"))
    )
    assert plan(on_platforms(both, ["app-store"])).count("FileScan") == 1


def test_dedup_limits_groups_before_its_one_exchange(spark, stored):
    text = plan(dedup_first_seen(spark.read.parquet(stored + "/reviews")))
    assert text.count("Exchange hashpartitioning") == 1
    before = text.split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in before and "Partial" in before


def test_parsing_does_not_shuffle(spark, stored):
    pages, batches = spark.read.parquet(stored + "/pages"), spark.read.parquet(stored + "/batches")
    for df in (
        parse_app_store(pages), parse_app_store(pages, strict_page=True), page_stats(read_pages(pages)),
        parse_google_play(batches), batch_stats(batches),
    ):
        assert "Exchange" not in plan(df)


def test_bodies_are_parsed_once(spark, stored):
    for strict in (False, True):
        text = plan(parse_app_store(spark.read.parquet(stored + "/pages"), strict_page=strict))
        assert text.lower().count("parsejson(") == 2  # the body, and one that repeats keys


def test_walks_read_no_bodies(spark, stored, tmp_path):
    path = str(tmp_path / "read")
    with_page_stats(read_pages(spark.read.parquet(stored + "/pages"))).write.parquet(path)
    marked = mark_reached(page_stats(spark.read.parquet(path)), AS_OF, 20)
    assert "entries" not in plan(marked)
    stats = mark_reached(batch_stats(spark.read.parquet(stored + "/batches")), AS_OF, None, F.col("is_last"), GOOGLE_WALK_KEY)
    assert "content" not in plan(stats).split("ReadSchema")[1]


def test_scoring_in_place_does_not_shuffle(spark, stored):
    lexicon = spark.createDataFrame([("good", 1.0)], "tok string, val double")
    text = plan(lexicon_score(spark.read.parquet(stored + "/reviews"), lexicon, ["app_id"]))
    assert "Exchange" not in text and "Join" not in text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"csv_roundtrip", "stream_dedup"}))
def test_no_python_workers(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_written_order_is_shown_file_by_file(spark, sf_dir):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shown = QUERIES["sorted_output"](spark, sf_dir)
        windows = [line for line in plan(shown).splitlines() if "windowspecdefinition" in line and "at#" in line]
        assert windows and all(re.search(r"windowspecdefinition\(file#\d+, at#", line) for line in windows)
        assert shown.where("in_order").count() == shown.count() > 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
