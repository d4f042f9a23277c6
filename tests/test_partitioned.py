"""The landing in folders: what is read, and that nothing else is."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

from revlume.schema import APP_STORE_PAGES
from revlume.sources.partitioned import app_bucket, read_landing, write_landing

ROWS = [(app, country, page, f"{app} {country} {page}") for app in ["a1", "b2", "c3", "d4", "e5"] for country in ["us", "gb", "de"] for page in (1, 2)]
ODD = [(None, "us", 1, "no app"), ("a1", None, 1, "no country"), ("", "gb", 1, "empty app"), ("a1", "us", 1, "again")]


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("landing") / "pages")
    frame = spark.createDataFrame(ROWS + ODD, APP_STORE_PAGES)
    write_landing(frame.where("page = 1"), path)
    write_landing(frame.where("page = 2"), path)
    return path


def read(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_everything_comes_back(spark, landing):
    assert read(read_landing(spark, landing, APP_STORE_PAGES)) == sorted(ROWS + ODD, key=str)


@pytest.mark.parametrize("bound", [1000, 0])
def test_countries_and_apps(spark, landing, bound):
    apps = spark.createDataFrame([("a1",), ("c3",), ("zz",), (None,), ("a1",)], "app_id string")
    got = read(read_landing(spark, landing, APP_STORE_PAGES, ["us", "fr"], apps, bound))
    assert got == sorted([r for r in ROWS + ODD if r[0] in ("a1", "c3") and r[1] == "us"], key=str)
    assert read(read_landing(spark, landing, APP_STORE_PAGES, [], apps, bound)) == []
    assert read(read_landing(spark, landing, APP_STORE_PAGES, None, apps.limit(0), bound)) == []


def test_only_the_folders_asked_for_are_read(spark, landing, tmp_path):
    spark.createDataFrame([("a1",)], "app_id string").write.parquet(str(tmp_path / "apps"))
    frame = read_landing(spark, landing, APP_STORE_PAGES, ["us"], spark.read.parquet(str(tmp_path / "apps")))
    text = frame._jdf.queryExecution().toString()
    filters = [line for line in text.splitlines() if "PartitionFilters" in line and "country" in line]
    assert filters and all(re.search(r"country#\d+ IN \(us\)|country#\d+ = us", line) for line in filters)
    assert any("dynamicpruning" in line for line in filters)
    assert frame.count() == 3


def test_buckets_are_fixed(spark):
    rows = spark.createDataFrame([("a1",), ("",), (None,)], "app_id string").select(app_bucket(F.col("app_id")).alias("b")).collect()
    assert [r.b for r in rows] == [zlib.crc32(t) % 64 for t in (b"a1", b"", b"")]


def test_a_long_list_still_prunes(spark, landing):
    apps = spark.createDataFrame([("a1",), ("b2",)], "app_id string")
    frame = read_landing(spark, landing, APP_STORE_PAGES, None, apps, 1)
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*app_bucket#\d+ IN", text)
