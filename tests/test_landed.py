"""Raw files of any shape: each becomes one row, with a place for what does not fit."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from revlume.sources.app_store import parse_app_store
from revlume.sources.google_play import parse_google_play
from revlume.sources.landed import land_files, landed_app_store, landed_google_play, landing_report
from revlume.session import scratch_path
from revlume.streaming.dedup import run_available

ENTRY = {"im:rating": {"label": "4"}, "content": {"label": "Fine\napp"}, "title": {"label": "t"}, "updated": {"label": "2024-06-01T10:00:00Z"}, "author": {"name": {"label": "A B"}}}
FILES = {
    "app_id=a/country=us/page=1/x.json": json.dumps({"feed": {"entry": [ENTRY, ENTRY]}}),
    "app_id=a/country=us/page=2/x.json": json.dumps({"feed": {"entry": ENTRY, "rights": "r"}, "v": 1}, indent=2),
    "app_id=a/country=us/page=2/copy.json": json.dumps({"feed": {}}),
    "app_id=a/country=us/page=3/x.json": '{"feed": {"entry": [',
    "app_id=a/country=us/page=4/x.json": " \n",
    "app_id=a/country=us/page=5/x.json": "",
    "app_id=a/country=us/page=6/x.json": '{"error": 1}',
    "app_id=a/country=us/page=x/x.json": "{}",
    "app_id=a%2Fb%20c/country=__HIVE_DEFAULT_PARTITION__/page=1/x.json": json.dumps({"feed": None}),
    "stray.json": "{}",
    "app_id=b/country=us/page=1/x.json": b'{"feed": "\xff\xfe',
    "app_id=a/page=1/x.json": "{}",
}
WANTED = {
    "page=1/x.json": "ok", "page=2/x.json": "ok", "page=2/copy.json": "ok", "page=3/x.json": "not_json", "page=4/x.json": "empty",
    "page=6/x.json": "no_feed", "page=x/x.json": "bad_path",
}


def written(tmp_path, files):
    for name, text in files.items():
        file = tmp_path / "raw" / name
        os.makedirs(file.parent, exist_ok=True)
        file.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path / "raw")


def test_every_file_is_a_row(spark, tmp_path):
    root = written(tmp_path, FILES)
    rows = landed_app_store(spark, root).collect()
    assert len(rows) == len(FILES) - 1  # all but the one without a byte
    us = {r.file.split("country=us/")[1]: r for r in rows if "=a/country=us/" in r.file}
    assert {k: r.status for k, r in us.items()} == WANTED
    assert all((r.corrupt is None) == (r.status == "ok") for r in rows)
    assert us["page=3/x.json"].corrupt == FILES["app_id=a/country=us/page=3/x.json"]
    assert json.loads(json.loads(us["page=2/x.json"].unknown)["page"]) == {"v": "1"}
    assert json.loads(json.loads(us["page=2/x.json"].unknown)["feed"]) == {"rights": "r"}
    odd = next(r for r in rows if "HIVE" in r.file)
    assert (odd.app_id, odd.country, odd.page, odd.status) == ("a/b c", None, 1, "no_feed")
    assert sorted(r.status for r in rows if "country" not in r.file) == ["bad_path", "bad_path"]
    report = landing_report(landed_app_store(spark, root)).first()
    assert report.n_files == len(FILES) - 1 == report.n_ok + report.n_bad_path + report.n_empty + report.n_not_json + report.n_no_feed


def test_landed_pages_are_parsed(spark, tmp_path):
    landed = landed_app_store(spark, written(tmp_path, FILES)).where("status = 'ok'")
    rows = parse_app_store(landed.select("app_id", "country", "page", "body")).collect()
    assert sorted((r.page, r.review_text) for r in rows) == [(1, "Fine app"), (1, "Fine app"), (2, "Fine app")]


def test_streamed_files(spark, tmp_path):
    root = written(tmp_path, FILES)
    stream = landed_app_store(spark, root, streaming=True, files_per_batch=4)
    path = scratch_path(spark, "landed-stream")
    run_available(stream, path, scratch_path(spark, "landed-state"))
    got = spark.read.schema(stream.schema).parquet(path).groupBy("status").count()
    wanted = landed_app_store(spark, root).groupBy("status").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_google_batches(spark, tmp_path):
    element = {"at": "2024-06-01T10:00:00", "score": 5, "userName": "N", "content": " good ", "thumbsUpCount": 2, "appVersion": "1.2"}
    at = "app_id=a/lang=en/country=us/page={}/b.json"
    files = {
        at.format(1): json.dumps({"next_token": "t", "batch": [element, {**element, "score": "bad"}], "took": 3}),
        at.format(2): json.dumps({"batch": []}), at.format(3): json.dumps({"next_token": None}), at.format(4): "[1,",
    }
    landed = landed_google_play(spark, written(tmp_path, files))
    rows = {r.page: r for r in landed.collect()}
    assert {p: r.status for p, r in rows.items()} == {1: "ok", 2: "ok", 3: "no_feed", 4: "not_json"}
    assert rows[1].next_token == "t" and rows[2].next_token is None and rows[2].batch == [] and rows[2].unknown is None
    assert json.loads(rows[1].unknown) == {"page": '{"took":"3"}', "elements": [{"appVersion": "1.2"}] * 2}
    reviews = parse_google_play(landed.where("status = 'ok'").drop("file", "status", "corrupt", "unknown")).collect()
    assert [(r.review_text, r.star_rating, r.review_ts) for r in reviews] == [("good", 5, datetime(2024, 6, 1, 10))]


def test_land_files(spark):
    """Rows come back from their files, one each, whatever their keys hold, and no file needs a program of its own."""
    rows = [("a b/%c+ü=1", "de", "1", "x\r\ny"), (None, "", "2", " "), ("a", None, "p3", "{}"), ("a", "us", "4", "")]
    root = scratch_path(spark, "land")
    land_files(spark.createDataFrame(rows, "app_id string, country string, page string, body string"), ["app_id", "country", "page"], "body", root)
    found = {(r.app_id, r.country, r.page, r.body) for r in landed_app_store(spark, root).collect()}
    assert found == {("a b/%c+ü=1", "de", 1, "x\r\ny\n"), (None, None, 2, " \n"), ("a", None, None, "{}\n"), ("a", "us", 4, "\n")}


def test_landed_files_are_opened_once(spark, sf_dir):
    from revlume.plans.queries import landed_pages

    plan = landed_pages(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and "content#" not in plan
