"""Full runs, sinks, and the incremental job."""

import csv
import datetime
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from revlume import schema
from revlume.functions.naming import APP_STORE
from revlume.operators.analysis import choose_scorer
from revlume.plans.full_run import RunConfig, run
from revlume.session import shared_dir, staged
from revlume.sources.sinks import read_csv, read_summary, write_csv
from revlume.streaming.dedup import run_available, stream_dedup
from test_sources import feed, post

UTC = datetime.timezone.utc
AS_OF = datetime.datetime(2024, 12, 31, tzinfo=UTC)


def stamp(days):
    return (AS_OF - datetime.timedelta(days=days)).isoformat()


def at(days):
    return AS_OF - datetime.timedelta(days=days)


CATALOG = [
    ("1", "one", "111", "com.one.app", ["app-store", "google-play"]),
    ("2", "two", "222", "com.two.app", ["app-store", "google-play"]),
    ("3", "bad", "nope", "com.bad.app", ["app-store"]),
    ("4", "four", "444", "com.four.app", ["google-play"]),
]


def landed(spark):
    def page(app, country, number, *entries):
        return (app, country, number, json.dumps(feed(*entries)))

    pages = [
        page("1", "us", 1, post({"updated": stamp(1), "content": "good app"}), post({"updated": stamp(2), "content": "bad app", "im:rating": "2"})),
        page("1", "us", 2, post({"updated": stamp(1), "content": "good app"}), post({"updated": stamp(400), "content": "old"})),
        page("1", "us", 3, post({"updated": stamp(3), "content": "not reached"})),
        page("1", "gb", 1, post({"updated": stamp(1), "content": " good\n app "}), post({"updated": stamp(5), "content": 'say "hi",\nyou'})),
        page("1", "fr", 1, post({"updated": stamp(1), "content": "not selected"})),
        page("2", "us", 1, post({"updated": stamp(7), "content": "fine"}), post(raw={"author": 5})),
        page("3", "us", 1, post({"updated": stamp(7), "content": "rejected app"})),
    ]

    def item(days, score, text, name="Bob Ray"):
        return (at(days), score, name, text, 1, None, None)

    batches = [
        ("1", "en", "us", 1, "t", [item(1, 5.0, "good app"), item(1, 5.0, "good app", "Al")]),
        ("1", "en", "us", 2, None, [item(9, 1.0, "bad app")]),
        ("1", "en", "us", 3, "t", [item(9, 1.0, "after the end")]),
        ("4", "en", "us", 1, None, [item(1, 3.0, "kind")]),
    ]
    return (
        spark.createDataFrame(CATALOG, schema.APP_CATALOG),
        spark.createDataFrame(pages, schema.APP_STORE_PAGES),
        spark.createDataFrame(batches, schema.GOOGLE_PLAY_BATCHES),
    )


@pytest.fixture(scope="module")
def scorer(spark):
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "tok string, val double")
    return choose_scorer(lexicon, ["platform", "app_id", "review_date", "star_rating", "text_hash"])[0]


CONFIG = dict(as_of=AS_OF, countries=("us", "gb"), output_mode="both")


def rows_of(path):
    found = {}
    for name in sorted(glob.glob(f"{path}/output_name=*")):
        for part in sorted(glob.glob(name + "/part-*.csv")):
            with open(part, encoding="utf-8", newline="") as f:
                found.setdefault(name.split("=")[1], []).extend(csv.DictReader(f))
    return found


def test_run_combined(spark, scorer, tmp_out):
    result = run(*landed(spark), tmp_out, RunConfig(**CONFIG), scorer)
    raw, analysis = rows_of(tmp_out + "/reviews"), rows_of(tmp_out + "/analysis")
    assert set(raw) == {"one_reviews", "two_reviews", "four_reviews"}
    assert set(analysis) == {"one_reviews_analysis", "two_reviews_analysis", "four_reviews_analysis"}
    one = raw["one_reviews"]
    assert list(one[0]) == schema.STANDARD_COLUMNS
    texts = sorted((r["platform"], r["review_text"]) for r in one)
    assert texts == [
        ("App Store", "bad app"), ("App Store", "good app"), ("App Store", 'say "hi", you'),
        ("Google Play Store", "bad app"), ("Google Play Store", "good app"),
    ]
    keys = [(r["review_date"], r["star_rating"]) for r in one]
    assert keys == sorted(keys, reverse=True)
    labels = {r["review_text"]: r["sentiment_label"] for r in analysis["one_reviews_analysis"]}
    assert labels == {"good app": "good", "bad app": "bad", 'say "hi", you': "neutral"}
    assert list(analysis["one_reviews_analysis"][0]) == schema.STANDARD_COLUMNS + schema.ANALYSIS_COLUMNS

    summary = {r.app_id: r for r in result.summary.collect()}
    assert set(summary) == {"1", "2", "4"}
    assert summary["1"].by_platform == '{"app_store":3,"google_play":2}' and summary["1"].status == "success"
    assert summary["2"].status == "partial" and summary["2"].platforms_failed == ["google-play"]
    assert summary["4"].by_platform == '{"google_play":1}' and summary["4"].exit_code == 0
    assert summary["1"].files_written == ["one_reviews", "one_reviews_analysis"]
    assert summary["1"].duration_seconds >= summary["1"].collecting_seconds > 0
    assert summary["1"].reviews_per_second > 0
    assert {r.app_id: r.errors for r in result.rejected.collect()} == {"3": ["app_store_id_malformed"]}
    assert spark.read.json(tmp_out + "/run_summary").count() == 3


def test_a_rerun_takes_the_place_of_the_first(spark, tmp_out):
    """The second run of an id replaces its rows, also where it finds less; other runs stay."""
    catalog, pages, batches = landed(spark)
    config = RunConfig(**{**CONFIG, "output_mode": "reviews"})
    run(catalog, pages, batches, tmp_out, config, run_id="a")
    run(catalog, pages, batches, tmp_out, config, run_id="7")
    run(catalog, pages.where("app_id != '1'"), batches, tmp_out, config, run_id="a")
    rows = read_summary(spark, tmp_out + "/run_summary", "app_id string, total_reviews long").collect()
    assert sorted((r.run_id, r.app_id, r.total_reviews) for r in rows) == [
        ("7", "1", 5), ("7", "2", 1), ("7", "4", 1), ("a", "1", 2), ("a", "2", 1), ("a", "4", 1),
    ]


def test_rows_are_counted_while_written(spark, scorer, tmp_out):
    summary = run(*landed(spark), tmp_out, RunConfig(**CONFIG), scorer).summary.collect()
    written = {kind: sum(map(len, rows_of(f"{tmp_out}/{kind}").values())) for kind in ("reviews", "analysis")}
    assert {(r.run_reviews_rows, r.run_analysis_rows) for r in summary} == {(written["reviews"], written["analysis"])} == {(7, 7)}
    assert all(r.run_reviews_seconds >= 0 and r.run_analysis_seconds >= 0 for r in summary)


def test_run_split_and_extended(spark, scorer, tmp_out):
    config = RunConfig(**(CONFIG | dict(single_file=False, extended_fields=True, output_mode="analysis")))
    result = run(*landed(spark), tmp_out, config, scorer)
    out = rows_of(tmp_out + "/analysis")
    assert set(out) == {
        "one_app_store_reviews_analysis", "one_google_play_reviews_analysis",
        "two_app_store_reviews_analysis", "four_google_play_reviews_analysis",
    }
    assert not os.path.exists(tmp_out + "/reviews") and len(result.paths) == 1
    row = out["one_google_play_reviews_analysis"][0]
    assert row["thumbs_up_count"] == "1" and row["developer_reply"] == "" and "review_title" in row
    files = {r.app_id: r.files_written for r in result.summary.collect()}
    assert files["2"] == ["two_app_store_reviews_analysis"]


def test_page_cap_override(spark, tmp_out):
    config = RunConfig(**(CONFIG | dict(output_mode="reviews", max_pages=1)))
    result = run(*landed(spark), tmp_out, config)
    counts = {r.app_id: r.by_platform for r in result.summary.collect()}
    assert counts["1"] == '{"app_store":3,"google_play":1}'
    assert result.rejected.first().exit_code == 1


def test_run_one_platform_and_strict(spark, tmp_out):
    config = RunConfig(**(CONFIG | dict(platforms=("app-store",), output_mode="reviews", strict_page=True)))
    result = run(*landed(spark), tmp_out, config)
    summary = {r.app_id: r for r in result.summary.collect()}
    assert summary["1"].by_platform == '{"app_store":3}'
    assert summary["2"].status == "failed"  # its only page holds a malformed entry
    # an app without a selected platform is a settings error
    assert {r.app_id: r.errors for r in result.rejected.collect()}["4"] == ["no_platform"]


def test_a_failing_platform_leaves_the_other(spark, scorer, tmp_out):
    catalog, pages, batches = landed(spark)
    broken = batches.withColumn("batch", F.expr("IF(page > 0, raise_error('lost'), batch)").cast(batches.schema["batch"].dataType))
    with pytest.raises(Exception, match="lost"):
        run(catalog, pages, broken, tmp_out, RunConfig(**CONFIG), scorer)
    config = RunConfig(**(CONFIG | dict(keep_going=True)))
    result = run(catalog, pages, broken, tmp_out, config, scorer)
    summary = {r.app_id: r for r in result.summary.collect()}
    assert summary["1"].status == "partial" and summary["1"].platforms_failed == ["google-play"]
    assert summary["4"].status == "failed"
    assert "lost" in json.loads(summary["1"].platform_errors)["google-play"]


def test_summary_counts_what_was_not_read(spark, tmp_out):
    catalog, pages, batches = landed(spark)
    more = [("2", "us", 2, json.dumps(feed(post({"updated": "some day"}), post({"im:rating": None})))), ("2", "gb", 1, '{"feed"')]
    pages = pages.unionByName(spark.createDataFrame(more, schema.APP_STORE_PAGES))
    result = run(catalog, pages, batches, tmp_out, RunConfig(**(CONFIG | dict(output_mode="reviews"))))
    row = {r.app_id: r for r in result.summary.collect()}["2"]
    assert (row.n_bad, row.n_undated, row.n_rejected, row.n_unreadable) == (1, 1, 1, 1)


def test_a_repeated_catalog_row_writes_no_review_twice(spark, tmp_out):
    catalog, pages, batches = landed(spark)
    twice = catalog.unionByName(catalog.where("app_id = '1'"))
    result = run(twice, pages, batches, tmp_out, RunConfig(**(CONFIG | dict(output_mode="reviews"))))
    assert {r.app_id for r in result.rejected.collect()} == {"1", "3"}
    assert set(rows_of(tmp_out + "/reviews")) == {"two_reviews", "four_reviews"}
    assert result.summary.groupBy("app_id").count().where("count > 1").isEmpty()


def test_interrupted_and_empty(spark, scorer, tmp_out):
    catalog, pages, batches = landed(spark)
    config = RunConfig(**(CONFIG | dict(interrupted=True)))
    result = run(catalog, pages.limit(0), batches.limit(0), tmp_out, config, scorer)
    assert {(r.status, r.exit_code) for r in result.summary.collect()} == {("interrupted", 130)}
    assert result.paths == () and not os.path.exists(tmp_out + "/reviews")


def test_settings(spark):
    with pytest.raises(ValueError):
        RunConfig(as_of=AS_OF, output_mode="everything")
    with pytest.raises(ValueError):
        run(*landed(spark), "/tmp/unused", RunConfig(as_of=AS_OF))


def test_csv_is_quoted_and_survives(spark, tmp_out):
    rows = [(datetime.date(2024, 5, 1), 3, ' "a",\r\nb\\ "" ', None), (None, None, "", "x")]
    frame = spark.createDataFrame(rows, "d date, n int, t string, u string").coalesce(1)
    assert write_csv(frame, tmp_out)
    (part,) = glob.glob(tmp_out + "/part-*.csv")
    with open(part, "rb") as f:
        data = f.read()
    assert data.startswith(b'"d","n","t","u"\n"2024-05-01","3"," ""a"",')
    with open(part, encoding="utf-8", newline="") as f:
        back = list(csv.reader(f))
    assert back[1][2] == rows[0][2] and back[2] == ["", "", "", "x"]
    again = read_csv(spark, tmp_out, "d string, n int, t string, u string").orderBy(F.desc("d")).collect()
    assert again[0].t == rows[0][2] and again[0].n == 3


def test_csv_of_nothing_is_not_written(spark, tmp_out):
    assert not write_csv(spark.range(0), tmp_out)
    assert not os.path.exists(tmp_out)


def test_staged_tables_are_in_the_shared_folder(spark):
    frame = staged(spark.range(5), "check")
    assert frame.count() == 5
    assert frame.inputFiles()[0].removeprefix("file://").startswith(shared_dir(spark).removeprefix("file:"))


# ---- incremental ------------------------------------------------------------

ROW = (
    "platform string, app_id string, country string, page int, entry_pos int, "
    "review_ts timestamp, review_date date, star_rating int, review_text string"
)


def stream_rows(texts, page=1, days=10):
    moment = at(days)
    return [
        (APP_STORE, "1", "us", page, i, moment, moment.date(), 5, t) for i, t in enumerate(texts)
    ]


def land(spark, path, rows):
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").json(path)


def run_stream(spark, source, out, checkpoint):
    landed_rows = spark.readStream.schema(ROW).json(source)
    kept = stream_dedup(landed_rows, AS_OF)
    run_available(kept.select("platform", "app_id", "review_date", "star_rating", "text_hash"), out, checkpoint)
    return spark.read.parquet(out)


def test_stream_takes_up_new_pages_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    land(spark, source, stream_rows(["a", "b", "a"]) + stream_rows(["old"], days=366))
    assert run_stream(spark, source, out, checkpoint).count() == 2
    land(spark, source, stream_rows(["a", "c"], page=2) + stream_rows(["edge"], days=365))
    assert run_stream(spark, source, out, checkpoint).count() == 4
    # a day after as_of must not push everything else out of the window
    land(spark, source, stream_rows(["future"], days=-400))
    land(spark, source, stream_rows(["edge", "d"], days=365))
    assert run_stream(spark, source, out, checkpoint).count() == 6
    land(spark, source, stream_rows(["e", "future"], days=365) + stream_rows(["future"], days=-400))
    assert run_stream(spark, source, out, checkpoint).count() == 8


def test_stream_in_one_or_many_batches_keeps_the_same_keys(spark, tmp_path):
    texts = ["hot"] * 60 + [f"t{i % 17}" for i in range(90)]
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    land(spark, one, stream_rows(texts))
    for i in range(0, 150, 50):
        land(spark, many, stream_rows(texts[i:i + 50], page=i))
    a = run_stream(spark, one, one + "-out", one + "-state")
    b = run_stream(spark, many, many + "-out", many + "-state")
    assert a.count() == b.count() == 18
    assert a.exceptAll(b).count() == 0


def test_a_run_reads_catalog_and_batches_once(spark, scorer, tmp_out):
    """The catalog is checked once for all joins with its apps, the batches are worked out once for walk and reviews."""
    catalog, pages, batches = landed(spark)
    read = {"catalog": spark.sparkContext.accumulator(0), "batches": spark.sparkContext.accumulator(0)}

    def counted(df, name):
        def run_of(rows):
            for batch in rows:
                read[name].add(batch.num_rows)
                yield batch

        return df.mapInArrow(run_of, df.schema)

    run(counted(catalog, "catalog"), pages, counted(batches, "batches"), tmp_out, RunConfig(**CONFIG), scorer)
    assert read["catalog"].value == len(CATALOG)
    assert read["batches"].value == batches.count()
    assert set(rows_of(tmp_out + "/reviews")) == {"one_reviews", "two_reviews", "four_reviews"}
