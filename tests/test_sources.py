"""Raw pages and batches: flattening, validity, malformed entries."""

import datetime
import json

from pyspark.sql import functions as F

from revlume import schema
from revlume.operators.projections import extended_columns, standard_columns
from revlume.sources.app_store import page_reviews, page_stats, parse_app_store, read_pages
from revlume.sources.catalog import catalog_errors, request_frontier, usable_apps
from revlume.sources.google_play import parse_google_play

UTC = datetime.timezone.utc


LABELS = {
    "im:rating": "3", "content": "Loads fast on the train", "title": "Handy",
    "updated": "2024-03-09T06:30:00Z", "author": "Mira Okafor",
}


def post(changes=None, raw=None):
    """A feed entry: labels by field, and fields given as they are ("absent" leaves one out)."""
    labelled = {field: {"label": text} for field, text in (LABELS | (changes or {})).items()}
    labelled["author"] = {"name": labelled["author"]}
    return {field: value for field, value in (labelled | (raw or {})).items() if value != "absent"}


def pages(spark, *bodies):
    rows = [
        ("1", "us", i + 1, b if isinstance(b, (str, type(None))) else json.dumps(b))
        for i, b in enumerate(bodies)
    ]
    return spark.createDataFrame(rows, schema.APP_STORE_PAGES)


def feed(*entries):
    return {"feed": {"entry": list(entries)}}


def parse(spark, *entries, **options):
    rows = parse_app_store(pages(spark, feed(*entries)), **options)
    return [r.asDict() for r in rows.orderBy("page", "entry_pos").collect()]


def statuses(spark, *entries):
    rows = page_reviews(read_pages(pages(spark, feed(*entries))), only_ok=False)
    return [r.status for r in rows.orderBy("entry_pos").collect()]


def test_valid_entry(spark):
    (row,) = parse(spark, post())
    assert row["star_rating"] == 3
    assert row["review_text"] == "Loads fast on the train"
    assert row["platform"] == "App Store"
    assert row["reviewer_anonymized"] == "M.O."
    assert row["review_date"] == datetime.date(2024, 3, 9)
    assert row["review_title"] == "Handy"


def test_null_rating_and_content(spark):
    assert parse(spark, post({"im:rating": None, "content": None})) == []


def test_empty_content_falls_back_to_title(spark):
    (row,) = parse(spark, post({"content": "", "title": "Works offline"}))
    assert row["review_text"] == "Works offline"


def test_title_kept_only_when_it_differs(spark):
    rows = parse(
        spark, post({"content": "Maps no longer stutter", "title": "Since the update"}),
        post({"content": "Said twice", "title": "Said twice"}),
    )
    assert [r["review_title"] for r in rows] == ["Since the update", None]


def test_text_is_collapsed(spark):
    (row,) = parse(spark, post({"content": "  a\u00a0\x1cb\n c\u3000"}))
    assert row["review_text"] == "a b c"


def test_own_day_and_instant(spark):
    (row,) = parse(spark, post({"updated": "2024-06-01T23:30:00-07:00"}))
    assert row["review_date"] == datetime.date(2024, 6, 1)
    frame = parse_app_store(pages(spark, feed(post({"updated": "2024-06-01T23:30:00-07:00"}))))
    assert frame.select(F.unix_seconds("review_ts")).first()[0] == 1717309800


def test_release_date_is_the_fallback(spark):
    released = {"label": "2024-05-05T00:00:00Z"}
    rows = parse(
        spark, post({"updated": None}, {"im:releaseDate": released}),
        post(raw={"updated": "absent", "im:releaseDate": released}),
        post({"updated": ""}, {"im:releaseDate": released}),
    )
    assert {r["review_date"] for r in rows} == {datetime.date(2024, 5, 5)} and len(rows) == 3


def test_skipped_entries(spark):
    assert statuses(
        spark, post({"im:rating": "bad"}), post({"im:rating": None}), post({"im:rating": 4.5}), post({"im:rating": True}),
        post({"im:rating": "4.0"}), post({"updated": None}), post({"updated": "soon"}), post({"updated": 5}),
        post({"content": None, "title": None}), post({"content": " ", "title": "\n"}), post(raw={"im:rating": "absent"}),
    ) == ["skip"] * 5 + ["undated"] * 3 + ["skip"] * 3


def test_ratings_are_clamped(spark):
    rows = parse(spark, post({"im:rating": "0"}), post({"im:rating": "9"}), post({"im:rating": 3}), post({"im:rating": 10**30}))
    assert [r["star_rating"] for r in rows] == [1, 5, 3, 5]


def test_missing_wrappers_are_fine(spark):
    (row,) = parse(spark, post(raw={"author": {"name": {}}, "title": {}}))
    assert row["reviewer_anonymized"] == "A."
    (row,) = parse(spark, {k: v for k, v in post().items() if k not in ("author", "title")})
    assert row["reviewer_anonymized"] == "A." and row["review_title"] is None


MALFORMED = [
    post(raw={"author": None}), post(raw={"author": "x"}), post(raw={"author": {"name": "x"}}),
    post({"author": 5}), post(raw={"title": None}), post({"title": 7}), post({"content": 7}),
    post(raw={"im:rating": None}), post(raw={"content": "x"}), post(raw={"updated": "x"}),
    post({"updated": None}, {"im:releaseDate": "x"}), "text", 7, None, [],
]


def test_malformed_entries(spark):
    assert statuses(spark, *MALFORMED) == ["bad"] * len(MALFORMED)


def test_skip_comes_before_malformed(spark):
    # the rating is read before the author, the date before the title
    assert statuses(
        spark, post({"im:rating": "bad"}, {"author": "x"}), post({"updated": "soon"}, {"title": None}),
        post({"updated": "2024-06-01"}, {"im:releaseDate": "x"}),
    ) == ["skip", "undated", "ok"]


def test_isolate_and_strict(spark):
    body, clean = feed(post(), post(raw={"author": "x"})), feed(post())
    frame = pages(spark, body, clean)
    assert parse_app_store(frame).count() == 2
    assert [r.page for r in parse_app_store(frame, strict_page=True).collect()] == [2]


def test_page_shapes(spark):
    frame = pages(
        spark, {"feed": {"entry": post()}}, {"feed": {}}, {"feed": {"entry": None}}, {"feed": None},
        {}, [], "garbage", None, feed(), feed(post(), post()),
    )
    found = {r.page: r.n for r in parse_app_store(frame).groupBy("page").agg(F.count("*").alias("n")).collect()}
    assert found == {1: 1, 10: 2}
    stats = {r.page: (r.n_rows, r.n_bad) for r in page_stats(read_pages(frame)).collect()}
    assert len(stats) == 10 and stats[10] == (2, 0) and stats[7] == (0, 0)
    unreadable = {r.page for r in page_stats(read_pages(frame)).collect() if r.n_unreadable}
    assert unreadable == {7}


def test_repeated_keys_are_read(spark):
    body = json.dumps(feed(post({"content": "second"}))).replace('"content":', '"content": {"label": "first"}, "content":')
    frame = pages(spark, body)
    (row,) = parse_app_store(frame).collect()
    assert row.review_text == "second" and row.star_rating == 3 and row.reviewer_anonymized == "M.O."
    assert page_stats(read_pages(frame)).first().n_unreadable == 0


def test_repeated_apps_and_names(spark):
    rows = [("x", "one", GOOD_A, GOOD_G, BOTH), ("x", "two", GOOD_A, GOOD_G, BOTH), ("y", "two", GOOD_A, GOOD_G, BOTH + BOTH)]
    found = catalog_errors(spark.createDataFrame(rows, schema.APP_CATALOG)).orderBy("app_id", "app_name").collect()
    assert [r.errors for r in found] == [["app_id_repeated"], ["app_id_repeated", "app_name_repeated"], ["app_name_repeated"]]
    assert found[2].platforms == BOTH


def test_rows_without_an_id_or_a_name_repeat_nothing(spark):
    rows = [(f"app{i}", None if i % 2 else " \t", GOOD_A, GOOD_G, BOTH) for i in range(6)]
    rows += [(None, "a", GOOD_A, GOOD_G, BOTH), ("", "b", GOOD_A, GOOD_G, BOTH), ("z", "c", GOOD_A, GOOD_G, BOTH)]
    found = catalog_errors(spark.createDataFrame(rows, schema.APP_CATALOG)).collect()
    errors = {(r.app_id, r.app_name): r.errors for r in found}
    assert len(found) == 9 and errors.pop(("z", "c")) == []
    assert errors.pop((None, "a")) == errors.pop(("", "b")) == ["app_id_missing"]
    assert set(map(tuple, errors.values())) == {("app_name_missing",)}
    assert catalog_errors(spark.createDataFrame([], schema.APP_CATALOG)).count() == 0


def test_projections(spark):
    rows = parse_app_store(pages(spark, feed(post())))
    assert standard_columns(rows).columns == schema.STANDARD_COLUMNS
    assert extended_columns(rows).columns == schema.STANDARD_COLUMNS + ["review_title"]


# ---- Google Play -----------------------------------------------------------

AT = datetime.datetime(2024, 6, 1, 23, 30, tzinfo=UTC)


def item(at=AT, score=4.0, name="Ilse Brandt", content="Opens quickly", thumbs=3, reply=None, replied=None):
    return (at, score, name, content, thumbs, reply, replied)


def google(spark, *items):
    rows = [("com.a.b", "en", "us", 1, None, list(items))]
    frame = parse_google_play(spark.createDataFrame(rows, schema.GOOGLE_PLAY_BATCHES))
    return [r.asDict() for r in frame.orderBy("entry_pos").collect()]


def test_google_valid(spark):
    (row,) = google(spark, item(reply=" thanks ", replied=AT))
    assert row["star_rating"] == 4 and row["platform"] == "Google Play Store"
    assert row["reviewer_anonymized"] == "I. B." and row["review_date"] == datetime.date(2024, 6, 1)
    assert row["thumbs_up_count"] == 3 and row["developer_reply"] == "thanks"
    assert row["developer_reply_date"] == datetime.date(2024, 6, 1)


def test_google_dropped(spark):
    assert google(
        spark, item(at=None), item(score=None), item(score=0.0), item(score=6.0), item(score=0.9),
        item(content=None), item(content=" \n\u00a0"), item(score=float("nan")),
    ) == []


def test_google_edges(spark):
    rows = google(
        spark, item(score=4.7), item(score=5.9), item(name=None), item(reply="  "),
        item(thumbs=None), item(content=" a  b "),
    )
    assert [r["star_rating"] for r in rows] == [4, 5, 4, 4, 4, 4]
    assert rows[2]["reviewer_anonymized"] == "A." and rows[3]["developer_reply"] is None
    assert rows[4]["thumbs_up_count"] == 0
    assert rows[5]["review_text"] == "a  b"  # ends only


def test_google_dates_are_utc_days(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        frame = spark.createDataFrame(
            [("a", "en", "us", 1, None, [item()])], schema.GOOGLE_PLAY_BATCHES
        )
        day = parse_google_play(frame).select(F.col("review_date").cast("string")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert day == "2024-06-01"


def test_google_batches_land_as_json(spark, tmp_path):
    path = str(tmp_path / "landed")
    rows = [("com.a.b", "en", "us", 1, None, [item()])]
    spark.createDataFrame(rows, schema.GOOGLE_PLAY_BATCHES).write.json(path)
    back = spark.read.schema(schema.GOOGLE_PLAY_BATCHES).json(path)
    assert parse_google_play(back).count() == 1


# ---- catalog ---------------------------------------------------------------

BOTH = ["app-store", "google-play"]
GOOD_A, GOOD_G = "901234567", "org.tidepool.notes"


def errors(spark, a=GOOD_A, g=GOOD_G, platforms=BOTH):
    frame = spark.createDataFrame([("x", "app", a, g, platforms)], schema.APP_CATALOG)
    return catalog_errors(frame).first().errors


def test_usable_catalog_rows(spark):
    assert errors(spark) == []
    assert errors(spark, platforms=["app-store"]) == []
    assert errors(spark, platforms=["google-play"]) == []


def test_placeholders(spark):
    assert errors(spark, a="123456789") == ["app_store_id_placeholder"]
    assert errors(spark, g="com.example") == ["google_play_id_placeholder"]


def test_id_formats(spark):
    assert errors(spark, a="id-77x") == ["app_store_id_malformed"]
    assert errors(spark, g="tidepoolnotes") == ["google_play_id_malformed"]
    assert errors(spark, g="9org.tidepool.notes") == ["google_play_id_malformed"]
    assert errors(spark, a=" ", g=None) == ["app_store_id_empty", "google_play_id_empty"]
    assert errors(spark, a="123456789\n") == ["app_store_id_malformed"]


def test_platform_selection(spark):
    assert errors(spark, platforms=[]) == ["no_platform"]
    assert errors(spark, platforms=None) == ["no_platform"]
    assert errors(spark, platforms=["app-store"], g="com.example") == []


def test_frontier(spark):
    frame = spark.createDataFrame(
        [("x", "app", "42", GOOD_G, BOTH), ("y", "b", "bad", GOOD_G, BOTH), ("z", "c", "7", GOOD_G, ["google-play"])],
        schema.APP_CATALOG,
    )
    assert [r.app_id for r in usable_apps(frame).orderBy("app_id").collect()] == ["x", "z"]
    rows = request_frontier(frame, ["us", "gb"], 2).orderBy("country_order", "page").collect()
    assert [(r.app_id, r.country, r.page) for r in rows] == [
        ("x", "us", 1), ("x", "us", 2), ("x", "gb", 1), ("x", "gb", 2),
    ]
    assert rows[1].url.endswith("/us/rss/customerreviews/page=2/id=42/sortby=mostrecent/json")
    assert request_frontier(frame, ["us"], 0).count() == 0


def test_google_times_without_zone_are_utc(spark):
    from revlume.operators.walk import batch_stats

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        naive = schema.GOOGLE_PLAY_BATCHES.simpleString().replace("timestamp", "timestamp_ntz")
        moment = datetime.datetime(2024, 6, 1, 23, 30)
        frame = spark.createDataFrame([("a", "en", "us", 1, None, [item(at=moment, replied=moment)])], naive)
        row = parse_google_play(frame).select(
            F.unix_seconds("review_ts"), F.col("review_date").cast("string"),
            F.col("developer_reply_date").cast("string"),
        ).first()
        oldest = batch_stats(frame).select(F.unix_seconds("oldest_ts")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert tuple(row) == (1717284600, "2024-06-01", "2024-06-01") and oldest == 1717284600
