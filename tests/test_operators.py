"""Walks, dedup, order, unions, aggregates."""

import datetime
import random

from pyspark.sql import functions as F

from revlume.functions.naming import APP_STORE, GOOGLE_PLAY
from revlume.operators.aggregates import (
    count_by_platform, exit_code, run_status, run_summary, throughput,
)
from revlume.operators.combine import union_all
from revlume.operators.dedup import country_order, dedup_first_seen
from revlume.operators.filters import in_countries, on_platforms, within_window
from revlume.operators.joins import fits, heavy_keys, only, spread, with_attributes, without
from revlume.operators.ordering import sort_reviews
from revlume.operators.walk import (
    batch_stats, keep_reached, mark_reached, oldest_per_page, order_breaks,
)
from revlume.schema import GOOGLE_PLAY_BATCHES, GOOGLE_WALK_KEY

UTC = datetime.timezone.utc
AS_OF = datetime.datetime(2024, 12, 31, tzinfo=UTC)
CUTOFF = datetime.datetime(2024, 1, 1, tzinfo=UTC)


def day(n):
    """n days before AS_OF."""
    return AS_OF - datetime.timedelta(days=n)


def walk_by_hand(pages, cap):
    """pages: {page: (n_rows, oldest, is_last)} of one walk; pages reached."""
    reached = []
    for page in range(1, cap + 1):
        n, oldest, is_last = pages.get(page, (0, None, False))
        if n == 0:
            break
        reached.append(page)
        if (oldest is not None and oldest < CUTOFF) or is_last:
            break
    return reached


def test_walk_against_a_loop(spark):
    rng = random.Random(7)
    rows, expected = [], set()
    for app in range(120):
        pages = {}
        for page in range(1, 9):
            if rng.random() < 0.08:
                continue
            n = 0 if rng.random() < 0.05 else 3
            oldest = None if rng.random() < 0.05 else day(rng.choice([10, 100, 365, 366, 400] if page > 3 else [10, 100, 365]))
            pages[page] = (n, oldest, rng.random() < 0.05)
        rows += [(str(app), "us", p, *v) for p, v in pages.items()]
        expected |= {(str(app), p) for p in walk_by_hand(pages, 6)}
    stats = spark.createDataFrame(
        rows, "app_id string, country string, page int, n_rows long, oldest_ts timestamp, is_last boolean"
    )
    for frame in (stats, stats.repartition(13), stats.union(stats)):  # order and copies do not matter
        marked = mark_reached(frame, AS_OF, 6, F.col("is_last"))
        got = {(r.app_id, r.page) for r in marked.where("reached").collect()}
        assert got == expected


def test_walk_keeps_the_crossing_page_but_not_the_next(spark):
    rows = [("a", "us", p, day(d)) for p, d in [(1, 5), (1, 9), (2, 300), (2, 366), (3, 20), (4, 30)]]
    reviews = spark.createDataFrame(rows, "app_id string, country string, page int, review_ts timestamp")
    marked = mark_reached(oldest_per_page(reviews), AS_OF, 20)
    for bound in (0, 10):  # joined by shuffle and by broadcast
        kept = keep_reached(reviews, marked, 20, max_broadcast_rows=bound)
        assert sorted(r.page for r in kept.collect()) == [1, 1, 2, 2]
    inside = within_window(kept, AS_OF)
    assert inside.count() == 3


def test_walk_is_per_country_and_needs_page_one(spark):
    rows = [("a", "us", 2, day(5)), ("a", "gb", 1, day(5)), ("a", "gb", 2, day(6)), ("a", "gb", 4, day(7))]
    reviews = spark.createDataFrame(rows, "app_id string, country string, page int, review_ts timestamp")
    marked = mark_reached(oldest_per_page(reviews), AS_OF, 20).where("reached")
    assert sorted((r.country, r.page) for r in marked.collect()) == [("gb", 1), ("gb", 2)]


def test_batch_stats_use_every_time(spark):
    def item(at, score=4.0, text="x"):
        return (at, score, None, text, None, None, None)

    rows = [
        ("a", "en", "us", 1, "t", [item(day(3)), item(None)]),
        ("a", "en", "us", 2, "t", [item(day(400), None, None)]),  # dropped later, but ends the walk
        ("a", "en", "us", 3, "t", [item(day(4))]),
        ("b", "en", "us", 1, "t", [item(None)]),  # no time: does not stop
        ("b", "en", "us", 2, None, [item(day(4))]),
        ("b", "en", "us", 3, "t", [item(day(4))]),
        ("c", "en", "us", 1, "t", []),
        ("c", "en", "us", 2, "t", None),
    ]
    stats = batch_stats(spark.createDataFrame(rows, GOOGLE_PLAY_BATCHES))
    got = {(r.app_id, r.page): (r.n_rows, r.is_last) for r in stats.collect()}
    assert got[("a", 1)] == (2, False) and got[("b", 2)] == (1, True) and got[("c", 2)][0] == 0
    reached = mark_reached(stats, AS_OF, None, F.col("is_last"), GOOGLE_WALK_KEY).where("reached").collect()
    assert sorted((r.app_id, r.page) for r in reached) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_null_countries_are_walked_like_others(spark):
    rows = [("a", None, p, day(p)) for p in (1, 3)] + [("a", "us", p, day(p)) for p in (1, 2)]
    reviews = spark.createDataFrame(rows, "app_id string, country string, page int, review_ts timestamp")
    marked = mark_reached(oldest_per_page(reviews), AS_OF)
    for bound in (0, 10):
        kept = keep_reached(reviews, marked, max_broadcast_rows=bound).collect()
        assert sorted((str(r.country), r.page) for r in kept) == [("None", 1), ("us", 1), ("us", 2)]


def test_survivor_does_not_depend_on_file_order(spark):
    rows = [("p", "1", "zz", 9, 1, 1, datetime.date(2024, 5, 1), 3, "same", name) for name in ("H. D.", "X. F.", "A. B.")]
    names = (
        "platform string, app_id string, country string, country_order int, page int, entry_pos int, "
        "review_date date, star_rating int, review_text string, reviewer_anonymized string"
    )
    for order in (rows, rows[::-1]):
        (row,) = dedup_first_seen(spark.createDataFrame(order, names)).collect()
        assert row.reviewer_anonymized == "A. B."


def test_page_cap(spark):
    rows = [("a", "us", p, day(p)) for p in range(1, 9)]
    reviews = spark.createDataFrame(rows, "app_id string, country string, page int, review_ts timestamp")
    marked = mark_reached(oldest_per_page(reviews), AS_OF, 3)
    assert sorted(r.page for r in keep_reached(reviews, marked, 3).collect()) == [1, 2, 3]


def test_order_breaks(spark):
    rows = [("a", "us", 1, day(1), day(5)), ("a", "us", 2, day(4), day(9)), ("a", "us", 3, day(10), day(12))]
    stats = spark.createDataFrame(rows, "app_id string, country string, page int, newest_ts timestamp, oldest_ts timestamp")
    assert [r.page for r in order_breaks(stats).collect()] == [2]


def test_window_is_inclusive(spark):
    rows = [(1, CUTOFF), (2, CUTOFF - datetime.timedelta(microseconds=1)), (3, AS_OF), (4, day(-5))]
    frame = spark.createDataFrame(rows, "i int, review_ts timestamp")
    assert sorted(r.i for r in within_window(frame, AS_OF).collect()) == [1, 3, 4]
    naive = frame.withColumn("review_ts", F.col("review_ts").cast("timestamp_ntz"))
    assert sorted(r.i for r in within_window(naive, AS_OF).collect()) == [1, 3, 4]


REVIEWS = "platform string, app_id string, country string, page int, entry_pos int, review_date date, star_rating int, review_text string, who string"


def reviews(spark, n=400, seed=3):
    rng = random.Random(seed)
    d = datetime.date(2024, 5, 1)
    rows = []
    for i in range(n):
        text = "good" if rng.random() < 0.35 else rng.choice("abcdef") * rng.randint(1, 3)
        rows.append(
            (rng.choice([APP_STORE, GOOGLE_PLAY]), rng.choice("xy"), rng.choice(["us", "gb"]), i // 20, i % 20,
             d + datetime.timedelta(days=rng.randint(0, 2)), rng.randint(4, 5), text, str(i))
        )
    return rows


def dedup(frame):
    placed = frame.withColumn("country_order", country_order(["us", "gb"]))
    return dedup_first_seen(placed)


def test_dedup_first_seen_against_a_set(spark):
    rows = reviews(spark)
    expected, seen = set(), set()
    for r in sorted(rows, key=lambda r: (["us", "gb"].index(r[2]), r[3], r[4])):
        key = (r[0], r[1], r[5], r[6], r[7])
        if key not in seen:
            seen.add(key)
            expected.add(r[8])
    frame = spark.createDataFrame(rows, REVIEWS)
    once = dedup(frame)
    assert {r.who for r in once.collect()} == expected
    # neither the order of rows nor their partitions matter, and it is idempotent
    random.Random(1).shuffle(rows)
    assert {r.who for r in dedup(spark.createDataFrame(rows, REVIEWS).repartition(11)).collect()} == expected
    assert {r.who for r in dedup_first_seen(once).collect()} == expected


def test_dedup_ignores_who_and_where_but_not_platform(spark):
    d = datetime.date(2024, 5, 1)
    rows = [
        (APP_STORE, "x", "gb", 1, 0, d, 5, "Great!", "second"),
        (APP_STORE, "x", "us", 9, 9, d, 5, "Great!", "first"),
        (GOOGLE_PLAY, "x", "us", 1, 0, d, 5, "Great!", "other store"),
        (APP_STORE, "y", "us", 1, 0, d, 5, "Great!", "other app"),
        (APP_STORE, "x", "us", 1, 1, d, 4, "Great!", "other stars"),
    ]
    got = {r.who for r in dedup(spark.createDataFrame(rows, REVIEWS)).collect()}
    assert got == {"first", "other store", "other app", "other stars"}


def test_sort(spark):
    rows = reviews(spark)
    got = sort_reviews(spark.createDataFrame(rows, REVIEWS)).collect()
    keys = [(r.review_date, r.star_rating) for r in got]
    assert keys == sorted(keys, reverse=True) and len(got) == len(rows)


def test_unions_and_filters(spark):
    a = spark.createDataFrame([(APP_STORE, "us", "t")], "platform string, country string, review_title string")
    b = spark.createDataFrame([(GOOGLE_PLAY, "us", 3)], "platform string, country string, thumbs_up_count int")
    both = union_all(a, b)
    assert sorted(both.columns) == ["country", "platform", "review_title", "thumbs_up_count"]
    assert union_all(both, both).count() == 4
    assert on_platforms(both, ["google-play"]).first().thumbs_up_count == 3
    assert in_countries(both, ["gb"]).count() == 0


def test_joins_by_broadcast_and_by_shuffle(spark):
    rows, listed = spark.range(10), spark.createDataFrame([(3,), (4,)], "id long")
    names = spark.createDataFrame([(3, "c")], "id long, name string")
    assert fits(listed, 2) and not fits(listed, 1)
    for bound in (0, 10):
        assert without(rows, listed, ["id"], bound).count() == 8
        assert only(rows, listed, ["id"], [], bound).count() == 2
        named = with_attributes(rows, names, ["id"], [], bound)
        assert named.count() == 10 and named.where("name = 'c'").count() == 1


def test_what_is_broadcast_is_bounded_in_bytes(spark):
    wide = spark.range(3).selectExpr("id", "repeat('x', 1000) AS name", "array(repeat('y', 1000)) AS more")
    assert fits(wide, 3, 10_000) and not fits(wide, 3, 5_000) and not fits(wide.select("id", "more"), 3, 2_000)
    assert fits(wide.limit(0), 0, 0) and fits(wide.selectExpr("CAST(NULL AS string) AS name"), 3, 100)


def test_only_heavy_keys_are_repeated(spark):
    # a third of all rows has one key, a tenth has none, all others are rare
    rows = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 10 = 1 THEN NULL ELSE concat('k', id) END AS k", "id AS place"
    )
    listed = rows.select("k").distinct()
    heavy = {r["_key"]: r["_salts"] for r in heavy_keys(rows, ["k"], 100).collect()}
    hashed = listed.where("k = 'hot' OR k IS NULL").select("k", F.xxhash64("k").alias("h")).collect()
    shares = {r.k: heavy.pop(r.h) for r in hashed}
    assert not heavy and 34 <= shares["hot"] <= 35 and 6 <= shares[None] <= 8
    dealt, copies = spread(rows, listed, ["k"], ["place"], 100)
    assert copies.count() == listed.count() + sum(shares.values()) - 2
    per_salt = dealt.groupBy("k", "_salt").count().agg(F.max("count")).first()[0]
    assert per_salt < 600
    assert heavy_keys(rows.limit(0), ["k"]).count() == 0
    kept = only(rows, listed, ["k"], ["place"], 0)
    assert kept.count() == 30_000


def test_hot_keys_are_salted_beyond_the_bound(spark):
    rows = spark.range(300).selectExpr("IF(id % 3 = 0, 7, id) AS k", "id AS place")
    listed = spark.createDataFrame([(7, "hot"), (8, "b")], "k long, name string")
    for bound in (0, 10):
        kept = only(rows, listed, ["k"], ["place"], bound)
        assert kept.columns == ["k", "place"] and kept.count() == 102
        named = with_attributes(rows, listed, ["k"], ["place"], bound)
        assert named.count() == 300 and named.where("name = 'hot'").count() == 101
    plan = only(rows, listed, ["k"], ["place"], 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_counts_have_a_row_per_selected_platform(spark):
    frame = spark.createDataFrame([(APP_STORE,)] * 3, "platform string")
    got = {r.platform_key: r.n_reviews for r in count_by_platform(frame, ["app-store", "google-play"]).collect()}
    assert got == {"app_store": 3, "google_play": 0}


def test_status_and_code(spark):
    frame = spark.createDataFrame(
        [(5, 0, False), (5, 1, False), (0, 2, False), (0, 2, True), (5, 0, True)],
        "total int, failed int, stop boolean",
    )
    status = run_status(F.col("total"), F.col("failed"), F.col("stop"))
    rows = frame.select(status.alias("s"), exit_code(status).alias("c")).collect()
    assert [(r.s, r.c) for r in rows] == [
        ("success", 0), ("partial", 2), ("failed", 3), ("interrupted", 130), ("interrupted", 130),
    ]


def test_run_summary(spark):
    catalog = spark.createDataFrame(
        [("x", ["app-store", "google-play"]), ("y", ["google-play", "app-store"]), ("z", ["app-store"]), ("w", ["app-store"])],
        "app_id string, platforms array<string>",
    )
    frame = spark.createDataFrame(
        [("x", APP_STORE), ("x", APP_STORE), ("x", GOOGLE_PLAY), ("z", GOOGLE_PLAY), ("w", APP_STORE)], "app_id string, platform string"
    )
    got = {r.app_id: r for r in run_summary(catalog, frame).collect()}
    assert got["x"].by_platform == '{"app_store":2,"google_play":1}' and got["x"].status == "success"
    assert got["y"].platforms_failed == ["google-play", "app-store"] and got["y"].exit_code == 3
    assert got["z"].by_platform == '{"app_store":0}' and got["z"].total_reviews == 0
    assert got["w"].total_reviews == 1 and got["w"].platforms_failed == []


def test_throughput(spark):
    frame = spark.createDataFrame([(10, 2.0), (10, 0.0), (10, None)], "n long, s double")
    assert [r[0] for r in frame.select(throughput(F.col("n"), F.col("s"))).collect()] == [5.0, None, None]
