"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from revlume.functions import (
    clamp_star_rating, clean_text, first_non_empty, initials_app_store,
    initials_google_play, is_star, local_date, output_name, parse_timestamp,
    sentiment_label, strip_text, text_hash, title_if_differs, utc_date,
    whole_score,
)
from revlume.operators.aggregates import (
    count_by_platform, exit_code, run_status, run_summary, throughput,
)
from revlume.operators.analysis import analyze_reviews, choose_scorer
from revlume.operators.combine import union_all
from revlume.operators.dedup import DEDUP_KEY, country_order, dedup_first_seen
from revlume.operators.filters import in_countries, on_platforms, within_window
from revlume.operators.ordering import sort_reviews
from revlume.operators.projections import extended_columns, standard_columns
from revlume.operators.phrases import MAX_PHRASES, Phrase
from revlume.operators.sentiment import Rules, lexicon_score, phrase_spans
from revlume.operators.walk import (
    batch_stats, keep_reached, mark_reached, oldest_per_page, order_breaks,
)
from revlume.plans import views
from revlume.plans.full_run import RunConfig, run
from revlume.plans.views import AS_OF, COUNTRIES, EVENTS_AS_OF, table
from revlume.schema import APP_STORE_PAGES, GOOGLE_PAGE_KEY, GOOGLE_WALK_KEY, PAGE_KEY
from revlume.session import scratch_path, staged
from revlume.sources.app_store import (
    page_quality, page_reviews, page_stats, parse_app_store, read_pages, with_page_stats,
)
from revlume.sources.catalog import catalog_errors, request_frontier
from revlume.sources.google_play import parse_google_play
from revlume.sources.landed import land_files, landed_app_store, landing_report
from revlume.sources.partitioned import read_landing, write_landing
from revlume.sources.sinks import read_csv, read_summary, write_csv
from revlume.streaming.dedup import run_available, stream_dedup
from revlume.streaming.first_seen import settled, stream_first_seen
from revlume.streaming.walk import settled_pages, stream_walk

BOTH = ["app-store", "google-play"]

# Word lists that occur in the test texts, so that every rule is exercised.
TEST_RULES = Rules(
    intensifiers=("the", "la", "der", "so"),
    diminishers=("and", "en", "und"),
    negations=("is", "de", "not"),
    contrast="for",
)


def shown(col: Column) -> Column:
    """Text of a value, with a visible null."""
    return F.coalesce(col.cast("string"), F.lit("<null>"))


def day(name: str) -> Column:
    return shown(F.col(name)).alias(name)


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reviews_src`` with text, rating and name rules of its platform applied."""
    src = views.reviews_src(spark, sf_dir).where(strip_text(F.col("text")) != "")
    app_store = F.col("platform") == "App Store"
    rating = F.col("raw_rating")
    rows = src.select(
        "seq", "app_id", "platform", "country", "page", "entry_pos", "review_ts",
        country_order(COUNTRIES).alias("country_order"),
        utc_date(F.col("review_ts")).alias("review_date"),
        F.when(app_store, clamp_star_rating(rating))
        .otherwise(whole_score(rating)).alias("star_rating"),
        F.when(app_store, initials_app_store(F.col("author")))
        .otherwise(initials_google_play(F.col("author"))).alias("reviewer_anonymized"),
        F.when(app_store, clean_text(F.col("text")))
        .otherwise(strip_text(F.col("text"))).alias("review_text"),
        F.when(app_store, clean_text(F.col("title"))).alias("review_title"),
        F.when(~app_store, F.length("title")).alias("thumbs_up_count"),
    )
    return rows.where(is_star(F.col("star_rating")))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated reviews inside the window, each once."""
    return dedup_first_seen(within_window(rated(spark, sf_dir), AS_OF))


def lexicon_scorer(spark: SparkSession, sf_dir: str, key: list[str]):
    scorer, _ = choose_scorer(
        views.word_lexicon(spark, sf_dir), key, rules=TEST_RULES
    )
    return scorer


# ---- end to end -----------------------------------------------------------

def clean_review_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and rating rules, window, first-seen dedup, score, label, order."""
    ordered = sort_reviews(clean(spark, sf_dir))
    scored = analyze_reviews(ordered, lexicon_scorer(spark, sf_dir, ["seq"]))
    return scored.select(
        "seq", "app_id", "platform", day("review_date"), "star_rating",
        "reviewer_anonymized", "text_hash", "sentiment_score", "sentiment_label",
    )


def _collected(rows: DataFrame, stats: DataFrame, page_key: list[str], **kw):
    marked = mark_reached(stats, AS_OF, walk_key=page_key[:-1], **kw)
    kept = within_window(keep_reached(rows, marked, page_key=page_key), AS_OF)
    return dedup_first_seen(
        kept.withColumn("country_order", country_order(COUNTRIES))
    )


def collect_app_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw App Store pages to clean reviews: parse, walk, window, dedup."""
    read = staged(
        with_page_stats(read_pages(views.app_store_pages(spark, sf_dir))), "app-store"
    )
    found = _collected(page_reviews(read), page_stats(read), PAGE_KEY)
    return found.select(
        "app_id", "country", "page", "entry_pos", day("review_date"), "star_rating",
        "reviewer_anonymized", "text_hash",
    )


def pruned_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a landing in folders by country and bucket of apps, read for the countries and apps asked for."""
    path = scratch_path(spark, "landing")
    write_landing(views.app_store_pages(spark, sf_dir), path)
    apps = views.documents(spark, sf_dir).select(F.expr(f"concat('app-', doc_id div {views.DOCS_PER_APP})").alias("app_id"))
    pages = read_landing(spark, path, APP_STORE_PAGES, COUNTRIES, apps.distinct())
    read = staged(with_page_stats(read_pages(pages)), "app-store")
    return _collected(page_reviews(read), page_stats(read), PAGE_KEY).select(
        "app_id", "country", "page", "entry_pos", day("review_date"), "star_rating",
        "reviewer_anonymized", "text_hash",
    )


def collect_google_play(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw Google Play batches to clean reviews."""
    batches = views.google_play_batches(spark, sf_dir)
    found = _collected(
        parse_google_play(batches), batch_stats(batches), GOOGLE_PAGE_KEY,
        is_last=F.col("is_last"),
    )
    return found.select(
        "app_id", shown(F.col("country")).alias("country"), "lang", "page", "entry_pos", day("review_date"), "star_rating",
        "reviewer_anonymized", "text_hash",
    )


def full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run with all its outputs; the analysis files read back."""
    out = scratch_path(spark, "run")
    config = RunConfig(as_of=AS_OF, countries=tuple(COUNTRIES), extended_fields=True)
    result = run(
        views.app_catalog(spark, sf_dir), views.app_store_pages(spark, sf_dir),
        views.google_play_batches(spark, sf_dir), out, config,
        lexicon_scorer(spark, sf_dir, DEDUP_KEY),
    )
    columns = (
        "review_date string, star_rating int, reviewer_anonymized string, "
        "review_text string, platform string, review_title string, thumbs_up_count int, "
        "developer_reply string, developer_reply_date string, sentiment_score double, "
        "sentiment_label string, output_name string"
    )
    written = (
        read_csv(spark, f"{out}/analysis", columns)
        if result.paths
        else spark.createDataFrame([], columns)
    )
    return written.select(
        "output_name", "review_date", "star_rating", "reviewer_anonymized", "platform",
        text_hash(F.col("review_text")).alias("text_hash"),
        shown(F.col("thumbs_up_count")).alias("thumbs_up_count"),
        shown(F.col("developer_reply")).alias("developer_reply"),
        "sentiment_score", "sentiment_label",
    )


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run measures of itself: rows of each app and output, counted while written, and its times."""
    config = RunConfig(as_of=AS_OF, countries=tuple(COUNTRIES), output_mode="both")
    result = run(
        views.app_catalog(spark, sf_dir), views.app_store_pages(spark, sf_dir),
        views.google_play_batches(spark, sf_dir), scratch_path(spark, "metrics"), config,
        lexicon_scorer(spark, sf_dir, DEDUP_KEY),
    )
    parts = ["collecting_seconds", "run_reviews_seconds", "run_analysis_seconds"]
    times = F.forall(F.array("duration_seconds", *parts), lambda t: t.isNotNull() & (t >= 0))
    # Each time is rounded to a hundredth.
    whole = F.col("duration_seconds") + 0.05 >= sum((F.col(c) for c in parts), F.lit(0.0))
    return result.summary.select(
        "app_id", "status", "exit_code", "total_reviews", F.size("files_written").alias("n_files"),
        "run_reviews_rows", "run_analysis_rows", (times & whole).alias("times_ok"),
    )


def rerun_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary rows after a run, one of another id, and the first once more: each app has one row of each run."""
    out = scratch_path(spark, "rerun")
    config = RunConfig(as_of=AS_OF, countries=tuple(COUNTRIES), output_mode="reviews")
    landed = [
        staged(view(spark, sf_dir), "rerun-in")
        for view in (views.app_catalog, views.app_store_pages, views.google_play_batches)
    ]
    for run_id in ("first", "second", "first"):
        run(*landed, out, config, run_id=run_id)
    rows = read_summary(spark, f"{out}/run_summary", "app_id string, status string, total_reviews long")
    return rows.groupBy("run_id", "app_id", "status", "total_reviews").agg(F.count(F.lit(1)).alias("n_rows"))


def output_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs and their rows of a run with one file per platform and both kinds, and of a raw one."""
    catalog, pages, batches = (
        staged(view(spark, sf_dir), "layout")
        for view in (views.app_catalog, views.app_store_pages, views.google_play_batches)
    )
    found = []
    for mode, single in (("both", False), ("reviews", True)):
        out = scratch_path(spark, "layout-out")
        config = RunConfig(as_of=AS_OF, countries=tuple(COUNTRIES), output_mode=mode, single_file=single)
        result = run(catalog, pages, batches, out, config, lexicon_scorer(spark, sf_dir, DEDUP_KEY))
        for path in result.paths:
            names = read_csv(spark, path, "review_date string, output_name string").groupBy("output_name")
            found.append(names.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(mode).alias("mode"), "output_name", "n_rows"))
    none = spark.createDataFrame([], "mode string, output_name string, n_rows long")
    return union_all(none, *found)


# ---- sources and sinks ----------------------------------------------------

def app_store_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_app_store(views.app_store_pages(spark, sf_dir))
    return rows.select(
        "app_id", "country", "page", "entry_pos",
        F.unix_seconds("review_ts").alias("review_epoch"),
        day("review_date"), "star_rating", "reviewer_anonymized", "platform",
        text_hash(F.col("review_text")).alias("text_hash"),
        F.substring(F.sha2(F.coalesce("review_title", F.lit("")), 256), 1, 16).alias("title_hash"),
    )


def app_store_parse_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_app_store(views.app_store_pages(spark, sf_dir), strict_page=True)
    return rows.groupBy("app_id", "country", "page").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.sum("star_rating").alias("stars")
    )


def page_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What damaged pages hold: reviews, malformed and undated entries, unreadable bodies."""
    read = with_page_stats(read_pages(views.damaged_pages(spark, sf_dir)))
    return page_quality(page_stats(read), "app_id", "country", "page")


def google_play_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_google_play(views.google_play_batches(spark, sf_dir))
    return rows.select(
        "app_id", "lang", "page", "entry_pos",
        F.unix_seconds("review_ts").alias("review_epoch"),
        day("review_date"), "star_rating", "reviewer_anonymized", "platform",
        text_hash(F.col("review_text")).alias("text_hash"),
        "thumbs_up_count", shown(F.col("developer_reply")).alias("developer_reply"),
        day("developer_reply_date"),
    )


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_frontier(views.app_catalog(spark, sf_dir), ["us", "gb", "de"], 5)


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write sorted reviews as quoted CSV and read them back."""
    path = scratch_path(spark, "csv")
    reviews = staged(clean(spark, sf_dir), "clean")
    write_csv(standard_columns(sort_reviews(reviews)), path, same_rows=reviews)
    return read_csv(
        spark, path,
        "review_date string, star_rating int, reviewer_anonymized string, "
        "review_text string, platform string",
    )


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = views.app_catalog(spark, sf_dir)
    stopped = F.expr("cast(substring(app_id, 5) as bigint) % 50 = 7")
    return run_summary(catalog, clean(spark, sf_dir), stopped).withColumn(
        "platforms_failed", F.array_join("platforms_failed", ",")
    )


# ---- projections and filters ----------------------------------------------

def standard_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standard_columns(rated(spark, sf_dir), "seq")
    return rows.withColumn("review_date", day("review_date"))


def extended_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extended_columns(rated(spark, sf_dir), "seq").drop("review_text")
    return rows.withColumns(
        {
            "review_date": day("review_date"),
            "review_title": shown(F.col("review_title")),
            "thumbs_up_count": shown(F.col("thumbs_up_count")),
        }
    )


def platform_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_platforms(rated(spark, sf_dir), ["google-play"]).select(
        "seq", "platform", "star_rating"
    )


def country_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_countries(rated(spark, sf_dir), ["de", "fr"]).select("seq", "country")


def recency_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumnRenamed("ts", "review_ts")
    return within_window(events, EVENTS_AS_OF).select("event_id", "user_id")


def app_store_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_pages(views.app_store_pages(spark, sf_dir))
    return page_reviews(read, only_ok=False).select("app_id", "country", "page", "entry_pos", "status")


def google_play_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_google_play(views.google_play_batches(spark, sf_dir))
    return rows.groupBy("app_id", "lang", "page").agg(F.count(F.lit(1)).alias("n_valid"))


def catalog_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog_errors(views.app_catalog(spark, sf_dir))
    return found.select("app_id", F.array_join("errors", ",").alias("errors"))


# ---- walks ----------------------------------------------------------------

def oldest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.event_pages(spark, sf_dir).where("valid")
    return oldest_per_page(rows).select(
        "app_id", "page", "n_rows", F.unix_micros("oldest_ts").alias("oldest_micros")
    )


def page_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.event_pages(spark, sf_dir).where("valid")
    marked = mark_reached(oldest_per_page(rows), EVENTS_AS_OF)
    return marked.select("app_id", "page", "n_rows", "stale", "reached")


def page_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk again with a cap of 12 pages asked for."""
    rows = views.event_pages(spark, sf_dir).where("valid")
    marked = mark_reached(oldest_per_page(rows), EVENTS_AS_OF, 12)
    return marked.select("app_id", "page", "n_rows", "stale", "reached")


def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages out of order in the derived App Store pages (a diagnostic)."""
    reviews = parse_app_store(views.app_store_pages(spark, sf_dir))
    ends = reviews.groupBy("app_id", "country", "page").agg(
        F.max("review_ts").alias("newest_ts"), F.min("review_ts").alias("oldest_ts")
    )
    return order_breaks(ends).select(
        "app_id", "country", "page", F.unix_seconds("newest_ts").alias("newest"),
        F.unix_seconds("previous_oldest_ts").alias("previous_oldest"),
    )


def batch_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = batch_stats(views.google_play_batches(spark, sf_dir))
    marked = mark_reached(stats, AS_OF, is_last=F.col("is_last"), walk_key=GOOGLE_WALK_KEY)
    return marked.select(
        "app_id", "lang", shown(F.col("country")).alias("country"), "page", "n_rows", "is_last", "stale", "reached"
    )


# ---- aggregates, order, sets ----------------------------------------------

def platform_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by_platform(clean(spark, sf_dir), BOTH)


def throughput_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews per second of each app, its seconds given; none where no time has passed."""
    per_app = clean(spark, sf_dir).groupBy("app_id").agg(F.count(F.lit(1)).alias("total"))
    seconds = F.expr("cast(substring(app_id, 5) as int) % 4 * 2.5D")
    rate = F.round(throughput(F.col("total"), seconds), 6)
    return per_app.select("app_id", "total", F.coalesce(rate, F.lit(-1.0)).alias("per_second"))


def status_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run status where each country and month is a run of both platforms."""
    per_run = (
        rated(spark, sf_dir)
        .groupBy("country", F.substring(F.col("review_date").cast("string"), 1, 7).alias("month"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.countDistinct("platform").alias("with_data"),
        )
    )
    status = run_status(
        F.col("total"), F.lit(2) - F.col("with_data"), F.col("month") == "2024-02"
    )
    return per_run.select(
        "country", "month", "total", status.alias("status"),
        exit_code(status).alias("exit_code"),
    )


def sorted_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted rows, written and read back; each file row shows the one before it."""
    ordered = sort_reviews(rated(spark, sf_dir)).select("seq", day("review_date"), "star_rating", "platform")
    path = scratch_path(spark, "sorted")
    ordered.write.parquet(path)
    # Files and rows in the order in which they were written.
    written = spark.read.schema(ordered.schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")
    )
    row = F.struct("review_date", "star_rating")
    # The first row of a file follows the last one of the file before it; one row a file is little.
    files = written.groupBy("file").agg(F.max_by(row, "at").alias("last"))
    files = files.select("file", F.lag("last").over(Window.orderBy("file")).alias("ended"))
    before = written.withColumn("inside", F.lag(row).over(Window.partitionBy("file").orderBy("at")))
    before = before.join(F.broadcast(files), "file").withColumn("previous", F.coalesce("inside", "ended"))
    in_order = F.col("previous").isNull() | (F.struct("review_date", "star_rating") <= F.col("previous"))
    return before.select("seq", "review_date", "star_rating", "platform", in_order.alias("in_order"))


def union_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All selected countries: one table with a country column, read once."""
    return in_countries(rated(spark, sf_dir), COUNTRIES).select("seq", "country", "platform")


def union_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rated(spark, sf_dir)
    app_store = on_platforms(rows, ["app-store"]).select("seq", "star_rating", "review_title")
    google = on_platforms(rows, ["google-play"]).select("seq", "star_rating", "thumbs_up_count")
    return union_all(app_store, google).select(
        "seq", "star_rating",
        shown(F.col("review_title")).alias("review_title"),
        shown(F.col("thumbs_up_count")).alias("thumbs_up_count"),
    )


def dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(spark, sf_dir).select(
        "seq", "app_id", "platform", day("review_date"), "star_rating", "text_hash"
    )


# ---- scalar functions -----------------------------------------------------

def _over_texts(name: str, function: Callable[[Column], Column]):
    """Apply a text function to every text of documents and conversations."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = views.documents(spark, sf_dir).select(
            F.col("doc_id").alias("id"), F.lit(-1).cast("long").alias("part"), "text"
        )
        turns = table(spark, sf_dir, "conversations").select(
            F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text"
        )
        return docs.unionByName(turns).select(
            "id", "part", shown(function(F.col("text"))).alias(name)
        )

    return query


def clamp_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(
        """CASE (l_orderkey + l_linenumber) % 9
           WHEN 0 THEN cast(cast(l_quantity as int) as string)
           WHEN 1 THEN concat('+', cast(l_quantity as int) % 7)
           WHEN 2 THEN concat('-', cast(l_quantity as int))
           WHEN 3 THEN cast(l_quantity as string)
           WHEN 4 THEN concat('  ', cast(l_quantity as int) % 6, '\\n')
           WHEN 5 THEN concat(cast(l_quantity as int) % 2, '_', cast(l_quantity as int) % 9)
           WHEN 6 THEN repeat(cast(cast(l_quantity as int) as string), 20)
           WHEN 7 THEN l_returnflag
           ELSE concat('00', cast(l_quantity as int) % 8) END"""
    )
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber", shown(clamp_star_rating(raw)).alias("star_rating")
    )


def google_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(
        """CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN concat('bad ', value)
           ELSE cast(value / 50.0D AS STRING) END"""
    )
    score = whole_score(raw)
    return table(spark, sf_dir, "events").select(
        "event_id", score.alias("score"), is_star(score).alias("kept")
    )


def _name() -> Column:
    return F.expr(
        """CASE p_size % 7 WHEN 0 THEN p_name WHEN 1 THEN concat('  ', p_name, '\\n', p_type, ' ')
           WHEN 2 THEN '' WHEN 3 THEN concat('Anon ', p_name) WHEN 4 THEN '12 34'
           WHEN 5 THEN concat(p_size, p_name, ' ', p_brand) ELSE 'a Google USER' END"""
    )


def _initials(function: Callable[[Column], Column]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = table(spark, sf_dir, "part").select(
            F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), _name().alias("name")
        )
        docs = views.documents(spark, sf_dir).select(
            F.lit("document").alias("kind"), F.col("doc_id").alias("id"),
            F.col("text").alias("name"),
        )
        return parts.unionByName(docs).select(
            "kind", "id", function(F.col("name")).alias("initials")
        )

    return query


def _order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = "date_format(o_orderdate, '%s')"
    text = F.expr(
        f"""CASE o_orderkey % 15
            WHEN 0 THEN {stamp % "yyyy-MM-dd"}
            WHEN 1 THEN concat({stamp % "yyyy-MM-dd"}, 'T23:30:00-07:00')
            WHEN 2 THEN concat({stamp % "yyyy-MM-dd"}, 'T00:10:00+05:30')
            WHEN 3 THEN concat({stamp % "yyyy-MM-dd"}, 'T12:00:00Z')
            WHEN 4 THEN concat({stamp % "yyyy-MM-dd"}, ' 08:15')
            WHEN 5 THEN {stamp % "MMM d, yyyy"}
            WHEN 6 THEN concat({stamp % "EEE, dd MMM yyyy"}, ' 23:00:00 -0800')
            WHEN 7 THEN {stamp % "MM/dd/yyyy"}
            WHEN 9 THEN {stamp % "yyyy-M-d"}
            WHEN 10 THEN concat({stamp % "yyyyMMdd"}, 'T120000Z')
            WHEN 11 THEN concat({stamp % "yyyy-MM-dd"}, 'T12Z')
            WHEN 12 THEN {stamp % "yyyy.MM.dd"}
            WHEN 13 THEN {stamp % "MMM d yyyy"}
            WHEN 14 THEN concat({stamp % "EEE MMM d"}, ' 12:00:00 ', {stamp % "yyyy"})
            ELSE concat({stamp % "yyyy"}, '-13-45') END"""
    )
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", text.alias("text"))


def parse_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_dates(spark, sf_dir).select(
        "o_orderkey",
        shown(F.unix_seconds(parse_timestamp(F.col("text")))).alias("epoch"),
    )


def review_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_dates(spark, sf_dir).select(
        "o_orderkey", shown(local_date(F.col("text"))).alias("review_date")
    )


#: Forty spellings of an order's day, as patterns of ``date_format``; quoted parts stand as they are.
DATE_SPELLINGS = [
    "yyyy/MM/dd", "yyyy/M/d H:mm", "yyyy.MM.dd", "yyyy MM dd", "yyyyMMdd", "yyyyMMdd'T1015Z'", "yyyyMMdd'T101500-0330'",
    "yyyy-MM-dd'T12Z'", "yyyy-M-d", "yyyy-MMM-dd", "yyyy MMMM d", "M/d/yyyy", "MM/dd/yyyy' 11:59 PM'", "M-d-yyyy",
    "d/M/yyyy", "dd.MM.yyyy", "MMM d, yyyy", "MMM'. 'd, yyyy' 10:30 PM'", "MMMM d'th', yyyy' at 10:30 p.m.'",
    "MMMM d yyyy", "d MMMM yyyy", "d'th of 'MMMM yyyy' 12:00 am'", "dd-MMM-yyyy' 10:30:15'", "d MMM yyyy' 1:05am'",
    "EEE, dd MMM yyyy' 23:30:00 -0700'", "EEE MMM d' 10:30:00 'yyyy", "EEE MMM dd' 10:30:00 UTC 'yyyy",
    "EEE MMM d' 10:30:00 -0800 'yyyy", "EEEE, MMMM d, yyyy' 10 PM'", "'10:30 'd MMMM yyyy", "'10:30:15 PM, 'MMM d yyyy",
    "MMM d yyyy' 10:30:00,123'", "MMM d yyyy' 10:30:00.123456789 GMT'", "MMM d, yyyy' 10:30 PST'",
    "M/d/yyyy' 1:02:03 PM +05:30'", "EEE d MMM yyyy' 10:30 GMT+3'", "MMM yyyy", "M/d/yy", "'13/13/'yyyy", "'30 Feb 'yyyy",
]


def date_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's day in one of forty spellings, read by the grammar."""
    kind = F.pmod(F.col("o_orderkey"), F.lit(len(DATE_SPELLINGS)))
    spelled = F.when(F.lit(False), "")
    for i, pattern in enumerate(DATE_SPELLINGS):
        spelled = spelled.when(kind == i, F.date_format("o_orderdate", pattern))
    texts = table(spark, sf_dir, "orders").select("o_orderkey", kind.cast("int").alias("kind"), spelled.alias("text"))
    return texts.select(
        "o_orderkey", "kind",
        shown(F.unix_micros(parse_timestamp(F.col("text")))).alias("micros"),
        shown(local_date(F.col("text"))).alias("own_day"),
    )


def coalesce_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.expr("CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE text END")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", first_non_empty(first, F.col("role")).alias("chosen")
    )


def title_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.expr("IF(doc_id % 3 = 0, text, source)")
    return views.documents(spark, sf_dir).select(
        "doc_id", shown(title_if_differs(title, F.col("text"))).alias("title")
    )


def label_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.expr(
        "IF(event_type = 'signup', double('NaN'), round((value - 100.0D) / 100.0D, 2))"
    )
    return table(spark, sf_dir, "events").select(
        "event_id", sentiment_label(score).alias("sentiment_label")
    )


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.expr("IF(c_custkey % 3 = 0, NULL, IF(c_custkey % 3 = 1, 'app_store', 'google_play'))")
    name = F.expr("lower(replace(c_name, '#', '_'))")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", output_name(name, key, F.expr("c_custkey % 2 = 0")).alias("output_name")
    )


# ---- sentiment ------------------------------------------------------------

def lexicon_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.documents(spark, sf_dir).select("doc_id", "text")
    scored = lexicon_score(
        docs, views.word_lexicon(spark, sf_dir), ["doc_id"], "text", TEST_RULES
    )
    return scored.select("doc_id", "sentiment_score")


def lexicon_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores by the word join that a very large lexicon takes."""
    from dataclasses import replace

    docs = views.documents(spark, sf_dir).select("doc_id", "text")
    scored = lexicon_score(
        docs, views.word_lexicon(spark, sf_dir), ["doc_id"], "text",
        replace(TEST_RULES, max_inline_words=0),
    )
    return scored.select("doc_id", "sentiment_score")


def lexicon_spread_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores when not even the words in use can be broadcast: frequent words are dealt over salts."""
    from dataclasses import replace

    docs = views.documents(spark, sf_dir).select("doc_id", "text")
    scored = lexicon_score(
        docs, views.word_lexicon(spark, sf_dir), ["doc_id"], "text",
        replace(TEST_RULES, max_inline_words=0, max_broadcast_words=0),
    )
    return scored.select("doc_id", "sentiment_score")


def lexicon_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases in every document, and scores in which they count as one word."""
    from dataclasses import replace

    # A phrase list is bounded; one row more than that many ends in an error.
    rows = views.word_phrases(spark, sf_dir).take(MAX_PHRASES + 1)
    phrases = tuple(Phrase(tuple(r.phrase.split(" ")), r.v, r.b, r.g, r.e) for r in rows)
    docs = views.documents(spark, sf_dir).select("doc_id", "text")
    found = phrase_spans(docs, phrases, "text")
    scored = lexicon_score(
        found, views.word_lexicon(spark, sf_dir), ["doc_id"], "text", replace(TEST_RULES, phrases=phrases)
    )
    places = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["length"]))
    return scored.select("doc_id", "n_found", F.array_join(places, ",").alias("spans"), "sentiment_score")


def scorer_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores where a model is asked for that cannot be loaded: the lexicon takes over."""
    def load():
        raise OSError("no model on this machine")

    scorer, backend = choose_scorer(views.word_lexicon(spark, sf_dir), ["doc_id"], load, TEST_RULES)
    docs = views.documents(spark, sf_dir).select("doc_id", F.col("text").alias("review_text"))
    return scorer(docs).select("doc_id", "sentiment_score", F.lit(backend).alias("backend"))


def analyze_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = analyze_reviews(
        rated(spark, sf_dir), lexicon_scorer(spark, sf_dir, ["seq"])
    )
    return scored.select(
        "seq", "platform", "star_rating", "sentiment_score", "sentiment_label"
    )


# ---- streaming ------------------------------------------------------------

#: Bytes of text that one landed file holds, about.
LANDED_BYTES = 32 << 20


def _landed_files(texts: DataFrame) -> int:
    """Files in which ``texts`` land: three at least, and as many more as they are longer, so that no task's part grows."""
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(3, -(-size // LANDED_BYTES))


def stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys left by the incremental job over landed App Store pages, taken up in three micro-batches."""
    landed, files = scratch_path(spark, "landed"), _landed_files(views.documents(spark, sf_dir))
    views.app_store_pages(spark, sf_dir).repartition(files, "app_id", "page").write.parquet(landed)
    pages = spark.readStream.schema(APP_STORE_PAGES).option("maxFilesPerTrigger", -(-files // 3)).parquet(landed)
    path, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    kept = stream_dedup(parse_app_store(pages), AS_OF).select(
        "platform", "app_id", day("review_date"), "star_rating", "text_hash"
    )
    run_available(kept, path, checkpoint)
    return spark.read.schema(kept.schema).parquet(path)


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw App Store files of every page, some of them damaged or misplaced: what each app and country landed."""
    kind = "(cast(substr(app_id, 5) AS int) + page * 3 + length(country)) % 7"
    pages = views.app_store_pages(spark, sf_dir).withColumn("kind", F.expr(kind)).select(
        "app_id", "country", F.expr("IF(kind = 1, concat('p', page), cast(page AS string))").alias("page"),
        F.expr(
            """CASE kind WHEN 2 THEN ' ' WHEN 3 THEN substr(body, 1, length(body) - 2) WHEN 4 THEN '{"error": "gone"}'
               WHEN 5 THEN concat('{"version": 2, ', substr(body, 2)) ELSE body END"""
        ).alias("body"),
    )
    root = scratch_path(spark, "raw-pages")
    land_files(pages, ["app_id", "country", "page"], "body", root)
    # Many small files are slow to open: each is opened once, many in a task, and the report and the parser read the table.
    parts = max(spark.sparkContext.defaultParallelism, _landed_files(views.documents(spark, sf_dir)))
    landed = staged(landed_app_store(spark, root).coalesce(parts), "landed-pages")
    read = read_pages(landed.where("status = 'ok'").select("app_id", "country", "page", "body"))
    entries = read.groupBy("app_id", "country").agg(F.sum(F.size("entries")).cast("long").alias("n_entries"))
    report = landing_report(landed, "app_id", "country")
    same = report["app_id"].eqNullSafe(entries["app_id"]) & report["country"].eqNullSafe(entries["country"])
    both = report.join(entries, same, "left")
    return both.select(*[report[c] for c in report.columns], F.coalesce("n_entries", F.lit(0)).alias("n_entries"))


def _streamed(spark: SparkSession, rows: DataFrame, name: str, *by: Column, files: int = 3) -> DataFrame:
    """``rows`` landed in files that each hold some of everything, read as a stream of a third of the files at a time."""
    landed = scratch_path(spark, f"{name}-landed")
    rows.repartition(files, *by).write.parquet(landed)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(landed)


def first_seen_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-seen reviews kept by the incremental job, which corrects itself when an earlier row lands later."""
    files = _landed_files(views.documents(spark, sf_dir))
    reviews = _streamed(spark, rated(spark, sf_dir), "first-seen", F.xxhash64("seq"), files=files)
    given, path = stream_first_seen(reviews, AS_OF), scratch_path(spark, "first-seen")
    run_available(given, path, scratch_path(spark, "first-seen-state"))
    return settled(spark.read.schema(given.schema).parquet(path)).select(
        "seq", "app_id", "platform", day("review_date"), "star_rating", "text_hash"
    )


def page_walk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page walk kept up by state per walk while pages land in any order."""
    stats = oldest_per_page(views.event_pages(spark, sf_dir).where("valid"))
    pages = _streamed(spark, stats, "walk", F.xxhash64("app_id", "page"))
    given, path = stream_walk(pages, EVENTS_AS_OF), scratch_path(spark, "walk")
    run_available(given, path, scratch_path(spark, "walk-state"))
    return settled_pages(spark.read.schema(given.schema).parquet(path)).select(
        "app_id", F.col("page").cast("int").alias("page"), "n_rows", "stale", "reached"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_review_table": clean_review_table,
    "collect_app_store": collect_app_store,
    "pruned_collect": pruned_collect,
    "collect_google_play": collect_google_play,
    "full_run": full_run,
    "output_layout": output_layout,
    "run_metrics": run_metrics,
    "rerun_output": rerun_output,
    "app_store_parse": app_store_parse,
    "app_store_parse_strict": app_store_parse_strict,
    "page_quality": page_quality_query,
    "google_play_parse": google_play_parse,
    "request_frontier": frontier,
    "csv_roundtrip": csv_roundtrip,
    "run_summary": summary,
    "standard_projection": standard_projection,
    "extended_projection": extended_projection,
    "platform_filter": platform_filter,
    "country_filter": country_filter,
    "recency_filter": recency_filter,
    "app_store_valid": app_store_valid,
    "google_play_valid": google_play_valid,
    "catalog_validation": catalog_validation,
    "oldest_per_page": oldest_page,
    "page_walk": page_walk,
    "page_cap": page_cap,
    "batch_walk": batch_walk,
    "page_order": newest_first,
    "count_by_platform": platform_counts,
    "throughput": throughput_query,
    "run_status": status_by_country,
    "sorted_output": sorted_output,
    "union_countries": union_countries,
    "union_platforms": union_platforms,
    "dedup_first_seen": dedup_query,
    "clean_text": _over_texts("cleaned", clean_text),
    "strip_text": _over_texts("stripped", strip_text),
    "text_hash": _over_texts("text_hash", text_hash),
    "clamp_star": clamp_star,
    "google_score": google_score,
    "initials_app_store": _initials(initials_app_store),
    "initials_google": _initials(initials_google_play),
    "parse_ts": parse_ts,
    "review_date": review_date,
    "date_spellings": date_spellings,
    "coalesce_fallback": coalesce_fallback,
    "title_if_differs": title_query,
    "sentiment_label": label_query,
    "output_name": output_names,
    "lexicon_score": lexicon_query,
    "lexicon_score_join": lexicon_join_query,
    "lexicon_score_spread": lexicon_spread_query,
    "lexicon_phrases": lexicon_phrases,
    "scorer_fallback": scorer_fallback,
    "analyze_reviews": analyze_query,
    "landed_pages": landed_pages,
    "stream_dedup": stream_query,
    "stream_first_seen": first_seen_stream,
    "stream_page_walk": page_walk_stream,
}
