"""Review-shaped views derived from the given tables.

Each view covers every row of its table.  Groups are cut by arithmetic on row
ids, so none of them grows with the table.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from revlume.functions.dates import naive_as_utc
from revlume.schema import GOOGLE_PLAY_REVIEW

AS_OF = datetime(2024, 12, 31, tzinfo=timezone.utc)
EVENTS_AS_OF = datetime(2025, 1, 16, tzinfo=timezone.utc)
COUNTRIES = ["en", "de", "fr", "es"]
DOCS_PER_APP = 60
DOCS_PER_PAGE = 10
_DAY = 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def reviews_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as flat, not yet cleaned reviews of both platforms."""
    end = int(AS_OF.timestamp())
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("seq"),
        F.expr("concat('app-', n_chars div 100)").alias("app_id"),
        F.expr("IF(doc_id % 2 = 0, 'App Store', 'Google Play Store')").alias("platform"),
        F.col("lang").alias("country"),
        F.expr("cast(doc_id div 50 + 1 as int)").alias("page"),
        F.expr("cast(doc_id % 50 as int)").alias("entry_pos"),
        F.expr(f"timestamp_seconds({end} - (n_chars % 500) * {_DAY})").alias("review_ts"),
        F.expr("cast(n_chars % 8 as string)").alias("raw_rating"),
        F.expr("concat(source, ' ', lang)").alias("author"),
        F.expr("concat(lang, ' ', source)").alias("title"),
        F.col("text"),
    )


def _page_numbers() -> list:
    return [
        F.expr(f"concat('app-', doc_id div {DOCS_PER_APP})").alias("app_id"),
        F.expr(
            f"cast((doc_id % {DOCS_PER_APP}) div {DOCS_PER_PAGE} + 1 as int)"
        ).alias("page"),
    ]


# Days before AS_OF: later pages are older, with some overlap between pages.
_DAYS_BACK = f"((doc_id % {DOCS_PER_APP}) div {DOCS_PER_PAGE} * 60 + n_chars % 90)"


def app_store_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` wrapped as App Store page bodies, up to ten per page."""
    entry = """
      named_struct(
        'im:rating', named_struct('label', CASE n_chars % 12
            WHEN 8 THEN '4.0' WHEN 9 THEN ' +4 ' WHEN 10 THEN 'bad'
            WHEN 11 THEN CAST(NULL AS STRING)
            ELSE cast(n_chars % 12 as string) END),
        'content', named_struct('label', IF(doc_id % 10 = 3, '', text)),
        'title', named_struct('label',
            IF(doc_id % 10 = 5, text, concat(source, '  ', lang))),
        'updated', named_struct('label', IF(doc_id % 9 = 4, NULL, stamp)),
        'im:releaseDate', named_struct('label', stamp),
        'author', named_struct('name', named_struct('label', CASE doc_id % 6
            WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat(source, ' ', lang)
            WHEN 3 THEN lang WHEN 4 THEN '12 34'
            ELSE concat(lang, ' x ', source) END)))
    """
    stamp = f"""
      concat(cast(date_sub(DATE'2024-12-31', cast({_DAYS_BACK} as int)) as string), 'T',
             lpad(doc_id % 24, 2, '0'), ':', lpad(doc_id % 60, 2, '0'), ':00',
             element_at(array('Z', '-07:00', '+05:30', ''), cast(doc_id % 4 + 1 as int)))
    """
    entries = (
        documents(spark, sf_dir)
        .select(
            *_page_numbers(), F.col("lang").alias("country"), "doc_id", "text",
            "source", "lang", "n_chars", F.expr(stamp).alias("stamp"),
        )
        .withColumn("entry", F.to_json(F.expr(entry), {"ignoreNullFields": "false"}))
        .withColumn(
            "entry",
            F.expr(
                """IF(doc_id % 50 = 17,
                      replace(entry, '"author":{', '"author":"x","was":{'), entry)"""
            ),
        )
    )
    by_page = entries.groupBy("app_id", "country", "page").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "entry"))).alias("es")
    )
    joined = F.array_join(F.transform("es", lambda e: e["entry"]), ",")
    feed = F.when(F.size("es") == 1, joined).otherwise(
        F.concat(F.lit("["), joined, F.lit("]"))
    )
    return by_page.select(
        "app_id", "country", "page",
        F.concat(F.lit('{"feed":{"entry":'), feed, F.lit("}}")).alias("body"),
    )


def damaged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The App Store pages, some cut off, some with a repeated key, some without dates."""
    kind = "(cast(substring(app_id, 5) as bigint) + page) % 7"
    body = f"""
      CASE {kind} WHEN 0 THEN substring(body, 1, 40)
        WHEN 1 THEN replace(body, '"im:rating":', '"im:rating":{{"label":"1"}},"im:rating":')
        WHEN 2 THEN replace(replace(body, '"updated":', '"was":'), '"im:releaseDate":', '"then":')
        ELSE body END"""
    return app_store_pages(spark, sf_dir).withColumn("body", F.expr(body))


def google_play_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as Google Play batches of up to ten structs."""
    end = int(AS_OF.timestamp())
    item = f"""
      named_struct(
        'at', IF(doc_id % 13 = 5, NULL,
                 timestamp_seconds({end} - {_DAYS_BACK} * {_DAY} + doc_id % 1000)),
        'score', IF(n_chars % 11 = 7, NULL, (n_chars % 8) + 0.7D),
        'userName', CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' A Google  User'
            WHEN 2 THEN concat(source, ' ', lang) WHEN 3 THEN 'Canon Fan'
            ELSE concat(lang, '  x ', source) END,
        'content', IF(doc_id % 17 = 3, ' \\t', concat('\\n ', text, ' ')),
        'thumbsUpCount', IF(doc_id % 3 = 0, NULL, cast(n_chars % 40 as int)),
        'replyContent', CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  '
            ELSE concat(' Thanks, ', source, ' ') END,
        'repliedAt', IF(doc_id % 4 < 2, NULL,
                        timestamp_seconds({end} - (n_chars % 60) * {_DAY})))
    """
    by_page = (
        documents(spark, sf_dir)
        .select(*_page_numbers(), "doc_id", F.expr(item).alias("item"))
        .groupBy("app_id", "page")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("items"),
        )
    )
    # Some apps have no country, and some are landed in two languages of three pages each.
    app = f"(first_id div {DOCS_PER_APP})"
    second = f"({app} % 3 = 1 AND page > 3)"
    last = f"page = 6 OR (page = 3 AND {app} % 4 = 1)"
    return by_page.select(
        "app_id",
        F.expr(f"IF({second}, 'de', 'en')").alias("lang"),
        F.expr(f"IF({app} % 5 = 2, NULL, 'us')").alias("country"),
        F.expr(f"IF({second}, page - 3, page)").alias("page"),
        F.expr(f"IF({last}, NULL, concat('t', page))").alias("next_token"),
        F.transform("items", lambda x: x["item"])
        .cast(f"array<{GOOGLE_PLAY_REVIEW.simpleString()}>")
        .alias("batch"),
    )


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as reviews of one app per user, two days to a page.

    Rows of type ``error`` stand for entries that do not parse.
    """
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("app_id"),
        F.lit("us").alias("country"),
        F.expr("cast((30 - day(ts)) div 2 + 1 as int)").alias("page"),
        naive_as_utc(F.col("ts")).alias("review_ts"),
        (F.col("event_type") != "error").alias("valid"),
    )


def app_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as a catalog in which many ids are unusable, and some ids and names repeated."""
    customers = table(spark, sf_dir, "customer").withColumn("again", F.explode(F.expr("sequence(0, IF(c_custkey % 50 = 10, 1, 0))")))
    return customers.select(
        F.expr("concat('app-', c_custkey)").alias("app_id"),
        F.expr(
            """IF(c_custkey % 50 = 20, concat('shared_', c_custkey div 100),
                  concat(lower(replace(c_name, '#', '_')), IF(again = 1, '_again', '')))"""
        ).alias("app_name"),
        F.expr(
            """CASE (c_custkey + 4) % 9 WHEN 0 THEN '123456789' WHEN 1 THEN ''
               WHEN 2 THEN concat('id', c_custkey) WHEN 3 THEN '  '
               ELSE cast(500000000 + c_custkey as string) END"""
        ).alias("app_store_id"),
        F.expr(
            """CASE (c_custkey + 4) % 7 WHEN 0 THEN 'com.example'
               WHEN 1 THEN concat('1com.app.n', c_custkey)
               WHEN 2 THEN lower(c_mktsegment) WHEN 3 THEN NULL
               ELSE concat('com.', lower(c_mktsegment), '.app', c_custkey) END"""
        ).alias("google_play_id"),
        F.expr(
            """CASE c_custkey % 4 WHEN 0 THEN array('app-store', 'google-play', 'app-store')
               WHEN 1 THEN array('app-store') WHEN 2 THEN array('google-play')
               ELSE cast(array() as array<string>) END"""
        ).alias("platforms"),
    )


def word_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon of the words of ``benchmark``; its values are arbitrary."""
    text = table(spark, sf_dir, "benchmark").select(F.lower("text").alias("text"))
    found = text.select(
        F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))).alias("tok")
    ).distinct()
    return found.select(
        "tok",
        F.expr("((length(tok) * 7 + ascii(tok) * 3) % 80 - 40) / 10.0D").alias("val"),
    )


def word_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two to four plain words of ``benchmark``; what they count as is arbitrary."""
    text = table(spark, sf_dir, "benchmark").select(F.lower("text").alias("text"))
    runs = [
        F.regexp_extract_all("text", F.lit(f"[a-z]{{2,}}(?: [a-z]{{2,}}){{{n}}}"), F.lit(0)) for n in (1, 2, 3)
    ]
    found = text.select(F.explode(F.concat(*runs)).alias("phrase")).distinct()
    kind = "(length(phrase) * 5 + ascii(phrase)) % 5"
    return found.select(
        "phrase",
        F.expr(f"IF({kind} = 0, ((length(phrase) * 7 + ascii(phrase) * 3) % 80 - 40) / 10.0D, NULL)").alias("v"),
        F.expr(f"IF({kind} = 1, IF(length(phrase) % 2 = 0, 0.293D, -0.293D), NULL)").alias("b"),
        F.expr(f"{kind} = 2").alias("g"),
        F.expr(f"IF({kind} = 3, 1.25D, NULL)").alias("e"),
    )
