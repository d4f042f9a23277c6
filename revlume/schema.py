"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

APP_STORE_PAGES = T.StructType(
    [
        T.StructField("app_id", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("body", T.StringType()),
    ]
)

GOOGLE_PLAY_REVIEW = T.StructType(
    [
        T.StructField("at", T.TimestampType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("userName", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("thumbsUpCount", T.IntegerType()),
        T.StructField("replyContent", T.StringType()),
        T.StructField("repliedAt", T.TimestampType()),
    ]
)

GOOGLE_PLAY_BATCHES = T.StructType(
    [
        T.StructField("app_id", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("next_token", T.StringType()),
        T.StructField("batch", T.ArrayType(GOOGLE_PLAY_REVIEW)),
    ]
)

APP_CATALOG = T.StructType(
    [
        T.StructField("app_id", T.StringType()),
        T.StructField("app_name", T.StringType()),
        T.StructField("app_store_id", T.StringType()),
        T.StructField("google_play_id", T.StringType()),
        T.StructField("platforms", T.ArrayType(T.StringType())),
    ]
)

LEXICON = T.StructType(
    [
        T.StructField("tok", T.StringType()),
        T.StructField("val", T.DoubleType()),
    ]
)

# One walk is one app in one country store, on Google Play also in one language;
# pages are numbered from 1 in it.
WALK_KEY = ["app_id", "country"]
PAGE_KEY = WALK_KEY + ["page"]
GOOGLE_WALK_KEY = ["app_id", "lang", "country"]
GOOGLE_PAGE_KEY = GOOGLE_WALK_KEY + ["page"]

STANDARD_COLUMNS = [
    "review_date",
    "star_rating",
    "reviewer_anonymized",
    "review_text",
    "platform",
]
EXTENDED_COLUMNS = {
    "app_store": ["review_title"],
    "google_play": ["thumbs_up_count", "developer_reply", "developer_reply_date"],
}
ANALYSIS_COLUMNS = ["sentiment_score", "sentiment_label"]
