"""App Store pages: nested JSON bodies flattened to review rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revlume.functions import (
    clamp_star_rating,
    clean_text,
    initials_app_store,
    local_date,
    parse_timestamp,
    title_if_differs,
)
from revlume.functions.naming import APP_STORE

# The labelled fields of one feed entry.
FIELDS = {
    "rating": '$["im:rating"]',
    "content": "$.content",
    "title": "$.title",
    "updated": "$.updated",
    "released": '$["im:releaseDate"]',
    "author": "$.author",
    "name": "$.author.name",
}

# JSON text or whole number. 4.0 is held as a short decimal and is not whole;
# a decimal of 19 digits or more was too long for a bigint.
WHOLE_OR_TEXT = r"\A(STRING|BIGINT|DECIMAL\((19|[23]\d),0\))\z"


_LABEL = "struct<label: string>"
_LENIENT = (
    f"array<struct<`im:rating`: {_LABEL}, content: {_LABEL}, title: {_LABEL}, updated: {_LABEL}, "
    f"`im:releaseDate`: {_LABEL}, author: struct<name: {_LABEL}>>>"
)


def _lenient_entries(body: Column) -> Column:
    """Entries of a body whose objects repeat keys (the last one counts); null for other text."""
    entry = F.from_json(body, "feed struct<entry: string>")["feed"]["entry"]
    return F.from_json(entry, _LENIENT)


def is_unreadable(body: Column, parsed: Column) -> Column:
    """Text that is no JSON body: neither strictly (``parsed``), nor with repeated keys."""
    return body.isNotNull() & parsed.isNull() & _lenient_entries(body).isNull()


def feed_entries(body: Column, strictly: Column) -> Column:
    """``feed.entry`` as an array: a lone object becomes one element.

    ``strictly`` is the parsed body, null where its objects repeat keys.
    """
    rewritten = F.to_json(F.struct(F.struct(_lenient_entries(body).alias("entry")).alias("feed")))
    parsed = F.coalesce(strictly, F.try_parse_json(rewritten))
    entry = F.try_variant_get(parsed, "$.feed.entry", "variant")
    # held in an array, so that both looks at it share one parse of the body
    shapes = F.transform(
        F.array(entry),
        lambda e: F.coalesce(
            F.try_variant_get(e, "$", "array<variant>"),
            F.when(e.isNotNull(), F.array(e)),
        ),
    )
    return F.flatten(shapes)


def _labels(entry: Column) -> Column:
    """Per field: its label as text, the label's JSON type, its wrapper's type."""
    wrapped = {f: F.try_variant_get(entry, path, "variant") for f, path in FIELDS.items()}
    parts = [F.schema_of_variant(entry).alias("type")]
    for f, wrapper in wrapped.items():
        label = FIELDS[f] + ".label"
        parts.append(
            F.struct(
                F.try_variant_get(entry, label, "string").alias("text"),
                F.schema_of_variant(F.try_variant_get(entry, label, "variant")).alias("type"),
                F.schema_of_variant(wrapper).alias("wrapper"),
            ).alias(f)
        )
    return F.struct(*parts)


def _blank(field: Column) -> Column:
    """Label missing, JSON null, or an empty or zero value."""
    kind, label = field["type"], field["text"]
    empty = (label == "") | (
        (kind != "STRING") & label.isin("false", "0", "0.0", "[]", "{}")
    )
    return kind.isNull() | (kind == "VOID") | empty


def _odd_wrapper(field: Column) -> Column:
    """Present, but not an object that could hold a label."""
    return F.coalesce(~field["wrapper"].startswith("OBJECT"), F.lit(False))


def _odd_label(field: Column) -> Column:
    """Label with a value that is not text."""
    return ~_blank(field) & (field["type"] != "STRING")


def _chosen(raw: Column) -> Column:
    """Texts to work on: the date that counts, title, body."""
    released = _blank(raw["updated"])
    date = F.when(released, raw["released"]).otherwise(raw["updated"])
    return F.struct(
        raw.alias("raw"),
        released.alias("use_released"),
        F.when(date["type"] == "STRING", date["text"]).alias("date"),
        clean_text(raw["title"]["text"]).alias("title"),
        clean_text(raw["content"]["text"]).alias("content"),
    )


def _values(c: Column) -> Column:
    rating = c["raw"]["rating"]
    return F.struct(
        c["raw"].alias("raw"),
        c["use_released"].alias("use_released"),
        parse_timestamp(c["date"]).alias("review_ts"),
        local_date(c["date"]).alias("review_date"),
        F.when(rating["type"].rlike(WHOLE_OR_TEXT), clamp_star_rating(rating["text"]))
        .alias("star_rating"),
        initials_app_store(c["raw"]["name"]["text"]).alias("reviewer_anonymized"),
        F.coalesce(c["content"], c["title"]).alias("review_text"),
        c["title"].alias("title"),
    )


def _status(v: Column) -> Column:
    """``ok``, ``skip`` (not a usable review), ``undated`` or ``bad`` (malformed).

    The tests run in the order in which a reader meets the fields: an entry
    that is skipped for its rating is not malformed for its author.
    """
    ok, skip, bad = F.lit("ok"), F.lit("skip"), F.lit("bad")
    raw = v["raw"]
    is_object = F.coalesce(raw["type"].startswith("OBJECT"), F.lit(False))
    return (
        F.when(~is_object, bad)
        .when(_odd_wrapper(raw["rating"]) | _odd_wrapper(raw["content"]), bad)
        .when(v["star_rating"].isNull(), skip)
        .when(_odd_wrapper(raw["updated"]), bad)
        .when(v["use_released"] & _odd_wrapper(raw["released"]), bad)
        .when(v["review_ts"].isNull(), F.lit("undated"))
        .when(_odd_wrapper(raw["author"]) | _odd_wrapper(raw["name"]), bad)
        .when(_odd_label(raw["name"]) | _odd_wrapper(raw["title"]), bad)
        .when(_odd_label(raw["title"]) | _odd_label(raw["content"]), bad)
        .when(v["review_text"].isNull(), skip)
        .otherwise(ok)
    )


REVIEW_FIELDS = [
    "review_ts", "review_date", "star_rating", "reviewer_anonymized", "review_text",
]


def _review(v: Column, position: Column) -> Column:
    return F.struct(
        position.alias("entry_pos"),
        _status(v).alias("status"),
        *[v[f].alias(f) for f in REVIEW_FIELDS],
        title_if_differs(v["title"], v["review_text"]).alias("review_title"),
    )


def read_pages(pages: DataFrame, strict_page: bool = False) -> DataFrame:
    """Replace ``body`` by ``entries``, the page's parsed entries with a status.

    A page is read inside its own row, step by step, so each value is worked
    out once, nothing is shuffled, and what concerns the page as a whole (its
    oldest review, whether it is malformed) needs no aggregation.  With
    ``strict_page`` one malformed entry empties its page.
    """
    keys = [c for c in pages.columns if c != "body"]
    pages = pages.withColumn("_parsed", F.try_parse_json("body"))
    raw = F.transform(feed_entries(F.col("body"), F.col("_parsed")), _labels)
    values = F.transform(F.transform(raw, _chosen), _values)
    read = pages.select(
        *keys, is_unreadable(F.col("body"), F.col("_parsed")).alias("unreadable"), F.transform(values, _review).alias("entries")
    )
    if strict_page:
        malformed = F.exists("entries", lambda e: e["status"] == "bad")
        read = read.withColumn("entries", F.when(~malformed, F.col("entries")))
    return read


def with_page_stats(read: DataFrame) -> DataFrame:
    """Add per page its oldest valid review, and how many are valid or bad.

    Kept beside the entries, so that a staged table gives the figures of a page
    from three narrow columns.
    """
    ok = F.filter("entries", lambda e: e["status"] == "ok")
    times = F.transform(ok, lambda e: e["review_ts"])
    count = lambda status: F.coalesce(
        F.size(F.filter("entries", lambda e: e["status"] == status)), F.lit(0)
    ).cast("long")
    return read.withColumns(
        {
            "oldest_ts": F.array_min(times),
            "n_rows": count("ok"),
            "n_bad": count("bad"),
            "n_undated": count("undated"),
            "n_rejected": count("skip"),
            "n_unreadable": F.col("unreadable").cast("long"),
        }
    )


QUALITY = ["n_rows", "n_bad", "n_undated", "n_rejected", "n_unreadable"]


def page_quality(stats: DataFrame, *key: str) -> DataFrame:
    """What was read and what was not: entries and pages counted per ``key``."""
    return stats.groupBy(*key).agg(*[F.sum(c).alias(c) for c in QUALITY])


def page_stats(read: DataFrame) -> DataFrame:
    """One row per page with its figures."""
    counted = read if "n_rows" in read.columns else with_page_stats(read)
    return counted.drop("entries", "unreadable")


def page_reviews(read: DataFrame, only_ok: bool = True) -> DataFrame:
    """One row per entry of pages read by ``read_pages``."""
    keys = [c for c in read.columns if c not in ("entries", "unreadable", "oldest_ts", *QUALITY)]
    wanted = F.filter("entries", lambda e: (e["status"] == "ok") | F.lit(not only_ok))
    rows = read.select(*keys, F.explode(wanted).alias("e"))
    return rows.select(
        *keys,
        "e.entry_pos",
        *([] if only_ok else ["e.status"]),
        *[f"e.{f}" for f in REVIEW_FIELDS],
        F.lit(APP_STORE).alias("platform"),
        "e.review_title",
    )


def parse_app_store(pages: DataFrame, strict_page: bool = False) -> DataFrame:
    """Valid reviews of landed App Store pages.

    By default a malformed entry is left out alone; ``strict_page`` leaves out
    its whole page.
    """
    return page_reviews(read_pages(pages, strict_page))
