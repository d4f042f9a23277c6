"""The table of apps to collect: validation and the request frontier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from revlume.functions import strip_text

# The unfilled ids, the code of a settings error, the id shapes, and
# the feed address.
PLACEHOLDER_APP_STORE_ID = "123456789"
PLACEHOLDER_GOOGLE_PLAY_ID = "com.example"
CONFIG_ERROR_CODE = 1
DIGITS_ONLY = r"(?U)\A\d+\z"
PACKAGE_NAME = r"(?d)^[a-zA-Z][a-zA-Z0-9_]*(\.[a-zA-Z][a-zA-Z0-9_]*)+$"
FEED_URL = (
    "https://itunes.apple.com/%s/rss/customerreviews"
    "/page=%d/id=%s/sortby=mostrecent/json"
)


def is_app_store_id(col: Column) -> Column:
    return col.rlike(DIGITS_ONLY)


def is_package_name(col: Column) -> Column:
    return col.rlike(PACKAGE_NAME)


def _id_error(prefix: str, col: Column, placeholder: str, well_formed: Column) -> Column:
    return (
        F.when(strip_text(col) == "", F.lit(f"{prefix}_empty"))
        .when(col == placeholder, F.lit(f"{prefix}_placeholder"))
        .when(~well_formed, F.lit(f"{prefix}_malformed"))
    )


def catalog_errors(catalog: DataFrame) -> DataFrame:
    """Catalog with ``errors array<string>``, empty for a usable app.

    Ids of a platform that is not selected are not looked at.  Rows that share
    an id would count reviews twice, and apps that share a name would share an
    output: both are errors of all rows concerned.  A row without an id or a
    name, or with a blank one, has an error of its own and repeats nothing.
    ``platforms`` comes out without repeats.
    """
    platforms = F.array_distinct(F.coalesce("platforms", F.array().cast("array<string>")))
    blank = lambda c: strip_text(F.col(c)) == ""

    def several(c: str) -> Column:
        # rows without a value are dealt by the others, so that they do not meet in one task
        dealt = F.when(blank(c), F.xxhash64("app_id", "app_name", "app_store_id", "google_play_id"))
        return (F.count(F.lit(1)).over(Window.partitionBy(c, dealt)) > 1) & ~blank(c)

    app_store, google = F.col("app_store_id"), F.col("google_play_id")
    found = F.array(
        F.when(
            F.array_contains(platforms, "app-store"),
            _id_error(
                "app_store_id", app_store, PLACEHOLDER_APP_STORE_ID,
                is_app_store_id(app_store),
            ),
        ),
        F.when(
            F.array_contains(platforms, "google-play"),
            _id_error(
                "google_play_id", google, PLACEHOLDER_GOOGLE_PLAY_ID,
                is_package_name(google),
            ),
        ),
        F.when(F.size(platforms) == 0, F.lit("no_platform")),
        F.when(blank("app_id"), F.lit("app_id_missing")).when(F.col("_id_repeated"), F.lit("app_id_repeated")),
        F.when(blank("app_name"), F.lit("app_name_missing")).when(F.col("_name_repeated"), F.lit("app_name_repeated")),
    )
    marked = catalog.withColumns({"_id_repeated": several("app_id"), "_name_repeated": several("app_name")})
    checked = marked.withColumns({"errors": F.array_compact(found), "platforms": platforms})
    return checked.drop("_id_repeated", "_name_repeated")


def usable_apps(catalog: DataFrame) -> DataFrame:
    return catalog_errors(catalog).where(F.size("errors") == 0).drop("errors")


def request_frontier(
    catalog: DataFrame, countries: Sequence[str], max_pages: int
) -> DataFrame:
    """One row per App Store request: app x country x page, with its URL.

    The two short lists are exploded inside each catalog row, so the catalog
    is never joined or shuffled.
    """
    apps = usable_apps(catalog).where(F.array_contains("platforms", "app-store"))
    places = F.array(*[F.lit(c) for c in countries])
    per_country = apps.select(
        "app_id", "app_store_id", F.posexplode(places).alias("country_order", "country")
    )
    pages = F.sequence(F.lit(1), F.lit(max_pages)) if max_pages > 0 else F.array().cast("array<int>")
    return per_country.select("*", F.explode(pages).alias("page")).withColumn(
        "url", F.format_string(FEED_URL, "country", "page", "app_store_id")
    )
