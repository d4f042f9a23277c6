"""Names of outputs and platforms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Platform names in rows, keys in counts, and slugs in settings.
APP_STORE = "App Store"
GOOGLE_PLAY = "Google Play Store"
KEY_OF_PLATFORM = {APP_STORE: "app_store", GOOGLE_PLAY: "google_play"}
SLUG_OF_KEY = {"app_store": "app-store", "google_play": "google-play"}
KEY_OF_SLUG = {slug: key for key, slug in SLUG_OF_KEY.items()}
PLATFORM_OF_KEY = {key: name for name, key in KEY_OF_PLATFORM.items()}


def _choose(col: Column, pairs: dict[str, str]) -> Column:
    chosen = F.lit(None).cast("string")
    for value, result in pairs.items():
        chosen = F.when(col == value, F.lit(result)).otherwise(chosen)
    return chosen


def platform_key(platform: Column) -> Column:
    """``App Store`` -> ``app_store``"""
    return _choose(platform, KEY_OF_PLATFORM)


def platform_slug(key: Column) -> Column:
    """``app_store`` -> ``app-store``"""
    return _choose(key, SLUG_OF_KEY)


def slug_key(slug: Column) -> Column:
    """``app-store`` -> ``app_store``"""
    return _choose(slug, KEY_OF_SLUG)


def output_name(app_name: Column, key: Column | None, analysis: Column) -> Column:
    """``{app}[_{platform}]_reviews[_analysis]``; a null or empty key is left out."""
    key = F.lit(None).cast("string") if key is None else F.nullif(key, F.lit(""))
    return F.concat_ws(
        "_", app_name, key, F.lit("reviews"), F.when(analysis, F.lit("analysis"))
    )
