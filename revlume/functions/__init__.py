from revlume.functions.dates import (
    cutoff, cutoff_literal, local_date, parse_timestamp, utc_date,
)
from revlume.functions.labels import sentiment_label
from revlume.functions.names import initials_app_store, initials_google_play
from revlume.functions.naming import (
    output_name, platform_key, platform_slug, slug_key,
)
from revlume.functions.ratings import clamp_star_rating, is_star, whole_score
from revlume.functions.text import (
    clean_text, first_non_empty, strip_text, text_hash, title_if_differs,
)

__all__ = [
    "clamp_star_rating", "clean_text", "cutoff", "cutoff_literal",
    "first_non_empty", "initials_app_store", "initials_google_play", "is_star",
    "local_date",
    "output_name", "parse_timestamp", "platform_key", "platform_slug",
    "sentiment_label", "slug_key", "strip_text", "text_hash",
    "title_if_differs", "utc_date", "whole_score",
]
