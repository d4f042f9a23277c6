"""Star-rating rules. The two stores differ: one clamps, the other drops."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from revlume.functions.text import strip_text

MIN_STARS, MAX_STARS = 1, 5

# Whole number as a reader of free text accepts it: any decimal digits, single
# underscores between them, an optional sign.
_WHOLE_NUMBER = r"(?U)\A[+-]?\d+(_\d+)*\z"


def clamp_star_rating(col: Column) -> Column:
    """Integer text clamped to 1..5, null when it is not an integer."""
    text = strip_text(col.cast("string"))
    number = F.replace(text, F.lit("_"), F.lit("")).try_cast("decimal(38,0)")
    # too long for the cast: the sign alone decides
    beyond = F.when(text.startswith("-"), MIN_STARS).otherwise(MAX_STARS)
    inside = F.least(F.lit(MAX_STARS), F.greatest(F.lit(MIN_STARS), number))
    clamped = F.when(number.isNull(), beyond).otherwise(inside).cast("int")
    return F.when(col.isNotNull() & text.rlike(_WHOLE_NUMBER), clamped)


def whole_score(col: Column) -> Column:
    """Score truncated towards zero; missing or unreadable counts as 0."""
    return F.coalesce(col.try_cast("double").try_cast("int"), F.lit(0))


def is_star(col: Column) -> Column:
    return col.between(MIN_STARS, MAX_STARS)
