"""Reviewer names reduced to initials."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from revlume.functions.text import WHITESPACE_CLASS, strip_text

# Fixed values.
NO_NAME = "A."
ANONYMOUS_PATTERN = r"(?iu)anonymous|anon|google user|a google user"


def _initials(name: Column, separator: str) -> Column:
    words = F.filter(
        F.split(strip_text(name), WHITESPACE_CLASS + "+"),
        lambda w: w.rlike("[A-Za-z]"),
    )
    # first and last lettered word, so that the split runs once per name
    ends = F.transform(
        F.array(words),
        lambda ws: F.when(
            F.size(ws) > 1, F.array(F.element_at(ws, 1), F.element_at(ws, -1))
        ).otherwise(ws),
    )
    marks = F.transform(
        F.flatten(ends), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))
    )
    return F.coalesce(
        F.nullif(F.array_join(marks, separator), F.lit("")), F.lit(NO_NAME)
    )


def initials_app_store(name: Column) -> Column:
    """``Alice Smith`` -> ``A.S.``"""
    return _initials(name, "")


def initials_google_play(name: Column) -> Column:
    """``Alice Smith`` -> ``A. S.``; names that say "anonymous" -> ``A.``"""
    one_line = F.regexp_replace(name, WHITESPACE_CLASS + "+", " ")
    return F.when(one_line.rlike(ANONYMOUS_PATTERN), F.lit(NO_NAME)).otherwise(
        _initials(name, " ")
    )
