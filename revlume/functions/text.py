"""Text normalisation as Column expressions (JVM side, no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The code points Unicode calls white space, plus the four
# ASCII separators \x1c-\x1f. Java's own \s leaves most of them out.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The first part only rules most letters out quickly.
WHITESPACE_CLASS = (
    r"[\x00-\x20\x7f-\u3000&&"
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)


def strip_text(col: Column) -> Column:
    """Trim both ends; null becomes the empty string.

    ``btrim`` walks in from the ends only, so a long inner run of blanks
    costs nothing (an anchored regex would retry at every blank).
    """
    return F.coalesce(F.btrim(col, F.lit(WHITESPACE)), F.lit(""))


def clean_text(col: Column) -> Column:
    """Collapse inner white space, trim, and turn blank into null."""
    collapsed = F.regexp_replace(col, WHITESPACE_CLASS + "+", " ")
    return F.nullif(F.trim(collapsed), F.lit(""))


def first_non_empty(*cols: Column) -> Column:
    """First argument that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def text_hash(col: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the UTF-8 text."""
    return F.substring(F.sha2(col, 256), 1, 16)


def title_if_differs(title: Column, text: Column) -> Column:
    """The title, unless it only repeats the body."""
    return F.when(title != text, title)
