"""Scalar rules, as tables of input and expected value."""

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from revlume.functions import (
    clamp_star_rating, clean_text, first_non_empty, initials_app_store,
    initials_google_play, local_date, output_name, parse_timestamp, platform_key,
    platform_slug, sentiment_label, strip_text, text_hash, title_if_differs,
    whole_score,
)
from revlume.functions.dates import cutoff, naive_as_utc
from revlume.functions.text import WHITESPACE


def apply(spark, function, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    rows = df.select("i", function(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


def check(spark, function, cases, dtype="string"):
    got = apply(spark, function, [c[0] for c in cases], dtype)
    assert list(zip([c[0] for c in cases], got)) == cases


ODD_TEXTS = [
    "", " ", "a", " a ", "a\n\tb", "\x1ca\x1fb\x1d", "\xa0a\u3000 b\u2003", "a\x85b",
    "\u200ba", "a \u2028\u2029 b", "\u1680", "x" * 50, "a\r\nb \x0b\x0c", "\x1b[a",
    "café  crème\n", "\u180ea\u180e", "  \U0001f600  \U0001f600 ",
]


def test_whitespace_is_the_unicode_set():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if re.match(r"\s", chr(c))}


def test_clean_text(spark):
    expected = [(t, re.sub(r"\s+", " ", t).strip() or None) for t in ODD_TEXTS]
    check(spark, clean_text, expected + [(None, None)])


def test_strip_text(spark):
    check(spark, strip_text, [(t, t.strip()) for t in ODD_TEXTS] + [(None, "")])


def test_clamp_star_rating(spark):
    check(
        spark, clamp_star_rating,
        [
            ("0", 1), ("6", 5), ("3", 3), ("4", 4), ("bad", None), ("4.0", None), ("+4", 4),
            ("99999999999", 5), ("-3", 1), ("1_0", 5), ("", None), (" 5 ", 5), ("1e0", None),
            ("__1", None), ("1__0", None), ("_1", None), ("-0", 1), ("00_3", 3), ("5\n", 5),
            ("9" * 60, 5), ("-" + "9" * 60, 1), ("\uff14", 4), ("\u0663", 3), ("+", None),
            ("3 3", None), (None, None),
        ],
    )


def test_clamp_star_rating_of_numbers(spark):
    check(spark, clamp_star_rating, [(0, 1), (6, 5), (3, 3), (None, None)], "int")


def test_whole_score(spark):
    check(
        spark, whole_score,
        [(4.7, 4), (0.0, 0), (None, 0), (6.0, 6), (-1.5, -1), (1e18, 0)], "double",
    )
    assert apply(spark, whole_score, [float("nan")], "double") == [0]


NAMES = [
    # name, App Store, Google Play
    ("Noor", "N.", "N."), ("Teun de Wit", "T.W.", "T. W."), ("A Google User", "A.U.", "A."),
    ("", "A.", "A."), (None, "A.", "A."), ("Canon Fan", "C.F.", "A."), ("1abc", "1.", "1."),
    ("李雷", "A.", "A."), ("  bob \u3000 van\tdyk ", "B.D.", "B. D."),
    ("ANONYMOUS", "A.", "A."), ("x", "X.", "X."), ("1 2", "A.", "A."),
    ("ßa x", "SS.X.", "SS. X."), ("google\u00a0 user", "G.U.", "A."),
]


def test_initials(spark):
    check(spark, initials_app_store, [(n, a) for n, a, _ in NAMES])
    check(spark, initials_google_play, [(n, g) for n, _, g in NAMES])


def test_text_hash(spark):
    long_a, long_b = ("prefix " * 60 + tail for tail in ("one", "two"))
    got = apply(spark, text_hash, [long_a, long_b, "same", "same", "é"])
    assert got[0] != got[1] and got[2] == got[3]
    assert got[4] == hashlib.sha256("é".encode()).hexdigest()[:16]


DATES = [
    # text, UTC instant, own day
    ("2024-06-01T23:30:00-07:00", "2024-06-02 06:30:00", "2024-06-01"),
    ("2024-06-01T00:10:00+05:30", "2024-05-31 18:40:00", "2024-06-01"),
    ("2024-06-01T00:00:00Z", "2024-06-01 00:00:00", "2024-06-01"),
    ("2024-06-01", "2024-06-01 00:00:00", "2024-06-01"),
    ("2024-06-01 10:05", "2024-06-01 10:05:00", "2024-06-01"),
    ("2024-06-01T10:00:00+0530", "2024-06-01 04:30:00", "2024-06-01"),
    ("2024-06-01T10:00:00.5 UTC", "2024-06-01 10:00:00", "2024-06-01"),
    ("Jun 1, 2024", "2024-06-01 00:00:00", "2024-06-01"),
    ("June 1, 2024 10:30 PM", "2024-06-01 22:30:00", "2024-06-01"),
    ("Sat, 01 Jun 2024 23:30:00 -0700", "2024-06-02 06:30:00", "2024-06-01"),
    ("06/01/2024", "2024-06-01 00:00:00", "2024-06-01"),
    ("13/06/2024", "2024-06-13 00:00:00", "2024-06-13"),
    ("2024-13-01", None, None), ("2024-02-30", None, None), ("soon", None, None),
    ("", None, None), (None, None, None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_dates_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = [d[0] for d in DATES]
        epochs = apply(spark, lambda c: F.unix_seconds(parse_timestamp(c)), texts)
        days = apply(spark, lambda c: local_date(c).cast("string"), texts)
        naive = spark.sql("SELECT timestamp_ntz'2024-06-01 12:00:00' AS t")
        noon = naive.select(F.unix_seconds(naive_as_utc(F.col("t")))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)

    def epoch(text):
        read = datetime.datetime.fromisoformat(text + "+00:00")
        return int(read.timestamp())

    assert epochs == [d[1] and epoch(d[1]) for d in DATES]
    assert days == [d[2] for d in DATES]
    assert noon == epoch("2024-06-01 12:00:00")


MORE_DATES = """2024-03-05T10:30:00.250+02:00|20240305|20240305T1015Z|20240305T101500-0330|2024-03-05T12Z|2024/3/5
2024.03.05 10:30|2024 03 05|3/5/2024|15/3/2024 23:59|03-05-2024|25.12.2024|5.3.2024 10:30|Mar. 5, 2024 10:30 PM
March 5th, 2024 at 10:30 p.m.|5 March 2024|5th of March 2024 12:00 am|05-Mar-2024 10:30:15|2024-Mar-05|2024 March 5
Tue Mar  5 10:30:00 2024|Tue Mar 05 10:30:00 UTC 2024|Tue Mar 5 10:30:00 -0800 2024|Tuesday, March 5, 2024 10 PM
10:30 5 March 2024|10:30:15 PM, Mar 5 2024|Mar 5 2024 10:30:00,123|Mar 5 2024 10:30:00.123456789 GMT|Sept 5, 2024
SEPTEMBER 5 2024|5 sep 2024 1:05am|2024-3-5 1:02:03|3/5/2024 1:02:03 PM +05:30|Mar 5, 2024; 10:30|10 PM 5 Mar 2024
Tue 5 Mar 2024 10:30 GMT+3|Tue 5 Mar 2024 10:30 UTC-3|30 Feb 2024|13/13/2024|Mar 5 2024 25:00|Mar 5 2024 13:00 PM
on|?|Mar 5 2024 foo|20240230|31 Apr 2024 10:30|5.3.2024 10:60|2024/13/13|Mar Mar 2024"""


def test_dates_are_read_as_the_public_parser_reads_them(spark):
    parser = pytest.importorskip("dateutil.parser")
    texts = re.split(r"[|\n]", MORE_DATES)
    start = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)

    def expected(text):
        try:
            read = parser.parse(text)
        except (ValueError, OverflowError):
            return None, None
        at = read if read.tzinfo else read.replace(tzinfo=datetime.timezone.utc)
        return (at - start) // datetime.timedelta(microseconds=1), read.date().isoformat()

    got = zip(
        apply(spark, lambda c: F.unix_micros(parse_timestamp(c)), texts),
        apply(spark, lambda c: local_date(c).cast("string"), texts),
        strict=True,
    )
    assert dict(zip(texts, got, strict=True)) == {t: expected(t) for t in texts}


def test_dates_that_name_no_day_stay_unread(spark):
    texts = ["Mar 2024", "3/5/24", "Mar 5 24", "5", "2024", "10:30", "Mar 5 2024 10:30 11:30", "-", " . ", "\U0001f600", "1" * 5000]
    assert apply(spark, parse_timestamp, texts) == [None] * len(texts)


def test_cutoff_counts_days():
    now = datetime.datetime(2024, 12, 31)
    assert cutoff(now).isoformat() == "2024-01-01T00:00:00+00:00"


def test_labels(spark):
    nan = float("nan")
    got = apply(spark, sentiment_label, [0.25, 0.2499, 0.0, -0.2499, -0.25, 1.0, -1.0, nan], "double")
    assert got == ["good", "neutral", "neutral", "neutral", "bad", "good", "bad", "neutral"]


def test_fallback_and_title(spark):
    df = spark.createDataFrame(
        [(None, "b", "t", "t"), ("", "b", "t", "x"), ("a", "b", None, "x"), (None, "", "t", None)],
        "a string, b string, title string, text string",
    )
    rows = df.select(
        first_non_empty(F.col("a"), F.col("b")), title_if_differs(F.col("title"), F.col("text"))
    ).collect()
    assert [tuple(r) for r in rows] == [("b", None), ("b", "t"), ("a", None), (None, None)]


def test_names_of_outputs(spark):
    df = spark.range(1)
    name = lambda key, analysis: df.select(
        output_name(F.lit("app"), None if key is None else F.lit(key), F.lit(analysis))
    ).first()[0]
    assert name(None, False) == "app_reviews"
    assert name(None, True) == "app_reviews_analysis"
    assert name("app_store", False) == "app_app_store_reviews"
    assert name("google_play", True) == "app_google_play_reviews_analysis"


def test_platform_names(spark):
    check(spark, platform_key, [("App Store", "app_store"), ("Google Play Store", "google_play"), ("x", None)])
    check(spark, platform_slug, [("app_store", "app-store"), ("google_play", "google-play")])
