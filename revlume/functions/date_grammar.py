"""Dates that are not ISO 8601, by a grammar of words and numbers instead of a list of formats.

One pass cuts a text into numbers, words and marks and writes every word as what it means: a month as its
number, weekdays and joining words ("at", "of", "th") as nothing.  The clock and its zone are then cut out
wherever they stand, and what is left must be a date: three fields, or one number of eight digits.  A small
table on the kinds of the three fields says which is which.  A further spelling costs nothing, as no format
is tried after another.

Ambiguous texts are defined: of two numbers before the year the first is the month, unless it is above 12;
a year has four digits; a month without a day or a year of two digits names no date; letters such as "PST"
after a clock, which differ from country to country, are read as no offset; "GMT+3" and "UTC+3", written
as one word, are clocks three hours behind Greenwich, as in POSIX.  Hours go to 23, with am or pm
from 1 to 12; a day that the month does not have makes the whole text unreadable.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
    "november", "december",
]
_WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
_MEANINGS = {
    **{name: f"M{i:02}" for i, whole in enumerate(_MONTHS, 1) for name in (whole, whole[:3])},
    "sept": "M09",
    **{name: "" for whole in _WEEKDAYS for name in (whole, whole[:3])},
    **dict.fromkeys(["st", "nd", "rd", "th", "of", "at", "on", "and", "m", ",", ";"], ""),
    **{"a": "AM", "am": "AM", "p": "PM", "pm": "PM", "t": "T", "z": "Z", "utc": "Z", "gmt": "Z"},
    **{mark: mark for mark in "./-:+"},
    # "GMT+3" says what is added to the clock to reach Greenwich
    **{"gmt+": "-", "utc+": "-", "gmt-": "+", "utc-": "+"},
}

_TOKEN = r"(\d+|(?:UTC|GMT)[+-](?=\d)|[A-Za-z]+|[^\sA-Za-z\d])"
_NOON = r"(?: ([AP]M)(?: \.)*)"
# Groups: before; hour, minute, second, fraction twice, noon; hour, noon; hour, minute, second; sign,
# hours, minutes; sign, hours, minutes; after.
_CLOCK = (
    r"\A(.*?)(?: T)?(?:"
    r" (\d{1,2}) : (\d{1,2})(?: : (\d{1,2})(?: \. (\d+)| (\d{3}|\d{6}))?)?" + _NOON + r"?"
    r"| (\d{1,2})" + _NOON + r""
    r"|(?<= T) (\d{2})(?:(\d{2})(\d{2})?)?)"
    r"(?: [ZN])?(?: ([+-]) (\d{1,2}) : (\d{2})| ([+-]) (\d{2}|\d)(\d{2})?)?(?= )(.*)\z"
)
_CLOCK_FIELDS = "$1$19|$2$8$10|$3$11|$4$12|$5$6|$7$9|$13$16|$14$17|$15$18|"
_FIELD = r"(M\d{2}|\d{4}|\d{1,2})"
_BETWEEN = r"(?: [-/.])*"
_THREE = rf"\A {_FIELD}{_BETWEEN} {_FIELD}{_BETWEEN} {_FIELD}(?: T)? *\z"
_EIGHT = r"\A (\d{4})(\d{2})(\d{2})(?: T)? *\z"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _canonical(text: Column) -> Column:
    """Words as what they mean, each token between blanks."""
    pairs = [F.lit(x) for pair in _MEANINGS.items() for x in pair]
    meanings = F.create_map(*pairs)

    def meaning(token: Column) -> Column:
        return (
            F.when(token.rlike(r"\A\d"), token)
            .otherwise(F.coalesce(
                meanings[F.lower(token)],
                F.when(token.rlike(r"\A[A-Z]{3,5}\z"), "N").otherwise("?"),
            ))
        )

    told = F.filter(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1)), meaning), lambda t: t != "")
    return F.concat(F.lit(" "), F.array_join(told, " "), F.lit(" "))


def _number(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(text.try_cast("int"))


def _day(rest: Column) -> Column:
    """The date that is left when the clock is gone."""
    plain = F.regexp_replace(rest, " +", " ")
    fields = F.split(F.regexp_replace(F.regexp_replace(plain, _EIGHT, "$1|$2|$3"), _THREE, "$1|$2|$3"), r"\|")

    def dated(f: Column) -> Column:
        a, b, c = f[0], F.get(f, F.lit(1)), F.get(f, F.lit(2))
        named = lambda x: x.startswith("M")
        year = lambda x: F.length(x) == 4

        def made(y: Column, m: Column, d: Column) -> Column:
            month = F.lpad(F.ltrim(m, F.lit("M")), 2, "0")
            return F.when(
                year(y) & ~named(y) & ~named(d),
                F.concat_ws("-", y, month, F.lpad(d, 2, "0")),
            )

        written = (
            F.when(F.size(f) != 3, F.lit(None).cast("string"))
            .when(named(a), made(c, a, b))
            .when(named(b) & year(a), made(a, b, c))
            .when(named(b), made(c, b, a))
            .when(year(a), made(a, b, c))
            .when(a.try_cast("int") > 12, made(c, b, a))
            .otherwise(made(c, a, b))
        )
        return written.try_cast("date")

    return _let(fields, dated)


def _read(canonical: Column) -> Column:
    fields = F.split(F.regexp_replace(canonical, _CLOCK, _CLOCK_FIELDS), r"\|")

    def told(f: Column) -> Column:
        part = lambda i: F.coalesce(F.get(f, F.lit(i)), F.lit(""))
        hour, noon = _number(part(1)), part(5)
        right_hour = F.when(noon == "", hour <= 23).otherwise((hour >= 1) & (hour <= 12))
        full_hour = F.when(noon == "", hour).otherwise(hour % 12 + F.when(noon == "PM", 12).otherwise(0))
        minute, second = _number(part(2)), _number(part(3))
        micros = F.rpad(F.substring(part(4), 1, 6), 6, "0").cast("long")
        zone_hours, zone_minutes = _number(part(7)), _number(part(8))
        right = right_hour & (minute <= 59) & (second <= 59) & (zone_hours <= 23) & (zone_minutes <= 59)
        day = F.when(right, _day(F.get(f, F.lit(0))))
        million = F.lit(1_000_000).cast("long")
        wall = (F.unix_date(day).cast("long") * 86_400 + full_hour * 3_600 + minute * 60 + second) * million + micros
        offset = F.when(part(6) == "-", -1).otherwise(1) * (zone_hours * 3_600 + zone_minutes * 60) * million
        return F.struct(day.alias("day"), F.timestamp_micros(wall - offset).alias("instant"))

    return _let(fields, told)


def read_date(text: Column) -> Column:
    """``day``, in the text's own offset, and ``instant`` of a date text; null where it names no date."""
    return _let(_canonical(text), _read)
