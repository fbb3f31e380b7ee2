"""Partial dates (YYYY, YYYY-MM, YYYY-MM-DD) as strings with closed day spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import DATE


def parse_date(text: Column) -> Column:
    """The first date in the text, as YYYY-MM-DD or YYYY-MM; null if there is none or it isn't in the calendar."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), DATE, 0)
    s = F.regexp_replace(found, r"(?<=\d)(?:st|nd|rd|th)\b", "")
    s = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[,.]", " "), " +", " "), r"\bSept\b", "Sep"))
    day = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in ("yyyy-MM-dd", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy")])
    month = F.coalesce(*[F.try_to_timestamp(F.concat(F.lit("1 "), s), F.lit(f)) for f in ("d MMMM yyyy", "d MMM yyyy")])
    return F.when(found == "", None).otherwise(F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.date_format(month, "yyyy-MM")))


def dates_in_text(text: Column) -> Column:
    """All valid dates in the text, distinct, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DATE), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, parse_date), lambda d: d.isNotNull()))


def span_start(iso: Column) -> Column:
    """The first day of a partial date; null if it is malformed."""
    return F.when(iso.rlike(r"^\d{4}$"), F.try_to_timestamp(F.concat(iso, F.lit("-01-01")), F.lit("yyyy-MM-dd"))).when(iso.rlike(r"^\d{4}-\d{2}$"), F.try_to_timestamp(F.concat(iso, F.lit("-01")), F.lit("yyyy-MM-dd"))).when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))).cast("date")


def span_end(iso: Column) -> Column:
    """The last day of a partial date."""
    start = span_start(iso)
    return F.when(F.char_length(iso) == 4, F.make_date(F.year(start), F.lit(12), F.lit(31))).when(F.char_length(iso) == 7, F.last_day(start)).otherwise(start)


def within(iso: Column, start: Column, end: Column) -> Column:
    """Whether the whole span of a partial date lies in [start, end]; a month is never inside a day."""
    return F.coalesce((span_start(iso) >= start) & (span_end(iso) <= end), F.lit(False))


def in_spans(iso: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: within(iso, s["start"], s["end"]))


def dates_conflict(a: Column, b: Column) -> Column:
    """Two lists of dates conflict if both have dates and none of either begins one of the other."""
    agree = F.exists(a, lambda x: F.exists(b, lambda y: x.startswith(y) | y.startswith(x)))
    return (F.size(a) > 0) & (F.size(b) > 0) & ~agree
