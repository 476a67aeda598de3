"""Dates as audits count them: inclusive days, partial dates, cutoffs. All are column expressions; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inclusive_days(start: Column, end: Column) -> Column:
    """Days from start to end, both counted; null if they are inverted."""
    return F.when(end >= start, F.datediff(end, start) + 1)


def overlap_days(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Days that [a, b] and [c, d] share, 0 if none."""
    return F.greatest(F.lit(0), F.datediff(F.least(b, d), F.greatest(a, c)) + 1)


def hard_date(text: Column) -> Column:
    """Only a full, valid ISO date; anything else is null."""
    return F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.trim(text), "yyyy-MM-dd"))


def month_edge(text: Column, last: bool) -> Column:
    """A full ISO date, or the first or last day of a date that only gives its month (`2019-03 ...`)."""
    month = F.try_to_date(F.concat(F.regexp_extract(text, r"^\s*(\d{4}-\d{2})(?!-?\d)", 1), F.lit("-01")), "yyyy-MM-dd")
    return F.coalesce(hard_date(text), F.last_day(month) if last else month)


def any_date(text: Column) -> Column:
    """An ISO or DD/MM/YYYY date at the beginning of a text."""
    iso = F.try_to_date(F.regexp_extract(text, r"^\s*(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    return F.coalesce(iso, F.try_to_date(F.regexp_extract(text, r"^\s*(\d{2}/\d{2}/\d{4})", 1), "dd/MM/yyyy"))


#: Spanish months, in order.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "setiembre", "octubre", "noviembre", "diciembre")


def said_date(text: Column) -> Column:
    """The first date in a sentence: DD/MM/YYYY, else `12 de marzo de 1996`. A month alone is no date."""
    short = F.try_to_date(F.regexp_extract(text, r"\b(\d{2}/\d{2}/\d{4})\b", 1), "dd/MM/yyyy")
    rule = rf"(?i)\b(\d{{1,2}})\s+de\s+({'|'.join(MONTHS)}|septiembre)\s+del?\s+(?:año\s+)?(\d{{4}})\b"
    name = F.replace(F.lower(F.regexp_extract(text, rule, 2)), F.lit("septiembre"), F.lit("setiembre"))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), name)
    spelled = F.concat_ws("-", F.regexp_extract(text, rule, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, rule, 1), 2, "0"))
    return F.coalesce(short, F.try_to_date(spelled, "yyyy-MM-dd"))


def axis_unit(months: Column) -> Column:
    """What a time axis counts in: months up to 60 of them, quarters up to 240, else years."""
    return F.when(months <= 60, "mes").when(months <= 240, "trimestre").otherwise("anio")


def epoch_date(text: Column) -> Column:
    """The day of `/Date(milliseconds)/`."""
    return F.to_date(F.timestamp_millis(F.regexp_extract(text, r"/Date\((-?\d+)\)/", 1).try_cast("long")))


def years_before(day: Column, years: int) -> Column:
    """The same day so many years before; 29 February becomes the 28th."""
    return F.add_months(day, -12 * years)


def months_inclusive(start: Column, end: Column) -> Column:
    """Calendar months that [start, end] touches."""
    return (F.year(end) * 12 + F.month(end)) - (F.year(start) * 12 + F.month(start)) + 1
