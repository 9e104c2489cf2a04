"""Dates from text: the first pattern that fits gives the value, what fits none is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

# Patterns in the order in which they are tried, each with the form a text must have.
# Each is also tried with a time after it.
DATE_PATTERNS = (
    ("yyyy-MM-dd", r"\d{4}-\d{2}-\d{2}"),
    ("yyyy/MM/dd", r"\d{4}/\d{2}/\d{2}"),
    ("dd/MM/yyyy", r"\d{2}/\d{2}/\d{4}"),
    ("dd-MM-yyyy", r"\d{2}-\d{2}-\d{4}"),
    ("MM/dd/yyyy", r"\d{2}/\d{2}/\d{4}"),
    ("M/d/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"),
)
TIME = ("HH:mm:ss", r"\d{2}:\d{2}:\d{2}")
# Names of months, English and Vietnamese, in their order.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
VIETNAMESE = ("một", "hai", "ba", "tư", "năm", "sáu", "bảy", "tám", "chín", "mười", "mười một", "mười hai")

ISO = r"^\d{4}-\d{2}-\d{2}\z"
SLASHED = r"^\d{2}/\d{2}/\d{4}\z"


def _fits(c: Column, form: str) -> Column:
    return c.rlike(rf"^{form}\z")


def _parsed(c: Column, pattern: str) -> Column:
    return F.to_date(F.try_to_timestamp(c, F.lit(pattern)))


def slashed_to_iso(c: Column) -> Column:
    """dd/MM/yyyy -> yyyy-MM-dd by its text; other forms unchanged."""
    t = trimmed(c)
    return F.when(t.rlike(SLASHED), F.concat_ws("-", F.substring(t, 7, 4), F.substring(t, 4, 2), F.substring(t, 1, 2))).otherwise(t)


def to_date(c: Column) -> Column:
    """Date, by any of the patterns; a time after it is left out."""
    t = trimmed(c)
    day = F.regexp_replace(t, rf" {TIME[1]}\z", "")
    return F.coalesce(*[F.when(_fits(day, form), _parsed(day, p)) for p, form in DATE_PATTERNS])


def to_timestamp(c: Column) -> Column:
    """Date and time; a date alone is its midnight."""
    t = trimmed(c)
    timed = [F.when(_fits(t, f"{form} {TIME[1]}"), F.try_to_timestamp(t, F.lit(f"{p} {TIME[0]}"))) for p, form in DATE_PATTERNS]
    return F.coalesce(*timed, to_date(t).cast("timestamp"))


def iso_text(c: Column) -> Column:
    """Text of a date as yyyy-MM-dd, of a month as yyyy-MM; other text unchanged."""
    t = trimmed(c)
    return F.coalesce(F.date_format(to_date(t), "yyyy-MM-dd"), t)


def two_forms(c: Column) -> Column:
    """Date from dd/MM/yyyy or yyyy-MM-dd only, and only if it is one."""
    t = trimmed(c)
    return F.coalesce(F.when(t.rlike(SLASHED), _parsed(t, "dd/MM/yyyy")), F.when(t.rlike(ISO), _parsed(t, "yyyy-MM-dd")))


def from_serial(c: Column) -> Column:
    """Spreadsheet day number, 1 to under 3 000 000; numbers below 61 stand before the leap day that never was."""
    n = F.floor(c.try_cast("double")).cast("int")
    ok = (n >= 1) & (n < 3_000_000)
    shifted = F.when(n < 61, n + 1).otherwise(n)
    return F.when(ok, F.date_add(F.lit("1899-12-30").cast("date"), shifted))


def full_year(c: Column) -> Column:
    """M/d/yy -> M/d/yyyy, d-M-yy -> d-M-yyyy: years to 30 are 20yy, others 19yy; other text unchanged."""
    t = trimmed(c)
    short = r"^(\d{1,2}[/-]\d{1,2}[/-])(\d{2})\z"
    year = F.regexp_extract(t, short, 2).try_cast("int")
    century = F.when(year <= 30, F.lit("20")).otherwise(F.lit("19"))
    return F.when(t.rlike(short), F.concat(F.regexp_extract(t, short, 1), century, F.regexp_extract(t, short, 2))).otherwise(t)


def month_number(c: Column) -> Column:
    """1 to 12 from an English name, long or short, a Vietnamese one, or a number."""
    t = F.lower(trimmed(c))
    names = {}
    for k, name in enumerate(MONTHS, 1):
        names[name] = names[name[:3]] = k
    names["sept"] = 9
    for k, name in enumerate(VIETNAMESE, 1):
        names[f"tháng {name}"] = names[f"tháng {k}"] = k
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    digits = F.regexp_extract(t, r"^(\d{1,2})\z", 1).try_cast("int")
    return F.coalesce(F.try_element_at(known, t), F.when(digits.between(1, 12), digits))


def named_month_date(c: Column) -> Column:
    """dd-MMM-yyyy or dd-MMM-yy with a month's name -> date."""
    t = trimmed(c)
    form = r"^(\d{1,2})-([^-]+)-(\d{4}|\d{2})\z"
    year = F.regexp_extract(t, form, 3)
    short = year.try_cast("int")
    whole = F.when(F.length(year) == 4, short).when(short <= 30, 2000 + short).otherwise(1900 + short)
    iso = F.format_string("%04d-%02d-%02d", whole, month_number(F.regexp_extract(t, form, 2)), F.regexp_extract(t, form, 1).try_cast("int"))
    return F.when(t.rlike(form) & month_number(F.regexp_extract(t, form, 2)).isNotNull(), _parsed(iso, "yyyy-MM-dd"))


FOREVER = "9999-12-31"


def destruction_date(retention: Column, start: Column) -> Column:
    """Permanent, or no date to count from: the last day there is; short, medium, long: 5, 10, 15 years later."""
    later = lambda years: F.add_months(start, 12 * years)
    last = F.lit(FOREVER).cast("date")
    return (
        F.when((retention == "permanent") | start.isNull() | retention.isNull(), last)
        .when(retention == "short", later(5)).when(retention == "medium", later(10)).when(retention == "long", later(15)).otherwise(last)
    )
