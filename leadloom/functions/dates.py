"""Dates as column expressions: ISO weeks, day-first dates in text, spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names and their usual short forms.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}

#: What notices write before the date that ends them, and before the date they are opened on.
CLOSING_LABELS = ("last date", "last day", "closing date", "due date", "end date", "bid end", "bid submission end", "submission date", "submission deadline", "valid up to", "valid upto", "valid till", "valid until")
OPENING_LABELS = ("date of opening", "opening date", "bid opening", "tender opening")
#: Characters after the end of a label within which its date starts.
LABEL_REACH = 90

#: A date is three fields in a row: numbers or the name of a month, parted by a sign and blanks. What they mean is told
#: by their kinds alone.
_NAME = "(?:" + "|".join(sorted(MONTHS, key=lambda m: (-len(m), m))) + r")\b\.?"
_PART = r"\s*[-./,]\s*|\s+"
FIELDS = rf"(?i)\b(\d{{4}}|\d{{1,2}}|{_NAME})({_PART})(\d{{1,2}}|{_NAME})({_PART})(\d{{4}}|\d{{1,2}})\b"


def half_up(c: Column) -> Column:
    """Round to whole numbers, halves towards plus infinity."""
    return F.floor(c + 0.5)


def days_between(a: Column, b: Column) -> Column:
    """Whole days from a to b; for timestamps rounded half up; null where either is null."""
    return half_up((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 86_400_000_000)


def _calendar(year: Column, month: Column, day: Column) -> Column:
    y = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    date = F.try_to_date(F.concat_ws("-", y, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return F.when(y.cast("int").between(1970, 2100), date)


def _read(first: Column, second: Column, third: Column, parts: Column) -> Column:
    """The date of three fields: year-month-day, day-month-year with a number or a name, or name-day-year."""
    month_of = F.create_map(*[F.lit(x) for name, n in MONTHS.items() for x in (name, str(n))])
    named = lambda c: F.try_element_at(month_of, F.lower(F.replace(c, F.lit("."), F.lit(""))))
    is_number, long_year = lambda c: c.rlike("^[0-9]"), F.length(third) == 4
    year_last = long_year | (F.length(third) == 2)
    return (
        F.when(first.rlike("^[0-9]{4}$"), F.when(is_number(second) & (parts == "--") & (F.length(second) == 2) & (F.length(third) == 2), _calendar(first, second, third)))
        .when(is_number(first) & is_number(second), F.when(parts.rlike("^[-./]{2}$") & year_last, _calendar(third, second, first)))
        .when(is_number(first), F.when(year_last, _calendar(third, named(second), first)))
        .when(is_number(second), F.when(long_year, _calendar(third, named(first), second)))
    )


def find_dates(c: Column) -> Column:
    """All dates in a text, in order; those that the calendar does not have are left out."""
    field = lambda i: F.regexp_extract_all(c, F.lit(FIELDS), F.lit(i))
    found = F.arrays_zip(*(field(i).alias(f"f{i}") for i in range(1, 6)))
    dates = F.transform(found, lambda f: _read(f["f1"], f["f3"], f["f5"], F.concat(f["f2"], f["f4"])))
    return F.filter(dates, lambda d: d.isNotNull())


def parse_date(c: Column) -> Column:
    """A date as notices write it, day first, with nothing around it; null unless the calendar has it."""
    return F.when(F.trim(c).rlike(f"^(?:{FIELDS})$"), F.get(find_dates(F.trim(c)), F.lit(0)))


def find_deadline(c: Column, today: Column) -> Column:
    """The first date soon after a closing label, else after an opening label, else the earliest date from today on; a
    past date without a label is no deadline."""

    def labelled(labels: tuple[str, ...]) -> Column:
        phrase = "|".join(label.replace(" ", r"\s+") for label in labels)
        after = F.regexp_extract_all(c, F.lit(rf"(?is)\b(?:{phrase})\b(.{{0,{LABEL_REACH}}})"), F.lit(1))
        return F.get(F.flatten(F.transform(after, find_dates)), F.lit(0))

    future = F.array_min(F.filter(find_dates(c), lambda d: d >= today))
    return F.coalesce(labelled(CLOSING_LABELS), labelled(OPENING_LABELS), future)


def iso_week(c: Column) -> Column:
    """YYYY-Www by ISO 8601."""
    return F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


def week_start(week: Column) -> Column:
    """Monday of an ISO week; null for a week its year does not have."""
    year, n = F.substring(week, 1, 4), F.substring(week, 7, 2).cast("int")
    monday = F.date_add(F.trunc(F.to_date(F.concat(year, F.lit("-01-04"))), "week"), 7 * (n - 1))
    return F.when(iso_week(monday) == week, monday)


def previous_week(week: Column) -> Column:
    return iso_week(F.date_sub(week_start(week), 7))


def in_week(ts: Column, week: Column) -> Column:
    start = week_start(week)
    return F.coalesce(ts.cast("date").between(start, F.date_add(start, 6)), F.lit(False))


def last_days(n: int, end: Column) -> Column:
    """The n days up to `end`, oldest first."""
    return F.sequence(F.date_sub(end, n - 1), end)


def short_date(c: Column) -> Column:
    return F.date_format(c, "dd MMM")


def from_unix_text(c: Column) -> Column:
    """Seconds since 1970 as text."""
    return F.timestamp_seconds(c.try_cast("double"))


def delivery_date(payload_date: Column, run_id: Column, at: Column) -> Column:
    in_run = F.try_to_date(F.regexp_extract(run_id, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    return F.coalesce(payload_date.cast("date"), in_run, at.cast("date"))


def next_run_at(now: Column, zone: str, hour: int, minute: int) -> Column:
    """The next wall-clock time of a zone strictly after a UTC instant, as UTC."""
    local_day = F.date_trunc("day", F.from_utc_timestamp(now, zone))
    at = lambda days: F.to_utc_timestamp(local_day + F.make_dt_interval(F.lit(days), F.lit(hour), F.lit(minute)), zone)
    return F.when(at(0) > now, at(0)).otherwise(at(1))
