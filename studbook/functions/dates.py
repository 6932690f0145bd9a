"""Date and time readers. Each returns timestamp_ntz, null when no accepted shape fits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import clean_text, strip

# Accepted shapes as (guard, Spark pattern), tried in this order.
MULTI_FORMATS = [
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
]
US_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}, \d{1,2}:\d{1,2}$", "M/d/yyyy, H:m"),
]
LISTING_FORMATS = [(r"^\d{1,2}/\d{1,2}/\d{4}, \d{1,2}:\d{1,2}$", "d/M/yyyy, H:m")]
DOTTED_FORMATS = [(r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy")]
CERTIFICATE_FORMATS = [(r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy")]

# Russian genitive month names, January first.
RUSSIAN_MONTHS = [
    "января", "февраля", "марта", "апреля", "мая", "июня",
    "июля", "августа", "сентября", "октября", "ноября", "декабря",
]


def _first_format(c: Column, formats: list[tuple[str, str]]) -> Column:
    # Month names are matched without regard to case, as the feeds write them freely.
    named = F.initcap(c)
    return F.coalesce(*[
        F.when(c.rlike(guard), F.try_to_timestamp(named, F.lit(pattern))).cast("timestamp_ntz")
        for guard, pattern in formats
    ])


def parse_date_multi(c: Column) -> Column:
    return _first_format(clean_text(c), MULTI_FORMATS)


def parse_datetime_us(c: Column) -> Column:
    return _first_format(c, US_FORMATS)


def parse_datetime_listing(c: Column) -> Column:
    return _first_format(c, LISTING_FORMATS)


def parse_date_dotted(c: Column) -> Column:
    return _first_format(F.regexp_replace(strip(c), r"\.+$", ""), DOTTED_FORMATS)


def parse_date_cert(c: Column) -> Column:
    return _first_format(clean_text(c), CERTIFICATE_FORMATS)


def parse_date_ru(c: Column) -> Column:
    """Exactly three tokens: day, genitive month name, year."""
    parts = F.split(clean_text(c), " ")
    month = F.array_position(F.array(*[F.lit(m) for m in RUSSIAN_MONTHS]), F.lower(F.get(parts, F.lit(1))))
    digits = F.get(parts, F.lit(0)).rlike(r"^\d+$") & F.get(parts, F.lit(2)).rlike(r"^\d{1,4}$")
    iso = F.concat_ws("-", F.lpad(F.get(parts, F.lit(2)), 4, "0"), month.cast("string"), F.get(parts, F.lit(0)))
    return F.when(
        (F.size(parts) == 3) & digits & (month > 0), F.try_to_timestamp(iso, F.lit("yyyy-M-d"))
    ).cast("timestamp_ntz")


def format_date_long(c: Column, with_time: bool = False) -> Column:
    """Long Russian date such as `5 мая 2022 г.`; `Unknown` for null."""
    names = F.array(*[F.lit(m) for m in RUSSIAN_MONTHS])
    text = F.concat(
        F.dayofmonth(c).cast("string"), F.lit(" "), F.element_at(names, F.month(c)),
        F.lit(" "), F.year(c).cast("string"), F.lit(" г."),
    )
    if with_time:
        text = F.concat(text, F.lit(" в "), F.date_format(c, "HH:mm"))
    return F.coalesce(text, F.lit("Unknown"))
