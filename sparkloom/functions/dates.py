"""Calendar functions whose rules differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_label(day: Column) -> Column:
    """yyyy-MM."""
    return F.date_format(day, "yyyy-MM")


def weekday0(day: Column) -> Column:
    """Day of the week as text, Sunday 0."""
    return (F.dayofweek(day) - 1).cast("string")


def monday_week(day: Column) -> Column:
    """Week of the year from 00, weeks start on Monday, days before the first Monday are in week 0."""
    return F.floor((F.dayofyear(day) + 6 - F.pmod(F.dayofweek(day) + 5, F.lit(7))) / 7).cast("int")


def quarter_label(day: Column) -> Column:
    return F.concat(F.lit("T"), F.floor((F.month(day) + 2) / 3).cast("string"))


def age_years(born: Column, at: Column) -> Column:
    """Whole years of 365.25 days."""
    return (F.datediff(at, born) / F.lit(365.25)).cast("int")


def month_spine(first: Column, last: Column) -> Column:
    """The first days of all months from first to last."""
    return F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))


def day_spine(first: Column, last: Column) -> Column:
    return F.sequence(first, last, F.expr("interval 1 day"))


def feed_date(text: Column) -> Column:
    """Day of a feed's date: RFC 822 with or without weekday, ISO instant, ISO day, ISO month or year; else null.

    Instants count by their UTC day.
    """
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    zoned = F.regexp_replace(bare, r"\s(GMT|UT|UTC|Z)$", " +0000")
    forms = [F.try_to_timestamp(zoned, F.lit(f"{d} MMM yyyy HH:mm{s} xx")) for d in ("d", "dd") for s in (":ss", "")]
    forms += [F.try_to_timestamp(bare, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d MMM yyyy")]
    forms += [F.try_to_timestamp(F.concat(bare, F.lit(rest)), F.lit("yyyy-MM-dd")) for rest in ("-01", "-01-01")]
    return F.to_date(F.coalesce(*forms))


def is_hour(at: Column, zone: str, hour: int) -> Column:
    """Whether an instant falls in that hour of the zone's clock, by the rules of its date.

    Of the two runs that a fixed universal hour needs to meet a local one all year round, one is meant.
    """
    return F.hour(F.from_utc_timestamp(at, zone)) == hour


def instant_ms(text: Column) -> Column:
    """Milliseconds of an instant as servers write it: an HTTP date, or ISO date and time with a zone and any
    number of decimals; null for anything else."""
    http = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"\s(GMT|UTC)$", " +0000"), F.lit("dd MMM yyyy HH:mm:ss xx"))
    whole = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}:[0-9]{2}:[0-9]{2})(\.[0-9]+)?(Z|[+-][0-9]{2}(?::?[0-9]{2})?)$"
    part = lambda k: F.regexp_extract(F.trim(text), whole, k)
    zone = F.rpad(F.replace(F.when(part(4) == "Z", "+0000").otherwise(part(4)), F.lit(":"), F.lit("")), 5, "0")
    iso = F.try_to_timestamp(F.concat(part(1), F.lit("T"), part(2), zone), F.lit("yyyy-MM-dd'T'HH:mm:ssxx"))
    more = F.rpad(F.substring(part(3), 2, 3), 3, "0").cast("int")
    return F.coalesce(F.unix_millis(http), F.unix_millis(F.when(F.trim(text).rlike(whole), iso)) + F.when(F.trim(text).rlike(whole), more))
