"""Date arithmetic. Every function takes the clock as an argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(value: str | datetime | Column) -> Column:
    """Clock argument as a timestamp expression."""
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("timestamp")


def days(count: Column) -> Column:
    return F.make_dt_interval(count.cast("int"))


def due_date(created_at: Column, sla_days: Column, as_of: Column) -> Column:
    """created_at (or the clock if it is missing) plus the SLA; null without an SLA."""
    start = F.coalesce(created_at, as_of)
    return F.when(sla_days.isNotNull(), start + days(sla_days))


def days_overdue(due: Column, as_of: Column) -> Column:
    """Whole days late, never negative, 0 for a missing date."""
    late = (F.unix_micros(as_of) - F.unix_micros(due)) / F.lit(86_400_000_000)
    return F.coalesce(F.greatest(F.floor(late), F.lit(0)), F.lit(0)).cast("long")


def age_label(ts: Column, as_of: Column) -> Column:
    seconds = F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(1_000_000))

    def per(unit: int, suffix: str) -> Column:
        return F.concat(F.floor(seconds / unit).cast("string"), F.lit(suffix))

    return (
        F.when(ts.isNull(), F.lit(""))
        .when(seconds < 60, F.lit("just now"))
        .when(seconds < 3600, per(60, "m ago"))
        .when(seconds < 86400, per(3600, "h ago"))
        .otherwise(per(86400, "d ago"))
    )


def month_start(as_of: Column) -> Column:
    return F.date_trunc("month", as_of)


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text in UTC, microseconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    fine = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(fine)


def money(cents: Column) -> Column:
    return F.format_string("$%.2f", cents / F.lit(100.0))
