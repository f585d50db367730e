"""Times as epoch microseconds, whatever the session's time zone (zone-less timestamps are read as UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(c: Column) -> Column:
    """Epoch microseconds of a zone-less timestamp."""
    clock = (F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint") * 1_000_000
    return F.unix_date(c.cast("date")).cast("bigint") * DAY + clock + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def day(at: Column) -> Column:
    """Date of epoch microseconds."""
    return F.date_from_unix_date(F.floor(at / DAY).cast("int"))


def month(at: Column) -> Column:
    return F.date_format(day(at), "yyyy-MM")


def month_number(at: Column) -> Column:
    return (F.year(day(at)) * 12 + F.month(day(at)) - 1).cast("bigint")
