"""Timestamps in many formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value.
SYSLOG_FORMAT = "yyyy MMM d HH:mm:ss"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp"))


def _iso(value: Column) -> Column:
    """ISO text with any fraction and either Z or a numeric offset (colon optional)."""
    shaped = value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:?\d{2})$")
    fixed = F.regexp_replace(value, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(shaped, F.try_to_timestamp(fixed))


def timeline_time(value) -> Column:
    """Timestamp of timeline sources. NULL where no format fits (never 'now')."""
    value = F.trim(_col(value).cast("string"))
    return F.coalesce(
        _iso(value),
        F.when(value.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
               F.try_to_timestamp(value, F.lit("yyyy-MM-dd HH:mm:ss"))),
        F.when(value.rlike(r"(?i)^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AP]M$"),
               F.try_to_timestamp(F.upper(value), F.lit("M/d/yyyy h:mm:ss a"))),
    )


def log_time(value, year: int | None = None) -> Column:
    """Timestamp of log lines. Syslog carries no year: it is a parameter, else NULL."""
    value = F.trim(_col(value).cast("string"))
    syslog = F.lit(None).cast("timestamp")
    if year is not None:
        squeezed = F.concat(F.lit(f"{year} "), F.regexp_replace(value, r"\s+", " "))
        syslog = F.when(value.rlike(r"^[A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}$"),
                        F.try_to_timestamp(squeezed, F.lit(SYSLOG_FORMAT)))
    return F.coalesce(
        F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"), F.try_to_timestamp(value)),
        F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}$"),
               F.try_to_timestamp(value, F.lit("yyyy-MM-dd HH:mm:ss"))),
        syslog,
    )
