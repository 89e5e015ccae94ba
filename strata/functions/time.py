"""Time helpers that do not depend on the session time zone.

The input tables use TIMESTAMP_NTZ (wall-clock values). Casting them to
TIMESTAMP interprets them in the session time zone, so epoch numbers and
watermarks would shift with the cluster's setting. These helpers read the
wall clock as UTC instead.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _epoch_ntz() -> Column:
    # A string literal cast to TIMESTAMP_NTZ is zone-free (a Python datetime
    # literal would be a zoned TIMESTAMP first).
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_us(ntz: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 of a TIMESTAMP_NTZ value (read as UTC)."""
    return F.timestamp_diff("MICROSECOND", _epoch_ntz(), ntz.cast("timestamp_ntz"))


def utc_instant(ntz: Column) -> Column:
    """The TIMESTAMP instant whose UTC wall clock equals the NTZ value."""
    return F.timestamp_micros(epoch_us(ntz))


def ntz_literal(value: str | _dt.datetime) -> Column:
    if isinstance(value, _dt.datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")
