"""Source-timestamp helpers: epoch units, precision class, GTID parts.

All functions are time-zone independent: ``timestamp_ntz`` values are read as UTC wall
clock, so results do not depend on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_micros(ts_ntz) -> Column:
    """Microseconds since the epoch of a UTC wall-clock ``timestamp_ntz``."""
    return F.timestamp_diff("MICROSECOND", _epoch(), _c(ts_ntz))


def precision_class(ts_us) -> Column:
    """Resolution actually carried by an epoch-µs value.

    ``second-padded`` (µs is a whole second), ``millisecond`` or ``microsecond``.
    """
    us = _c(ts_us)
    return (
        F.when(us.isNull(), F.lit(None).cast("string"))
        .when(us % F.lit(1_000_000) == 0, F.lit("second-padded"))
        .when(us % F.lit(1_000) == 0, F.lit("millisecond"))
        .otherwise(F.lit("microsecond"))
    )


def ns_is_derived(ts_ns) -> Column:
    """Nanosecond value that is only ``µs * 1000``."""
    return _c(ts_ns) % F.lit(1_000) == 0


def gtid_source(gtid) -> Column:
    """``uuid:txn`` -> server uuid (NULL for an empty GTID)."""
    g = F.nullif(_c(gtid), F.lit(""))
    return F.split_part(g, F.lit(":"), F.lit(1))


def gtid_txn(gtid) -> Column:
    g = F.nullif(_c(gtid), F.lit(""))
    return F.split_part(g, F.lit(":"), F.lit(2)).try_cast("bigint")
