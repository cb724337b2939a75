"""Minutes as the reference point of velocity checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minute_number(moment: Column) -> Column:
    """Whole minutes since 1970.

    The difference of two minute numbers counts minute boundaries: 00:00:59 and
    00:01:01 are one minute apart, 10:00:00 and 11:00:59 sixty.
    """
    day = F.unix_date(moment.cast("date")).cast("long")
    return day * 1440 + F.hour(moment) * 60 + F.minute(moment)
