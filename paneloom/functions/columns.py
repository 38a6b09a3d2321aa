"""Column functions shared by all operators; everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day numbers count from 1900-01-01. LAST_DAY stands for "open" and lies in the year 2258.
EPOCH_SHIFT = 25567
DAY_BITS = 17
LAST_DAY = (1 << DAY_BITS) - 1
OPEN_DATE = "99991231"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instrument_code(c: Column | str) -> Column:
    """``.SH``/``.SZ``/``.BJ`` notation without blanks; null stays null."""
    bare = F.upper(F.translate(F.trim(col(c)), " \t\r\n　 ", ""))
    for other, own in ((".XSHG", ".SH"), (".XSHE", ".SZ"), (".BJSE", ".BJ")):
        bare = F.replace(bare, F.lit(other), F.lit(own))
    return bare


def compact_date(c: Column | str) -> Column:
    """``YYYYMMDD`` from ``YYYYMMDD`` or ``YYYY-MM-DD``; blank becomes null."""
    bare = F.translate(F.trim(col(c)), "-/ ", "")
    return F.when(F.length(bare) > 0, bare)


def day_number(c: Column | str) -> Column:
    """Days since 1900-01-01 of a date string; null where the string is no date. Dates past LAST_DAY become LAST_DAY."""
    day = F.unix_date(F.try_to_date(compact_date(c), "yyyyMMdd")) + EPOCH_SHIFT
    return F.when(day.isNotNull(), F.least(day, F.lit(LAST_DAY))).cast("int")


def day_string(c: Column | str) -> Column:
    """``YYYYMMDD`` of a day number; LAST_DAY and beyond give ``99991231``."""
    c = col(c)
    return F.when(c >= LAST_DAY, OPEN_DATE).otherwise(F.date_format(F.date_from_unix_date((c - EPOCH_SHIFT).cast("int")), "yyyyMMdd"))


def finite(c: Column | str) -> Column:
    """Null for NaN and infinities."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


#: Fixed values that systems write in place of a reading.
FILLERS = (9999.0, 99999.0, 999999.0, 9999999.0, 9999.99, 99999.99, 999999.99, 8888.88, 88888.88, 888888.88, 8888.0, 88888.0, 888888.0)
UNKNOWN_WORDS = ("", "unknown", "unk", "n/a", "na", "none", "null", "nan", "nil", "-", "--", "?", "missing", "tbd", "未知", "无", "不详")


def is_filler(c: Column | str) -> Column:
    return F.abs(col(c)).isin(*FILLERS) | col(c).isin(-999.0, -99.0)


def latest(value: Column | str, at: Column | str) -> Column:
    """Aggregate: the value (null included) of the row with the greatest ``at``; a null ``at`` is the earliest."""
    return F.max_by(value, F.coalesce(col(at), F.lit("0001-01-02").cast("timestamp")))
