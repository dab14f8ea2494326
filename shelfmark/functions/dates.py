"""Column functions on periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grammar of time labels: (pattern, names of its groups). Ranges of quarters and months end on day 28, a fixed rule of the data.
YEARS, QUARTER, HALF, MONTH, YEAR = r"^(\d{4})[-–~](\d{4})$", r"^(\d{4})-Q([1-4])$", r"^(\d{4})-H([12])$", r"^(\d{4})-(\d{1,2})$", r"^(\d{4})$"


def _group(c: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(c, pattern, i).try_cast("int")


def _day(y: Column, m, d) -> Column:
    m, d = (x if isinstance(x, Column) else F.lit(x) for x in (m, d))
    return F.make_date(F.greatest(y, F.lit(1)), m, d)


def label_range(label: Column) -> Column:
    """Struct (start, end) of a label's period; null for a label of another form."""
    c = F.trim(label)
    two = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    y1, y2 = _group(c, YEARS, 1), _group(c, YEARS, 2)
    q, qy = _group(c, QUARTER, 2), _group(c, QUARTER, 1)
    h, hy = _group(c, HALF, 2), _group(c, HALF, 1)
    m, my = F.least(F.greatest(_group(c, MONTH, 2), F.lit(1)), F.lit(12)), _group(c, MONTH, 1)
    y = _group(c, YEAR, 1)
    return (
        F.when(c.rlike(YEARS) & (y1 <= y2), two(_day(y1, 1, 1), _day(y2, 12, 31)))
        .when(c.rlike(QUARTER), two(_day(qy, q * 3 - 2, 1), _day(qy, q * 3, 28)))
        .when(c.rlike(HALF), two(_day(hy, h * 6 - 5, 1), F.when(h == 1, _day(hy, 6, 30)).otherwise(_day(hy, 12, 31))))
        .when(c.rlike(MONTH), two(_day(my, m, 1), _day(my, m, 28)))
        .when(c.rlike(YEAR), two(_day(y, 1, 1), _day(y, 12, 31)))
    )


def label_point(label: Column) -> Column:
    """A date in the middle of a quarter, month or year; null for halves, ranges and other forms."""
    c = F.trim(label)
    return (
        F.when(c.rlike(QUARTER), _day(_group(c, QUARTER, 1), _group(c, QUARTER, 2) * 3 - 1, 15))
        .when(c.rlike(MONTH), _day(_group(c, MONTH, 1), F.least(F.greatest(_group(c, MONTH, 2), F.lit(1)), F.lit(12)), 15))
        .when(c.rlike(YEAR), _day(_group(c, YEAR, 1), 6, 15))
    )


def decay(day: Column, period: Column, duration: Column) -> Column:
    """1 within the period, else falling with the days from it: over 90 for bursts and short runs, over 365 for others. 0 without a day or period."""
    start, end = period["start"], period["end"]
    away = F.when(day > end, F.datediff(day, end)).otherwise(F.datediff(start, day))
    over = F.when(duration.isin("burst", "short"), 90.0).otherwise(365.0)
    return F.when(day.isNull() | start.isNull() | end.isNull(), 0.0).when(day.between(start, end), 1.0).otherwise(F.exp(-away / over))
