"""Date helpers: month buckets, trailing windows and interval predicates.

Window bounds depend only on the ``as_of`` parameter, so they are computed once
on the driver and enter the plan as DATE literals; comparisons against literals
are what the Parquet reader can push down.  Row-level work stays in native
expressions (``trunc``, ``add_months``, ``last_day``).
"""

from __future__ import annotations

import calendar
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shift_months(d: date, months: int) -> date:
    """Calendar month shift clamping the day to the target month's end.

    Same rule as Spark ``add_months`` and ``relativedelta(months=n)``.
    """
    idx = d.year * 12 + (d.month - 1) + months
    year, month0 = divmod(idx, 12)
    last = calendar.monthrange(year, month0 + 1)[1]
    return date(year, month0 + 1, min(d.day, last))


def first_of_month(d: date) -> date:
    return d.replace(day=1)


def last_of_month(d: date) -> date:
    return d.replace(day=calendar.monthrange(d.year, d.month)[1])


@dataclass(frozen=True)
class Window:
    """Trailing window of ``months`` whole months plus the running one.

    ``lo`` = first day of (month of as_of − months), ``hi`` = last day of the
    month of as_of (dates ending later this month already count), and the
    calendar runs over the first days ``lo`` … ``month0``.
    """

    as_of: date
    months: int = 15

    @property
    def month0(self) -> date:
        return first_of_month(self.as_of)

    @property
    def lo(self) -> date:
        return shift_months(self.month0, -self.months)

    @property
    def hi(self) -> date:
        return last_of_month(self.as_of)

    def calendar(self) -> list[date]:
        """First days of the window's months and of the running one."""
        return [shift_months(self.lo, i) for i in range(self.months + 1)]

    def contains(self, d: Column | str) -> Column:
        d = _col(d)
        return (d >= F.lit(self.lo)) & (d <= F.lit(self.hi))


def stored(name: str) -> str:
    """Name under which a scan keeps a date column's stored form, when that is a timestamp."""
    return f"{name}__stored"


@dataclass(frozen=True)
class Day:
    """A date column, or the timestamps behind it, to be compared with days.

    A bound on ``CAST(timestamp AS DATE)`` does not reach the scan; the same
    bound on the timestamps does: from the day's first instant, and up to but
    not including the next day's (in the session's time zone, as the cast).
    """

    column: Column
    kind: DataType

    def _instant(self, d: date) -> Column:
        return F.lit(d).cast(self.kind)

    @property
    def _exact(self) -> bool:
        return isinstance(self.kind, DateType)

    def missing(self) -> Column:
        return self.column.isNull()

    def present(self) -> Column:
        return self.column.isNotNull()

    def until(self, d: date) -> Column:
        """On or before ``d``."""
        return self.column <= F.lit(d) if self._exact else self.column < self._instant(d + timedelta(days=1))

    def since(self, d: date) -> Column:
        """On or after ``d``."""
        return self.column >= (F.lit(d) if self._exact else self._instant(d))

    def after(self, d: date) -> Column:
        return self.column > F.lit(d) if self._exact else self.column >= self._instant(d + timedelta(days=1))

    def between(self, lo: date, hi: date) -> Column:
        return self.since(lo) & self.until(hi)


def on_days(df: DataFrame, test: Callable[[Callable[[str], Day]], Column]) -> Column:
    """``test`` on the date columns of ``df``, so that the scan can use it.

    ``test`` is given a function from a column's name to its ``Day``.  Where
    ``df`` keeps the stored timestamps of some date columns, the same test on
    those is added; it is equal, so rows are neither lost nor gained.
    """
    exact = lambda name: Day(F.col(name), DateType())
    at_rest = lambda name: Day(F.col(stored(name)), df.schema[stored(name)].dataType) if stored(name) in df.columns else exact(name)
    if any(stored(name) in df.columns for name in df.columns):
        return test(exact) & test(at_rest)
    return test(exact)


def to_date(c: Column | str) -> Column:
    """Strict cast to DATE (ANSI: malformed input raises)."""
    return _col(c).cast("date")


def effective_end(cancel_date: Column | str, end_date: Column | str) -> Column:
    """The client's cancellation wins over the line's own end date."""
    return F.coalesce(to_date(cancel_date), to_date(end_date))


def month_bucket(d: Column | str) -> Column:
    """First day of the month, as DATE (``trunc``, not ``date_trunc``)."""
    return F.trunc(_col(d), "MM")


def is_month_end(d: Column | str) -> Column:
    d = _col(d)
    return F.last_day(d) == d


def active_at(start: Column | str, end: Column | str, t: Column | date) -> Column:
    """Half-open interval test ``start <= t < end`` with NULL end = still open."""
    t = F.lit(t) if isinstance(t, date) else t
    start, end = _col(start), _col(end)
    return (start <= t) & (end.isNull() | (end > t))


def months_after_cutoff(
    d: Column | str, as_of: date, n_months: int, lenient: bool = False
) -> Column:
    """Keep ``d >= as_of − n months`` at day precision; ``n = 0`` keeps all.

    NULL is dropped.  With ``lenient`` the column is text parsed with
    ``try_to_date`` so unparseable values are dropped instead of raising.
    """
    d = _col(d)
    if n_months == 0:
        return F.lit(True)
    cutoff = F.lit(shift_months(as_of, -n_months))
    if lenient:
        return F.try_to_date(d.cast("string")) >= cutoff
    return d >= cutoff
