"""Indian Standard Time business days over UTC ``TIMESTAMP_NTZ`` columns.

Rules (SURVEY §1.4):

* R1  business day = calendar day in Asia/Kolkata of a UTC timestamp.
* R2  the orders listing filters on the raw UTC date instead.
* R3  "today" is an explicit ``as_of`` date; no operator reads the clock.
* R4  week / month = ``ts >= as_of - 7 / 30 days`` on the raw timestamp.
* R5  any other period (or custom with a bound missing) = all time.

Day predicates are written as half-open UTC ranges on the bare column so the
bounds reach the parquet scan as ``PushedFilters``; grouping uses
``convert_timezone`` which keeps the value ``TIMESTAMP_NTZ`` and so never
depends on the session time zone.
"""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Business time zone and its offset (no DST since 1945).
IST_ZONE = "Asia/Kolkata"
IST_OFFSET = timedelta(hours=5, minutes=30)
TRAILING_DAYS = {"week": 7, "month": 30}
MAX_RANGE_DAYS = 365


def ntz(value: datetime | date) -> Column:
    """A ``TIMESTAMP_NTZ`` literal (zone-free, constant-folded)."""
    if not isinstance(value, datetime):
        value = datetime.combine(value, time())
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def ist_timestamp(col: Column | str) -> Column:
    """Wall-clock time in IST of a UTC ``TIMESTAMP_NTZ`` column."""
    return F.convert_timezone(F.lit("UTC"), F.lit(IST_ZONE), F.col(col) if isinstance(col, str) else col)


def ist_date(col: Column | str) -> Column:
    """IST calendar date."""
    return F.to_date(ist_timestamp(col))


def on_ist_days(col: Column | str, start: date, end: date | None = None) -> Column:
    """``start <= ist_date(col) <= end`` as a UTC range on the bare column."""
    c = F.col(col) if isinstance(col, str) else col
    lo = datetime.combine(start, time()) - IST_OFFSET
    hi = datetime.combine(end or start, time()) + timedelta(days=1) - IST_OFFSET
    return (c >= ntz(lo)) & (c < ntz(hi))


def on_utc_days(col: Column | str, start: date | None = None, end: date | None = None) -> Column | None:
    """Raw UTC date range, each bound optional (R2, used by F4)."""
    c = F.col(col) if isinstance(col, str) else col
    pred = None
    if start is not None:
        pred = c >= ntz(start)
    if end is not None:
        upper = c < ntz(end + timedelta(days=1))
        pred = upper if pred is None else pred & upper
    return pred


def period_filter(col: Column | str, period: str, as_of: date,
                  start: date | None = None, end: date | None = None) -> Column | None:
    """Predicate of a statistics period (F6); ``None`` means all time."""
    c = F.col(col) if isinstance(col, str) else col
    if period == "today":
        return on_ist_days(c, as_of)
    if period in TRAILING_DAYS:
        return c >= ntz(as_of - timedelta(days=TRAILING_DAYS[period]))
    if period == "custom" and start is not None and end is not None:
        return on_ist_days(c, start, end)
    return None


def check_range(start: str | None, end: str | None) -> tuple[date, date]:
    """The two days of a custom range (F7), or ``ValueError``: both must be ISO
    dates, in order, and span at most ``MAX_RANGE_DAYS``."""
    try:
        first, last = (date.fromisoformat(x or "") for x in (start, end))
    except ValueError:
        raise ValueError(f"a range needs two ISO dates, got {start!r} and {end!r}") from None
    span = (last - first).days
    if not 0 <= span <= MAX_RANGE_DAYS:
        raise ValueError(f"a range runs forward over at most {MAX_RANGE_DAYS} days, this one over {span}")
    return first, last


def period_days(period: str, as_of: date, start: date | None = None, end: date | None = None) -> tuple[date, date] | None:
    """Days outside which ``period_filter`` and today cannot hold; ``None``: no bound.

    A trailing window is open upwards, so only a closed period has a bound.
    """
    if period == "today":
        return as_of, as_of
    if period == "custom" and start is not None and end is not None:
        return min(start, as_of), max(end, as_of)
    return None
