"""Durations and checks of label intervals. Intervals are half-open: touching is no overlap."""

from __future__ import annotations

import math
import re
from datetime import timedelta
from numbers import Real

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, DateType, DayTimeIntervalType, TimestampNTZType, TimestampType

from foldwise.operators.scan import ordered_scan

#: Calendar codes that name no fixed duration.
CALENDAR_CODES = ("M", "Y", "MS", "YS", "BM", "BMS", "BY", "BYS", "ME", "YE", "Q", "QS", "QE")

_UNIT = {"w": 604800e6, "d": 86400e6, "h": 3600e6, "min": 60e6, "s": 1e6, "ms": 1e3, "us": 1.0, "ns": 1e-3}
_NAMES = {
    "w": "w", "week": "w", "weeks": "w", "d": "d", "day": "d", "days": "d", "h": "h", "hr": "h", "hour": "h", "hours": "h", "m": "min", "t": "min", "min": "min", "minute": "min", "minutes": "min",
    "s": "s", "sec": "s", "second": "s", "seconds": "s", "ms": "ms", "milli": "ms", "millisecond": "ms", "milliseconds": "ms", "us": "us", "micro": "us", "microsecond": "us", "microseconds": "us", "ns": "ns", "": "ns",
}


def parse_horizon(value) -> timedelta:
    """A non-negative fixed duration of whole microseconds from text (``"5D"``, ``"1h30min"``, ``"2 days 03:00:00"``),
    timedelta or a NumPy or pandas duration. ValueError: missing, negative, calendar or unreadable; TypeError: other types."""
    if isinstance(value, bool) or not (isinstance(value, (str, timedelta)) or type(value).__module__.split(".")[0] in ("numpy", "pandas")):
        raise TypeError(f"a horizon is text or a duration, not {type(value).__name__}")
    if isinstance(value, str):
        micros = _micros(value)
    else:
        if value != value or str(value) == "NaT":
            raise ValueError("the horizon is missing")
        if type(value).__module__.split(".")[0] == "numpy":
            if not hasattr(value, "dtype") or value.dtype.kind != "m":
                raise TypeError("a horizon is text or a duration")
            micros = value.astype("timedelta64[ns]").astype("int64").item() / 1000
        else:
            nanos = getattr(value, "nanoseconds", 0)
            micros = value / timedelta(microseconds=1) if not nanos else value.value / 1000
    if micros < 0:
        raise ValueError("a horizon is not negative")
    if micros != int(micros):
        raise ValueError("a horizon is a whole number of microseconds")
    return timedelta(microseconds=int(micros))


def _micros(text: str) -> float:
    bare = text.strip()
    if re.sub(r"^[+-]?[\d.]*\s*", "", bare) in CALENDAR_CODES and not re.fullmatch(r"[+-]?[\d.]+\s*m", bare):
        raise ValueError(f"{text!r} is a calendar unit, not a fixed duration")
    sign = -1.0 if bare.startswith("-") else 1.0
    body, total, found = bare.lstrip("+-"), 0.0, False
    clock = re.search(r"(\d+):(\d{1,2})(?::(\d{1,2}(?:\.\d+)?))?$", body)
    if clock:
        total += int(clock[1]) * 3600e6 + int(clock[2]) * 60e6 + float(clock[3] or 0) * 1e6
        body, found = body[: clock.start()], True
    at = 0
    for m in re.finditer(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*([A-Za-z]*)\s*", body):
        unit = _NAMES.get(m[2].lower())
        if m.start() != at or unit is None:
            break
        at, found = m.end(), True
        total += float(m[1]) * _UNIT[unit]
    if not found or body[at:].strip():
        raise ValueError(f"{text!r} is no duration")
    return sign * round(total, 3)


def is_time(kind: DataType) -> bool:
    return isinstance(kind, (TimestampNTZType, TimestampType, DateType, DayTimeIntervalType))


def check_times_schema(df: DataFrame, pred: str, eval_: str) -> None:
    """Both columns are times of one family; no text or numbers."""
    a, b = df.schema[pred].dataType, df.schema[eval_].dataType
    for name, kind in ((pred, a), (eval_, b)):
        if not is_time(kind):
            raise ValueError(f"{name} is no time column: {kind.simpleString()}")
    if isinstance(a, DayTimeIntervalType) != isinstance(b, DayTimeIntervalType):
        raise ValueError("times and durations don't mix")


def aligned(df: DataFrame, *names: str) -> list[Column]:
    """Time columns of one kind: where instants (TIMESTAMP) meet times without a zone, the instants are read in UTC."""
    kinds = [df.schema[c].dataType for c in names]
    if len({type(k) for k in kinds}) == 1 or not any(isinstance(k, TimestampNTZType) for k in kinds):
        return [F.col(c) for c in names]
    utc = "timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(unix_micros(`{}`) as decimal(24, 0)) / 1000000)"
    return [F.expr(utc.format(c)) if isinstance(k, TimestampType) else F.col(c).cast("timestamp_ntz") if isinstance(k, DateType) else F.col(c) for c, k in zip(names, kinds)]


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two intervals overlap. An empty interval strictly inside another does."""
    return ~((a1 <= b0) | (b1 <= a0))


def horizons_overlap(a0, a1, b0, b1) -> bool:
    """The same for single values. ValueError: missing or reversed."""
    for x in (a0, a1, b0, b1):
        if x is None or x != x or str(x) == "NaT":
            raise ValueError("an interval's end is missing")
    if a1 < a0 or b1 < b0:
        raise ValueError("an interval ends before it starts")
    return not (a1 <= b0 or b1 <= a0)


def time_faults(df: DataFrame, pos: str, pred: str, eval_: str, parallel: bool | None = None) -> DataFrame:
    """One row: missing times, rows that end before they start, the first of these, and steps back in time."""
    # The row before, also if its time is missing: a struct is never null.
    stepped = ordered_scan(df.select(pos, pred, eval_), [pos], {"_last": ("last", F.struct(F.col(pred).alias("t")), "before")}, parallel).withColumn("_before", F.col("_last.t"))
    one = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("bigint")
    return stepped.agg(
        one(F.col(pred).isNull() | F.col(eval_).isNull()).alias("n_missing"), one(F.col(eval_) < F.col(pred)).alias("n_reversed"),
        F.min(F.when(F.col(eval_) < F.col(pred), F.col(pos))).alias("first_reversed"), one(F.col("_before") > F.col(pred)).alias("n_backward"),
    )


def validate_times(df: DataFrame, pred: str, eval_: str, pos: str = "pos", require_monotonic: bool = True) -> None:
    check_times_schema(df, pred, eval_)
    f = time_faults(df, pos, pred, eval_).first()
    if f["n_missing"]:
        raise ValueError("times are missing")
    if f["n_reversed"]:
        raise ValueError(f"{eval_} is before {pred}, first at row {f['first_reversed']}")
    if require_monotonic and f["n_backward"]:
        raise ValueError(f"{pred} goes back in time")


def check_integer(value, name: str, least: int) -> int:
    if isinstance(value, bool) or not hasattr(value, "__index__"):
        raise TypeError(f"{name} is an integer")
    if int(value) < least:
        raise ValueError(f"{name} is at least {least}")
    return int(value)


def check_bars_per_year(value) -> float | None:
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, Real) and not hasattr(value, "__float__"):
        raise TypeError("bars_per_year is a number")
    if not math.isfinite(float(value)) or float(value) <= 0:
        raise ValueError("bars_per_year is positive and finite")
    return float(value)


def check_positions(df: DataFrame, n: int, pos: str = "pos") -> None:
    """ValueError unless positions are distinct integers in 0..n-1."""
    if df.schema[pos].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("positions are integers")
    r = df.agg(F.count(pos).alias("n"), F.countDistinct(pos).alias("d"), F.min(pos).alias("a"), F.max(pos).alias("b")).first()
    if r["n"] != r["d"]:
        raise ValueError("positions repeat")
    if r["n"] and (r["a"] < 0 or r["b"] >= n):
        raise ValueError("positions are out of range")


def embargo_mode(embargo=None, embargo_observations=None, embargo_fraction=None) -> tuple[str, object] | None:
    """("time", timedelta), ("count", int), ("share", float), or None. At most one is given."""
    given = [x is not None for x in (embargo, embargo_observations, embargo_fraction)]
    if sum(given) > 1:
        raise ValueError("give one kind of embargo")
    if embargo is not None:
        return "time", parse_horizon(embargo)
    if embargo_observations is not None:
        return "count", check_integer(embargo_observations, "embargo_observations", 0)
    if embargo_fraction is not None:
        if isinstance(embargo_fraction, bool) or not isinstance(embargo_fraction, Real):
            raise TypeError("embargo_fraction is a number")
        if not (math.isfinite(embargo_fraction) and 0 <= embargo_fraction <= 1):
            raise ValueError("embargo_fraction is between 0 and 1")
        return "share", float(embargo_fraction)
    return None
