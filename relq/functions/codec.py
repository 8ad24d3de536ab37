"""Stored forms of values that Spark has no storable type for: times, intervals and JSON."""

from __future__ import annotations

import datetime as dt
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RelqError

DAY = 86_400_000_000


def time_to_micros(t: dt.time) -> int:
    """A time of day as microseconds since midnight, as "time" fields hold it."""
    if t.tzinfo is not None:
        raise RelqError(4107, "a time with a zone")
    return ((t.hour * 60 + t.minute) * 60 + t.second) * 1_000_000 + t.microsecond


def micros_to_time(n: int) -> dt.time:
    if not 0 <= n < DAY:
        raise RelqError(4107, f"{n} microseconds in a day")
    seconds, micros = divmod(n, 1_000_000)
    return dt.time(seconds // 3600, seconds // 60 % 60, seconds % 60, micros)


def interval(months: int = 0, days: int = 0, micros: int = 0) -> tuple[int, int, int]:
    """An interval as "interval" fields hold it: months, days and microseconds stay apart."""
    return months, days, micros


def add_interval(at: Column, held: Column) -> Column:
    """A wall-clock time moved by a stored interval: months first, then days, then microseconds."""
    moved = F.add_months(at.cast("date"), held["months"]).cast("timestamp_ntz") + (at - F.date_trunc("day", at).cast("timestamp_ntz"))
    return moved + F.make_dt_interval(days=held["days"]) + F.make_dt_interval(secs=(held["micros"] / F.lit(1e6)).cast("decimal(18,6)"))


def to_json(value: Any) -> str | None:
    return None if value is None else json.dumps(value, sort_keys=True, ensure_ascii=False, default=str)


def from_json(text: str | None, name: str = "value") -> Any:
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        raise RelqError(4107, f"{name} is no JSON") from None


def json_column(c: Column, schema: T.DataType) -> Column:
    """A JSON column read as a declared type; text that does not fit is an error when it runs."""
    return F.from_json(c, schema, {"mode": "FAILFAST"})
