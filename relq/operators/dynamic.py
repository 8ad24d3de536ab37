"""Filters from untrusted input: an allowlist of fields, equality only, values converted to the field's type."""

from __future__ import annotations

import datetime as dt
import uuid
from typing import Any

from pyspark.sql import types as T

from ..errors import RelqError
from ..functions.expr import Expr

#: The integers that each type holds.
RANGES = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def converted(field: Any, name: str, value: Any) -> Any:
    bad = RelqError(4113, f"{name}: {value!r}")
    kind = field.type
    try:
        if field.labels:
            if value not in field.labels:
                raise bad
            return value
        if field.kind == "uuid":
            return str(uuid.UUID(value))
        if isinstance(kind, T.StringType):
            if not isinstance(value, str):
                raise bad
            return value
        if isinstance(kind, T.BooleanType):
            if not isinstance(value, bool):
                raise bad
            return value
        if type(kind) in RANGES:
            if isinstance(value, bool) or not isinstance(value, int) or not -(1 << RANGES[type(kind)]) <= value < 1 << RANGES[type(kind)]:
                raise bad
            return value
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise bad
            return float(value)
        if isinstance(kind, T.DateType):
            return dt.date.fromisoformat(value)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return dt.datetime.fromisoformat(value)
    except (TypeError, ValueError, AttributeError):
        raise bad from None
    raise RelqError(4006, f"{name} of type {kind.simpleString()}")


def conditions(entity: Any, columns: Any, fields: dict[str, Any]) -> list[Expr]:
    """One condition for each field, in the order of their names: equality, or IS NULL for None."""
    out = []
    for name in sorted(fields):
        if name not in entity.__filterable__ or name not in entity.__fields__:
            raise RelqError(4112, name)
        f = entity.__fields__[name]
        if isinstance(f.type, (T.ArrayType, T.StructType, T.BinaryType)):
            raise RelqError(4006, name)
        column = getattr(columns, name)
        out.append(column.is_null() if fields[name] is None else column == converted(f, name, fields[name]))
    return out
