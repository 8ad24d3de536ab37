"""The expression values that queries are made of.

An expression is an operation name with its arguments, immutable, and compared by ``key()``; Python's comparison
operators build predicates. Nothing here touches Spark: ``relq.plans.compiler`` turns expressions into columns.
"""

from __future__ import annotations

import datetime as dt
import decimal
import enum
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import types as T

from ..errors import RelqError

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
AGGREGATES = ("count", "sum", "avg", "min", "max", "percentile")
RANKS = ("row_number", "rank", "dense_rank", "lag", "lead")
UNITS = ("minute", "hour", "day", "week", "month", "quarter", "year")


def type_of(value: Any) -> T.DataType | None:
    for kind, found in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (decimal.Decimal, T.DecimalType(38, 18)), (str, T.StringType()), (dt.datetime, T.TimestampNTZType()), (dt.date, T.DateType())):
        if isinstance(value, kind):
            return found
    return None


def expr(value: Any) -> Expr:
    if isinstance(value, Expr):
        return value
    if isinstance(value, enum.Enum):
        value = value.value
    return Expr("literal", (value,), type_of(value))


def literal(value: Any) -> Expr:
    """A constant column."""
    return expr(value)


class Expr:
    """op(args). type is the Spark type where it is known; order terms are Exprs of op "order"."""

    __slots__ = ("args", "op", "type")

    def __init__(self, op: str, args: tuple, type_: T.DataType | None = None) -> None:
        object.__setattr__(self, "op", op)
        object.__setattr__(self, "args", args)
        object.__setattr__(self, "type", type_)

    def __setattr__(self, name: str, value: Any) -> None:
        raise AttributeError("expressions are immutable")

    def key(self) -> tuple:
        return (self.op, *(a.key() if hasattr(a, "key") else (type(a).__name__, repr(a)) for a in self.args))

    def __hash__(self) -> int:
        return hash(self.key())

    def __bool__(self) -> bool:
        raise TypeError("combine predicates with & | ~, not with and, or, not")

    def walk(self):
        """This expression and those in it, but not those of subqueries."""
        yield self
        for a in self.args:
            if isinstance(a, Expr):
                yield from a.walk()
            elif isinstance(a, Window):
                for x in (*a.partition, *a.order):
                    yield from x.walk()

    def has_aggregate(self) -> bool:
        """An aggregate that is no window function's own."""
        if self.op == "over":
            inner = self.args[0]
            own = [a for a in inner.args if isinstance(a, Expr)] if inner.op == "aggregate" else [inner]
            return any(x.has_aggregate() for x in (*own, *self.args[1].partition, *self.args[1].order))
        return self.op == "aggregate" or any(isinstance(a, Expr) and a.has_aggregate() for a in self.args)

    def has_window(self) -> bool:
        return any(x.op == "over" for x in self.walk())

    # comparisons
    def _compare(self, op: str, other: Any) -> Expr:
        return Expr("compare", (op, self, expr(other)), T.BooleanType())

    def __eq__(self, other: Any) -> Expr:  # type: ignore[override]
        return self.is_null() if other is None else self._compare("=", other)

    def __ne__(self, other: Any) -> Expr:  # type: ignore[override]
        return self.is_not_null() if other is None else self._compare("<>", other)

    def __lt__(self, other: Any) -> Expr:
        return self._compare("<", other)

    def __le__(self, other: Any) -> Expr:
        return self._compare("<=", other)

    def __gt__(self, other: Any) -> Expr:
        return self._compare(">", other)

    def __ge__(self, other: Any) -> Expr:
        return self._compare(">=", other)

    def is_null(self) -> Expr:
        return Expr("is_null", (self,), T.BooleanType())

    def is_not_null(self) -> Expr:
        return ~self.is_null()

    def is_distinct_from(self, other: Any) -> Expr:
        return ~self.is_not_distinct_from(other)

    def is_not_distinct_from(self, other: Any) -> Expr:
        return Expr("same", (self, expr(other)), T.BooleanType())

    def in_(self, values: Any) -> Expr:
        """Membership in a list (an empty one holds nothing, not even null) or in a query of one column."""
        if hasattr(values, "selection"):
            return Expr("in_query", (self, values), T.BooleanType())
        return Expr("in_list", (self, *(expr(v) for v in values)), T.BooleanType())

    def not_in(self, values: Any) -> Expr:
        return ~self.in_(values)

    # logic
    def __and__(self, other: Any) -> Expr:
        return Expr("and", (self, expr(other)), T.BooleanType())

    def __or__(self, other: Any) -> Expr:
        return Expr("or", (self, expr(other)), T.BooleanType())

    def __invert__(self) -> Expr:
        return Expr("not", (self,), T.BooleanType())

    # text
    def like(self, pattern: str) -> Expr:
        return Expr("like", (self, pattern, False), T.BooleanType())

    def ilike(self, pattern: str) -> Expr:
        return Expr("like", (self, pattern, True), T.BooleanType())

    def _literal_match(self, how: str, text: str, any_case: bool) -> Expr:
        return Expr("match", (self, how, text, any_case), T.BooleanType())

    def contains(self, text: str, any_case: bool = False) -> Expr:
        return self._literal_match("contains", text, any_case)

    def has_prefix(self, text: str, any_case: bool = False) -> Expr:
        return self._literal_match("prefix", text, any_case)

    def has_suffix(self, text: str, any_case: bool = False) -> Expr:
        return self._literal_match("suffix", text, any_case)

    # arithmetic, in the wider of both sides' types; a constant takes the column's where it is of its kind
    def _math(self, op: str, other: Any) -> Expr:
        other = expr(other)
        return Expr("math", (op, self, other), wider(self, other))

    def __add__(self, other: Any) -> Expr:
        return self._math("+", other)

    def __sub__(self, other: Any) -> Expr:
        return self._math("-", other)

    def __mul__(self, other: Any) -> Expr:
        return self._math("*", other)

    def __truediv__(self, other: Any) -> Expr:
        """Integers divide towards zero."""
        return self._math("/", other)

    def rounded(self, digits: int) -> Expr:
        return Expr("rounded", (self, digits), self.type)

    # time
    def truncated(self, unit: str, zone: str | None = None) -> Expr:
        if unit not in UNITS:
            raise ValueError(f"unit {unit!r} is none of {UNITS}")
        return Expr("truncate", (self, unit, zone), self.type)

    def interval_since(self, earlier: Any) -> Expr:
        return Expr("interval", (self, expr(earlier)), T.DayTimeIntervalType())

    def seconds(self) -> Expr:
        """The length of an interval, as a double."""
        if self.op != "interval":
            raise ValueError("seconds() is of intervals")
        return Expr("seconds", self.args, T.DoubleType())

    # aggregates
    def _aggregate(self, name: str, type_: T.DataType | None, *more: Any) -> Expr:
        if self.has_window():
            raise RelqError(4002, f"{name} of a window function")
        return Expr("aggregate", (name, self, None, *more), type_)

    def count(self) -> Expr:
        return self._aggregate("count", T.LongType())

    def sum(self) -> Expr:
        return self._aggregate("sum", T.LongType() if isinstance(self.type, INTEGERS) else self.type if isinstance(self.type, T.DecimalType) else T.DoubleType())

    def avg(self) -> Expr:
        return self._aggregate("avg", self.type if isinstance(self.type, T.DecimalType) else T.DoubleType())

    def min(self) -> Expr:
        return self._aggregate("min", self.type)

    def max(self) -> Expr:
        return self._aggregate("max", self.type)

    def percentile(self, p: float) -> Expr:
        """The exact interpolated percentile, p from 0 to 1."""
        if not 0 <= p <= 1:
            raise ValueError("a percentile lies between 0 and 1")
        return self._aggregate("percentile", T.DoubleType(), float(p))

    def median(self) -> Expr:
        return self.percentile(0.5)

    def filter(self, condition: Expr) -> Expr:
        """An aggregate over the rows of its group that meet the condition; further calls narrow it."""
        if self.op != "aggregate":
            raise ValueError("filter() is of aggregates")
        if condition.has_aggregate() or condition.has_window():
            raise RelqError(4001, "in an aggregate's filter")
        held = self.args[2]
        return Expr("aggregate", (*self.args[:2], condition if held is None else held & condition, *self.args[3:]), self.type)

    def over(self, window: Window | None = None) -> Expr:
        if self.op not in ("aggregate", "ranking"):
            raise ValueError("over() is of aggregates and ranking functions")
        return Expr("over", (self, window or Window()), self.type)

    # order
    def asc(self) -> Expr:
        return Expr("order", (self, False, None))

    def desc(self) -> Expr:
        return Expr("order", (self, True, None))

    def nulls_first(self) -> Expr:
        return Expr("order", (*ordered(self).args[:2], True))

    def nulls_last(self) -> Expr:
        return Expr("order", (*ordered(self).args[:2], False))

    def cast(self, type_: T.DataType) -> Expr:
        return Expr("cast", (self, type_), type_)

    def __repr__(self) -> str:
        return f"{self.op}({', '.join(map(repr, self.args))})"


def wider(a: Expr, b: Expr) -> T.DataType | None:
    """The type of arithmetic on both; None, Spark's own choice, where one is not known."""
    if a.type is None or b.type is None:
        return a.type if b.op == "literal" else None
    whole, broken = INTEGERS, (T.FloatType, T.DoubleType)
    for kinds in (whole, broken):
        if isinstance(a.type, kinds) and isinstance(b.type, kinds):
            if b.op == "literal" or a.op == "literal":
                return a.type if b.op == "literal" else b.type
            return max((a.type, b.type), key=lambda t: kinds.index(type(t)))
    if isinstance(a.type, broken) or isinstance(b.type, broken):
        return T.DoubleType()
    return b.type if isinstance(a.type, whole) else a.type


def ordered(e: Expr) -> Expr:
    return e if e.op == "order" else e.asc()


@dataclass(frozen=True, eq=False)
class Window:
    """partition and order of a window, and its frame: (rows or range, from, to) with None for unbounded."""

    partition: tuple[Expr, ...] = ()
    order: tuple[Expr, ...] = ()
    frame: tuple[str, int | None, int | None] | None = None

    def key(self) -> tuple:
        return ("window", tuple(x.key() for x in self.partition), tuple(x.key() for x in self.order), self.frame)

    def partition_by(self, *by: Expr) -> Window:
        return replace(self, partition=(*self.partition, *by))

    def order_by(self, *by: Expr) -> Window:
        return replace(self, order=(*self.order, *map(ordered, by)))

    def _framed(self, kind: str, start: Any, end: Any) -> Window:
        low, high = bound(start, True), bound(end, False)
        if low is not None and high is not None and low > high:
            raise RelqError(4003, f"{start} to {end}")
        return replace(self, frame=(kind, low, high))

    def rows(self, start: Any, end: Any = 0) -> Window:
        return self._framed("rows", start, end)

    def range(self, start: Any, end: Any = 0) -> Window:
        if len(self.order) != 1 and any(x not in (0, "unbounded_preceding", "unbounded_following") for x in (start, end)):
            raise RelqError(4003, "a range by offsets needs one order term")
        return self._framed("range", start, end)


def preceding(n: int) -> int:
    if n < 0:
        raise RelqError(4003, "a negative offset")
    return -n


def following(n: int) -> int:
    if n < 0:
        raise RelqError(4003, "a negative offset")
    return n


def bound(at: Any, start: bool) -> int | None:
    """A bound as an offset; None where it is unbounded on its own side."""
    if at == ("unbounded_preceding" if start else "unbounded_following"):
        return None
    if not isinstance(at, int):
        raise RelqError(4003, f"{at!r} as the frame's {'start' if start else 'end'}")
    return at


def _ranking(name: str, type_: T.DataType | None, *args: Any) -> Expr:
    return Expr("ranking", (name, *args), type_)


def row_number() -> Expr:
    return _ranking("row_number", T.IntegerType())


def rank() -> Expr:
    return _ranking("rank", T.IntegerType())


def dense_rank() -> Expr:
    return _ranking("dense_rank", T.IntegerType())


def lag(e: Expr, n: int = 1) -> Expr:
    return _ranking("lag", e.type, e, n)


def lead(e: Expr, n: int = 1) -> Expr:
    return _ranking("lead", e.type, e, n)


def percentile(e: Expr, p: float) -> Expr:
    return e.percentile(p)


def now() -> Expr:
    """The transaction's time: one value for all of its statements."""
    return Expr("now", (), T.TimestampType())


def fragment(text: str, *binds: Any, type: T.DataType | None = None) -> Expr:  # noqa: A002
    """SQL text with {} for each bind, an expression or a value. Values never become text."""
    if text.count("{}") != len(binds):
        raise ValueError(f"{text.count('{}')} places for {len(binds)} binds")
    return Expr("fragment", (text, *(expr(b) for b in binds)), type)


def scalar(query: Any) -> Expr:
    """The one value of a correlated query; more than one row is an error when it runs."""
    return Expr("scalar", (query,), query.selection[0][1].type if query.selection else None)


def scalar_first(query: Any) -> Expr:
    return Expr("scalar_first", (query,), query.selection[0][1].type if query.selection else None)


def scalar_count(query: Any) -> Expr:
    """How many rows a correlated query has, never null."""
    return Expr("scalar_count", (query,), T.LongType())


def exists(query: Any) -> Expr:
    return Expr("exists", (query,), T.BooleanType())
