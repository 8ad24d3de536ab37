"""Immutable query values.

Every method gives a new value; nothing runs. Functions passed to methods get the columns of each source in the order
in which they were joined. Shapes without a meaning are refused here, with the codes of ``relq.errors``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from ..errors import InvalidProjection, RelqError
from ..functions.expr import Expr, exists, expr, ordered
from ..sources.entity import Columns

EXCLUDED, INCLUDED, ONLY = "excluded", "included", "only"


@dataclass(frozen=True, eq=False)
class Join:
    kind: str
    source: Any
    alias: str
    on: Expr


@dataclass(frozen=True, eq=False)
class CommonTable:
    """A named query that others may read from, join, or test membership in. Same name, same definition."""

    name: str
    body: Any

    @property
    def entity(self) -> Any:
        return self.body.entity

    def query(self) -> Query:
        return Query(self, self.name)

    def columns_for(self, alias: str) -> Any:
        return OutputColumns(self.body, alias)


class OutputColumns:
    """The output columns of a query under a name."""

    def __init__(self, body: Any, alias: str) -> None:
        self._names, self._alias = dict(body.outputs()), alias

    def __getattr__(self, name: str) -> Expr:
        if name not in self._names:
            raise AttributeError(f"the query has no output {name}")
        return Expr("column", (self._alias, name), self._names[name])


@dataclass(frozen=True, eq=False)
class Raw:
    """A common table's body as SQL text, for what queries cannot say, WITH RECURSIVE included.

    {name} in the text stands for the table of an entity of uses, :name for a parameter of args. entity declares what
    comes out; a missing column is error 4106.
    """

    text: str
    declares: Any
    uses: tuple = ()
    args: tuple[tuple[str, Any], ...] = ()

    @property
    def entity(self) -> Any:
        return self.declares

    def outputs(self) -> list[tuple[str, Any]]:
        return [(f.column, f.type) for f in self.declares.__fields__.values()]

    def cte(self, name: str) -> CommonTable:
        return CommonTable(name, self)


@dataclass(frozen=True, eq=False)
class Recursive:
    """Rows of anchor, then again and again the rows of source that on links to rows already found.

    on gets the source's columns and the found rows' columns. key names the column by which cycles are detected: a
    row whose key its walk holds already closes a cycle; it ends there and is left out unless closers is true.
    Outputs are the anchor's, with walked_path (keys from the anchor on) and closes_cycle where key is given.
    """

    name: str
    anchor: Query
    source: Any
    on: Callable[[Any, Any], Expr]
    key: str | None = None
    closers: bool = False
    levels: int = 100

    @property
    def entity(self) -> Any:
        return self.source

    def outputs(self) -> list[tuple[str, Any]]:
        from pyspark.sql import types as T

        own = self.anchor.outputs()
        if self.key:
            own = [*own, ("walked_path", T.ArrayType(dict(own)[self.key])), ("closes_cycle", T.BooleanType())]
        return own

    def query(self) -> Query:
        return Query(CommonTable(self.name, self), self.name)


@dataclass(frozen=True, eq=False)
class Query:
    """A query over one source and those joined to it. source: an entity, a common table or a combination."""

    source: Any
    alias: str
    joins: tuple[Join, ...] = ()
    condition: Expr | None = None
    scope: str = EXCLUDED
    group: tuple[Expr, ...] = ()
    having_: Expr | None = None
    selection: tuple[tuple[str, Expr], ...] = ()
    order: tuple[Expr, ...] = ()
    limit_: int | None = None
    offset_: int = 0
    distinct_: bool | tuple[Expr, ...] = False
    ctes: tuple[CommonTable, ...] = ()
    preloads: tuple[tuple[str, Any], ...] = ()
    lock: str | None = None
    names: tuple[str, ...] = field(default=())

    @staticmethod
    def of(entity: Any, alias: str | None = None) -> Query:
        return Query(entity, alias or entity.__table__)

    # what it is
    @property
    def entity(self) -> Any:
        return getattr(self.source, "entity", self.source)

    @property
    def grouped(self) -> bool:
        return bool(self.group) or self.having_ is not None or any(e.has_aggregate() for _, e in self.selection)

    def _columns(self, source: Any, alias: str) -> Any:
        if isinstance(source, CommonTable):
            return source.columns_for(alias)
        if isinstance(source, Combined):
            return OutputColumns(source, alias)
        return Columns(source, alias)

    def sources(self) -> list[Any]:
        return [self._columns(self.source, self.alias), *(self._columns(j.source, j.alias) for j in self.joins)]

    def outputs(self) -> list[tuple[str, Any]]:
        """Names and types of the columns it returns."""
        if self.selection:
            return [(n, e.type) for n, e in self.selection]
        if isinstance(self.source, CommonTable):
            return self.source.body.outputs()
        if isinstance(self.source, Combined):
            return self.source.outputs()
        return [(f.column, f.type) for f in self.source.__fields__.values()]

    def _given(self, made: Any) -> Any:
        return made(*self.sources()) if callable(made) and not isinstance(made, Expr) else made

    def _all(self, made: tuple) -> list:
        out: list = []
        for m in made:
            x = self._given(m)
            out += list(x) if isinstance(x, (tuple, list)) else [x]
        return out

    # filters
    def _check_where(self, p: Expr) -> Expr:
        p = expr(p)
        if p.has_aggregate():
            raise RelqError(4001)
        if p.has_window():
            raise RelqError(4002)
        return p

    def where(self, made: Any) -> Query:
        p = self._check_where(self._given(made))
        return replace(self, condition=p if self.condition is None else self.condition & p)

    def or_where(self, made: Any) -> Query:
        p = self._check_where(self._given(made))
        return replace(self, condition=p if self.condition is None else self.condition | p)

    def filtered(self, fields: dict[str, Any]) -> Query:
        """Equality filters from untrusted input, for the entity's filterable fields only."""
        from .dynamic import conditions

        q = self
        for p in conditions(self.entity, self.sources()[0], fields):
            q = q.where(p)
        return q

    def with_deleted(self) -> Query:
        return replace(self, scope=INCLUDED)

    def only_deleted(self) -> Query:
        if not hasattr(self.entity, "deleted_column") or self.entity.deleted_column() is None:
            raise RelqError(4105)
        return replace(self, scope=ONLY)

    # joins
    def _joined(self, kind: str, target: Any, on: Any, alias: str | None) -> Query:
        if isinstance(target, Query):
            if target.condition is not None or target.joins or target.selection:
                raise InvalidProjection("join an entity, an aliased entity or a common table; a query belongs in one")
            target, alias = target.source, alias or target.alias
        alias = alias or getattr(target, "name", None) or target.__table__
        if alias in (self.alias, *(j.alias for j in self.joins)):
            raise RelqError(4007, alias)
        p = on(*self.sources(), self._columns(target, alias))
        return replace(self, joins=(*self.joins, Join(kind, target, alias, self._check_where(p))), ctes=self._with(target))

    def _with(self, target: Any) -> tuple[CommonTable, ...]:
        if not isinstance(target, CommonTable):
            return self.ctes
        for held in self.ctes:
            if held.name == target.name:
                if held.body is not target.body:
                    raise RelqError(None, f"two definitions of {target.name}")
                return self.ctes
        return (*self.ctes, target)

    def join(self, target: Any, on: Callable[..., Expr], alias: str | None = None) -> Query:
        return self._joined("inner", target, on, alias)

    def left_join(self, target: Any, on: Callable[..., Expr], alias: str | None = None) -> Query:
        return self._joined("left", target, on, alias)

    def with_table(self, cte: CommonTable) -> Query:
        """Declares a common table for its subqueries."""
        return replace(self, ctes=self._with(cte))

    def reading_from(self, cte: CommonTable) -> Query:
        """The same query over the rows of a common table of its entity."""
        return replace(self, source=cte, ctes=self._with(cte), scope=INCLUDED)

    # grouping
    def group_by(self, *made: Any) -> Query:
        by = self._all(made)
        for e in by:
            if e.has_aggregate():
                raise RelqError(4001, "in GROUP BY")
            if e.has_window():
                raise RelqError(4002, "in GROUP BY")
        return replace(self, group=(*self.group, *by))

    def having(self, made: Any) -> Query:
        p = expr(self._given(made))
        if p.has_window():
            raise RelqError(4002)
        return replace(self, having_=p if self.having_ is None else self.having_ & p)

    # projection
    def select(self, *made: Any, **labeled: Any) -> Query:
        """Positional columns are named _1, _2, ...; labels name the rest. A function may give a dict of labels."""
        out: list[tuple[str, Any]] = []
        for m in made:
            x = self._given(m)
            if isinstance(x, dict):
                out += x.items()
            else:
                out += [("", y) for y in (x if isinstance(x, (tuple, list)) else [x])]
        out = [(n or f"_{i + 1}", e) for i, (n, e) in enumerate(out)] + [(n, self._given(e)) for n, e in labeled.items()]
        if not out:
            raise InvalidProjection("no columns")
        for n, e in out:
            if isinstance(e, Expr) and e.op == "order":
                raise InvalidProjection(f"{n} is an order term")
        if len({n for n, _ in out}) < len(out):
            raise InvalidProjection("a label twice")
        return replace(self, selection=tuple((n, expr(e)) for n, e in out), preloads=())

    def distinct(self) -> Query:
        return replace(self, distinct_=True)

    def distinct_on(self, *made: Any) -> Query:
        """The first row by the order for each value; the order must begin with the same terms."""
        return replace(self, distinct_=tuple(self._all(made)))

    # order and slices
    def order_by(self, *made: Any) -> Query:
        return replace(self, order=(*self.order, *map(ordered, self._all(made))))

    def limit(self, n: int) -> Query:
        return replace(self, limit_=n)

    def offset(self, n: int) -> Query:
        return replace(self, offset_=n)

    # subqueries
    def exists(self) -> Expr:
        return exists(self)

    def not_exists(self) -> Expr:
        return ~exists(self)

    def cte(self, name: str) -> CommonTable:
        return CommonTable(name, self)

    # associations, locks
    def preload(self, name: str, tune: Callable[[Query], Query] | None = None) -> Query:
        if name not in self.entity.__associations__:
            raise RelqError(None, f"{self.entity.__name__} has no association {name}")
        return replace(self, preloads=(*self.preloads, (name, tune)))

    def lock_for_update(self, wait: str = "wait") -> Query:
        """Adds the table to what a transaction checks at its commit. Spark has no row locks, so no_wait and
        skip_locked are refused."""
        from ..errors import Unsupported

        if wait != "wait":
            raise Unsupported(f"row locks with {wait}")
        return replace(self, lock="update")

    # sets
    def _set(self, op: str, other: Query) -> Query:
        if self.lock or other.lock:
            raise RelqError(4005)
        made = combine(op, self, other)
        return Query(made, self.alias, scope=INCLUDED, ctes=_merged(self.ctes, other.ctes))

    def union(self, other: Query) -> Query:
        return self._set("union", other)

    def union_all(self, other: Query) -> Query:
        return self._set("union_all", other)

    def intersect(self, other: Query) -> Query:
        return self._set("intersect", other)

    def except_(self, other: Query) -> Query:
        return self._set("except", other)

    # checks that need the whole value
    def checked(self) -> Query:
        if self.grouped and not self.selection:
            raise RelqError(4004)
        if isinstance(self.distinct_, tuple) and self.order:
            if [e.args[0].key() for e in self.order[: len(self.distinct_)]] != [e.key() for e in self.distinct_]:
                raise InvalidProjection("the order must begin with the columns of distinct_on")
        if self.distinct_ is True and self.selection:
            held = {e.key() for _, e in self.selection}
            if any(o.args[0].key() not in held for o in self.order):
                raise InvalidProjection("a distinct query is ordered by its own columns only")
        return self


def _merged(a: tuple, b: tuple) -> tuple:
    out = list(a)
    for c in b:
        same = [x for x in out if x.name == c.name]
        if same and same[0].body is not c.body:
            raise RelqError(None, f"two definitions of {c.name}")
        if not same:
            out.append(c)
    return tuple(out)


@dataclass(frozen=True, eq=False)
class Combined:
    """A set operation of two queries, or of a combination and a query: left to right, in call order."""

    op: str
    left: Any
    right: Any
    order: tuple[tuple[str, bool, bool | None], ...] = ()
    limit_: int | None = None
    offset_: int = 0

    @property
    def entity(self) -> Any:
        return getattr(self.left, "entity", None)

    def outputs(self) -> list[tuple[str, Any]]:
        return self.left.outputs()

    @property
    def ctes(self) -> tuple:
        return _merged(self.left.ctes, self.right.ctes)

    def union(self, other: Any) -> Combined:
        return combine("union", self, other)

    def union_all(self, other: Any) -> Combined:
        return combine("union_all", self, other)

    def intersect(self, other: Any) -> Combined:
        return combine("intersect", self, other)

    def except_(self, other: Any) -> Combined:
        return combine("except", self, other)

    def order_by(self, name: str, descending: bool = False, nulls_first: bool | None = None) -> Combined:
        if name not in dict(self.outputs()):
            raise InvalidProjection(f"no output {name}")
        return replace(self, order=(*self.order, (name, descending, nulls_first)))

    def limit(self, n: int) -> Combined:
        return replace(self, limit_=n)

    def offset(self, n: int) -> Combined:
        return replace(self, offset_=n)


def combine(op: str, left: Any, right: Any) -> Combined:
    """Two queries with the same output labels, matched by label; branches keep their own order and limit."""
    if getattr(left, "lock", None) or getattr(right, "lock", None):
        raise RelqError(4005)
    a, b = (sorted(n for n, _ in q.outputs()) for q in (left, right))
    if a != b:
        raise InvalidProjection(f"labels {', '.join(a)} against {', '.join(b)}")
    return Combined(op, left, right)
