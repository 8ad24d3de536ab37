"""Query values to DataFrames. The only place that knows both.

The order of steps is fixed, whatever the order of calls: sources (the deleted rows of joined ones left out before the
join), joins, WHERE, groups with every aggregate that any later step needs as a hidden column, HAVING, windows, the
projection, DISTINCT, order, slice, associations. All of it is built-in expressions, and nothing runs here but the levels
of a recursion.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..errors import RelqError
from ..functions.expr import INTEGERS, Expr, Window, ordered
from ..operators.query import INCLUDED, ONLY, Combined, CommonTable, Query, Raw, Recursive
from ..sources.entity import Catalog
from ..sources.shared import shared_folder

#: A list longer than this is joined instead of written into the plan.
LONG_LIST = 1000


class Compiler:
    """Compiles queries over one catalog; common tables are compiled once each."""

    def __init__(self, catalog: Catalog, now: dt.datetime | None = None) -> None:
        self.catalog, self.spark, self.now = catalog, catalog.spark, now
        self.common: dict[int, DataFrame] = {}

    # sources
    def source(self, source: Any) -> DataFrame:
        if isinstance(source, CommonTable):
            if id(source.body) not in self.common:
                body = source.body
                self.common[id(body)] = self.recursive(body) if isinstance(body, Recursive) else self.raw(body) if isinstance(body, Raw) else self.query(body)
            return self.common[id(source.body)]
        return self.combined(source) if isinstance(source, Combined) else self.catalog.frame(source)

    def deleted(self, source: Any, alias: str, scope: str) -> Column | None:
        column = source.deleted_column() if hasattr(source, "deleted_column") else None
        if column is None or scope == INCLUDED:
            return None
        c = F.col(f"`{alias}`.`{column}`")
        return c.isNotNull() if scope == ONLY else c.isNull()

    # queries
    def query(self, q: Any, outer: frozenset[str] = frozenset()) -> DataFrame:
        if isinstance(q, Combined):
            return self.combined(q)
        q = q.checked()
        local = {q.alias, *(j.alias for j in q.joins)}
        scope = Scope(self, outer - local)
        df = scope.bind(self.source(q.source).alias(q.alias), all_parts(q))
        for j in q.joins:
            right = self.source(j.source).alias(j.alias)
            gone = self.deleted(j.source, j.alias, INCLUDED if q.scope == INCLUDED else "excluded" if q.scope != ONLY else INCLUDED)
            if gone is not None:
                right = right.where(gone).alias(j.alias)
            df = df.join(right, scope.column(j.on), j.kind)
        keep = [c for c in (self.deleted(q.source, q.alias, q.scope), q.condition is not None and scope.column(q.condition)) if c is not None and c is not False]
        if keep:
            df = df.where(reduce(lambda a, b: a & b, keep))
        selection = q.selection or tuple((n, Expr("column", (q.alias, n), t)) for n, t in q.outputs())
        if q.grouped:
            df = self.grouped(df, q, scope)
        if isinstance(q.distinct_, tuple):
            df = self.first_of_each(df, q, scope)
        names = [n for n, _ in selection]
        if q.distinct_ is True:
            df = df.select(*(scope.column(e).alias(n) for n, e in selection)).distinct()
            held = {e.key(): n for n, e in selection}
            terms = [placed(F.col(f"`{held[o.args[0].key()]}`"), o) for o in q.order if o.args[0].key() in held]
            df = sliced(df.orderBy(*terms) if terms else df, q)
        elif any(e.has_window() for _, e in selection):  # window functions see all rows: they come before the slice
            df = df.select(*(scope.column(e).alias(n) for n, e in selection), *(scope.column(o.args[0]).alias(f"__o{i}") for i, o in enumerate(q.order)))
            df = df.orderBy(*(placed(F.col(f"__o{i}"), o) for i, o in enumerate(q.order))) if q.order else df
            df = sliced(df, q).select(*(F.col(f"`{n}`") for n in names))
        elif q.preloads and q.order:  # joins with the associations lose an order: it is carried along and applied after them
            terms = [scope.column(o.args[0]).alias(f"__o{i}") for i, o in enumerate(q.order)]
            df = df.select(*(scope.column(e).alias(n) for n, e in selection), *terms)
            order = [placed(F.col(f"__o{i}"), o) for i, o in enumerate(q.order)]
            if q.offset_ or q.limit_ is not None:
                df = sliced(df.orderBy(*order), q)
        else:  # the slice stands right above its sort: in a correlated subquery Spark takes the order from there only
            df = df.orderBy(*(placed(scope.column(o.args[0]), o) for o in q.order)) if q.order else df
            df = sliced(df, q).select(*(scope.column(e).alias(n) for n, e in selection))
        if q.preloads:
            from ..operators.preload import preloaded

            df = preloaded(self, df, q)
            if q.order and q.distinct_ is not True:
                df = df.orderBy(*(placed(F.col(f"__o{i}"), o) for i, o in enumerate(q.order))).drop(*(f"__o{i}" for i in range(len(q.order))))
            elif q.order:
                df = df.orderBy(*terms)
        return df

    def grouped(self, df: DataFrame, q: Query, scope: Scope) -> DataFrame:
        wanted = [e for _, e in q.selection] + [o.args[0] for o in q.order] + ([q.having_] if q.having_ is not None else [])
        aggregates: dict[tuple, Expr] = {}
        for e in wanted:
            for a in own_aggregates(e):
                aggregates.setdefault(a.key(), a)
        keys = {e.key(): (e, f"__g{i}") for i, e in enumerate(q.group)}
        made = {k: (e, f"__a{i}") for i, (k, e) in enumerate(aggregates.items())}
        values = [scope.column(e).alias(n) for e, n in made.values()] or [F.count(F.lit(1)).alias("__rows")]
        by = [scope.column(e).alias(n) for e, n in keys.values()]
        df = df.groupBy(*by).agg(*values) if by else df.select(*values)  # stays unresolved in a correlated subquery
        scope.held = {k: n for k, (_, n) in (*keys.items(), *made.items())}
        df = scope.bind(df, all_parts(q))
        return df.where(scope.column(q.having_)) if q.having_ is not None else df

    def first_of_each(self, df: DataFrame, q: Query, scope: Scope) -> DataFrame:
        """The first row of each value. The filter on the rank right above the window lets Spark keep the first row of each
        value in every task before the shuffle."""
        by = [scope.column(e) for e in q.distinct_]
        order = [placed(scope.column(o.args[0]), o) for o in q.order]
        if not q.grouped and hasattr(q.source, "primary_key"):  # ties fall to the least key
            order += [F.col(f"`{q.alias}`.`{k}`").asc_nulls_last() for k in q.source.primary_key()]
        w = W.partitionBy(*by).orderBy(*(order or by))
        return df.withColumn("__first", F.row_number().over(w)).where("__first <= 1")

    def combined(self, c: Combined) -> DataFrame:
        names = [n for n, _ in c.outputs()]
        a, b = self.query(c.left).select(*names), self.query(c.right).select(*names)
        df = {"union": lambda: a.union(b).distinct(), "union_all": lambda: a.union(b), "intersect": lambda: a.intersect(b), "except": lambda: a.subtract(b)}[c.op]()
        if c.order:
            df = df.orderBy(*(placed(F.col(f"`{n}`"), Expr("order", (None, desc, first))) for n, desc, first in c.order))
        return sliced(df, c)

    def raw(self, r: Raw) -> DataFrame:
        df = self.spark.sql(r.text, args=dict(r.args) or None, **{e.__table__: self.catalog.frame(e) for e in r.uses})
        return Catalog(self.spark, None, {r.declares.__table__: df}).frame(r.declares)

    def recursive(self, r: Recursive) -> DataFrame:
        """The anchor's rows, then level by level the source's rows that link to the last level's, until there are none.

        A row whose walk holds its key goes no further. Spark's own WITH RECURSIVE ends at a million rows; here each level
        is a join of the last one with the source, written to the shared folder, so neither rows nor
        levels are bounded but by r.levels. More levels than that are an error, as rows would be lost.
        """
        names = [n for n, _ in r.anchor.outputs()]
        found = Query(CommonTable(r.name, r.anchor), r.name)._columns(CommonTable(r.name, r.anchor), r.name)
        condition = F.expr(text_of(r.on(Query.of(r.source).sources()[0], found), {r.source.__table__: "n", r.name: "w"}))
        nodes = self.catalog.frame(r.source)
        own = r.source.deleted_column()
        if own and r.anchor.scope != INCLUDED:
            nodes = nodes.where(F.col(f"`{own}`").isNull())
        level = self.query(r.anchor).select(*names)
        if r.key:
            level = level.select("*", F.array(f"`{r.key}`").alias("walked_path"), F.lit(False).alias("closes_cycle"))
        levels = [level := self.cut(level)]
        while not (going := level.where("NOT closes_cycle") if r.key else level).isEmpty():
            if len(levels) > r.levels:
                raise RelqError(None, f"{r.name}: rows beyond {r.levels} levels of recursion")
            next_ = nodes.alias("n").join(going.alias("w"), condition)
            columns = [F.col(f"n.`{n}`") for n in names]
            if r.key:
                at = F.col(f"n.`{r.key}`")
                columns += [F.concat("w.walked_path", F.array(at)).alias("walked_path"), F.array_contains("w.walked_path", at).alias("closes_cycle")]
            levels.append(level := self.cut(next_.select(*columns)))
        out = reduce(DataFrame.unionByName, levels)
        return out if r.closers or not r.key else out.where("NOT closes_cycle")

    def cut(self, df: DataFrame) -> DataFrame:
        """df as a table in the shared folder, where its plan begins anew."""
        path = f"{shared_folder(self.spark)}/relq-level-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def sliced(df: DataFrame, q: Any) -> DataFrame:
    df = df.offset(q.offset_) if q.offset_ else df
    return df if q.limit_ is None else df.limit(q.limit_)


def text_of(e: Expr, names: dict[str, str]) -> str:
    """A link of a recursive step, of columns, comparisons and AND, as SQL."""
    if e.op == "column":
        return f"{names[e.args[0]]}.`{e.args[1]}`"
    if e.op == "compare":
        return f"({text_of(e.args[1], names)} {e.args[0]} {text_of(e.args[2], names)})"
    if e.op == "and":
        return f"({text_of(e.args[0], names)} AND {text_of(e.args[1], names)})"
    raise ValueError(f"{e.op} in a recursive step's link")


def own_aggregates(e: Any):
    """The aggregates that grouping must compute: not those that a window function is."""
    if isinstance(e, Window):
        for x in (*e.partition, *e.order):
            yield from own_aggregates(x)
        return
    if not isinstance(e, Expr):
        return
    if e.op == "aggregate":
        yield e
        return
    for a in e.args[0].args if e.op == "over" and e.args[0].op == "aggregate" else e.args:
        yield from own_aggregates(a)
    if e.op == "over":
        yield from own_aggregates(e.args[1])


def placed(c: Column, term: Expr) -> Column:
    """An order term. Without a choice nulls are last ascending and first descending."""
    _, descending, first = term.args
    first = descending if first is None else first
    if descending:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


def pattern_of(pattern: str) -> str:
    """A LIKE pattern in which a backslash before an ordinary character is dropped, as it means that character."""
    return re.sub(r"\\([^%_\\])", r"\1", pattern)


def fragments(e: Any):
    if isinstance(e, Expr):
        if e.op == "fragment":
            yield e
        for a in e.args:
            yield from fragments(a)
    elif isinstance(e, Window):
        for x in (*e.partition, *e.order):
            yield from fragments(x)


class Scope:
    """Expressions to columns, with the names of an enclosing query and, after grouping, the hidden columns."""

    def __init__(self, compiler: Compiler, outer: frozenset[str]) -> None:
        self.compiler, self.outer, self.held = compiler, outer, {}

    def bind(self, df: DataFrame, parts: Any) -> DataFrame:
        """A constant column for each value bound in a fragment: text is parsed on its own, values never join it."""
        values = {b.key(): b for p in parts for f in fragments(p) for b in f.args[1:] if b.op == "literal"}
        self.binds = {k: f"__b{i}" for i, k in enumerate(values)}
        return df.withColumns({self.binds[k]: self.column(b) for k, b in values.items()}) if values else df

    def column(self, e: Expr) -> Column:
        if (name := self.held.get(e.key())) is not None:
            return F.col(name)
        return getattr(self, f"_{e.op}")(*e.args, type=e.type)

    def _column(self, alias, name, type):  # noqa: A002
        c = F.col(f"`{alias}`.`{name}`")
        return c.outer() if alias in self.outer else c

    def _literal(self, value, type):  # noqa: A002
        return F.lit(value)

    def _compare(self, op, a, b, type):  # noqa: A002
        x, y = self.column(a), self.column(b)
        return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def _is_null(self, a, type):  # noqa: A002
        return self.column(a).isNull()

    def _same(self, a, b, type):  # noqa: A002
        return self.column(a).eqNullSafe(self.column(b))

    def _in_list(self, a, *values, type):  # noqa: A002
        if not values:
            return F.lit(False)
        if len(values) > LONG_LIST and all(v.op == "literal" for v in values):
            name = self.compiler.spark.createDataFrame([(v.args[0],) for v in values], "v " + (a.type or values[0].type).simpleString())
            return self.column(a).isin(name)
        return self.column(a).isin([self.column(v) for v in values])

    def _in_query(self, a, q, type):  # noqa: A002
        return self.column(a).isin(self.sub(q))

    def sub(self, q: Any) -> DataFrame:
        """A subquery: every name that is not its own belongs to the queries around it."""
        own = {q.alias, *(j.alias for j in q.joins)} if isinstance(q, Query) else set()
        used = {a for e in all_parts(q) for a in names_in(e)}
        return self.compiler.query(q, frozenset(used - own) | self.outer)

    def _exists(self, q, type):  # noqa: A002
        return self.sub(q).exists()

    def _scalar(self, q, type):  # noqa: A002
        return self.sub(q).scalar()

    def _scalar_first(self, q, type):  # noqa: A002
        return self.sub(q.limit(1)).scalar()

    def _scalar_count(self, q, type):  # noqa: A002
        """The rows of a correlated query. Groups and distinct rows are counted by their distinct keys, as Spark resolves the
        names of a grouping before those of the queries around it are known."""
        from dataclasses import replace

        if q.having_ is not None or (q.distinct_ and (q.grouped or any(e.has_window() for _, e in q.selection))):
            from ..errors import Unsupported

            raise Unsupported("counting a correlated query with HAVING, or with DISTINCT over groups or windows")
        if q.grouped and not q.group:  # an aggregate over everything is one row
            return F.lit(1).cast("long")
        counted = ("count", Expr("literal", (1,)), None)
        if q.group or q.distinct_:
            every = tuple(e for _, e in q.selection) or tuple(Expr("column", (q.alias, n), t) for n, t in q.outputs())
            counted = ("count_distinct", Expr("struct", q.group or (every if q.distinct_ is True else q.distinct_)), None)
        plain = replace(q, selection=(("n", Expr("aggregate", counted)),), group=(), distinct_=False, order=(), limit_=None, offset_=0, preloads=())
        return self.sub(plain).scalar()

    def _struct(self, *parts, type):  # noqa: A002
        return F.struct(*(self.column(p).alias(f"k{i}") for i, p in enumerate(parts)))

    def _and(self, a, b, type):  # noqa: A002
        return self.column(a) & self.column(b)

    def _or(self, a, b, type):  # noqa: A002
        return self.column(a) | self.column(b)

    def _not(self, a, type):  # noqa: A002
        return ~self.column(a)

    def _like(self, a, pattern, any_case, type):  # noqa: A002
        return self.column(a).ilike(pattern_of(pattern)) if any_case else self.column(a).like(pattern_of(pattern))

    def _match(self, a, how, text, any_case, type):  # noqa: A002
        if not any_case:
            return {"contains": F.contains, "prefix": F.startswith, "suffix": F.endswith}[how](self.column(a), F.lit(text))
        held = re.sub(r"([\\%_])", r"\\\1", text)
        return self.column(a).ilike({"contains": f"%{held}%", "prefix": f"{held}%", "suffix": f"%{held}"}[how])

    def _math(self, op, a, b, type):  # noqa: A002
        x, y = self.column(a), self.column(b)
        if op == "/" and isinstance(type, INTEGERS):
            made = F.call_function("div", x, y)
        else:
            made = {"+": x.__add__, "-": x.__sub__, "*": x.__mul__, "/": x.__truediv__}[op](y)
        return made.cast(type) if isinstance(type, (*INTEGERS, T.FloatType, T.DoubleType)) else made

    def _truncate(self, a, unit, zone, type):  # noqa: A002
        c = self.column(a)
        if zone is None:
            return F.date_trunc(unit, c).cast(type or T.TimestampType())
        local = F.from_utc_timestamp(c, zone)
        if unit in ("minute", "hour"):  # by the row's own offset: a repeated hour stays two
            return F.timestamp_micros(F.unix_micros(F.date_trunc(unit, local)) - F.unix_micros(local) + F.unix_micros(c))
        return F.to_utc_timestamp(F.date_trunc(unit, local), zone)

    def _interval(self, later, earlier, type):  # noqa: A002
        return self.column(later) - self.column(earlier)

    def _seconds(self, later, earlier, type):  # noqa: A002
        micros = F.timestamp_diff("MICROSECOND", self.column(earlier).cast("timestamp"), self.column(later).cast("timestamp"))
        return micros / F.lit(1e6)

    def _now(self, type):  # noqa: A002
        return F.lit(self.compiler.now) if self.compiler.now else F.current_timestamp()

    def _rounded(self, a, digits, type):  # noqa: A002
        return F.round(self.column(a), digits)

    def _cast(self, a, to, type):  # noqa: A002
        return self.column(a).cast(to)

    def _fragment(self, text, *binds, type):  # noqa: A002
        names = []
        for b in binds:
            if b.op == "literal":
                names.append(f"`{self.binds[b.key()]}`")
            elif b.key() in self.held:
                names.append(self.held[b.key()])
            elif b.op == "column":
                names.append(f"`{b.args[0]}`.`{b.args[1]}`")
            else:
                raise ValueError("a fragment binds columns, grouped expressions and values")
        parts = text.split("{}")
        return F.expr("(" + "".join(p + n for p, n in zip(parts, [*names, ""])) + ")")

    def _plain_aggregate(self, name, a, condition, *more) -> Column:
        c = self.column(a)
        if condition is not None:
            c = F.when(self.column(condition), c)
        if name == "sum" and isinstance(a.type, INTEGERS):  # longs may pass their range on the way to a sum within it
            return F.sum(c.cast("decimal(38,0)") if isinstance(a.type, T.LongType) else c.cast("long"))
        if name in ("sum", "avg") and not isinstance(a.type, T.DecimalType):
            return getattr(F, name)(c.cast("double"))
        if name == "percentile":
            return F.percentile(c.cast("double"), F.lit(more[0]))
        return getattr(F, name)(c)

    def _aggregate(self, name, a, condition, *more, type):  # noqa: A002
        made = self._plain_aggregate(name, a, condition, *more)
        return made.cast("long") if name == "sum" and isinstance(a.type, INTEGERS) else made

    def _ranking(self, name, *args, type):  # noqa: A002
        return getattr(F, name)(*(self.column(a) if isinstance(a, Expr) else a for a in args))

    def _over(self, inner, window, type):  # noqa: A002
        w = W.partitionBy(*(self.column(e) for e in window.partition))
        if window.order:
            w = w.orderBy(*(placed(self.column(o.args[0]), ordered(o)) for o in window.order))
        if window.frame:
            kind, low, high = window.frame
            low, high = W.unboundedPreceding if low is None else low, W.unboundedFollowing if high is None else high
            w = w.rowsBetween(low, high) if kind == "rows" else w.rangeBetween(low, high)
        if inner.op == "ranking":
            return self.column(inner).over(w)
        made = self._plain_aggregate(*inner.args).over(w)
        return made.cast("long") if inner.args[0] == "sum" and isinstance(inner.args[1].type, INTEGERS) else made


def all_parts(q: Any):
    if isinstance(q, Combined):
        yield from all_parts(q.left)
        yield from all_parts(q.right)
        return
    yield from (e for _, e in q.selection)
    yield from q.group
    yield from q.order
    yield from (x for x in (q.condition, q.having_) if x is not None)
    yield from (j.on for j in q.joins)
    if isinstance(q.distinct_, tuple):
        yield from q.distinct_


def names_in(e: Any):
    """Names of sources in an expression, those that its subqueries take from outside included."""
    if isinstance(e, Window):
        for x in (*e.partition, *e.order):
            yield from names_in(x)
    elif isinstance(e, (Query, Combined)):
        own = {e.alias, *(j.alias for j in e.joins)} if isinstance(e, Query) else set()
        yield from (n for p in all_parts(e) for n in names_in(p) if n not in own)
    elif isinstance(e, Expr):
        if e.op == "column":
            yield e.args[0]
        for a in e.args:
            yield from names_in(a)


def compile_query(q: Any, catalog: Catalog, now: dt.datetime | None = None) -> DataFrame:
    return Compiler(catalog, now).query(q)
