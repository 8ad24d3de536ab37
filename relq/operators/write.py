"""Set-based changes as transformations of a table's rows.

Each function takes the present rows and gives the rows after the change and a count; none writes. ``Session`` in
``relq.operators.transaction`` stages and publishes what they give.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidConflictClause, RelqError
from ..functions.expr import Expr, expr
from ..plans.compiler import Compiler, Scope, all_parts
from ..sources.entity import Columns
from .query import INCLUDED, CommonTable, Query


def refuse_clauses(q: Query) -> Query:
    """Bulk writes take conditions only: anything else would be dropped silently."""
    for held, name in ((q.limit_ is not None, "LIMIT"), (q.offset_, "OFFSET"), (q.order, "ORDER BY"), (q.grouped, "GROUP BY"), (q.distinct_, "DISTINCT"), (q.lock, "a row lock"), (q.joins, "JOIN"), (q.selection, "a projection")):
        if held:
            raise RelqError(4111, name)
    if isinstance(q.source, CommonTable) or not hasattr(q.source, "__table__"):
        raise RelqError(4111, "a source that is no table")
    return q


def matches(compiler: Compiler, df: DataFrame, q: Query) -> tuple[DataFrame, Column]:
    """The rows under the query's name and the condition of its rows, where null counts as false."""
    scope = Scope(compiler, frozenset())
    df = scope.bind(df.alias(q.alias), all_parts(q))
    parts = [c for c in (compiler.deleted(q.source, q.alias, q.scope), None if q.condition is None else scope.column(q.condition)) if c is not None]
    hit = reduce(lambda a, b: a & b, parts, F.lit(True))
    return df, F.coalesce(hit, F.lit(False))


def _marked(compiler: Compiler, df: DataFrame, q: Query) -> DataFrame:
    """The rows with __hit. The condition is a column of its own, so that subqueries in it stand in a filter."""
    own, hit = matches(compiler, df, q)
    return own.select(*(F.col(f"`{q.alias}`.`{c}`").alias(c) for c in df.columns), hit.alias("__hit"))


def updated(compiler: Compiler, df: DataFrame, q: Query, **changes: Any) -> tuple[DataFrame, DataFrame]:
    """(rows after, rows hit). Changes are values, expressions, or functions of the query's columns."""
    q = refuse_clauses(q)
    unknown = [c for c in changes if c not in q.source.__fields__]
    if unknown or not changes:
        raise RelqError(None, f"unknown column {unknown}" if unknown else "no changes")
    marked = _marked(compiler, df, q).alias(q.alias)
    scope = Scope(compiler, frozenset())
    made = {q.source.__fields__[n].column: expr(v(*q.sources()) if callable(v) and not isinstance(v, Expr) else v) for n, v in changes.items()}
    marked = scope.bind(marked, made.values())
    hit = F.col(f"`{q.alias}`.`__hit`")
    types = dict(df.dtypes)
    out = marked.select(*(F.when(hit, scope.column(made[c]).cast(types[c])).otherwise(F.col(f"`{q.alias}`.`{c}`")).alias(c) if c in made else F.col(f"`{q.alias}`.`{c}`").alias(c) for c in df.columns))
    return out, marked.where(hit).select(*df.columns)


def removed(compiler: Compiler, df: DataFrame, q: Query) -> tuple[DataFrame, DataFrame]:
    """(rows left, rows hit): a real deletion, of soft-deletable rows too."""
    marked = _marked(compiler, df, refuse_clauses(q))
    return marked.where("NOT __hit").drop("__hit"), marked.where("__hit").drop("__hit")


def soft_deleted(compiler: Compiler, df: DataFrame, q: Query, at: Any) -> tuple[DataFrame, DataFrame]:
    """Sets the deletion column of rows that have none."""
    column = q.source.deleted_column()
    if column is None:
        raise RelqError(4105, q.source.__name__)
    name = next(n for n, f in q.source.__fields__.items() if f.column == column)
    return updated(compiler, df, q, **{name: at})


def restored(compiler: Compiler, df: DataFrame, q: Query) -> tuple[DataFrame, DataFrame]:
    return soft_deleted(compiler, df, q.only_deleted(), None)


@dataclass(frozen=True)
class OnConflict:
    """What an insert does where a stored row has the same values of target.

    do_nothing keeps the stored row; set names the columns taken from the incoming row, or maps columns to functions
    of (existing, incoming). where limits the rows that count, stored and incoming (a partial index), update_where those
    updated. The target is columns or, by constraint=, a name of the entity's unique=; without either it is the primary key.
    """

    target: tuple[str, ...] = ()
    set: tuple[str, ...] | dict[str, Callable[[Any, Any], Expr]] = ()
    where: Callable[[Any], Expr] | None = None
    update_where: Callable[[Any, Any], Expr] | None = None
    nothing: bool = False
    constraint: str | None = None

    @staticmethod
    def do_nothing(*target: str, where: Callable[[Any], Expr] | None = None, constraint: str | None = None) -> OnConflict:
        if target and constraint:
            raise InvalidConflictClause("a target is columns or a constraint")
        return OnConflict(target, where=where, nothing=True, constraint=constraint)

    @staticmethod
    def do_update(*target: str, set: Any, where: Any = None, update_where: Any = None, constraint: str | None = None) -> OnConflict:  # noqa: A002
        if bool(target) == bool(constraint) or not set:
            raise InvalidConflictClause("an update needs a target, columns or a constraint, and columns to set")
        return OnConflict(target, set if isinstance(set, dict) else tuple(set), where, update_where, constraint=constraint)

    def columns(self, entity: type) -> list[str]:
        """The target's columns in an entity."""
        if self.constraint is not None and self.constraint not in entity.__unique__:
            raise InvalidConflictClause(f"{entity.__name__} has no constraint {self.constraint}")
        fields = entity.__unique__[self.constraint] if self.constraint is not None else self.target
        return [entity.__fields__[t].column for t in fields] or entity.primary_key()


def upserted(compiler: Compiler, df: DataFrame, entity: type, batch: DataFrame, conflict: OnConflict) -> tuple[DataFrame, DataFrame]:
    """(rows after, rows inserted or updated): one full join on the target's columns.

    A batch that holds a target's values twice is an error when it runs, as it would touch one row twice; with
    do_nothing the first by all columns stays. Nulls in a target match nothing, nor do rows that where leaves out.
    """
    target, columns = conflict.columns(entity), df.columns
    whole = F.struct(*columns)
    known = reduce(lambda a, b: a & b, (F.col(t).isNotNull() for t in target), F.col("__counts"))

    def counting(rows: DataFrame, name: str) -> DataFrame:
        if conflict.where is None:
            return rows.withColumn("__counts", F.lit(True))
        test, own = conflict.where(Columns(entity, name)), Scope(compiler, frozenset())
        return own.bind(rows.alias(name), [test]).withColumn("__counts", F.coalesce(own.column(test), F.lit(False))).select(*rows.columns, "__counts")

    batch, df = counting(batch, "incoming"), counting(df, "existing")
    twice = batch.where(known).groupBy(*target).agg(F.min(whole).alias("__row"), F.count(F.lit(1)).alias("__n"))
    if not conflict.nothing:
        twice = twice.withColumn("__row", F.when(F.col("__n") == 1, F.col("__row")).otherwise(F.raise_error(F.lit("RELQ: the batch holds a key of the conflict target twice")).cast(twice.schema["__row"].dataType)))
    batch = twice.select("__row.*", F.lit(True).alias("__counts")).unionByName(batch.where(~known))
    old, new = df.alias("existing"), batch.withColumn("__new", F.lit(True)).alias("incoming")
    on = reduce(lambda a, b: a & b, (F.col(f"existing.`{t}`") == F.col(f"incoming.`{t}`") for t in target))
    on = on & F.col("existing.__counts") & F.col("incoming.__counts")
    e, i = Columns(entity, "existing"), Columns(entity, "incoming")
    wanted = conflict.update_where(e, i) if conflict.update_where is not None else None
    names = conflict.set if isinstance(conflict.set, dict) else {c: None for c in conflict.set}
    values = {entity.__fields__[n].column: getattr(i, n) if f is None else expr(f(e, i)) for n, f in names.items()}
    scope = Scope(compiler, frozenset())
    old = scope.bind(old.withColumn("__old", F.lit(True)).alias("existing"), [wanted, *values.values()])
    both = old.join(new, on, "full")
    clash = F.col("existing.__old").isNotNull() & F.col("incoming.__new").isNotNull()
    change = F.lit(False) if conflict.nothing else clash
    if wanted is not None:
        change = change & F.coalesce(scope.column(wanted), F.lit(False))
    made = {c: scope.column(v) for c, v in values.items()}
    inserted = F.col("existing.__old").isNull()

    def value(c: str) -> Column:
        stored = F.when(change, made[c]).otherwise(F.col(f"existing.`{c}`")) if c in made else F.col(f"existing.`{c}`")
        return F.when(inserted, F.col(f"incoming.`{c}`")).otherwise(stored).alias(c)

    out = both.select(*(value(c) for c in columns), (inserted | change).alias("__hit"))
    return out.drop("__hit"), out.where("__hit").drop("__hit")


#: Buckets by which a batch is numbered: their sizes are all that one task sees of the whole batch.
BUCKETS = 4096


def generated(entity: type, batch: DataFrame, present: DataFrame) -> DataFrame:
    """The batch with all of the entity's columns, the next numbers in its generated ones where they are null.

    Rows are numbered without gaps, by buckets of a hash of their other columns and by these columns within one.
    """
    for f in entity.__fields__.values():
        if f.column not in batch.columns:
            batch = batch.withColumn(f.column, F.lit(None).cast(f.type))
    for f in entity.__fields__.values():
        if f.generated:
            missing, given = batch.where(F.col(f.column).isNull()), batch.where(F.col(f.column).isNotNull())
            by = [c for c in missing.columns if c != f.column]
            missing = missing.withColumn("__b", F.pmod(F.xxhash64(*by), F.lit(BUCKETS)))
            sizes = missing.groupBy("__b").count()
            before = F.coalesce(F.sum("count").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            last = present.agg(F.coalesce(F.max(f.column), F.lit(0)).alias("__last"))  # one row
            starts = sizes.select("__b", before.alias("__start")).crossJoin(last)
            nth = F.row_number().over(W.partitionBy("__b").orderBy(*by))
            missing = missing.withColumn("__n", nth).join(F.broadcast(starts), "__b")  # BUCKETS rows at most
            missing = missing.withColumn(f.column, (F.col("__last") + F.col("__start") + F.col("__n")).cast(f.type)).drop("__b", "__n", "__start", "__last")
            batch = given.unionByName(missing)
    return batch.select(*entity.columns())


def all_rows(entity: type) -> Query:
    return Query(entity, entity.__table__, scope=INCLUDED)
