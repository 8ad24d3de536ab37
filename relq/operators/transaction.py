"""Transactions over the versioned store: staged overlays, savepoints, retries, and named multi-step work.

A transaction reads each table at the version it first saw (or as ISOLATION says), stages changed tables in folders of
their own, and on commit publishes them; a table it changed or read with a lock, and that others changed meanwhile, makes
it fail with VersionConflict. That check is on whole tables, weaker than row locks in concurrency. A changed table is
checked again by its publishing; tables only read are checked right before the first one is published, and several
tables are published one after another, so another writer or a reader between two of them may come between.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import itertools
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import RelqError, VersionConflict, classify
from ..plans.compiler import Compiler
from ..sources.entity import Entity
from ..sources.store import Store
from . import write
from .query import Query
from .repo import Diagnostics, Repo, limited


#: Folders of a table from which an insert writes it anew as one.
COMPACT = 64


#: read_committed: each statement sees what was published before it. repeatable_read: all see the versions first seen.
#: serializable: moreover a commit that changes a table fails where any table of the transaction was changed by others.
ISOLATION = ("read_committed", "repeatable_read", "serializable")


class Session:
    """Reads and writes of one transaction. A statement that takes longer than timeout, in seconds, is cancelled."""

    def __init__(
        self, store: Store, entities: list[type[Entity]], observers: tuple[Callable[[str], None], ...] = (), isolation: str = "repeatable_read", timeout: float | None = None
    ) -> None:
        if isolation not in ISOLATION:
            raise RelqError(None, f"isolation {isolation!r} is none of {', '.join(ISOLATION)}")
        self.store, self.entities, self.observers = store, {e.__table__: e for e in entities}, observers
        self.isolation, self.timeout = isolation, timeout
        self.versions = {n: store.version(n) for n in self.entities}
        self.overlay: dict[str, list[str]] = {}
        self.made: list[tuple[type[Entity], str]] = []
        self.checked: set[str] = set()
        self.failed = self.published = False
        self.now = dt.datetime.now(dt.timezone.utc)

    # reading
    def rows(self, entity: type[Entity]) -> DataFrame:
        name = entity.__table__
        return self.store.staged(entity, self._folders(name))

    def _folders(self, name: str) -> list[str]:
        return self.overlay[name] if name in self.overlay else self.store.folders(name, self.versions[name])

    def _stage(self, entity: type[Entity], df: DataFrame) -> list[str]:
        name = self.store.stage(entity, df)
        self.made.append((entity, name))
        return [name]

    def _refresh(self) -> None:
        """Under read_committed, the tables as they are now, but for those changed or locked here."""
        if self.isolation == "read_committed":
            for n in self.versions.keys() - self.overlay.keys() - self.checked:
                self.versions[n] = self.store.version(n)

    @contextlib.contextmanager
    def _statement(self) -> Iterator[None]:
        self._refresh()
        with limited(self.store.spark, self.timeout):
            yield

    def _repo(self) -> Repo:
        from ..sources.entity import Catalog

        return Repo(Catalog(self.store.spark, None, {n: self.rows(e) for n, e in self.entities.items()}), Diagnostics(), self.now, self.timeout)

    @property
    def repo(self) -> Repo:
        """Reads of the tables as this transaction sees them at the call."""
        self._refresh()
        return self._repo()

    def all(self, q: Any) -> list[Row]:
        own = self.repo
        if getattr(q, "lock", None):
            self.checked.add(q.source.__table__)
        return own.all(q)

    # writing
    def _compiler(self) -> Compiler:
        return Compiler(self._repo().catalog, self.now)

    def _put(self, entity: type[Entity], after: DataFrame, hit: DataFrame) -> int:
        n = hit.count()
        if n:
            self.overlay[entity.__table__] = self._stage(entity, after)
        return n

    def _batch(self, entity: type[Entity], rows: list[dict] | DataFrame) -> DataFrame:
        if isinstance(rows, DataFrame):
            return rows
        fields = entity.__fields__
        for r in rows:
            if unknown := set(r) - set(fields):
                raise RelqError(None, f"unknown column {sorted(unknown)}")
            for n, v in r.items():
                if fields[n].labels and v is not None and v not in fields[n].labels:
                    raise RelqError(4108, f"{n}: {v!r}")
        from pyspark.sql import types as T

        for n, f in fields.items():
            if f.generated and any(r.get(n) is None for r in rows):  # in the order of the list
                last = self.rows(entity).agg(F.max(f.column)).first()[0] or 0
                count = itertools.count(last + 1)
                rows = [r if r.get(n) is not None else {**r, n: next(count)} for r in rows]
        schema = T.StructType([T.StructField(f.column, f.type, True) for f in fields.values()])
        return self.store.spark.createDataFrame([tuple(r.get(n) for n in fields) for r in rows], schema)

    def insert(self, entity: type[Entity], rows: list[dict] | DataFrame, on_conflict: write.OnConflict | None = None) -> DataFrame:
        """Adds rows, numbering generated columns; gives the stored rows that were inserted or updated.

        Without a conflict clause the rows are written once, beside the table's: their keys are looked up among the
        stored ones, and nothing else is read or written again, until a table has COMPACT folders.
        """
        with self._statement():
            return self._insert(entity, rows, on_conflict)

    def _insert(self, entity: type[Entity], rows: list[dict] | DataFrame, on_conflict: write.OnConflict | None) -> DataFrame:
        present, name = self.rows(entity), entity.__table__
        batch = write.generated(entity, self._batch(entity, rows), present)
        if on_conflict is not None:
            if isinstance(rows, DataFrame):  # numbered once
                batch = self.store.staged(entity, self._stage(entity, batch))
            after, hit = write.upserted(self._compiler(), present, entity, batch, on_conflict)
            held = self.store.staged(entity, self._stage(entity, hit))
            self.overlay[name] = self._stage(entity, after)
            return held
        folders = self._stage(entity, batch)
        batch = self.store.staged(entity, folders)
        if key := entity.primary_key():
            known = reduce(lambda a, b: a & b, (F.col(f"`{k}`").isNotNull() for k in key))
            twice = batch.where(known).groupBy(*key).count().where("count > 1")
            if not twice.isEmpty() or not present.join(batch.select(*key), key, "left_semi").isEmpty():
                raise RelqError(None, f"a second row of the key {', '.join(key)}")
        every = [*self._folders(name), *folders]
        self.overlay[name] = every if len(every) < COMPACT else self._stage(entity, self.store.staged(entity, every))
        return batch

    def update(self, q: Query, **changes: Any) -> int:
        with self._statement():
            return self._put(q.source, *write.updated(self._compiler(), self.rows(q.source), q, **changes))

    def delete(self, q: Query) -> int:
        with self._statement():
            return self._put(q.source, *write.removed(self._compiler(), self.rows(q.source), q))

    force_delete = delete

    def soft_delete(self, q: Query) -> int:
        with self._statement():
            return self._put(q.source, *write.soft_deleted(self._compiler(), self.rows(q.source), q, self.now.replace(tzinfo=None)))

    def restore(self, q: Query) -> int:
        with self._statement():
            return self._put(q.source, *write.restored(self._compiler(), self.rows(q.source), q))

    def _row(self, entity: type[Entity], row: Any) -> Query:
        values = row.asDict() if isinstance(row, Row) else dict(row)
        q = write.all_rows(entity)
        for n, f in entity.__fields__.items():
            if f.key or f.version:
                q = q.where(lambda c, n=n, f=f: getattr(c, n) == values.get(f.column, values.get(n)))
        return q

    def update_row(self, entity: type[Entity], row: Any, **changes: Any) -> None:
        """Changes one row by its key, only the named columns; a version column must be as read and goes up by one.
        No such row is error 4104."""
        for n, f in entity.__fields__.items():
            if f.version:
                changes[n] = lambda c, n=n: getattr(c, n) + 1
        if self.update(self._row(entity, row), **changes) == 0:
            raise RelqError(4104, entity.__name__)

    def delete_row(self, entity: type[Entity], row: Any) -> None:
        if self.delete(self._row(entity, row)) == 0:
            raise RelqError(4104, entity.__name__)

    def debug_plan(self, kind: str, what: Any, *given: Any, **changes: Any) -> str:
        """The logical plan, unoptimised, of the table after a write that is not made: ("update", query, changes...),
        ("delete", query) or ("insert", entity, rows, conflict clause)."""
        self._refresh()
        entity = what.source if isinstance(what, Query) else what
        compiler, present = self._compiler(), self.rows(entity)
        if kind == "insert":
            batch = write.generated(entity, self._batch(entity, given[0]), present)
            after = write.upserted(compiler, present, entity, batch, given[1])[0] if given[1:] else present.unionByName(batch)
        elif kind == "update":
            after = write.updated(compiler, present, what, **changes)[0]
        elif kind == "delete":
            after = write.removed(compiler, present, what)[0]
        else:
            raise RelqError(None, f"no write is named {kind}")
        return after._jdf.queryExecution().logical().toString()

    # savepoints
    @contextlib.contextmanager
    def savepoint(self) -> Iterator[Session]:
        """What the block staged goes again if it raises."""
        held = dict(self.overlay)
        try:
            yield self
        except BaseException:
            self.overlay = held
            raise

    def rollback(self) -> None:
        """Ends the transaction without a change and removes what it staged."""
        self.failed, self.overlay = True, {}
        for entity, name in self.made:
            self.store.drop(entity, [name])
        self.made = []

    def commit(self) -> None:
        if self.failed:
            raise RelqError(4101)
        checked = self.versions if self.isolation == "serializable" and self.overlay else self.checked | set(self.overlay)
        for n in sorted(checked):
            if self.store.version(n) != self.versions[n]:
                raise VersionConflict(n)
        for n in sorted(self.overlay):
            self.store.publish(self.entities[n], self.overlay[n], self.versions[n])
            self.published = True  # from here on what was staged stays
        for tell in self.observers:
            tell("commit")


@contextlib.contextmanager
def transaction(
    store: Store, entities: list[type[Entity]], observers: tuple[Callable[[str], None], ...] = (), isolation: str = "repeatable_read", timeout: float | None = None
) -> Iterator[Session]:
    """Publishes what the block staged, or nothing where it raises."""
    own = Session(store, entities, observers, isolation, timeout)
    try:
        yield own
        own.commit()
    except BaseException:
        if not own.published:
            own.rollback()
        for tell in observers:
            tell("rollback")
        raise


def with_retries(
    store: Store, entities: list[type[Entity]], body: Callable[[Session], Any], attempts: int = 5, first_wait: float = 0.05, isolation: str = "repeatable_read", timeout: float | None = None
) -> Any:
    """Runs the body in a transaction, again after a version conflict, waiting twice as long each time, with jitter."""
    for n in range(attempts):
        try:
            with transaction(store, entities, isolation=isolation, timeout=timeout) as own:
                out = body(own)
            return out
        except VersionConflict as e:
            if n == attempts - 1 or classify(e) != "retryable":
                raise
            time.sleep(first_wait * 2**n * random.uniform(0.5, 1.5))
    return None


@dataclass(frozen=True)
class Failure:
    step: str
    error: BaseException
    done: dict[str, Any]


@dataclass(frozen=True)
class Multi:
    """Named steps of one transaction. A step gets the session and the results so far; a failure is given, not raised."""

    steps: tuple[tuple[str, Callable[[Session, dict[str, Any]], Any]], ...] = field(default=())

    def step(self, name: str, run: Callable[[Session, dict[str, Any]], Any]) -> Multi:
        if name in dict(self.steps):
            raise RelqError(None, f"two steps named {name}")
        return Multi((*self.steps, (name, run)))

    def merge(self, other: Multi) -> Multi:
        out = self
        for name, run in other.steps:
            out = out.step(name, run)
        return out

    def run(self, store: Store, entities: list[type[Entity]]) -> dict[str, Any] | Failure:
        done: dict[str, Any] = {}
        name = ""
        try:
            with transaction(store, entities) as own:
                for name, step in self.steps:
                    done[name] = step(own, dict(done))
        except Exception as e:
            return Failure(name, e, done)
        return done
