"""Running queries: rows, one, count, exists, page, stream, explain."""

from __future__ import annotations

import contextlib
import contextvars
import datetime as dt
import logging
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from ..errors import RelqError, StatementTimeout
from ..plans.compiler import Compiler
from ..sources.entity import Catalog, Entity
from ..streaming.rows import RowStream
from .query import Combined, Query

log = logging.getLogger("relq")
_ambient: contextvars.ContextVar[Repo | None] = contextvars.ContextVar("relq_repo", default=None)


@dataclass(frozen=True)
class PageRequest:
    """page from 1, per_page from 1 to 100: other numbers are moved to the nearest allowed one."""

    page: int = 1
    per_page: int = 20

    def __post_init__(self) -> None:
        object.__setattr__(self, "page", max(1, self.page))
        object.__setattr__(self, "per_page", min(100, max(1, self.per_page)))

    @property
    def offset(self) -> int:
        return min((self.page - 1) * self.per_page, (1 << 31) - 1)


@dataclass(frozen=True)
class Page:
    items: list
    total: int
    request: PageRequest

    @property
    def page_count(self) -> int:
        return -(-self.total // self.request.per_page)

    @property
    def is_first(self) -> bool:
        return self.request.page == 1

    @property
    def is_last(self) -> bool:
        return self.request.page >= self.page_count

    @property
    def has_next(self) -> bool:
        return not self.is_last

    @property
    def has_previous(self) -> bool:
        return not self.is_first

    @property
    def first_index(self) -> int | None:
        return self.request.offset + 1 if self.items else None

    @property
    def last_index(self) -> int | None:
        return self.request.offset + len(self.items) if self.items else None


def loaded(row: Row, name: str) -> Any:
    """An association of a row; error 4109 where the query did not preload it."""
    if name not in row.__fields__:
        raise RelqError(4109, name)
    return row[name]


@dataclass
class Diagnostics:
    """Queries slower than slow_seconds and statements repeated repeats times in a scope are logged and kept."""

    slow_seconds: float = 1.0
    repeats: int = 10

    def __post_init__(self) -> None:
        self.slow: list[tuple[str, float]] = []
        self.repeated: list[str] = []
        self.durations: dict[str, list[float]] = {}
        self._seen: Counter = Counter()

    @contextlib.contextmanager
    def timed(self, operation: str, df: DataFrame | None) -> Iterator[None]:
        began = time.monotonic()
        yield
        took = time.monotonic() - began
        self.durations.setdefault(operation, []).append(took)
        if took > self.slow_seconds:
            self.slow.append((operation, took))
            log.warning("slow %s: %.2f s", operation, took)
        if df is not None:
            key = df.semanticHash()
            self._seen[key] += 1
            if self._seen[key] == self.repeats:
                self.repeated.append(operation)
                log.warning("one statement ran %d times in this scope: load it once, or preload", self.repeats)


@contextlib.contextmanager
def limited(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """Cancels the jobs that this thread starts in the block once it took so many seconds, and raises StatementTimeout."""
    if seconds is None:
        yield
        return
    sc, tag, done, late = spark.sparkContext, f"relq-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        wait = seconds
        while not done.wait(wait):  # again and again: a statement may start further jobs
            late.set()
            sc.cancelJobsWithTag(tag)
            wait = 0.1

    sc.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise StatementTimeout(seconds) from e
        raise
    finally:
        done.set()
        watcher.join()
        sc.removeJobTag(tag)
    if late.is_set():
        raise StatementTimeout(seconds)


class Repo:
    """A catalog to run queries on. Reads see the catalog as it is; a transaction gives a repo of its own.

    A read that takes longer than timeout, in seconds, is cancelled with StatementTimeout.
    """

    def __init__(self, catalog: Catalog, diagnostics: Diagnostics | None = None, now: dt.datetime | None = None, timeout: float | None = None) -> None:
        self.catalog, self.diagnostics, self.now, self.timeout = catalog, diagnostics or Diagnostics(), now, timeout

    @contextlib.contextmanager
    def _statement(self, operation: str, df: DataFrame) -> Iterator[None]:
        with self.diagnostics.timed(operation, df), limited(self.catalog.spark, self.timeout):
            yield

    # the ambient repository
    @contextlib.contextmanager
    def ambient(self) -> Iterator[Repo]:
        token = _ambient.set(self)
        try:
            yield self
        finally:
            _ambient.reset(token)

    @staticmethod
    def require() -> Repo:
        found = _ambient.get()
        if found is None:
            raise RelqError(4102)
        return found

    # reading
    def frame(self, q: Any) -> DataFrame:
        """The query as a lazy DataFrame."""
        q = q.query() if isinstance(q, type) and issubclass(q, Entity) else q
        return Compiler(self.catalog, self.now).query(q)

    def all(self, q: Any) -> list[Row]:
        df = self.frame(q)
        with self._statement("all", df):
            return df.collect()

    def into(self, q: Any, kind: Callable[..., Any]) -> list[Any]:
        """The rows as objects made from their labels, for instance of a dataclass."""
        return [kind(**r.asDict(recursive=True)) for r in self.all(q)]

    def one(self, q: Any) -> Row | None:
        """The only row, or None; more than one is error 4103. An explicit limit stays."""
        df = self.frame(q if getattr(q, "limit_", None) is not None else q.limit(2))
        with self._statement("one", df):
            rows = df.collect()
        if len(rows) > 1:
            raise RelqError(4103)
        return rows[0] if rows else None

    def _unsliced(self, q: Any) -> DataFrame:
        """The rows that count: order and slice ignored, grouping and distinct not."""
        if isinstance(q, Combined):
            return self.frame(replace(q, order=(), limit_=None, offset_=0))
        order = q.order if isinstance(q.distinct_, tuple) else ()
        return self.frame(replace(q, order=order, limit_=None, offset_=0, preloads=(), lock=None))

    def count(self, q: Any) -> int:
        df = self._unsliced(q)
        with self._statement("count", df):
            return df.count()

    def exists(self, q: Any) -> bool:
        df = self._unsliced(q)
        with self._statement("exists", df):
            return not df.isEmpty()

    def page(self, q: Query, request: PageRequest) -> Page:
        """A slice and the total. A query without an order is ordered by the primary key."""
        if not q.order and not q.grouped and hasattr(q.source, "primary_key"):
            q = q.order_by(lambda c, *_: [getattr(c, f.name) for f in q.source.__fields__.values() if f.key])
        return Page(self.all(q.offset(request.offset).limit(request.per_page)), self.count(q), request)

    @contextlib.contextmanager
    def stream(self, q: Any) -> Iterator[RowStream]:
        """Rows one partition at a time; reading after the block is error 4110."""
        rows = RowStream(self.frame(q))
        try:
            yield rows
        finally:
            rows.close()

    def execute(self, text: str, **args: Any) -> DataFrame:
        """A raw statement with named parameters."""
        return self.catalog.spark.sql(text, args=args or None)

    def explain(self, q: Any, analyze: bool = False) -> str:
        """The physical plan; with analyze, after running it, so that the plan is the one that ran."""
        if isinstance(q, str):
            if analyze and q.lstrip().split(None, 1)[0].lower() not in ("select", "with", "values", "table"):
                raise RelqError(4115)
            df = self.catalog.spark.sql(q)
        else:
            df = self.frame(q)
        if analyze:
            df.write.format("noop").mode("overwrite").save()
        return df._jdf.queryExecution().explainString(self.catalog.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def debug_plan(self, q: Any) -> str:
        """The logical plan, unoptimised, for reading and tests."""
        return self.frame(q)._jdf.queryExecution().logical().toString()
