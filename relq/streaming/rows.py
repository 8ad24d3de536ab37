"""A lease on the rows of one query."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row

from ..errors import RelqError


class RowStream:
    """Iterates rows while the driver holds one partition, the next one prefetched. Closed, it raises 4110."""

    def __init__(self, df: DataFrame) -> None:
        self._df, self._rows, self._closed = df, None, False

    def __iter__(self) -> Iterator[Row]:
        return self

    def __next__(self) -> Row:
        if self._closed:
            raise RelqError(4110)
        if self._rows is None:
            self._rows = self._df.toLocalIterator(prefetchPartitions=True)
        return next(self._rows)

    def close(self) -> None:
        self._closed, self._rows = True, None
