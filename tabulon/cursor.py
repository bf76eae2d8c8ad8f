"""A forward cursor over a DataFrame's rows."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import DataFrame


class Cursor:
    """fetchone, fetchmany and fetchall share one position; rows stream from the executors."""

    def __init__(self, df: DataFrame, arraysize: int = 100):
        self.df, self.arraysize = df, arraysize
        self._rows = None

    def _at(self):
        if self._rows is None:
            self._rows = (tuple(r) for r in self.df.toLocalIterator(prefetchPartitions=True))
        return self._rows

    def fetchone(self) -> tuple | None:
        return next(self._at(), None)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        return list(islice(self._at(), size or self.arraysize))

    def fetchall(self) -> list[tuple]:
        return list(self._at())
