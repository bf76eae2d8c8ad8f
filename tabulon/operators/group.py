"""Grouped aggregation with the names FUNC(column), aggregates first and keys last."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES: dict[str, Callable[[Column], Column]] = {"MIN": F.min, "MAX": F.max, "SUM": F.sum, "AVG": F.avg, "COUNT": F.count}


class GroupBy:
    """A grouping; nothing runs until its result is used. A group whose values are all null stays, with null."""

    def __init__(self, df: DataFrame, columns: str | Iterable[str]):
        self.df = df
        self.keys = [columns] if isinstance(columns, str) else list(dict.fromkeys(columns))
        lost = [k for k in self.keys if k not in df.columns]
        if lost:
            raise ValueError(f"no such columns: {', '.join(lost)}")

    def aggregate(self, wanted: Iterable[tuple[str, str]] | tuple[str, str]) -> DataFrame:
        """The aggregates named by (function, column); a repeated one counts once; COUNT of * counts rows."""
        pairs = [wanted] if isinstance(wanted, tuple) and isinstance(wanted[0], str) else list(wanted)
        made: dict[str, Column] = {}
        for name, column in pairs:
            f = AGGREGATES.get(name.upper())
            if f is None:
                raise ValueError(f"no such aggregate: {name}; there are {', '.join(AGGREGATES)}")
            if column != "*" and column not in self.df.columns:
                raise ValueError(f"no such column: {column}")
            made[f"{name.upper()}({column})"] = F.count(F.lit(1)) if column == "*" else f(F.col(f"`{column}`"))
        out = self.df.groupBy(*(F.col(f"`{k}`") for k in self.keys)).agg(*(c.alias(n) for n, c in made.items()))
        return out.select(*(F.col(f"`{n}`") for n in [*made, *self.keys]))

    def _each(self, name: str, columns: str | Iterable[str]) -> DataFrame:
        return self.aggregate([(name, c) for c in ([columns] if isinstance(columns, str) else columns)])

    def min(self, columns: str | Iterable[str]) -> DataFrame:
        return self._each("MIN", columns)

    def max(self, columns: str | Iterable[str]) -> DataFrame:
        return self._each("MAX", columns)

    def sum(self, columns: str | Iterable[str]) -> DataFrame:
        return self._each("SUM", columns)

    def avg(self, columns: str | Iterable[str]) -> DataFrame:
        return self._each("AVG", columns)

    def count(self) -> DataFrame:
        return self.aggregate([("COUNT", "*")])

    def groups(self) -> DataFrame:
        """The distinct keys."""
        return self.df.select(*(F.col(f"`{k}`") for k in self.keys)).distinct()
