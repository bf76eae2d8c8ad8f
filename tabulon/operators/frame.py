"""Relation: a Spark DataFrame with a schema, row positions, a cursor and interchange."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Row as SparkRow
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import display as show
from ..cursor import Cursor
from ..row import Row
from ..schema import RelationSchema
from ..types import from_spark
from .group import GroupBy
from .position import POSITION, number_rows, read_with_position, renumber_rows

TAKE_LITERALS = 1_000


class Relation:
    """A relation. Operators that ask for a position need one: from a Parquet file, driver rows or an order.

    Positions count the rows of this relation. Operators that drop rows keep the order but leave gaps; the next operator that
    asks for places numbers the rows anew (`dense`), in blocks of the positions they had.
    """

    def __init__(self, df: DataFrame, schema: RelationSchema | None = None, dense: bool = True):
        self.held = df
        self._schema = schema
        self._gapless = dense
        self._dense_form: Relation | None = None
        self.arraysize = 100
        self._cursor: Cursor | None = None

    # sources
    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str) -> Relation:
        return cls(read_with_position(spark, path))

    @classmethod
    def from_dicts(cls, spark: SparkSession, dictionaries: Iterable[dict], schema: RelationSchema | None = None) -> Relation:
        """Columns are the first one's keys; later rows lack them as null and lose others. Without rows a schema is needed."""
        rows = list(dictionaries)
        names = schema.column_names if schema else list(rows[0]) if rows else []
        return cls.from_rows(spark, [tuple(r.get(n) for n in names) for r in rows], schema or names)

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Iterable[Sequence], schema: RelationSchema | list[str]) -> Relation:
        rows = [(*r, i) for i, r in enumerate(rows)]
        if isinstance(schema, RelationSchema):
            kind: T.StructType | None = schema.spark
        else:
            kind = None if rows and schema else T.StructType([T.StructField(n, T.StringType()) for n in schema])
        if kind is not None:
            df = spark.createDataFrame(rows, T.StructType([*kind.fields, T.StructField(POSITION, T.LongType(), False)]))
        else:
            empty = [n for k, n in enumerate(schema) if all(r[k] is None for r in rows)]
            df = spark.createDataFrame([SparkRow(*r) for r in rows], [*schema, POSITION], samplingRatio=1.0) if not empty else _with_void(spark, rows, schema, empty)
        return cls(df, schema if isinstance(schema, RelationSchema) else None)

    @classmethod
    def from_arrow(cls, spark: SparkSession, tables: pa.Table | Iterable[pa.Table] | None, size: int | None = None) -> Relation:
        """One table or many of the first one's schema; size 0 or None takes all rows."""
        held = [tables] if isinstance(tables, pa.Table) else list(tables or [])
        if not held:
            return cls(spark.createDataFrame([], T.StructType([T.StructField(POSITION, T.LongType(), False)])))
        whole = pa.concat_tables([t.select(held[0].column_names).cast(held[0].schema) for t in held])
        whole = whole.slice(0, size) if size else whole
        safe = pa.table([_readable(c) for c in whole.columns], names=whole.column_names)
        safe = safe.append_column(POSITION, pa.array(np.arange(safe.num_rows), pa.int64())).combine_chunks()  # chunks of one extent in all columns
        df = spark.createDataFrame(safe)
        return cls(df.select(*(F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`") for f in df.schema.fields)))

    def ordered_by(self, *order: str | Column) -> Relation:
        """The same rows with positions by an order."""
        return self._with(number_rows(self.spark, *order), self._schema, True)

    # plain access
    @property
    def has_position(self) -> bool:
        return POSITION in self.held.columns

    @property
    def spark(self) -> DataFrame:
        """The Spark DataFrame without the position: joins, windows, streams and writers start from it."""
        return self.held.drop(POSITION)

    @property
    def schema(self) -> RelationSchema:
        return self._schema or RelationSchema.from_spark(self.spark.schema)

    @property
    def column_names(self) -> tuple[str, ...]:
        return tuple(self.spark.columns)

    @property
    def columncount(self) -> int:
        return len(self.column_names)

    @property
    def rowcount(self) -> int:
        return self.held.count()

    @property
    def shape(self) -> tuple[int, int]:
        return self.rowcount, self.columncount

    def __len__(self) -> int:
        return self.rowcount

    def __iter__(self) -> Iterator[tuple]:
        return (tuple(r) for r in self._sorted().toLocalIterator(prefetchPartitions=True))

    def _with(self, df: DataFrame, schema: RelationSchema | None = None, dense: bool = False) -> Relation:
        return Relation(df, schema, dense)

    def dense(self) -> Relation:
        """The same rows with positions counted from 0 without gaps."""
        self._index()
        if self._gapless:
            return self
        if self._dense_form is None:
            self._dense_form = self._with(renumber_rows(self.held.withColumnRenamed(POSITION, "_was"), "_was"), self._schema, True)
        return self._dense_form

    def _sorted(self) -> DataFrame:
        return self.held.orderBy(POSITION).drop(POSITION) if self.has_position else self.held

    def _index(self) -> Column:
        if not self.has_position:
            raise ValueError("this needs row positions: use ordered_by")
        return F.col(POSITION)

    # projection and predicates
    def select(self, attributes: str | Sequence[str]) -> Relation:
        names = [attributes] if isinstance(attributes, str) else list(attributes)
        lost = [n for n in names if n not in self.column_names]
        if lost:
            raise ValueError(f"no such columns: {', '.join(lost)}")
        keep = [POSITION] if self.has_position else []
        return self._with(self.held.select(*(F.col(f"`{n}`") for n in names), *keep), dense=self._gapless)

    def query(self, predicate: Column | str | Callable[[SparkRow], bool]) -> Relation:
        """Rows for which a Column, SQL text or, slowly, a Python function of the row holds."""
        if callable(predicate) and not isinstance(predicate, Column):
            test = F.udf(lambda row: bool(predicate(row)), T.BooleanType())
            return self._with(self.held.where(test(F.struct(*(F.col(f"`{n}`") for n in self.column_names)))), self._schema)
        return self._with(self.held.where(predicate), self._schema)

    def filter(self, mask: Column | Iterable[bool]) -> Relation:
        """Rows where the mask is true: a Column, or values by position; rows beyond a short mask go."""
        if isinstance(mask, Column):
            return self._with(self.held.where(mask), self._schema)
        return self.take([i for i, keep in enumerate(mask) if keep])

    def take(self, indexes: Iterable[int]) -> Relation:
        """Rows at these places, in the relation's order; repeats and places that don't exist are ignored."""
        wanted = sorted({i for i in indexes if i >= 0})
        own = self.dense()
        if len(wanted) <= TAKE_LITERALS:
            return self._with(own.held.where(own._index().isin(wanted)), self._schema)
        ids = own.held.sparkSession.createDataFrame(pa.table({POSITION: pa.array(wanted, pa.int64())}))
        return self._with(own.held.join(ids, POSITION, "left_semi").select(*own.held.columns), self._schema)

    def head(self, size: int = 5) -> Relation:
        return self._with(self.held.orderBy(self._index()).limit(size), self._schema)

    def tail(self, size: int = 5) -> Relation:
        """The last rows, in order."""
        return self._with(self.held.orderBy(self._index().desc()).limit(size).orderBy(POSITION), self._schema)

    def slice(self, offset: int = 0, length: int | None = None) -> Relation:
        """Rows from an offset, counted from the end if negative; at most `length`. A filter on positions: no row is sorted or moved."""
        own = self.dense()
        if length == 0:
            return self._with(own.held.limit(0), self._schema, True)
        first = max(0, own.rowcount + offset) if offset < 0 else offset
        found = own.held.where(own._index() >= first) if first else own.held
        if length is not None:
            found = found.where(F.col(POSITION) < first + length)
        return self._with(found.withColumn(POSITION, F.col(POSITION) - first) if first else found, self._schema, True)

    def row(self, i: int) -> tuple:
        """The row at a place, counted from the end if negative."""
        own = self.dense()
        place = own.rowcount + i if i < 0 else i
        found = own.held.where(own._index() == place).drop(POSITION).first() if place >= 0 else None
        if found is None:
            raise IndexError("no such row")
        return tuple(found)

    def collect(self, columns: str | int | Sequence[str | int], limit: int | None = None) -> np.ndarray:
        """Values of one column as an array, or of many as one array each; a negative limit takes all."""
        many = [columns] if isinstance(columns, (str, int)) else list(columns)
        names = []
        for c in many:
            if isinstance(c, int):
                if not 0 <= c < self.columncount:
                    raise IndexError("no such column")
                c = self.column_names[c]
            names.append(c)
        df = self.select(names)._sorted()
        table = (df.limit(limit) if limit is not None and limit >= 0 else df).toArrow()
        arrays = []
        for k in range(len(names)):
            values = np.empty(table.num_rows, object)
            values[:] = table.column(k).to_pylist()
            arrays.append(values)
        return arrays[0] if isinstance(columns, (str, int)) else np.array(arrays, dtype=object)

    def __getitem__(self, columns: str | int | Sequence[str | int]) -> np.ndarray:
        return self.collect(columns)

    # sets
    def distinct(self, keep_first: bool = True) -> Relation:
        """Distinct rows in the order in which each first stands, at the place of the first; without positions or keep_first in any order."""
        if not (keep_first and self.has_position):
            return self._with(self.spark.distinct(), self._schema)
        names = [F.col(f"`{n}`") for n in self.column_names]
        return self._with(self.held.groupBy(*names).agg(F.min(POSITION).alias(POSITION)), self._schema)

    def __add__(self, other: Relation) -> Relation:
        """All rows of both, this one's first; names and types must be equal. Positions go on where both have them."""
        if not self.schema.same_shape(other.schema):
            raise ValueError("the schemas differ")
        if not (self.has_position and other.has_position):
            return self._with(self.spark.union(other.spark), self._schema)
        one, two = self.dense(), other.dense()
        names = [f"`{n}`" for n in self.column_names]
        rest = two.held.select(*(f"`{n}`" for n in two.column_names), (F.col(POSITION) + one.rowcount).alias(POSITION))
        return self._with(one.held.select(*names, POSITION).union(rest), self._schema, True)

    def to_batches(self, batch_size: int = 1_000) -> Iterator[Relation]:
        """Relations of consecutive rows."""
        own = self.dense()
        for start in range(0, own.rowcount, batch_size):
            yield own.slice(start, batch_size)

    def batch_ids(self, batch_size: int = 1_000) -> DataFrame:
        """All rows with batch_id: batches without a loop on the driver."""
        own = self.dense()
        return own.held.withColumn("batch_id", F.floor(own._index() / batch_size).cast("long"))

    def group_by(self, columns: str | Iterable[str]) -> GroupBy:
        return GroupBy(self.spark, columns)

    def materialize(self) -> Relation:
        """Keeps the rows in memory or on disk once they are computed."""
        self.held = self.held.persist()
        return self

    # out
    def arrow(self, size: int | None = None) -> pa.Table:
        df = self._sorted()
        return (df.limit(size) if size is not None and size >= 0 else df).toArrow()

    def pandas(self, size: int | None = None):
        return self.arrow(size).to_pandas()

    def polars(self, size: int | None = None):
        try:
            import polars
        except ImportError as e:
            from ..schema import MissingDependencyError

            raise MissingDependencyError("polars isn't installed") from e
        return polars.from_arrow(self.arrow(size))

    @property
    def description(self) -> list[tuple]:
        out = []
        for f in self.spark.schema.fields:
            t = from_spark(f.dataType)
            out.append((f.name, str(t), None, None, t.precision, t.scale, f.nullable))
        return out

    def nbytes(self) -> int:
        """Bytes of all rows as JSON text."""
        return self.spark.agg(F.sum(F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})))).first()[0] or 0

    def fingerprint(self) -> DataFrame:
        """h and n: a hash of 60 bits that doesn't depend on order, with the row count; a value counts with its length, so columns can't run together."""
        cols = [F.col(f"`{n}`").cast("string") for n in self.column_names]
        text = F.concat(*(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cols))
        return self.spark.agg(F.bit_xor(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")).alias("h"), F.count("*").alias("n"))

    # cursor
    @property
    def cursor(self) -> Cursor:
        if self._cursor is None:
            self._cursor = Cursor(self._sorted(), self.arraysize)
        return self._cursor

    def fetchone(self) -> tuple | None:
        return self.cursor.fetchone()

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        return self.cursor.fetchmany(size or self.arraysize)

    def fetchall(self) -> list[tuple]:
        return self.cursor.fetchall()

    # display
    def _ends(self, limit: int) -> tuple[list[tuple], bool]:
        """The first and last `limit` rows, all if there are few."""
        if not self.has_position:
            got = [tuple(r) for r in self.spark.take(2 * limit)]
            return got, False
        first = [tuple(r) for r in self._sorted().limit(2 * limit + 1).collect()]
        if len(first) <= 2 * limit:
            return first, False
        last = [tuple(r) for r in self.held.orderBy(F.col(POSITION).desc()).limit(limit).drop(POSITION).collect()]
        return first[:limit] + last[::-1], True

    def display(self, limit: int = 5, display_width: bool | int = True, max_column_width: int = 30, colorize: bool = False, show_types: bool = True) -> str:
        rows, _ = self._ends(limit)
        return show.table(self.schema, rows, limit, display_width, max_column_width, colorize, show_types)

    def __str__(self) -> str:
        return self.display(limit=10)

    def markdown(self, limit: int = 5, max_column_width: int = 30) -> str:
        rows = [tuple(r) for r in self._sorted().limit(limit).collect()]
        return show.markdown(self.schema, rows, max_column_width)

    def _repr_html_(self) -> str:
        rows, _ = self._ends(10)
        return show.html(self.schema, rows)


class RelationBuilder:
    """Records appended one at a time on the driver, validated, and flushed as a relation."""

    def __init__(self, spark: SparkSession, schema: RelationSchema | list[str]):
        self.session, self.rows = spark, []
        self.schema = schema if isinstance(schema, RelationSchema) else None
        self.names = schema.column_names if self.schema else list(schema)
        self._json = {c.name for c in self.schema if c.type.name == "JSONB"} if self.schema else set()
        self._kinds = [(c.name, c.type.python_type, c.nullable) for c in self.schema] if self.schema else []
        self._size, self._counted = 0, 0
        self._row = Row.make(list(self.names))

    @property
    def nbytes(self) -> int:
        """Bytes of the rows' frames; only those appended since it was last asked for are measured."""
        self._size += sum(self._row(r).nbytes for r in self.rows[self._counted :])
        self._counted = len(self.rows)
        return self._size

    def append(self, record: dict) -> None:
        if self._json:
            import json

            record = {k: json.dumps(v).encode() if k in self._json and isinstance(v, (dict, list, tuple, set)) else v for k, v in record.items()}
        if self.schema:
            ok = len(record) == len(self._kinds)
            for name, kind, nullable in self._kinds if ok else ():
                v = record.get(name, self)
                if not (isinstance(v, kind) or v is None and nullable):
                    ok = False
                    break
            if not ok:
                self.schema.validate(record)
        row = tuple(map(record.get, self.names))
        self.rows.append(row)

    def __len__(self) -> int:
        return len(self.rows)

    def relation(self) -> Relation:
        return Relation.from_rows(self.session, self.rows, self.schema or self.names)


def _with_void(spark: SparkSession, rows: list[tuple], names: list[str], empty: list[str]) -> DataFrame:
    """Rows some of whose columns hold nulls only; these columns become text."""
    full = [k for k, n in enumerate(names) if n not in empty]
    df = spark.createDataFrame([tuple(r[k] for k in full) + (r[-1],) for r in rows], [*(names[k] for k in full), POSITION])
    return df.withColumns({n: F.lit(None).cast("string") for n in empty}).select(*(f"`{n}`" for n in names), POSITION)


def _readable(c: pa.ChunkedArray) -> pa.ChunkedArray:
    """A column in a type that Spark takes."""
    t, k = c.type, pa.types
    if k.is_time32(t):
        return c.cast(pa.time64("us"))
    if k.is_date64(t):
        return c.cast(pa.date32())
    if k.is_float16(t):
        return c.cast(pa.float32())
    if k.is_uint64(t):
        return c.cast(pa.int64())
    if k.is_interval(t):
        return pa.chunked_array([pa.array([None if v is None else (v.months * 30 + v.days) * 86_400_000_000 + v.nanoseconds // 1000 for v in c.to_pylist()], pa.duration("us"))])
    return c
