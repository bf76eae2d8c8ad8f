"""The logical type system: a grammar for type names, Spark and Arrow mappings, and promotion."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

NAMES = ("BOOLEAN", "INTEGER", "DOUBLE", "DECIMAL", "VARCHAR", "BLOB", "DATE", "TIMESTAMP", "TIME", "INTERVAL", "ARRAY", "STRUCT", "JSONB", "VECTOR", "NULL")
NUMERIC, TEMPORAL = ("BOOLEAN", "INTEGER", "DOUBLE", "DECIMAL"), ("DATE", "TIME", "TIMESTAMP")
LARGE, COMPLEX = ("VARCHAR", "BLOB", "JSONB"), ("ARRAY", "STRUCT", "INTERVAL", "VECTOR", "JSONB")
PYTHON = {"BOOLEAN": bool, "INTEGER": int, "DOUBLE": float, "DECIMAL": Decimal, "VARCHAR": str, "BLOB": bytes, "DATE": dt.date, "TIMESTAMP": dt.datetime, "TIME": dt.time, "INTERVAL": dt.timedelta, "ARRAY": list, "STRUCT": dict, "JSONB": bytes, "VECTOR": list, "NULL": type(None)}
_NUMPY = {"BOOLEAN": "bool", "INTEGER": "int64", "DOUBLE": "float64", "DATE": "datetime64[D]", "TIMESTAMP": "datetime64[us]", "INTERVAL": "timedelta64[us]"}
_ALIASES = {"LIST": "ARRAY", "NUMERIC": "DECIMAL", "BSON": "JSONB", "STRING": "VARCHAR", "VARBINARY": "BLOB", "BIGINT": "INTEGER", "INT": "INTEGER", "FLOAT": "DOUBLE", "BOOL": "BOOLEAN"}
_GRAMMAR = re.compile(r"(?P<name>[A-Z]+)\s*(?:\[(?P<length>\d+)\]|\((?P<p>\d+)\s*,\s*(?P<s>\d+)\)|<(?P<inner>.+)>)?")
_ABOUT = {"BOOLEAN": "true or false", "INTEGER": "64-bit signed integer", "DOUBLE": "64-bit float", "DECIMAL": "exact number", "VARCHAR": "UTF-8 text", "BLOB": "bytes", "DATE": "calendar day", "TIMESTAMP": "moment without a zone", "TIME": "time of day", "INTERVAL": "span of days and time", "ARRAY": "list of one type", "STRUCT": "named fields", "JSONB": "JSON as bytes", "VECTOR": "list of doubles", "NULL": "no value"}


@dataclass(frozen=True)
class LogicalType:
    """A type with its parameters; values never change, so nothing leaks between columns."""

    name: str
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    element: LogicalType | None = None
    fields: tuple[tuple[str, LogicalType], ...] = ()

    def __str__(self) -> str:
        if self.name == "DECIMAL" and self.precision is not None:
            return f"DECIMAL({self.precision},{self.scale})"
        if self.name == "ARRAY" and self.element:
            return f"ARRAY<{self.element}>"
        return f"{self.name}[{self.length}]" if self.length is not None else self.name

    @property
    def is_numeric(self) -> bool:
        return self.name in NUMERIC

    @property
    def is_temporal(self) -> bool:
        return self.name in TEMPORAL

    @property
    def is_large_object(self) -> bool:
        return self.name in LARGE

    @property
    def is_complex(self) -> bool:
        return self.name in COMPLEX

    @property
    def python_type(self) -> type:
        return PYTHON[self.name]

    @property
    def numpy_dtype(self) -> np.dtype:
        return np.dtype(_NUMPY.get(self.name, "object"))

    @property
    def metadata(self) -> dict:
        return {"name": self.name, "about": _ABOUT[self.name], "python": self.python_type.__name__, "spark": self.spark.simpleString()}

    @property
    def spark(self) -> T.DataType:
        simple = {"BOOLEAN": T.BooleanType(), "INTEGER": T.LongType(), "DOUBLE": T.DoubleType(), "VARCHAR": T.StringType(), "BLOB": T.BinaryType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "INTERVAL": T.DayTimeIntervalType(), "JSONB": T.BinaryType(), "VECTOR": T.ArrayType(T.DoubleType()), "NULL": T.NullType()}
        if self.name == "DECIMAL":
            return T.DecimalType(self.precision or 28, 21 if self.scale is None else self.scale)
        if self.name == "ARRAY":
            return T.ArrayType(self.element.spark if self.element else T.StringType())
        if self.name == "STRUCT":
            return T.StructType([T.StructField(n, t.spark) for n, t in self.fields]) if self.fields else T.BinaryType()
        if self.name == "TIME":
            return T.TimeType() if hasattr(T, "TimeType") else T.StringType()
        return simple[self.name]

    @property
    def arrow(self) -> pa.DataType:
        simple = {"BOOLEAN": pa.bool_(), "INTEGER": pa.int64(), "DOUBLE": pa.float64(), "VARCHAR": pa.string(), "BLOB": pa.binary(), "DATE": pa.date32(), "TIMESTAMP": pa.timestamp("us"), "TIME": pa.time64("us"), "INTERVAL": pa.duration("us"), "JSONB": pa.binary(), "VECTOR": pa.list_(pa.float64()), "NULL": pa.null()}
        if self.name == "DECIMAL":
            return pa.decimal128(self.precision or 28, 21 if self.scale is None else self.scale)
        if self.name == "ARRAY":
            return pa.list_(self.element.arrow if self.element else pa.string())
        if self.name == "STRUCT":
            return pa.struct([(n, t.arrow) for n, t in self.fields]) if self.fields else pa.binary()
        return simple[self.name]


def parse_type(text: str) -> LogicalType:
    """A type from its name: VARCHAR[12], DECIMAL(10,2), ARRAY<INTEGER>, VECTOR[64] and the like; ValueError otherwise."""
    if not text or not text.strip():
        raise ValueError("a type name is needed")
    m = _GRAMMAR.fullmatch(text.strip().upper())
    if not m:
        raise ValueError(f"no such type: {text}")
    name = _ALIASES.get(m["name"], m["name"])
    if name not in NAMES:
        raise ValueError(f"no such type: {text}; the types are {', '.join(NAMES)}")
    if m["p"] is not None:
        p, s = int(m["p"]), int(m["s"])
        if name != "DECIMAL" or p > 38 or s > p:
            raise ValueError(f"precision and scale don't fit: {text}")
        return LogicalType(name, precision=p, scale=s)
    if m["inner"] is not None:
        if name != "ARRAY":
            raise ValueError(f"only arrays have elements: {text}")
        inner = parse_type(m["inner"])
        if inner.is_complex or inner.name == "NULL":
            raise ValueError(f"an array holds scalars: {text}")
        return LogicalType(name, element=inner)
    if m["length"] is not None:
        if name not in ("VARCHAR", "BLOB", "VECTOR"):
            raise ValueError(f"this type has no length: {text}")
        return LogicalType(name, length=int(m["length"]))
    return LogicalType(name, element=LogicalType("VARCHAR")) if name == "ARRAY" else LogicalType(name)


def from_spark(t: T.DataType) -> LogicalType:
    """The logical type of a Spark type."""
    for kinds, name in (((T.BooleanType,), "BOOLEAN"), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "INTEGER"), ((T.FloatType, T.DoubleType), "DOUBLE"), ((T.BinaryType,), "BLOB"), ((T.DateType,), "DATE"), ((T.TimestampType, T.TimestampNTZType), "TIMESTAMP"), ((T.DayTimeIntervalType, T.YearMonthIntervalType), "INTERVAL"), ((T.NullType,), "NULL")):
        if isinstance(t, kinds):
            return LogicalType(name)
    if isinstance(t, T.DecimalType):
        return LogicalType("DECIMAL", precision=t.precision, scale=t.scale)
    if isinstance(t, T.ArrayType):
        return LogicalType("ARRAY", element=from_spark(t.elementType))
    if isinstance(t, T.StructType):
        return LogicalType("STRUCT", fields=tuple((f.name, from_spark(f.dataType)) for f in t.fields))
    if isinstance(t, T.MapType):
        return LogicalType("STRUCT")
    return LogicalType("TIME") if type(t).__name__ == "TimeType" else LogicalType("VARCHAR")


def from_arrow(t: pa.DataType, mappable_as_binary: bool = False) -> LogicalType:
    """The logical type of an Arrow type; ValueError for dictionaries, fixed-size binaries and views."""
    k = pa.types
    for test, name in ((k.is_boolean, "BOOLEAN"), (k.is_integer, "INTEGER"), (k.is_floating, "DOUBLE"), (k.is_string, "VARCHAR"), (k.is_large_string, "VARCHAR"), (k.is_binary, "BLOB"), (k.is_large_binary, "BLOB"), (k.is_date, "DATE"), (k.is_timestamp, "TIMESTAMP"), (k.is_time, "TIME"), (k.is_duration, "INTERVAL"), (k.is_interval, "INTERVAL"), (k.is_null, "NULL")):
        if test(t):
            return LogicalType(name)
    if k.is_decimal(t):
        return LogicalType("DECIMAL", precision=t.precision, scale=t.scale)
    if k.is_list(t) or k.is_large_list(t) or k.is_fixed_size_list(t):
        return LogicalType("ARRAY", element=from_arrow(t.value_type))
    if k.is_struct(t) or k.is_map(t):
        if mappable_as_binary:
            return LogicalType("BLOB")
        return LogicalType("STRUCT", fields=tuple((f.name, from_arrow(f.type)) for f in t) if k.is_struct(t) else ())
    raise ValueError(f"no logical type for {t}")


def promote(types: list[LogicalType | str]) -> LogicalType:
    """The smallest type that holds all: within numbers or times the wider, else text, or bytes where any is bytes."""
    names = {t if isinstance(t, str) else t.name for t in types} - {"NULL"}
    if not names:
        return LogicalType("NULL")
    if len(names) == 1:
        return next((t for t in types if not isinstance(t, str) and t.name in names), LogicalType(next(iter(names))))
    for ladder in (("BOOLEAN", "INTEGER", "DOUBLE", "DECIMAL"), ("DATE", "TIMESTAMP"), ("VECTOR", "ARRAY")):
        if names <= set(ladder):
            return LogicalType(max(names, key=ladder.index))
    if names == {"BLOB", "VARCHAR"}:
        return LogicalType("VARCHAR")
    if names <= {"BLOB", "STRUCT", "JSONB", "VARCHAR"} or "BLOB" in names:
        return LogicalType("BLOB")
    return LogicalType("VARCHAR")
