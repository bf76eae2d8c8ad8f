"""Columns and schemas: construction, algebra, validation, persistence and statistics."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import LogicalType, from_arrow, from_spark, parse_type


class DataError(ValueError):
    """A record that can't be taken."""


class DataValidationError(DataError):
    """Faults by column."""

    def __init__(self, errors: dict[str, str]):
        self.errors = errors
        super().__init__("; ".join(f"{k}: {v}" for k, v in errors.items()))


class ExcessColumnsInDataError(DataError):
    """Fields that no column has."""

    def __init__(self, columns: list[str]):
        self.columns = columns
        super().__init__(f"unknown fields: {', '.join(columns)}")


class ColumnDefinitionError(ValueError):
    """A column without what it needs."""


class MissingDependencyError(ImportError):
    """A library that isn't installed."""


@dataclass(frozen=True)
class FlatColumn:
    """The definition of a column."""

    name: str
    type: LogicalType | str = "VARCHAR"
    default: object = None
    description: str | None = None
    disposition: str | None = None
    aliases: tuple[str, ...] = ()
    nullable: bool = True
    expectations: tuple = ()
    identity: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    origin: tuple[str, ...] = ()
    lowest_value: object = None
    highest_value: object = None
    null_count: int | None = None

    def __post_init__(self) -> None:
        if not self.name:
            raise ColumnDefinitionError("a column needs a name")
        if isinstance(self.type, str):
            object.__setattr__(self, "type", parse_type(self.type))
        if self.type.name == "DECIMAL" and self.type.precision is None:
            object.__setattr__(self, "type", LogicalType("DECIMAL", precision=28, scale=21))
        object.__setattr__(self, "aliases", tuple(self.aliases or ()))

    @classmethod
    def of(cls, **settings: object) -> FlatColumn:
        """A column from settings; unknown ones are ignored."""
        if not settings.get("name"):
            raise ColumnDefinitionError("a column needs a name")
        return cls(**{k: v for k, v in settings.items() if k in cls.__dataclass_fields__})

    @property
    def all_names(self) -> list[str]:
        return [*self.aliases, self.name]

    @property
    def spark_field(self) -> T.StructField:
        return T.StructField(self.name, self.type.spark, self.nullable, {"type": str(self.type), "identity": self.identity, "aliases": list(self.aliases)})

    @property
    def arrow_field(self) -> pa.Field:
        return pa.field(self.name, self.type.arrow, self.nullable)

    @classmethod
    def from_arrow(cls, f: pa.Field, mappable_as_binary: bool = False) -> FlatColumn:
        return cls(f.name, from_arrow(f.type, mappable_as_binary), nullable=f.nullable)

    @classmethod
    def from_spark(cls, f: T.StructField) -> FlatColumn:
        m = f.metadata or {}
        kind = parse_type(m["type"]) if "type" in m and "STRUCT" not in m["type"] else from_spark(f.dataType)
        return cls(f.name, kind, nullable=f.nullable, aliases=tuple(m.get("aliases", ())), **({"identity": m["identity"]} if "identity" in m else {}))

    def to_flatcolumn(self) -> FlatColumn:
        """A plain column without disposition and expectations."""
        return replace(self, disposition=None, expectations=())

    def materialize(self) -> None:
        raise TypeError("a flat column holds no values")

    def to_dict(self) -> dict:
        out = {k: getattr(self, k) for k in ("name", "default", "description", "disposition", "nullable", "identity", "lowest_value", "highest_value", "null_count")}
        return out | {"type": str(self.type), "aliases": list(self.aliases), "origin": list(self.origin)}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), default=str)

    @classmethod
    def from_json(cls, text: str | bytes) -> FlatColumn:
        return cls.of(**json.loads(text))


@dataclass
class RelationSchema:
    """A named, ordered list of columns."""

    name: str
    columns: list[FlatColumn] = field(default_factory=list)
    aliases: list[str] = field(default_factory=list)
    primary_key: str | None = None
    row_count_metric: int | None = None
    row_count_estimate: int | None = None
    data_size_metric: int | None = None
    data_size_estimate: int | None = None

    def __iter__(self) -> Iterator[FlatColumn]:
        return iter(self.columns)

    def __add__(self, other: RelationSchema) -> RelationSchema:
        """Columns of both, each identity once."""
        known = {c.identity for c in self.columns}
        fresh = []
        for c in other.columns:
            if c.identity not in known:
                known.add(c.identity)
                fresh.append(c)
        return RelationSchema(self.name, self.columns + fresh, list(dict.fromkeys(self.aliases + other.aliases)), self.primary_key)

    @property
    def num_columns(self) -> int:
        return len(self.columns)

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    def all_column_names(self) -> list[str]:
        return [n for c in self.columns for n in c.all_names]

    def find_column(self, name: str, case_insensitive: bool = False) -> FlatColumn | None:
        same = (lambda a: a.lower() == name.lower()) if case_insensitive else (lambda a: a == name)
        return next((c for c in self.columns if any(map(same, c.all_names))), None)

    def column(self, key: int | str) -> FlatColumn | None:
        return self.columns[key] if isinstance(key, int) else self.find_column(key)

    def pop_column(self, name: str) -> FlatColumn | None:
        found = self.find_column(name)
        if found:
            self.columns.remove(found)
        return found

    @property
    def spark(self) -> T.StructType:
        return T.StructType([c.spark_field for c in self.columns])

    def arrow(self, use_identities: bool = False) -> pa.Schema:
        return pa.schema([c.arrow_field.with_name(c.identity) if use_identities else c.arrow_field for c in self.columns])

    @classmethod
    def from_arrow(cls, schema: pa.Schema, name: str = "arrow") -> RelationSchema:
        return cls(name, [FlatColumn.from_arrow(f) for f in schema])

    @classmethod
    def from_spark(cls, schema: T.StructType, name: str = "relation") -> RelationSchema:
        return cls(name, [FlatColumn.from_spark(f) for f in schema.fields])

    def same_shape(self, other: RelationSchema) -> bool:
        return [(c.name, c.type) for c in self.columns] == [(c.name, c.type) for c in other.columns]

    def to_dict(self) -> dict:
        return {"name": self.name, "aliases": self.aliases, "primary_key": self.primary_key, "columns": [c.to_dict() for c in self.columns]}

    @classmethod
    def from_dict(cls, d: Mapping) -> RelationSchema:
        return cls(d["name"], [FlatColumn(c) if isinstance(c, str) else FlatColumn.of(**c) for c in d["columns"]], list(d.get("aliases") or []), d.get("primary_key"))

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), default=str)

    def validate(self, record: Mapping) -> bool:
        """True, or an error: excess fields at once, all other faults together."""
        if not isinstance(record, Mapping):
            raise TypeError("a record is a mapping")
        excess = [k for k in record if self.find_column(k) is None]
        if excess:
            raise ExcessColumnsInDataError(excess)
        errors = {}
        for c in self.columns:
            if c.name not in record:
                errors[c.name] = "Column missing"
            elif record[c.name] is None:
                if not c.nullable:
                    errors[c.name] = "Column not Nullable"
            elif not isinstance(record[c.name], c.type.python_type):
                errors[c.name] = f"Wrong type, {type(record[c.name]).__name__} for {c.type}"
        if errors:
            raise DataValidationError(errors)
        return True

    def errors(self, rules: Mapping[str, Column] | None = None, given: T.StructType | None = None) -> Column:
        """An array of faults of a row, empty if there are none: nulls where none may be, and broken rules.

        With the frame's own schema also fields that are unknown or missing, and values of a type other than the column's.
        """
        held = {f.name: f for f in given.fields} if given is not None else None
        known = {n for c in self.columns for n in c.all_names}
        faults = [F.lit(f"{n}: Unknown field") for n in held or () if n not in known]
        for c in self.columns:
            if held is not None and c.name not in held:
                faults.append(F.lit(f"{c.name}: Column missing"))
                continue
            if not c.nullable:
                faults.append(F.when(F.col(f"`{c.name}`").isNull(), F.lit(f"{c.name}: Column not Nullable")))
            if held is not None and (kind := from_spark(held[c.name].dataType)).name not in (c.type.name, "NULL") and not _stands_for(kind, c.type):
                faults.append(F.when(F.col(f"`{c.name}`").isNotNull(), F.lit(f"{c.name}: Wrong type, {kind} for {c.type}")))
        faults += [F.when(~F.coalesce(rule, F.lit(True)), F.lit(f"{name}: expectation not met")) for name, rule in (rules or {}).items()]
        return F.array_compact(F.array(*faults)) if faults else F.array().cast("array<string>")

    def check(self, df: DataFrame, rules: Mapping[str, Column] | None = None) -> DataFrame:
        """The rows, stopping at the first with a fault; unknown fields stop it at once."""
        known = {n for c in self.columns for n in c.all_names}
        excess = [n for n in df.columns if n not in known]
        if excess:
            raise ExcessColumnsInDataError(excess)
        bad = self.errors(rules, df.schema)
        return df.where(F.when(F.size(bad) > 0, F.raise_error(F.array_join(bad, "; "))).otherwise(F.lit(True)).cast("boolean"))

    def with_defaults(self, df: DataFrame) -> DataFrame:
        """Nulls replaced by the columns' defaults."""
        return df.fillna({c.name: c.default for c in self.columns if c.default is not None})


def _stands_for(kind: LogicalType, wanted: LogicalType) -> bool:
    """Whether Spark holds values of the wanted type as this one."""
    return (wanted.name, kind.name) in {("JSONB", "BLOB"), ("VECTOR", "ARRAY"), ("STRUCT", "BLOB"), ("TIME", "VARCHAR")}


def statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """lowest_value, highest_value and null_count of each column, as text, in one pass."""
    names = columns or df.columns
    found = df.agg(*(f(F.col(f"`{n}`")).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("l", F.min), ("h", F.max), ("c", F.count))), F.count("*").alias("rows"))
    rows = [F.struct(F.lit(n).alias("name"), F.col(f"l{i}").cast("string").alias("lowest_value"), F.col(f"h{i}").cast("string").alias("highest_value"), (F.col("rows") - F.col(f"c{i}")).alias("null_count")) for i, n in enumerate(names)]
    return found.select(F.inline(F.array(*rows)))
