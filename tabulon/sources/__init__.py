"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.frame import Relation


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> Relation:
    """A relation from Parquet (with positions), ORC, CSV (with a header) or JSON lines. CSV and JSON need a schema to avoid a second pass."""
    if kind == "parquet":
        return Relation.from_parquet(spark, path)
    reader = spark.read.options(**({"header": "true"} if kind == "csv" else {}) | options)
    return Relation((reader.schema(schema) if schema else reader).format("json" if kind == "jsonl" else kind).load(path))


def write(relation: Relation | DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Writes Parquet, ORC, CSV (with a header) or JSON lines."""
    df = relation.spark if isinstance(relation, Relation) else relation
    w = df.write.mode(mode).format("json" if kind == "jsonl" else kind)
    w = w.option("header", "true") if kind == "csv" else w
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def from_pandas(spark: SparkSession, frame) -> Relation:
    import pyarrow as pa

    return Relation.from_arrow(spark, pa.Table.from_pandas(frame, preserve_index=False))


def from_polars(spark: SparkSession, frame) -> Relation:
    return Relation.from_arrow(spark, frame.to_arrow())
