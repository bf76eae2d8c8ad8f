"""Row positions without a single-partition window.

Parquet rows have the reader's row index; several files are offset by the counts of those before them. Other
frames get positions from an order: range partitions, a number within each, and the counts of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import cut

POSITION, BLOCK = "_position", 1 << 18


def _offsets(df: DataFrame, key: str) -> DataFrame:
    """key and the rows of all smaller keys; there are as many rows as files or partitions."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(F.col(key).alias("_k"), F.coalesce(before, F.lit(0)).alias("_before"))


def read_with_position(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with _position, its row number from 0 in order of file and row."""
    df = spark.read.parquet(path)
    if len(df.inputFiles()) <= 1:
        return df.select("*", F.col("_metadata.row_index").alias(POSITION))
    held = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return held.join(_offsets(held, "_file"), F.col("_file") == F.col("_k")).withColumn(POSITION, F.col("_row") + F.col("_before")).drop("_file", "_row", "_k", "_before")


def number_rows(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with _position by an order that should be unique.

    Bounds of range partitions come from samples that differ from plan to plan, so the partitioned rows are written once, and both
    numbers and counts are read from that.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = cut(df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id()))
    held = held.withColumn("_part", F.shiftright("_at", 33)).withColumn("_inner", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = F.broadcast(_offsets(held, "_part"))  # a row for each partition
    return held.join(before, F.col("_part") == F.col("_k")).withColumn(POSITION, F.col("_inner") + F.col("_before")).drop("_at", "_part", "_inner", "_k", "_before")


def renumber_rows(df: DataFrame, was: str) -> DataFrame:
    """df with _position counted without gaps in the order of `was`, distinct numbers from 0: in blocks of them, with the counts of those before."""
    held = df.withColumn("_block", F.floor(F.col(was) / BLOCK).cast("long"))
    inner = F.row_number().over(Window.partitionBy("_block").orderBy(was)) - 1
    counts = _offsets(df.select(F.floor(F.col(was) / BLOCK).cast("long").alias("_block")), "_block")
    return held.withColumn("_inner", inner.cast("long")).join(counts, F.col("_block") == F.col("_k")).withColumn(POSITION, F.col("_inner") + F.col("_before")).drop(was, "_block", "_inner", "_k", "_before")
