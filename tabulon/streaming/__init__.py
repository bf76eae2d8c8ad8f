"""Appended records as a stream: the library's operators hold on streaming frames too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..schema import RelationSchema


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, kind: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(folder)


def validated(stream: DataFrame, schema: RelationSchema) -> tuple[DataFrame, DataFrame]:
    """Rows without faults, and the others with `_errors`: unknown, missing, null and wrongly typed fields."""
    checked = stream.withColumn("_errors", schema.errors(given=stream.schema))
    return checked.where(F.size("_errors") == 0).drop("_errors"), checked.where(F.size("_errors") > 0)


def windowed_counts(stream: DataFrame, at: str, key: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows by tumbling window and key, with a watermark for late ones."""
    held = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return held.groupBy(F.window("_at", every).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def append_to(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes what there is now as Parquet, each batch once, and stops."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
