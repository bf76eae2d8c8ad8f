"""Column encodings over (pos, v): run-length, dictionary, sparse, constant and function columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .position import POSITION, number_rows

BLOCK = 1 << 16
BROADCAST_BYTES = 8 << 20
#: Types whose values have no order or equality that runs and dictionaries need.
UNFIT = (T.MapType, T.StructType, T.ArrayType, T.NullType)


def fit_for(df: DataFrame, value: str, what: str) -> None:
    """TypeError for a column whose type can't be encoded so."""
    kind = df.schema[value].dataType
    if isinstance(kind, UNFIT) or type(kind).__name__ == "VariantType":
        raise TypeError(f"{what} can't encode {kind.simpleString()}")


def encode(df: DataFrame, kind: str, pos: str, value: str) -> DataFrame:
    """Runs ("rle"), codes at positions ("dictionary") or what isn't null ("sparse"); TypeError for another kind or an unfit type."""
    if kind == "rle":
        return rle_encode(df, pos, value)
    if kind == "dictionary":
        return dict_encode(df.select(pos, value), dictionary(df, pos, value), value).select(pos, "code")
    if kind == "sparse":
        fit_for(df, value, kind)
        return sparse_encode(df, pos, value)
    raise TypeError(f"no such encoding: {kind}")


def decode(encoded: DataFrame, kind: str, codes: DataFrame | None = None, length: int | None = None) -> DataFrame:
    """The values of what `encode` gave; a dictionary needs its codes, a sparse column its length."""
    if kind == "rle":
        return rle_decode(encoded)
    if kind == "dictionary" and codes is not None:
        return dict_decode(encoded, codes)
    if kind == "sparse" and length is not None:
        return sparse_decode(encoded, length)
    raise TypeError(f"no such encoding, or what it needs is missing: {kind}")


def rle_encode(df: DataFrame, pos: str, value: str, block: int = BLOCK) -> DataFrame:
    """start_pos, run_value and run_length of runs of equal values; positions have no gaps; null equals null, NaN no NaN.

    Runs are found in blocks of positions in parallel; only the runs at the edges of blocks meet in one ordered pass.
    """
    fit_for(df, value, "rle")
    nan = F.isnan(F.col(value)) if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)) else F.lit(False)
    rows = df.select(F.col(pos).alias("p"), F.col(value).alias("v"), nan.alias("x")).withColumn("b", F.floor(F.col("p") / block))
    w = Window.partitionBy("b").orderBy("p")
    fresh = F.when(F.lag("p").over(w).isNotNull() & F.lag("v").over(w).eqNullSafe(F.col("v")) & ~F.coalesce(F.col("x"), F.lit(False)), 0).otherwise(1)
    runs = rows.withColumn("c", fresh).withColumn("r", F.sum("c").over(w)).groupBy("b", "r").agg(F.min("p").alias("s"), F.max("p").alias("e"), F.count("*").alias("n"), F.first("v").alias("v"), F.first("x").alias("x"))
    edge = (F.pmod("s", F.lit(block)) == 0) | (F.pmod("e", F.lit(block)) == block - 1)
    inner = runs.where(~edge).select("s", "v", "n")
    o = Window.orderBy("s")
    met = F.lag("v").over(o).eqNullSafe(F.col("v")) & (F.lag("e").over(o) == F.col("s") - 1) & ~F.coalesce(F.col("x"), F.lit(False))
    joined = runs.where(edge).withColumn("c", F.when(met, 0).otherwise(1)).withColumn("r2", F.sum("c").over(o)).groupBy("r2").agg(F.min("s").alias("s"), F.first("v").alias("v"), F.sum("n").alias("n")).select("s", "v", "n")
    return inner.unionByName(joined).select(F.col("s").alias("start_pos"), F.col("v").alias("run_value"), F.col("n").alias("run_length"))


def rle_decode(runs: DataFrame, pos: str = "pos", value: str = "v") -> DataFrame:
    """The values at their positions again."""
    each = F.explode(F.sequence(F.col("start_pos"), F.col("start_pos") + F.col("run_length") - 1))
    return runs.where("run_length > 0").select(each.alias(pos), F.col("run_value").alias(value))


def dictionary(df: DataFrame, pos: str, value: str) -> DataFrame:
    """value and code, in order of first position; a null has a code too. Codes are numbered by range partitions."""
    fit_for(df, value, "dictionary")
    first = df.groupBy(value).agg(F.min(pos).alias("_first"))
    return number_rows(first, "_first").select(value, F.col(POSITION).alias("code"))


def dictionary_sorted(df: DataFrame, value: str) -> DataFrame:
    """value and code, in order of the values."""
    fit_for(df, value, "dictionary")
    return number_rows(df.select(value).distinct(), value).select(value, F.col(POSITION).alias("code"))


def _small(codes: DataFrame) -> DataFrame:
    """Broadcast if a sum of their bytes proves the codes small; else Spark joins by shuffle."""
    size = codes.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in codes.columns), F.lit(32)))).first()[0] or 0
    return F.broadcast(codes) if size <= BROADCAST_BYTES else codes


def dict_encode(df: DataFrame, codes: DataFrame, value: str) -> DataFrame:
    """df with each value's code."""
    c = _small(codes).withColumnRenamed(value, "_value")
    return df.join(c, df[value].eqNullSafe(c["_value"])).drop("_value")


def dict_decode(encoded: DataFrame, codes: DataFrame, strict: bool = True) -> DataFrame:
    """encoded with the values of its codes; a code outside the dictionary stops it if strict."""
    c = _small(codes).withColumnRenamed("code", "_code").withColumn("_known", F.lit(True))
    out = encoded.join(c, F.col("code") == F.col("_code"), "left" if strict else "inner")
    if strict:
        out = out.where(F.when(F.col("_known").isNull(), F.raise_error(F.lit("code outside the dictionary"))).otherwise(F.lit(True)).cast("boolean"))
    return out.drop("_code", "_known", "code")


def sparse_encode(df: DataFrame, pos: str, value: str, default: object = None) -> DataFrame:
    """idx and v of the values that aren't the default."""
    return df.where(~F.col(value).eqNullSafe(F.lit(default))).select(F.col(pos).alias("idx"), F.col(value).alias("v"))


def sparse_decode(sparse: DataFrame, length: int, default: object = None) -> DataFrame:
    """idx from 0 to length - 1, with the default where there's no value."""
    held = sparse.withColumn("_here", F.lit(True))
    every = sparse.sparkSession.range(length).withColumnRenamed("id", "idx")
    return every.join(held, "idx", "left").select("idx", F.when(F.col("_here"), F.col("v")).otherwise(F.lit(default)).alias("v"))


def constant(df: DataFrame, name: str, value: object) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def function_column(df: DataFrame, name: str, binding: Callable[..., object], *args: object) -> DataFrame:
    """A column of what the function returns, called once."""
    return df.withColumn(name, F.lit(binding(*args)))


def on_values(codes: DataFrame, value: str, f: Callable[[Column], Column]) -> DataFrame:
    """The small dictionary or run table with its values changed; decoding spreads the change over all rows."""
    return codes.withColumn(value, f(F.col(value)))
