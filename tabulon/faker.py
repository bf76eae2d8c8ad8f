"""Made-up rows for a schema, as Spark expressions."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.parse import epoch
from .schema import FlatColumn, RelationSchema

GIVEN = ("Ada", "Bela", "Chidi", "Dana", "Emre", "Farah", "Goran", "Hana", "Ines", "Jomo", "Kaja", "Luis", "Mina", "Nils", "Oona", "Pavel")
FAMILY = ("Abara", "Berg", "Costa", "Dimov", "Eze", "Fontaine", "Garcia", "Haas", "Ito", "Jansen", "Kovac", "Lind", "Moreau", "Novak", "Okoro", "Petit")
NULL_SHARE = 0.01


def name(seed: int) -> Column:
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (F.rand(seed + k) * len(names)).cast("int") + 1)
    full = F.concat_ws(" ", pick(GIVEN, 1), pick(FAMILY, 2))
    return F.when(F.rand(seed + 3) < 0.2, F.upper(full)).otherwise(full)


def value(c: FlatColumn, seed: int) -> Column:
    r, kind = F.rand(seed), c.type.name
    if kind == "INTEGER":
        out = (r * 101).cast("long") if c.disposition == "AGE" else (r * 2**31).cast("long") - 2**30
    elif kind == "VARCHAR":
        out = name(seed)
    elif kind == "BOOLEAN":
        out = r < 0.5
    elif kind == "DECIMAL":
        whole = min(c.type.precision - c.type.scale, 6)
        out = (r * 10**whole).cast(c.type.spark)
    elif kind == "DOUBLE":
        out = (r - 0.5) * 2_000_000
    elif kind == "TIMESTAMP":
        first, last = -315_619_200, 4_102_444_800  # 1960 to 2100
        out = epoch(F.lit(first) + (r * (last - first)).cast("long"))
    else:
        raise TypeError(f"no made-up values of type {c.type}")
    return F.when(F.rand(seed + 7) >= NULL_SHARE, out) if c.nullable else out


def generate_fake_data(spark: SparkSession, schema: RelationSchema, size: int, seed: int | None = None) -> DataFrame:
    """`size` rows, about one value in a hundred null where it may be."""
    seed = random.randrange(1 << 30) if seed is None else seed
    return spark.range(size).select(*(value(c, seed + 100 * i).alias(c.name) for i, c in enumerate(schema)))


def generate_random_row(spark: SparkSession, schema: RelationSchema) -> tuple:
    return tuple(generate_fake_data(spark, schema, 1).first())
