"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

quality: documents that the classifier rejects go. exact dedup: of equal texts the smallest doc_id stays. near dedup: one document
of each group stays, the one of the smallest id. decontamination: documents that hold a benchmark item go. bpe: ids, counts and
digests of what is left.

Decisions are by row, never by doc_id alone: rows of one doc_id with different texts are documents of their own, as are rows
without an id, which rank after all others. Of rows that repeat both id and text one passes the near and later stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import functions as F

from tabulon.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from tabulon.llm.common import drop_stage, new_stage_path, with_row_key
from tabulon.llm.queries import table, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL expresses the classifier and the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("keep").select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.unique(docs.select(*COLUMNS))


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with a number for each row (`_row`), rows that repeat id and text once, and the operators' view of them: that number as doc_id, and the text."""
    held, odd = with_row_key(docs.select(*COLUMNS))
    held = held.dropDuplicates(["_row"]) if odd else held
    return held, held.select(F.col("_row").alias("doc_id"), "text")


def _without(held: DataFrame, gone: DataFrame) -> DataFrame:
    """held but for the rows numbered in `gone`; Spark broadcasts the numbers only below its own size limit."""
    return held.join(gone.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held, view = _keyed(docs)
    return _without(held, near_dedup.near_dedup(view).where("doc_id != component_id")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held, view = _keyed(docs)
    return _without(held, decontaminate.contaminated(view, table(spark, sf_dir, "benchmark"))).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last goes through files in the shared folder, which go once the next one's are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_stage_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_stage(before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
