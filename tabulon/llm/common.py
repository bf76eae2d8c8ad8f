"""What the operators share: the shared folder, lineage cuts, Arrow slices and word rules."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.position import POSITION, number_rows
from ..shared import cut, shared_folder

#: Words of the licence and benchmark operators: runs of ASCII letters, digits and all non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 8 << 20


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A new folder on a mounted shared file system, for files that workers map into memory; removed at exit."""
    uri = urlparse(shared_folder(spark))
    if uri.scheme not in ("", "file"):
        raise ValueError("memory-mapped models need spark.checkpoint.dir on a mounted file system (file:)")
    path = os.path.join(uri.path, f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def ascii_lower(c: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def text_of(c: str | Column) -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `limit` bytes of `column` or a single row."""
    for b in batches:
        size = b.column(b.schema.get_field_index(column)).nbytes if b.num_rows else 0
        step = max(1, int(b.num_rows * limit / size)) if size > limit else max(1, b.num_rows)
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A to Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def release(spark: SparkSession) -> None:
    """Lets the cluster drop the shuffle files of finished steps that nothing refers to any more; else they stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_row_key(docs: DataFrame, key: str = "_row") -> tuple[DataFrame, bool]:
    """docs with a number, and whether it's another than doc_id. It tells apart rows of one id with different texts and rows without an id, in the order of the ids (null last).

    Where every row has an id of its own, which a count of ids shows without their texts, that is the number. Else the distinct
    (doc_id, SHA-256 of the text) are numbered by range partitions; repeated rows share a number.
    """
    odd = docs.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.withColumn(key, F.col("doc_id").cast("long")), False
    hashed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_sha": F.sha2(text_of("text"), 256)})
    names = hashed.select(F.col("_id").alias("_i"), F.col("_sha").alias("_s")).distinct().withColumn("_null", F.col("_i").isNull())
    numbered = cut(number_rows(names, "_null", F.coalesce("_i", F.lit(0)), "_s").select("_i", "_s", F.col(POSITION).alias(key)))
    return hashed.join(numbered, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_sha") == F.col("_s"))).drop("_id", "_sha", "_i", "_s"), True


_PIECE = 1 << 18
_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LETTER = np.random.default_rng(9).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_POWER = np.full(2 * _PIECE, _U(_BASE)).cumprod(dtype=np.uint64)
_INVERSE = np.full(2 * _PIECE, _U(pow(_BASE, -1, 1 << 64))).cumprod(dtype=np.uint64)
_ANY_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Lower-cases, and makes blanks of ASCII that is no letter.
LETTERS = bytes(32 if i < 128 and not chr(i).isalpha() else ord(chr(i).lower()) if i < 128 else i for i in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _hashed(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a piece and whether it is the end mark: a polynomial in random values of its bytes, by running sums."""
    x = np.frombuffer(piece, np.uint8)
    blank = np.ones(len(x) + 2, np.int8)
    blank[1:-1] = _BLANK[x]
    turn = np.diff(blank)
    start, stop = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_LETTER[x] * _POWER[: len(x)], out=sums[1:])
    size = stop - start
    h = mix((sums[stop] - sums[start]) * _INVERSE[start] + size.astype(np.uint64))
    for i in np.flatnonzero(size > _PIECE // 2):
        h[i] = xxhash.xxh64_intdigest(piece[start[i] : stop[i]])
    return h, x[start] == 255 if len(start) else np.zeros(0, bool)


def word_hashes(texts: list[str | None], table: bytes = _TO_LOWER) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between ASCII white space, A to Z lower-cased, of each text and of an end mark after each; and where each text ends.

    table: what bytes count as, another than lower-casing for words of another kind. Words longer than half a piece are hashed by themselves, so memory doesn't grow with texts or words.
    """
    data = b" \xff ".join((t or "").encode("utf-8", "replace") for t in texts).translate(table) + b" \xff" if texts else b""
    hashes, ends, at = [np.zeros(0, np.uint64)], [np.zeros(0, bool)], 0
    while at < len(data):
        stop = at + _PIECE
        if stop < len(data):
            found = max(data.rfind(b, at, stop) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if found <= at:  # one long word: up to the next blank
                after = _ANY_BLANK.search(data, stop)
                stop = after.start() if after else len(data)
                if not _BLANK[data[at]]:
                    hashes.append(np.array([xxhash.xxh64_intdigest(data[at:stop])], np.uint64))
                    ends.append(np.zeros(1, bool))
                    at = stop
                    continue
                at += 1
                continue
            stop = found
        h, e = _hashed(data[at:stop])
        hashes.append(h)
        ends.append(e)
        at = stop
    return np.concatenate(hashes), np.flatnonzero(np.concatenate(ends)) + 1


_STAGES: list[tuple[SparkSession, str]] = []
_CACHES: dict[str, Callable[[], object]] = {}


def claim(name: str, forget: Callable[[], object] | None = None) -> None:
    """Called where a worker begins a task of an operator: what other operators cached in this process goes, so that it holds one's caches at a time."""
    for other in [x for x in _CACHES if x != name]:
        _CACHES.pop(other)()
    if forget:
        _CACHES[name] = forget


def new_stage_path(spark: SparkSession, name: str) -> str:
    """The URI of a folder, not made yet, for a stage's table in the shared folder; drop_stage removes it."""
    path = f"{shared_folder(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"
    _STAGES.append((spark, path))
    return path


def drop_stage(path: str) -> None:
    """Removes a stage table that nothing reads any more."""
    for spark, own in [x for x in _STAGES if x[1] == path]:
        _STAGES.remove((spark, own))
        at = spark._jvm.org.apache.hadoop.fs.Path(own)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _drop_all() -> None:
    """At the end of the process, what is left, where the session still lives."""
    for spark, path in list(_STAGES):
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Py4JError, OSError):
                drop_stage(path)


atexit.register(_drop_all)
