"""Hashes of 32 and 64 bits (xxHash, seed 0) of single values and of columns, with equal results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _bytes(value: object) -> bytes:
    return bytes(value) if isinstance(value, (bytes, bytearray)) else str(value).encode()


def hash32(value: object) -> int:
    """From 0 to 2**32 - 1; what isn't bytes counts by its text."""
    import xxhash

    return xxhash.xxh32_intdigest(_bytes(value))


def hash64(value: object) -> int:
    """From 0 to 2**64 - 1."""
    import xxhash

    return xxhash.xxh64_intdigest(_bytes(value))


def _column(c: Column, kind: str, arrow: pa.DataType, f: Callable[[object], int]) -> Column:
    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([None if v is None else f(v) for v in a.to_pylist()], arrow)

    return run(c)


def hash32_column(c: Column) -> Column:
    """hash32 of text or bytes as a long, in Arrow batches; null for null. F.hash and F.xxhash64 are faster where no other system must agree."""
    return _column(c, "long", pa.int64(), hash32)


def hash64_column(c: Column) -> Column:
    """hash64 of text or bytes as a long of the same bits."""
    return _column(c, "long", pa.int64(), lambda v: (hash64(v) ^ (1 << 63)) - (1 << 63))
