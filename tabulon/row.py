"""Rows on the driver, their JSON and their byte frames; and the same frames as a column."""

from __future__ import annotations

import datetime as dt
import json
import struct
import time
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import DataError

PREFIX, MOST = b"\x52\x01", 16 << 20


class Row(tuple):
    """A tuple with field names."""

    fields: tuple[str, ...] = ()

    @classmethod
    def make(cls, fields: list[str]) -> type[Row]:
        return type("Row", (cls,), {"fields": tuple(fields)})

    def __new__(cls, values: dict | tuple | list):
        return super().__new__(cls, (values.get(f) for f in cls.fields) if isinstance(values, dict) else values)

    def get(self, name: str, default: object = None) -> object:
        return self[self.fields.index(name)] if name in self.fields else default

    def keys(self) -> tuple[str, ...]:
        return self.fields

    def values(self) -> tuple:
        return tuple(self)

    @property
    def as_map(self) -> tuple[tuple[str, object], ...]:
        return tuple(zip(self.fields, self))

    @property
    def as_dict(self) -> dict:
        return dict(zip(self.fields, self))

    @property
    def as_json(self) -> str:
        return json.dumps(self.as_dict, default=str, separators=(",", ":"), ensure_ascii=False)

    def to_bytes(self) -> bytes:
        """Prefix, size, time of writing in ns, then the values as tagged JSON; DataError beyond 16 MiB."""
        body = json.dumps([_tagged(v) for v in self], separators=(",", ":"), ensure_ascii=False).encode()
        if len(body) > MOST:
            raise DataError("the row is larger than 16 MiB")
        return PREFIX + struct.pack(">Iq", len(body), time.time_ns()) + body

    @classmethod
    def from_bytes(cls, frame: bytes) -> Row:
        if frame[:2] != PREFIX or len(frame) < 14:
            raise DataError("not a row")
        (size,) = struct.unpack(">I", frame[2:6])
        if len(frame) != 14 + size:
            raise DataError("the row is cut short")
        return cls(tuple(_plain(v) for v in json.loads(frame[14:])))

    @property
    def nbytes(self) -> int:
        return len(self.to_bytes())


def _tagged(v: object) -> object:
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    for kind, tag, out in _TAGS:
        if isinstance(v, kind):
            return {tag: out(v)}
    return [_tagged(x) for x in v] if isinstance(v, (list, tuple)) else {"~s": str(v)}


def _plain(v: object) -> object:
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        (tag, x), = v.items()
        return _BACK[tag](x)
    return v


#: Types that JSON lacks: their tag and their form; moments before days, as they are days too.
_TAGS = (
    ((bytes, bytearray), "~b", lambda v: bytes(v).hex()),
    (dt.datetime, "~t", dt.datetime.isoformat),
    (dt.date, "~d", dt.date.isoformat),
    (dt.time, "~c", dt.time.isoformat),
    (dt.timedelta, "~i", lambda v: [v.days, v.seconds, v.microseconds]),
    (Decimal, "~n", str),
    (dict, "~m", lambda v: {k: _tagged(x) for k, x in v.items()}),
)
_BACK = {"~b": bytes.fromhex, "~t": dt.datetime.fromisoformat, "~d": dt.date.fromisoformat, "~c": dt.time.fromisoformat, "~i": lambda x: dt.timedelta(*x), "~n": Decimal, "~s": str, "~m": lambda m: {k: _plain(y) for k, y in m.items()}}


def json_column() -> Column:
    """Each row as compact JSON, nulls included."""
    return F.to_json(F.struct("*"), {"ignoreNullFields": "false"})


def frames(df: DataFrame) -> DataFrame:
    """One column `frame`: prefix, size and compact JSON of each row, made without Python."""
    body = F.encode(json_column(), "UTF-8")
    size = F.unhex(F.lpad(F.hex(F.octet_length(body)), 8, "0"))
    return df.select(F.concat(F.lit(PREFIX), size, body).alias("frame"))


def extract_fields(record: dict, fields: list) -> tuple:
    """Values of the fields in order, None where there's none."""
    return tuple(map(record.get, fields))


def extract_columns(table: list[dict], columns: list[str]) -> list[list]:
    """Lists of the columns; KeyError where a record lacks one."""
    return [[r[c] for r in table] for c in columns]
