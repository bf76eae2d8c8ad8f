"""Lenient parsers of each logical type as Column expressions. Null gives null; values that can't be read give null, or an error if strict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import LogicalType, parse_type

TRUE = ("TRUE", "ON", "YES", "1", "1.0", "T", "Y")
#: The last second of the year 9999, where Python's datetimes end, and the last whole one of Spark's timestamps.
LAST_SECOND, LAST_OF_SPARK = 253_402_300_799, 9_223_372_036_854


def as_text(c: Column, kind: T.DataType | None = None) -> Column:
    """Text: booleans as True and False, bytes as UTF-8, containers as compact JSON."""
    if isinstance(kind, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(kind, T.BinaryType):
        return F.decode(c, "UTF-8")
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def boolean(c: Column, kind: T.DataType | None = None) -> Column:
    return F.upper(as_text(c, kind)).isin(*TRUE)


def integer(c: Column, kind: T.DataType | None = None) -> Column:
    c = F.decode(c, "UTF-8") if isinstance(kind, T.BinaryType) else c
    return F.when(F.trim(c.cast("string")).rlike(r"^[+-]?\d+$"), c.try_cast("bigint")) if isinstance(kind, (T.StringType, T.BinaryType)) else c.try_cast("bigint")


def double(c: Column, kind: T.DataType | None = None) -> Column:
    return (F.decode(c, "UTF-8") if isinstance(kind, T.BinaryType) else c).try_cast("double")


def decimal(c: Column, precision: int = 38, scale: int = 21, kind: T.DataType | None = None) -> Column:
    """Half-even at the scale; null where the precision can't hold it. A tie of a number with so many digits before the point that six more behind the scale don't fit rounds up."""
    c = F.decode(c, "UTF-8") if isinstance(kind, T.BinaryType) else c
    wide = min(38, scale + 6)
    exact = F.bround(c.try_cast(f"decimal(38,{wide})"), scale).try_cast(f"decimal({precision},{scale})")
    return F.coalesce(exact, c.try_cast(f"decimal({precision},{scale})"))


def cut_bytes(text: Column, n: int) -> Column:
    """The longest start of a text of at most n bytes of UTF-8, without a part of a character."""
    raw = F.encode(text, "UTF-8")
    goes_on = lambda i: F.coalesce(F.hex(F.substring(raw, i, 1)).between("80", "BF"), F.lit(False)) if i > 0 else F.lit(False)  # noqa: E731  (within a character)
    end = F.when(~goes_on(n + 1), n).when(~goes_on(n), n - 1).when(~goes_on(n - 1), n - 2).otherwise(n - 3)
    return F.when(F.octet_length(text) <= n, text).otherwise(F.decode(F.substring(raw, F.lit(1), F.greatest(end, F.lit(0))), "UTF-8"))


def varchar(c: Column, length: int | None = None, kind: T.DataType | None = None) -> Column:
    text = as_text(c, kind)
    return text if length is None else cut_bytes(text, length)


def blob(c: Column, length: int | None = None, kind: T.DataType | None = None) -> Column:
    raw = c if isinstance(kind, T.BinaryType) else F.encode(as_text(c, kind), "UTF-8")
    return raw if length is None else F.substring(raw, 1, length)


def epoch(seconds: Column, last: int = LAST_SECOND) -> Column:
    """The moment without zone so many whole seconds after 1970 began, whatever the session's zone; null before the year 1 and beyond `last`, the end of 9999."""
    s = seconds.cast("bigint")
    days = F.floor(s / 86_400).cast("int")
    moment = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days, F.lit(0), F.lit(0), F.pmod(s, F.lit(86_400)).cast("decimal(18,6)"))
    return F.when(s.between(-62_135_596_800, last), moment)


def iso_timestamp(c: Column, last: int = LAST_SECOND) -> Column:
    """A moment without zone from text, or null: digits are epoch seconds, up to `last`; an offset or Z is dropped, as are fractions."""
    x = c.cast("string")
    y = F.split_part(F.regexp_replace(x, "Z$", ""), F.lit("+"), F.lit(1))
    whole = y.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}.*)?)?$")
    return (
        F.when(x.rlike("^[0-9]+$"), epoch(x.try_cast("bigint"), last))
        .when((F.length(x) < 10) | (F.length(x) > 33) | ~whole, F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.substring(y, 1, 19).try_cast("timestamp_ntz"))
    )


def timestamp(c: Column, kind: T.DataType | None = None) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("second", c).cast("timestamp_ntz")
    if isinstance(kind, T.DateType):
        return c.cast("timestamp_ntz")
    if isinstance(kind, (T.IntegralType, T.FractionalType)):
        return epoch(F.floor(c))
    return iso_timestamp(F.decode(c, "UTF-8") if isinstance(kind, T.BinaryType) else c)


def timestamp_text(c: Column) -> Column:
    """The moment of a text as YYYY-MM-DD HH:MM:SS; epoch seconds count to the end of Spark's timestamps, with more digits for years beyond 9999."""
    return F.ltrim(iso_timestamp(c, LAST_OF_SPARK).cast("string"), F.lit("+"))


def date(c: Column, kind: T.DataType | None = None) -> Column:
    return timestamp(c, kind).cast("date")


def time_of_day(c: Column, kind: T.DataType | None = None) -> Column:
    """HH:MM:SS as text, from a time or a moment; cast it to TIME where the session allows that type."""
    bare = c.cast("string")
    moment = F.date_format(timestamp(c, kind), "HH:mm:ss")
    if kind is not None and not isinstance(kind, (T.StringType, T.BinaryType)):
        return moment
    return F.when(bare.rlike(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?$"), F.substring(F.concat(bare, F.when(F.length(bare) == 5, ":00").otherwise("")), 1, 8)).otherwise(moment)


def interval(c: Column) -> Column:
    """A number of days, with its fraction to the microsecond."""
    d = c.cast("double")
    days = F.floor(d)
    return F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), F.round((d - days) * 86_400, 6).cast("decimal(18,6)"))


def array(c: Column, element: LogicalType, kind: T.DataType | None = None) -> Column:
    held = c if isinstance(kind, T.ArrayType) else F.from_json(as_text(c, kind), "array<string>")
    inner = kind.elementType if isinstance(kind, T.ArrayType) else T.StringType()
    return F.transform(held, lambda x: parse(x, element, inner))


def vector(c: Column, kind: T.DataType | None = None) -> Column:
    return array(c, LogicalType("DOUBLE"), kind)


def parse(c: Column, to: LogicalType | str, kind: T.DataType | None = None, strict: bool = False) -> Column:
    """The column read as the logical type; kind is its Spark type where known."""
    t = parse_type(to) if isinstance(to, str) else to
    one = {
        "BOOLEAN": lambda: boolean(c, kind), "INTEGER": lambda: integer(c, kind), "DOUBLE": lambda: double(c, kind), "DECIMAL": lambda: decimal(c, t.precision or 38, 21 if t.scale is None else t.scale, kind),
        "VARCHAR": lambda: varchar(c, t.length, kind), "BLOB": lambda: blob(c, t.length, kind), "JSONB": lambda: blob(c, None, kind), "STRUCT": lambda: blob(c, None, kind), "DATE": lambda: date(c, kind), "TIMESTAMP": lambda: timestamp(c, kind),
        "TIME": lambda: time_of_day(c, kind), "INTERVAL": lambda: interval(c), "ARRAY": lambda: array(c, t.element or LogicalType("VARCHAR"), kind), "VECTOR": lambda: vector(c, kind), "NULL": lambda: F.lit(None),
    }
    out = one[t.name]()
    if not strict or t.name == "NULL":
        return out
    return F.when(c.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit(f"not a valid {t}: "), c.cast("string")))).otherwise(out)


def redacted(c: Column) -> Column:
    """The first eight hex digits of the SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 8)


def json_field(c: Column, name: str, to: LogicalType | str = "VARCHAR") -> Column:
    """One top-level field of a JSON text, by its exact name."""
    return parse(F.get_json_object(c, f"$['{name}']"), to, T.StringType())
