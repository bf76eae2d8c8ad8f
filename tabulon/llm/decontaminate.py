"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Items are partitioned by their number of distinct shingles into classes (powers of two). The sketch of an item is its bottom-k
MinHash: the k smallest shingle hashes, with k = floor((1 - t) * class bound) + 1 at most the item's size. A text that holds a
share t of an item lacks at most (1 - t) of its shingles, so it holds one of those k: the search misses nothing. A document's
shingle joins only below the largest sketch hash, which spares most of a long text; what it finds are the classes in which the
document may hold an item. In these classes alone it is verified by exact containment: distinct shingle strings that item
and document share, over those of the item.

Words are runs of letters and digits (WORD), A to Z lower-cased; an item of fewer than `width` words is one shingle of its own length.

Defined cases: null texts count as empty and match nothing, as do items without words; repeated documents or items give one row
for each (doc_id, item_id); rows with a null id are left out of the report; empty tables give an empty report; a share just at the
threshold counts; texts of any length are read whole; only ids and texts are read, so columns of other names don't matter. The
pipeline gives rows without an id a number first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, cut, text_of

WIDTH, CONTAINED, BROADCAST_BYTES = 5, 0.8, 16 << 20


def _words() -> Column:
    return F.regexp_extract_all(ascii_lower(text_of("text")), F.lit(WORD), F.lit(0))


def _shingles(words: Column, width: Column) -> Column:
    """Each `width` words in a row, joined by a space."""
    last = F.size(words) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(words, i, width), " "))).otherwise(F.array().cast("array<string>"))


def _hashes(words: Column, width: int) -> Column:
    """Hashes of the shingles, without making their strings twice: equal to xxhash64 over the words in turn."""
    last = F.size(words) - F.lit(width)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))


def _below(words: Column, width: int, top: int) -> Column:
    """The (width, hash) of a text's shingles whose hash a sketch can hold."""
    return F.transform(F.filter(_hashes(words, width), lambda h: h <= F.lit(top)), lambda h: F.struct(F.lit(width).alias("width"), h.alias("hash")))


def item_shingles(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, width, shingle and hash: the distinct shingles of each item."""
    words = benchmark.where("item_id is not null").select("item_id", _words().alias("w")).where("size(w) > 0")
    w = words.withColumn("width", F.least(F.size("w"), F.lit(width)))
    each = w.select("item_id", "width", F.explode(_shingles(F.col("w"), F.col("width"))).alias("shingle")).distinct()
    parts = F.split("shingle", " ")
    hashed = F.lit(None).cast("long")
    for n in range(1, width + 1):
        hashed = F.when(F.col("width") == n, F.xxhash64(*(F.element_at(parts, F.lit(k + 1)) for k in range(n)))).otherwise(hashed)
    return each.withColumn("hash", hashed)


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast if a sum of bytes proves it small (at most BROADCAST_BYTES); else Spark joins by shuffle."""
    size = F.lit(16 * len(df.columns))
    for c, kind in df.dtypes:
        size = size + (F.octet_length(c) if kind == "string" else 8 * F.size(c) if kind.startswith("array") else 0)
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, contained: float = CONTAINED) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of each item that a document holds."""
    items = cut(item_shingles(benchmark, width))
    size = items.groupBy("item_id").agg(F.count("*").alias("n_item"))
    sized = items.join(size, "item_id").withColumn("bound", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_item")))).cast("long"))
    sized = sized.withColumn("k", F.least(F.col("n_item"), F.floor(F.lit(1 - contained) * F.col("bound") + 1e-9) + 1))
    ranked = sized.select("item_id", "width", "hash", "bound", "k", F.row_number().over(Window.partitionBy("item_id").orderBy("hash")).alias("r")).where("r <= k")
    sketch = cut(ranked.select("width", "hash", "bound").distinct())
    tops = {r["width"]: r["top"] for r in sketch.groupBy("width").agg(F.max("hash").alias("top")).collect()}  # at most `width` rows
    sketch = _maybe_broadcast(sketch)

    own = docs.where("doc_id is not null").select("doc_id", _words().alias("w"))
    low = [_below(F.col("w"), n, top) for n, top in sorted(tops.items())] or [F.array().cast("array<struct<width:int,hash:bigint>>")]
    low = F.concat(*low)
    hits = own.select("doc_id", F.explode(low).alias("s")).select("doc_id", "s.width", "s.hash").join(sketch, ["width", "hash"])
    hits = cut(hits.groupBy("doc_id").agg(F.collect_set("bound").alias("classes")))  # some twenty classes at most

    # verification: only documents that hold a sketch value, in its classes, on strings
    texts = docs.select("doc_id", "text").join(_maybe_broadcast(hits), "doc_id").select("doc_id", "classes", _words().alias("w"))
    each = F.flatten(F.array(*(F.array_distinct(_shingles(F.col("w"), F.lit(n))) for n in sorted(tops) or [width])))
    found = texts.select("doc_id", "classes", F.explode(each).alias("shingle")).join(_maybe_broadcast(sized.select("item_id", "shingle", "bound")), "shingle")
    found = found.where(F.array_contains("classes", F.col("bound"))).select("doc_id", "item_id", "shingle").distinct()
    return (
        found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared")).join(size, "item_id")
        .where(F.col("n_shared") >= F.lit(contained) * F.col("n_item") - 1e-9)
        .select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    )


ORACLE = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda k: array_to_string(w[k:k + least(len(w), 5) - 1], ' '))) AS s, least(len(w), 5) AS n FROM iw WHERE len(w) > 0),
d AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS s FROM dw, (SELECT DISTINCT n FROM i) WHERE len(w) >= n),
z AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (n, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM f JOIN z USING (item_id) WHERE n_shared >= 0.8 * n_item - 1e-9
"""
