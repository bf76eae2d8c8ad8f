"""Line deduplication by distinct-site spread, in DataFrame operations only.

Lines that stand in at least `sites` places can be on that many sites; an exact count, partly aggregated before its shuffle, finds
them. For these a HyperLogLog sketch of the sites is merged per line hash. An estimate beyond `sites` by more than the margin
marks a line as boilerplate, one below by more leaves it; between the two the distinct sites are counted exactly.
Boilerplate lines go from every document.

A line is what stands between newlines, without ASCII white space at its ends; empty lines are never boilerplate.
The margin is six standard errors of the sketch and two sites more at least, so decisions are those of exact counts.

Defined cases: null text counts as empty (no lines go); null sources are no site; repeated rows count as places but not
as sites; rows with a null id are cleaned as others; an empty table gives an empty table; extra columns are kept, but for
n_lines, n_removed and the cleaned text's name, which the results replace; texts and lines of any length are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

SITES, LOG_K, BROADCAST_LINES, LITERAL_LINES = 8, 12, 100_000, 4_000


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\x0b\x0c"))


def line_key(line: Column) -> Column:
    """128 bits of a line, in two hashes."""
    t = trimmed(line)
    return F.struct(F.xxhash64(t).alias("h"), F.xxhash64(t, F.lit(1)).alias("g"))


def _lines(docs: DataFrame) -> DataFrame:
    lines = docs.select("source", F.explode(F.split(text_of("text"), "\n")).alias("line"))
    return lines.where(trimmed(F.col("line")) != "").select("source", line_key(F.col("line")).alias("k")).select("source", "k.h", "k.g")


def boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """The keys (h, g) of lines on at least `sites` distinct sources, with their count or estimate of sites."""
    lines = _lines(docs)
    often = cut(lines.groupBy("h", "g").agg(F.count("source").alias("n")).where(F.col("n") >= sites).select("h", "g"))
    few = often.count() <= BROADCAST_LINES  # 16 bytes each
    near = lines.where("source is not null").join(F.broadcast(often) if few else often, ["h", "g"], "left_semi")
    spread = near.groupBy("h", "g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", LOG_K)).alias("sites"))
    margin = max(2, math.ceil(6 * sites * 1.04 / math.sqrt(2**LOG_K)))
    spread = cut(spread.where(F.col("sites") >= sites - margin))
    sure = spread.where(F.col("sites") > sites + margin)
    doubtful = spread.where(F.col("sites") <= sites + margin).select("h", "g")
    doubtful = F.broadcast(doubtful) if few else doubtful
    exact = near.join(doubtful, ["h", "g"], "left_semi").groupBy("h", "g", "source").agg(F.lit(1).alias("one")).groupBy("h", "g").agg(F.count("*").alias("sites"))
    return sure.unionByName(exact.where(F.col("sites") >= sites))


def line_dedup(docs: DataFrame, sites: int = SITES, to: str = "clean_text") -> DataFrame:
    """docs with n_lines, n_removed and `to`, the text without boilerplate lines; these replace columns of the same name.

    Up to LITERAL_LINES boilerplate lines, counted before, are sought in place, so that no text moves; beyond, each document gets its own by a join.
    """
    bad = cut(boilerplate(docs, sites).select("h", "g"))
    n = bad.count()
    held = docs.withColumn("_line_all", F.split(text_of("text"), "\n"))
    if n <= LITERAL_LINES:
        rows = bad.collect()  # at most LITERAL_LINES pairs of numbers

        def gone(line: Column) -> Column:
            k = line_key(line)
            return k["h"].isin([r["h"] for r in rows]) & k["g"].isin([r["g"] for r in rows])

        kept = F.filter("_line_all", lambda x: ~gone(x) | (trimmed(x) == "")) if rows else F.col("_line_all")
        out = held.withColumn("_line_kept", kept)
    else:
        out = _joined(held, bad)
    done = {"n_lines": F.size("_line_all").cast("long"), "n_removed": (F.size("_line_all") - F.size("_line_kept")).cast("long"), to: F.array_join("_line_kept", "\n")}
    return out.withColumns(done).drop("_line_kept", "_line_all")


def _joined(held: DataFrame, bad: DataFrame) -> DataFrame:
    """held with _line_kept, by a join of each document with its own boilerplate; rows of one id have one list, of all their lines."""
    own = held.select("doc_id", F.explode("_line_all").alias("line")).where(trimmed(F.col("line")) != "")
    own = own.select("doc_id", line_key(F.col("line")).alias("k")).select("doc_id", "k.h", "k.g")
    # a document's own boilerplate, never more than its lines
    marked = own.join(bad, ["h", "g"], "left_semi").groupBy(F.col("doc_id").alias("_line_id")).agg(F.collect_set(F.struct("h", "g")).alias("_line_bad"))
    # rows without an id may be many: they are told apart by a number of their own
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("_line_all"), F.lit(64)).cast("int")).otherwise(0)
    marked = marked.withColumn("_line_salt", F.explode(F.when(F.col("_line_id").isNull(), F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))))
    joined = held.withColumn("_line_own", salt).join(marked, held["doc_id"].eqNullSafe(marked["_line_id"]) & (F.col("_line_own") == F.col("_line_salt")), "left")
    kept = F.when(F.col("_line_bad").isNull(), F.col("_line_all")).otherwise(F.filter("_line_all", lambda x: ~F.array_contains("_line_bad", line_key(x)) | (trimmed(x) == "")))
    return joined.withColumn("_line_kept", kept).drop("_line_bad", "_line_id", "_line_own", "_line_salt")


ORACLE = r"""
WITH l AS (SELECT source, trim(unnest(string_split(coalesce(text, ''), chr(10))), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM documents),
bad AS (SELECT list(t) AS ts FROM (SELECT t FROM l WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 8)),
d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, coalesce(ts, []) AS ts FROM documents, bad),
k AS (SELECT doc_id, ls, list_filter(ls, lambda x: NOT list_contains(ts, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))) AS kept FROM d)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(kept) AS BIGINT) AS n_removed, array_to_string(kept, chr(10)) AS clean_text FROM k
"""
