"""MinHash near-deduplication with tensored banding.

Two collections of SIDE band values each stand for a whole table key: table (i, j) has the key of band i of the first and band j
of the second collection. SIDE * SIDE tables take 2 * SIDE * ROWS minhashes, about the square root of what independent tables
need. A pair of similarity s meets in some table with probability (1 - (1 - s**ROWS)**SIDE)**2: it is missed about 3 times in a
million at 0.85 and 9 in 100,000 at 0.80, farther off still less often; unlike pairs (0.05) meet 3 times in a million.

1. Documents with the same words in the same order, known by 128 bits of a hash over them, are linked through the smallest id.
2. Documents that meet in a table have equal bands in the first collection. So narrow rows (band, document) are counted first, and
   only what shares a band is combined with the second collection; tables are never formed for the others.
3. Each of the documents left gets one trial link, to the smallest id in any of its buckets, which is confirmed on the texts. So a
   large family mostly collapses without its pairs ever being formed.
4. Buckets whose members aren't all connected yet are compared in blocks of BLOCK members; only members of different
   components whose sketches (SKETCH minhashes of a byte) agree in as many places as a true link does but for one in 10**9 become pairs.
   These are confirmed on the texts too.
5. Components of the confirmed links.

Links are confirmed by comparing the full sets of shingles as strings.

Defined cases: null text counts as empty; an empty set is linked with nothing; a text of fewer words than the shingle has its
whole sequence as one shingle; repeated rows are equal texts; rows of one id with different texts are one document that has the links of
each (its n_shingles stays that of the row); a row with a null id keeps component_id null and kept false and isn't linked; an empty
table gives an empty table; only doc_id and text are read; the result depends on no order of rows. Texts are read whole whatever their
length; a worker holds the shingle sets of two texts at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, cut, mix, slices, word_hashes, words_of

SIDE, ROWS, SKETCH, BLOCK, SHARE = 14, 3, 128, 512, 64
SLICE = 4 << 20
_U = np.uint64
_RNG = np.random.default_rng(20_240_117)
_MUL = _RNG.integers(1, 2**63, SKETCH, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _RNG.integers(0, 2**63, SKETCH, dtype=np.uint64)
_STEP = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * _U(2) + _U(1)


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, from those of its words."""
    if not len(h):
        return np.zeros(0, np.uint64)
    width = min(width, len(h))
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = mix(total + h[k : k + n] * _STEP[k % 16] + _U(k))
    return np.unique(total)


def minhashes(s: np.ndarray) -> np.ndarray:
    """SKETCH minhashes of 32 bits."""
    out = np.full(SKETCH, 2**32 - 1, np.uint64)
    for i in range(0, len(s), 4_096):
        out = np.minimum(out, ((s[i : i + 4_096] * _MUL[:, None] + _ADD[:, None]) >> _U(32)).min(1))
    return out


def meets(similarity: float, side: int = SIDE, rows: int = ROWS) -> float:
    """The probability that a pair meets in some table."""
    return (1 - (1 - similarity**rows) ** side) ** 2


def bands(m: np.ndarray, side: int) -> np.ndarray:
    """The band values of the two collections, of 64 bits; those of different bands differ."""
    parts = m[: 2 * side * ROWS].reshape(2, side, ROWS)
    keys = np.zeros((2, side), np.uint64) + np.arange(side, dtype=np.uint64) * _STEP[1]
    for r in range(ROWS):
        keys = mix(keys * _STEP[0] + parts[:, :, r] + _U(1))
    return keys


def _signatures(width: int, side: int):
    names = ["doc_id", "n_shingles", "d1", "d2", "keys_a", "keys_b", "sketch"]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_dedup")
        for b in slices(batches, "text", SLICE):
            rows, texts = [], b.column(1).to_pylist()
            hashes, ends = word_hashes(texts)
            starts = np.append(0, ends[:-1])
            for doc_id, text, start, end in zip(b.column(0).to_pylist(), texts, starts.tolist(), ends.tolist()):
                s = shingle_hashes(hashes[start : end - 1], width)
                if not len(s):
                    rows.append((doc_id, 0, 0, 0, None, None, None))
                    continue
                m = minhashes(s)
                one, two = bands(m, side)
                digest = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words_of(text))), np.int64)
                rows.append((doc_id, len(s), int(digest[0]), int(digest[1]), one.view(np.int64), (two >> _U(32)).astype(np.uint32).view(np.int32), mix(m).astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run, "doc_id long, n_shingles long, d1 long, d2 long, keys_a array<long>, keys_b array<int>, sketch binary"


def least_matches(percent: int, sketch: int = SKETCH, miss: float = 1e-9) -> int:
    """The most agreeing places that a pair of just that similarity reaches but with probability `miss`."""
    p, total = percent / 100, 0.0
    for k in range(sketch + 1):
        total += math.comb(sketch, k) * p**k * (1 - p) ** (sketch - k)
        if total > miss:
            return k
    return sketch


def _shingle_set(text: str | None, width: int) -> set:
    words = words_of(text)
    if len(words) <= width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width))))


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose full shingle sets have 100 * intersection >= percent * union.

    A group holds at most SHARE partners of one document, so its text is sent once for them.
    """
    sized = pairs.groupBy("x").agg(F.ceil(F.count("*") / SHARE).alias("_parts"))
    spread = pairs.join(sized, "x").select("x", "y", F.pmod(F.xxhash64("y"), "_parts").alias("part"))
    texts = docs.select(F.col("doc_id").alias("_id"), "text")
    needed = spread.select(F.col("y").alias("_id"), "x", "part", F.lit(1).alias("role")).unionByName(spread.select(F.col("x").alias("_id"), "x", "part", F.lit(0).alias("role")).distinct())
    rows = needed.join(texts, "_id").select("x", "part", "role", F.col("_id").alias("y"), "text")
    rows = rows.repartition("x", "part").sortWithinPartitions("x", "part", "role", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, set()
        for b in slices(batches, "text"):
            out = []
            for x, part, role, y, text in zip(*(c.to_pylist() for c in b.columns)):
                s = _shingle_set(text, width)
                if role == 0:
                    at, own = (x, part), s
                elif at == (x, part):
                    both = len(own & s)
                    if both and 100 * both >= percent * (len(own) + len(s) - both):
                        out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), ()))], names=["x", "y"])

    return rows.mapInArrow(run, "x long, y long").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for every id of links (x, y): least labels with pointer jumps."""
    both = cut(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x != y").distinct())
    label = cut(both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.first("x")).alias("component")))
    while True:  # labels only fall, so it ends
        near = both.join(label.select(F.col("id").alias("y"), "component"), "y").groupBy(F.col("x").alias("id")).agg(F.min("component").alias("near"))
        lower = label.join(near, "id", "left").select("id", "component", F.least("component", "near").alias("next"))
        jump = label.select(F.col("id").alias("next"), F.col("component").alias("far"))
        moved = cut(lower.join(jump, "next", "left").select("id", F.col("component").alias("before"), F.least("next", "far").alias("component")))
        changed = moved.where("before != component").limit(1).count()
        label = moved.select("id", "component")
        if not changed:
            return label


def _compare(least: int, percent: int):
    """Pairs of each (key, b1, b2) of sorted rows whose components differ and whose sizes and sketches allow a link."""

    def pairs(t: pa.Table, out: list[np.ndarray]) -> None:
        ids, comp, size, blk, b1, b2 = (t.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles", "blk", "b1", "b2"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        for start, stop in zip(*_groups(t)):
            n = stop - start
            if n < 2:
                continue
            i, c, z, s, k = ids[start:stop], comp[start:stop], size[start:stop], sketch[start:stop], blk[start:stop]
            crossed = b1[start] != b2[start]
            for m in range(n - 1):
                rest = slice(m + 1, n)
                ok = (c[rest] != c[m]) & (100 * np.minimum(z[rest], z[m]) >= percent * np.maximum(z[rest], z[m]))
                if crossed:
                    ok &= k[rest] != k[m]
                at = np.flatnonzero(ok) + m + 1
                if len(at):
                    at = at[(s[at] == s[m]).sum(1) >= least]
                    out.append(np.stack([np.minimum(i[m], i[at]), np.maximum(i[m], i[at])], 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def found(t: pa.Table) -> pa.RecordBatch:
            out: list[np.ndarray] = []
            pairs(t, out)
            both = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["x", "y"])

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows:
                last = int(_groups(held)[0][-1])  # a group may go on in the next batch
                yield found(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield found(held)

    return run


def _groups(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last rows of the runs of one (key, b1, b2)."""
    if not t.num_rows:
        return np.zeros(0, int), np.zeros(0, int)
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in ("key", "b1", "b2"):
        v = t.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(new)
    return at, np.append(at[1:], t.num_rows)


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, side: int = SIDE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    run, schema = _signatures(width, side)
    made = cut(docs.mapInArrow(run, schema))
    full = made.where("n_shingles > 0 and doc_id is not null")
    owner = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    mapped = cut(full.select("doc_id", "n_shingles", "d1", "d2").join(owner, ["d1", "d2"]).select("doc_id", "n_shingles", "rep"))
    reps = full.join(mapped.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")

    # bands of the first collection that several documents share, then the tables of these only
    ones = reps.select("doc_id", F.explode("keys_a").alias("one"))
    common = ones.groupBy("one").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low != high").select("one")
    live = cut(ones.join(common, "one").groupBy("doc_id").agg(F.collect_set("one").alias("ones")))  # at most SIDE of a document
    tables = live.join(reps.select("doc_id", "keys_b"), "doc_id").select("doc_id", F.explode("ones").alias("one"), "keys_b").select("doc_id", "one", F.explode("keys_b").alias("two"))
    keys = tables.select("doc_id", F.xxhash64("one", "two").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low != high").drop("high")
    shared = cut(keys.join(buckets, "key"))

    # an id with several texts links what each of them equals
    several = mapped.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("high")).where("x != high").select("doc_id", "x")
    several = mapped.join(several, "doc_id").select("x", F.col("rep").alias("y")).where("x != y")

    least = least_matches(percent)
    sketches = cut(reps.join(shared.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n_shingles", "sketch"))
    trial = shared.where("doc_id != low").groupBy(F.col("doc_id").alias("y")).agg(F.min("low").alias("x"))
    links = cut(confirmed(trial.select("x", "y"), docs, width, percent).unionByName(several))
    first = components(links)

    # what trial links left apart
    labelled = shared.select("key", "doc_id", "n").join(first.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_ = labelled.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 != c1").select("key")
    rows = labelled.join(open_, "key", "left_semi").join(sketches, "doc_id")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("doc_id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("key", F.least("blk", "other").alias("b1"), F.greatest("blk", "other").alias("b2"), "blk", "doc_id", "component", "n_shingles", "sketch")
    more = rows.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2", "blk", "doc_id").mapInArrow(_compare(least, percent), "x long, y long").distinct()
    tried = trial.select("x", "y")
    more = cut(more.join(tried, ["x", "y"], "left_anti"))
    links = links.unionByName(confirmed(more, docs, width, percent))
    whole = components(links)

    known = mapped.join(whole.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    bare = made.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.unionByName(bare).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda k: array_to_string(w[k:k + 2], ' '))) AS g FROM d WHERE len(w) > 0),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * c >= 85 * (zx.n + zy.n - c)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN z USING (doc_id) JOIN m ON m.x = doc_id
"""
