"""Exact deduplication by Patricia tries of whole texts.

Every task puts its texts into a radix trie, partitioned by (length, first byte of the hash), which the keys begin with, and passes on one row
for each distinct text: the bytes, the smallest id and the number of rows. So a text that fills a third of the table crosses the
shuffle once for each task. Once a task's trie holds TRIE_BYTES, its largest subtrees are spilled down to half of that: what they hold is passed on
at once and they are cut off, to grow again if such texts come again. The rows go to partitions by length and hash, sorted, where one bucket of a length
and four hash bytes is a trie at a time; a terminal node holds the smallest id and the number of rows. Sorting keeps the other buckets on disk.
Documents then find their owner by (length, SHA-256), which the tries have verified on full bytes: two texts of one
length and SHA-256 that differ stop the job. That join sees ids and hashes only, no texts.

Defined cases: null text counts as empty; rows with equal text and equal smallest id all count as kept (a repeated row);
a null id is never an owner unless all ids of the group are null; an empty table gives an empty table; only the id and the text are
read, so columns of other names don't matter; texts of any length are compared whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, slices, text_of

TRIE_BYTES, OUT_BYTES = 48 << 20, 4 << 20
#: A run of ASCII white space that isn't one space already.
ODD_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


class Patricia:
    """A compressed radix trie of byte strings; a terminal node holds [smallest id, rows, hash]."""

    __slots__ = ("bytes", "root")

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]  # edge label, children by first byte, terminal
        self.bytes = 0

    def add(self, key: bytes, low: int | None, rows: int, tag: object) -> list:
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node[2] is None:
                    node[2] = [low, rows, tag]
                else:
                    own = node[2]
                    own[0] = low if own[0] is None else own[0] if low is None else min(own[0], low)
                    own[1] += rows
                return node[2]
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = new = [key[at:], {}, [low, rows, tag]]
                self.bytes += len(key) - at + 200
                return new[2]
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = _common(label, key, at)
            node[1][key[at]] = middle = [label[:k], {label[k]: child}, None]
            child[0] = label[k:]
            self.bytes += 200
            node, at = middle, at + k

    def cut_off(self, goal: int) -> Iterator[tuple[bytes, list]]:
        """Cuts off the largest subtrees until they free `goal` bytes; gives the keys and ends that they held."""
        order, stack = [], [self.root]
        while stack:  # parents before children
            order.append(node := stack.pop())
            stack.extend(node[1].values())
        size: dict[int, int] = {}
        for node in reversed(order):
            size[id(node)] = len(node[0]) + 200 + sum(size[id(c)] for c in node[1].values())
        open_ = [(-size[id(c)], n, self.root, c, b"") for n, c in enumerate(self.root[1].values())]
        heapq.heapify(open_)
        number = len(open_)
        while open_ and goal > 0:
            held, _, parent, node, path = heapq.heappop(open_)
            if -held > goal and node[1]:  # a part of it is enough
                path += node[0]
                for c in node[1].values():
                    number += 1
                    heapq.heappush(open_, (-size[id(c)], number, node, c, path))
                continue
            del parent[1][node[0][0]]
            goal += held
            self.bytes += held
            yield from self.items(node, path)

    def items(self, node: list | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        stack = [(node or self.root, prefix)]
        while stack:
            (label, children, end), path = stack.pop()
            path += label
            if end is not None:
                yield path, end
            stack.extend((c, path) for c in children.values())


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common start of `label` and key[at:], which differ."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def normal_text(text: str | Column = "text") -> Column:
    """The text with each run of ASCII white space as one space."""
    return F.regexp_replace(text_of(text), ODD_RUN, " ")


_KEYS = ["_len", "_sha"]
_NAMES, _KINDS = ["_len", "_sha", "_text", "_low", "_rows"], [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
_OWNERS = "_len long, _sha binary, _low long, _rows long"


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text that the trie holds, subtree by subtree."""
    claim("exact_dedup")
    trie, head = Patricia(), 9

    def out(items: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for key, (low, n, sha) in items:
            rows.append((len(key) - head, sha, key[head:], low, n))
            size += len(key)
            if size > OUT_BYTES:
                yield _batch(rows, _KINDS, _NAMES)
                rows, size = [], 0
        yield _batch(rows, _KINDS, _NAMES)

    for b in slices(batches, "_text"):
        for doc_id, sha, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            trie.add(len(text).to_bytes(8, "big") + sha[:1] + text, doc_id, 1, sha)
        if trie.bytes > TRIE_BYTES:
            yield from out(trie.cut_off(trie.bytes - TRIE_BYTES // 2))
    yield from out(trie.items())


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The owner of each distinct text of a partition sorted by length and hash; one bucket's trie at a time."""
    bucket, trie, out = None, Patricia(), []

    def close() -> None:
        seen = set()
        for text, (low, rows, sha) in trie.items():
            if sha in seen:
                raise ValueError(f"two texts of {len(text)} bytes share the SHA-256 {sha.hex()}")
            seen.add(sha)
            out.append((len(text), sha, low, rows))

    kinds, names = [pa.int64(), pa.binary(), pa.int64(), pa.int64()], ["_len", "_sha", "_low", "_rows"]
    for b in slices(batches, "_text"):
        for n, sha, text, low, rows in zip(*(c.to_pylist() for c in b.columns)):
            if (n, sha[:4]) != bucket:
                close()
                bucket, trie = (n, sha[:4]), Patricia()
            trie.add(text, low, rows, sha)
        if len(out) > 5_000:
            yield _batch(out, kinds, names)
            out = []
    close()
    yield _batch(out, kinds, names)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def text_owners(keyed: DataFrame) -> DataFrame:
    """From _id, _sha, _text: for each distinct text its length, SHA-256, smallest id and rows."""
    local = keyed.select("_id", "_sha", F.encode("_text", "UTF-8").alias("_text")).mapInArrow(_local, "_len long, _sha binary, _text binary, _low long, _rows long")
    return local.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_owners, _OWNERS)


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    plain = docs.select(F.col(doc_id).cast("long").alias("_id"), normal_text(text).alias("_text"))
    keyed = plain.select("_id", F.unhex(F.sha2("_text", 256)).alias("_sha"), "_text")
    ids = keyed.select("_id", F.octet_length("_text").cast("long").alias("_len"), "_sha")
    return ids.join(text_owners(keyed), _KEYS).select(
        F.col("_id").alias("doc_id"), F.col("_low").alias("keep_id"), F.col("_rows").alias("group_size"), F.col("_id").eqNullSafe(F.col("_low")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256")
    )


def unique(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text no row of a smaller id has, decided by id and text: a row of the same id with another text stands for itself."""
    gone = exact_dedup(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_gone")).distinct()
    held = docs.withColumn("_sha", F.sha2(normal_text(), 256))
    return held.join(gone, (F.col("_sha") == F.col("_gone")) & held["doc_id"].eqNullSafe(F.col("_id")), "left_anti").select(*docs.columns)


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""
