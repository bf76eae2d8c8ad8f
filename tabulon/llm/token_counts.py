"""Token counts that follow edits: a segment tree of pre-tokens for each document.

A leaf holds the pre-tokens of one stretch of text (about LEAF of them) with its sums of characters, pre-tokens and tokens; inner
nodes hold the sums of their halves. An edit re-encodes the leaves it touches, with a few pre-tokens before it as context, and goes
on to the right only until the new pre-token borders meet old ones; then the sums on the paths to the root are updated.

`count_trees` makes the trees as rows that can be stored; `edit_trees` takes stored trees and a table of edits and gives the trees
after them: leaves that no edit touches keep their text and sums and aren't scanned or encoded again, and documents without
edits pass as they are. `token_counts` builds and edits in one pass. Pre-tokens of a slice of documents are counted together, each
distinct one once, in tries that share their prefixes (`bpe`).

Defined cases: null text counts as empty; null edits, or edits with a null part, change nothing (a null insert deletes);
positions beyond the text are cut to it; edits apply in list order, each to the text the earlier ones left; an empty table gives
an empty table; repeated rows and null ids pass row by row, and stored trees with a null id have no edits; of several
rows of edits for one id each gives a row of its own; columns besides those named are not read; a text of any length is one tree, encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import TrieBpe, tokenizer
from .bpe import forget as bpe_forget
from .common import claim, slices

LEAF, COUNTS_HELD, KEPT_CHARS, SLICE = 64, 400_000, 64, 4 << 20
EDITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("insert", T.StringType())]))
RESULT = "doc_id long, n_pretokens long, n_tokens long, n_pretokens_after long, n_tokens_after long, n_reencoded long"
TREES = "doc_id long, n_pretokens long, n_tokens long, n_reencoded long, leaves array<struct<text:string,chars:int,pretokens:int,tokens:int>>"
_LEAVES = pa.list_(pa.struct([("text", pa.string()), ("chars", pa.int32()), ("pretokens", pa.int32()), ("tokens", pa.int32())]))


class Counts:
    """Tokens of each pre-token, remembered up to COUNTS_HELD of at most KEPT_CHARS characters."""

    def __init__(self, bpe: TrieBpe):
        self.bpe, self.held, self.again, self.long = bpe, {}, set(), set()

    def learn(self, words: Iterable[str]) -> None:
        """Counts what isn't known yet. Where memory would outgrow its bound, what was asked for only once goes, and all if need be."""
        wanted = words if isinstance(words, set) else set(words)
        lacking = wanted.difference(self.held)
        self.again |= wanted - lacking
        if len(self.held) + len(lacking) > COUNTS_HELD:
            self.held = {w: n for w, n in self.held.items() if w in self.again}
            if len(self.held) + len(lacking) > 0.9 * COUNTS_HELD:
                self.held = {}
            self.again, lacking = set(), wanted.difference(self.held)
        symbols = {w: self.bpe.symbols(w) for w in lacking}
        known = self.bpe.count_words(list(symbols.values()))
        for w, s in symbols.items():
            self.held[w] = known[s]
        self.long.update(w for w in lacking if len(w) > KEPT_CHARS)

    def of(self, words: list[str]) -> list[int]:
        """Tokens of each of some pre-tokens."""
        try:
            return list(map(self.held.__getitem__, words))
        except KeyError:
            self.learn(words)
            return list(map(self.held.__getitem__, words))

    def forget_long(self) -> None:
        for w in self.long:
            self.held.pop(w, None)
        self.long.clear()


_COUNTS: dict[int, Counts] = {}


def forget() -> None:
    _COUNTS.clear()
    bpe_forget()


def counter(bpe: TrieBpe) -> Counts:
    return _COUNTS.setdefault(id(bpe), Counts(bpe))


def counts_of(bpe: TrieBpe, words: list[str]) -> list[int]:
    """Tokens of each pre-token."""
    return counter(bpe).of(words)


class CountTree:
    """The segment tree of one text; `reencoded` counts the pre-tokens encoded by edits. A leaf is its pre-tokens or, not scanned since it was stored, its text."""

    def __init__(self, bpe: TrieBpe, text: str = "", words: list[str] | None = None, stored: list[dict] | None = None):
        self.bpe, self.reencoded = bpe, 0
        if stored is not None:
            self.leaves: list[list[str] | str] = [x["text"] or "" for x in stored] or [[]]
        else:
            words = bpe.pattern.findall(text) if words is None else words
            self.leaves = [words[i : i + LEAF] for i in range(0, len(words), LEAF)] or [[]]
        n = len(self.leaves)
        self.width = 1 << (n - 1).bit_length()
        self.chars, self.tokens, self.pieces = ([0] * (2 * self.width) for _ in range(3))
        if stored:
            for at, name in ((self.chars, "chars"), (self.pieces, "pretokens"), (self.tokens, "tokens")):
                at[self.width : self.width + n] = [x[name] for x in stored]
        elif stored is None:
            counts = counts_of(bpe, words)
            for k, own in enumerate(self.leaves):
                self._fill(k, own, counts[k * LEAF : k * LEAF + LEAF])
        for at in (self.chars, self.tokens, self.pieces):
            for k in range(self.width - 1, 0, -1):
                at[k] = at[2 * k] + at[2 * k + 1]

    def stored(self) -> list[tuple[str, int, int, int]]:
        """The leaves as rows: text, characters, pre-tokens and tokens."""
        w = self.width
        return [(self._text(k), self.chars[w + k], self.pieces[w + k], self.tokens[w + k]) for k in range(len(self.leaves))]

    def _fill(self, k: int, words: list[str], counts: list[int]) -> None:
        n = self.width + k
        self.leaves[k] = words
        self.chars[n], self.tokens[n], self.pieces[n] = sum(map(len, words)), sum(counts), len(words)

    def _text(self, k: int) -> str:
        own = self.leaves[k]
        return own if isinstance(own, str) else "".join(own)

    def _words(self, k: int) -> list[str]:
        """The pre-tokens of a leaf; a stored one is scanned with the start of what follows, on which its last border depends."""
        own = self.leaves[k]
        if isinstance(own, str):
            words, left = [], len(own)
            for m in self.bpe.pattern.finditer(own + self._start(k + 1)):
                if left <= 0:
                    break
                words.append(m.group())
                left -= len(words[-1])
            own = self.leaves[k] = words
        return own

    def _start(self, k: int, n: int = 8) -> str:
        """The first characters of what leaves from k on hold."""
        out = ""
        while len(out) < n and k < len(self.leaves):
            out += self._text(k)[: n - len(out)]
            k += 1
        return out

    def _sum(self, k: int) -> None:
        for x in (self.chars, self.tokens, self.pieces):
            x[k] = x[2 * k] + x[2 * k + 1]

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at`, and the characters before the leaf."""
        k, before = 1, 0
        while k < self.width:
            k *= 2
            if at >= before + self.chars[k] and self.chars[k + 1]:
                before += self.chars[k]
                k += 1
        return k - self.width, before

    @property
    def text(self) -> str:
        return "".join(map(self._text, range(len(self.leaves))))

    def edit(self, start: int, stop: int, insert: str) -> None:
        """Puts `insert` in place of characters start to stop."""
        start = min(max(start, 0), self.chars[1])
        stop = min(max(stop, start), self.chars[1])
        if start == stop and not insert:
            return
        first, before = self._leaf_at(max(0, start - 1))
        while first and start - before < 8:  # context to the left: borders depend on the two characters that follow
            first -= 1
            before -= self.chars[self.width + first]
        last, end = self._leaf_at(stop)
        end += self.chars[self.width + last]
        old: list[str] = [w for k in range(first, last + 1) for w in self._words(k)]
        scanned = "".join(old)
        while True:
            lead = start - before
            text = scanned[:lead] + insert + scanned[stop - before :]
            shift, at = len(insert) - (stop - start), before
            borders = set()
            for w in old:
                borders.add(at + shift)
                at += len(w)
            tail = self._start(last + 1)
            words, at, met = [], before, None
            for m in self.bpe.pattern.finditer(text + tail):
                if at in borders and at >= start + len(insert) and at + 8 <= before + len(text):
                    met = at
                    break
                words.append(m.group())
                at += len(words[-1])
            if met is not None:  # from here on the old borders hold
                rest, at = [], before
                for w in old:
                    if at + shift >= met:
                        rest.append(w)
                    at += len(w)
                fresh, words = len(words), words + rest
                break
            if last + 1 >= len(self.leaves):
                words = self.bpe.pattern.findall(text)
                fresh = len(words)
                break
            last += 1
            old += self._words(last)
            scanned += "".join(self._words(last))
        self.reencoded += fresh
        counts = counts_of(self.bpe, words)
        share = -(-len(words) // (last - first + 1))
        for k in range(first, last + 1):
            i = (k - first) * share
            self._fill(k, words[i : i + share], counts[i : i + share])
        nodes = {(self.width + k) >> 1 for k in range(first, last + 1)}
        while nodes and 0 not in nodes:
            for k in nodes:
                self._sum(k)
            nodes = {k >> 1 for k in nodes}


def _apply(tree: CountTree, edits: list[dict] | None) -> None:
    for e in edits or []:
        if e and e["start"] is not None and e["stop"] is not None:
            tree.edit(e["start"], e["stop"], e["insert"] or "")


def _trees(bpe: TrieBpe, texts: list[str | None]) -> Iterator[CountTree]:
    """The trees of a slice of texts, whose pre-tokens are learned together."""
    words = [bpe.scan(t or "") for t in texts]
    counter(bpe).learn(set().union(*words))
    for own in words:
        yield CountTree(bpe, words=own)


def _table(rows: list[tuple], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")][: len(kinds)]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=names)


def count_trees(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The tree of each document as a row: doc_id, n_pretokens, n_tokens, n_reencoded (0) and its leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("counts", forget)
        bpe = tokenizer(path)
        for b in slices(batches, "text", SLICE):
            made = zip(b.column(0).to_pylist(), _trees(bpe, b.column(1).to_pylist()))
            yield _table([(i, t.pieces[1], t.tokens[1], 0, [dict(zip(("text", "chars", "pretokens", "tokens"), x)) for x in t.stored()]) for i, t in made], [pa.int64()] * 4 + [_LEAVES], TREES)
            counter(bpe).forget_long()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, TREES)


def edit_trees(trees: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """Stored trees after a table of edits (doc_id, edits): the same columns, n_reencoded being the pre-tokens that these edits encoded."""
    ids = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("edits").cast(EDITS).alias("edits"))
    columns = ["doc_id", "n_pretokens", "n_tokens", "n_reencoded", "leaves"]
    held = trees.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("counts", forget)
        bpe = tokenizer(path)
        for b in slices(batches, "leaves", SLICE):
            rows = []
            for doc_id, _, _, _, leaves, changes in zip(*(c.to_pylist() for c in b.columns)):
                tree = CountTree(bpe, stored=leaves or [])
                _apply(tree, changes)
                rows.append((doc_id, tree.pieces[1], tree.tokens[1], tree.reencoded, [dict(zip(("text", "chars", "pretokens", "tokens"), x)) for x in tree.stored()]))
            yield _table(rows, [pa.int64()] * 4 + [_LEAVES], TREES)
            counter(bpe).forget_long()

    changed = held.join(ids, "doc_id").select(*columns, "edits").mapInArrow(run, TREES)
    same = held.join(ids.select("doc_id"), "doc_id", "left_anti").select("doc_id", "n_pretokens", "n_tokens", F.lit(0).cast("long").alias("n_reencoded"), "leaves")
    return changed.unionByName(same)


def token_counts(docs: DataFrame, path: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """Counts of each document before and after its edits, an array of (start, stop, insert) in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("counts", forget)
        bpe = tokenizer(path)
        for b in slices(batches, "text", SLICE):
            rows = []
            for doc_id, tree, changes in zip(b.column(0).to_pylist(), _trees(bpe, b.column(1).to_pylist()), b.column(2).to_pylist()):
                n = tree.pieces[1], tree.tokens[1]
                _apply(tree, changes)
                rows.append((doc_id, *n, tree.pieces[1], tree.tokens[1], tree.reencoded))
            yield _table(rows, [pa.int64()] * 6, RESULT)
            counter(bpe).forget_long()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(edits).alias("edits")).mapInArrow(run, RESULT)


def stated_edits() -> F.Column:
    """Three edits that every document gets in the query: a banner at the start, words amid it replaced, its end cut."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    half = F.floor(n / 2).cast("long")
    edit = lambda start, stop, insert: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), F.lit(insert).alias("insert"))
    return F.array(edit(F.lit(0), F.lit(0), "Revised edition. "), edit(half, half + 12, " it's the amended clause "), edit(n, n + 40, ""))
