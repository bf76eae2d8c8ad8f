"""Interpolated modified Kneser-Ney model of any order from two, counted in Spark, stored as sorted arrays and mapped by workers.

Words: runs between ASCII white space with A to Z lower-cased, then one end token a text; a text's first word follows a start mark.
1. Unigram counts by word hash (64 bits), partly aggregated by task, summed in Spark and written sorted as the vocabulary:
   its positions are word numbers. All counts are exact over the whole training corpus.
2. For each order n from 2: an n-gram is 64 bits, the number of the (n-1)-gram before and that of the word. Each task sorts those of its texts
   and sends their counts to ranges of contexts as compressed runs of differences; each range, about RANGE tokens (more as the root of a
   corpus beyond some ten billion), is merged into one array of last words, sorted within each context, with the place where each context
   starts; positions in it number the n-grams. Contexts' numbers follow hashes, so ranges are about even.
3. Each distinct n-gram then counts for its last n-1 words: these are the counts of the order below, but what begins with the
   start mark keeps its own. Ranges also yield the counts of counts for the three discounts, and sums after contexts of over FEW words.
4. Workers map the arrays and look up the sorted distinct n-grams of a slice of texts at a time.

p(w|h) = (c(hw) - D(c)) / c(h) + gamma(h) * p(w|h less its first word), at last p(w) = (N(.w) - D'(N)) / N(..) + gamma' / (V + 1), with N(.w) the
distinct words before w; 1/(V+1) also goes to any unknown word. A context not seen leaves p as it is.
The folder is of the shared file system named by spark.checkpoint.dir; writing a file twice gives the same file.

Defined cases: null text is empty (only the end token); an empty training corpus gives every token 1/(V+1) = 1, score 0;
repeated rows count as often as they stand; a row with a null id has crc32 null and trains.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, new_shared_path, release, slices, word_hashes
from .language_id import held_out

RANGE, ROOT, FEW, MAPPED = 4_000_000, 2_000, 32, 8_192
_U = np.uint64


def _save(path: str, array: np.ndarray) -> None:
    """Writes a file whole or not at all, so that a task may run twice."""
    part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        h, c = _merged(held)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    for b in slices(batches, "text"):
        hashes, _ = word_hashes(b.column(0).to_pylist())
        if len(hashes):
            u, c = np.unique(hashes, return_counts=True)
            held.append((u, c.astype(np.int64)))
            size += len(u)
            if size > 2_000_000:
                held[:] = [_merged(held)]
                size = len(held[0][0])
                if size > 1_500_000:
                    yield out()
                    held.clear()
                    size = 0
    if held:
        yield out()


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not runs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = np.concatenate([k for k, _ in runs]), np.concatenate([c for _, c in runs])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct keys as differences, bytes of one weight together, then counts, compressed."""
    gaps = np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T
    high = int(counts.max()) if len(counts) else 0
    kind = np.uint8 if high < 256 else np.uint32 if high < 2**32 else np.uint64
    head = np.array([len(keys), np.dtype(kind).itemsize], np.uint64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + gaps.tobytes() + counts.astype(kind).tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, wide = (int(x) for x in np.frombuffer(raw, np.uint64, 2))
    gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 16).reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(gaps, dtype=np.uint64), np.frombuffer(raw, f"u{wide}", n, 16 + 8 * n).astype(np.int64)


class _Vocabulary:
    """Word numbers by hash, from mapped files of one hash range each."""

    def __init__(self, folder: str):
        names = sorted(x for x in os.listdir(folder) if x.startswith("words-") and x.endswith(".npy"))
        counts = [np.load(os.path.join(folder, x.replace("words-", "counts-")), mmap_mode="r") for x in names]
        self.files = [(np.load(os.path.join(folder, x), mmap_mode="r"), c) for x, c in zip(names, counts)]
        self.files = [f for f in self.files if len(f[0])]
        self.first = np.array([f[0][0] for f in self.files], np.uint64)
        self.base = np.concatenate([[0], np.cumsum([len(f[0]) for f in self.files])]).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1 if unknown) and count of sorted hashes."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.append(np.searchsorted(hashes, self.first), len(hashes))
        for k, (words, counts) in enumerate(self.files):
            own = hashes[cuts[k] : cuts[k + 1]]
            if len(own):
                at = np.searchsorted(words, own)
                at[at == len(words)] = 0
                ok = words[at] == own
                number[cuts[k] : cuts[k + 1]] = np.where(ok, at + self.base[k], -1)
                count[cuts[k] : cuts[k + 1]] = np.where(ok, counts[at], 0)
        return number, count


_OPEN: dict[str, object] = {}


def _opened(kind: type, folder: str, *args: int):
    key = f"{kind.__name__}:{folder}:{args}"
    if key not in _OPEN:
        for k in [k for k in _OPEN if folder not in k]:
            del _OPEN[k]
        _OPEN[key] = kind(folder, *args)
    return _OPEN[key]


def _tokens(texts: list[str | None], words: _Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in a row: number and count of each token, and past-last token of each text."""
    hashes, ends = word_hashes(texts)
    u, back = np.unique(hashes, return_inverse=True)
    number, count = words.numbers(u)
    return number[back], count[back], ends


def _before(ids: np.ndarray, ends: np.ndarray, first: int) -> np.ndarray:
    """The number at the token before, `first` at the start of a text."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.concatenate([[0], ends[:-1]])] = first
    return out


def _edges(ranges: int, of: int) -> np.ndarray:
    """First numbers of even ranges, and the end."""
    return np.array([-(-r * max(of, 1) // ranges) for r in range(ranges + 1)], np.int64)


class NgramModel:
    """A trained model: its folder and the few numbers that all share."""

    def __init__(self, folder: str, tokens: int, kinds: int, ranges: int, sizes: list[int], low: list[float], high: list[list[float]], pairs: int, gamma_low: float):
        self.folder, self.tokens, self.kinds, self.ranges, self.sizes = folder, tokens, kinds, ranges, sizes  # sizes: distinct n-grams, of words first
        self.low, self.high, self.pairs, self.gamma_low = low, high, pairs, gamma_low  # discounts of words and of each order above, distinct bigrams


def _path(folder: str, what: str, n: int, r: int) -> str:
    return os.path.join(folder, f"{what}-{n}-{r}.npy")


class _Level:
    """The mapped n-grams of one order by range of contexts: `last` has their last words, `starts` where each context's begin."""

    def __init__(self, folder: str, n: int, ranges: int, contexts: int, bits: int):
        self.folder, self.n, self.bits = folder, n, _U(bits)
        self.sizes = np.load(os.path.join(folder, f"sizes-{n}.npy"))
        self.base = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.first = _edges(ranges, contexts)
        self.held: dict[tuple[int, str], np.ndarray] = {}

    def array(self, r: int, what: str) -> np.ndarray:
        """An array of a range, mapped when it's asked for; at most MAPPED are open at a time."""
        if (r, what) not in self.held:
            if len(self.held) >= MAPPED:
                self.held.clear()
            self.held[r, what] = np.load(_path(self.folder, what, self.n, r), mmap_mode="r")
        return self.held[r, what]

    def _cuts(self, ctx: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """Ranges with the parts of sorted contexts that are theirs, and the first and past-last places of these."""
        cut = np.searchsorted(ctx, self.first)
        for r in np.flatnonzero((cut[1:] > cut[:-1]) & (self.sizes > 0)).tolist():
            own, starts = slice(cut[r], cut[r + 1]), self.array(r, "starts")
            at = ctx[own] - self.first[r]
            yield r, own, starts[at].astype(np.int64), starts[at + 1].astype(np.int64)

    def _counts(self, r: int, at: np.ndarray) -> np.ndarray:
        c = self.array(r, "times")[at].astype(np.int64)
        full = np.flatnonzero(c == 255)
        if len(full):
            c[full] = self.array(r, "most")[np.searchsorted(self.array(r, "often"), at[full])]
        return c

    def find(self, ctx: np.ndarray, number: np.ndarray, counts: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: not there) of n-grams of context and word, and their counts (0)."""
        ids, c = np.full(len(ctx), -1, np.int64), np.zeros(len(ctx), np.int64)
        ask = np.flatnonzero((ctx >= 0) & (number >= 0))
        keys, back = np.unique(ctx[ask].astype(np.uint64) << self.bits | number[ask].astype(np.uint64), return_inverse=True)
        got, times = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        words = (keys & ((_U(1) << self.bits) - _U(1))).astype(np.int64)
        for r, own, lo, hi in self._cuts((keys >> self.bits).astype(np.int64)):
            there, wanted, end = self.array(r, "last"), words[own], hi.copy()
            live = np.flatnonzero(lo < hi)
            while len(live):  # halves what is left of each
                mid = (lo[live] + hi[live]) >> 1
                less = there[mid] < wanted[live]
                lo[live] = np.where(less, mid + 1, lo[live])
                hi[live] = np.where(less, hi[live], mid)
                live = live[lo[live] < hi[live]]
            ok = lo < end
            ok[ok] = there[lo[ok]] == wanted[ok]
            at = np.where(ok, lo, 0)
            got[own] = np.where(ok, at + self.base[r], -1)
            if counts:
                times[own] = np.where(ok, self._counts(r, at), 0)
        ids[ask], c[ask] = got[back], times[back]
        return ids, c

    def parts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context and last word of n-grams by number."""
        u, back = np.unique(ids, return_inverse=True)
        ctx, word, cut = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64), np.searchsorted(u, self.base)
        for r in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            own = slice(cut[r], cut[r + 1])
            at = u[own] - self.base[r]
            ctx[own] = np.searchsorted(self.array(r, "starts"), at, "right") - 1 + self.first[r]
            word[own] = self.array(r, "last")[at]
        return ctx[back], word[back]

    def sums(self, ctx: np.ndarray) -> np.ndarray:
        """After each of sorted distinct contexts: the total count, and kinds with count 1, 2 and more."""
        out = np.zeros((len(ctx), 4), np.int64)
        for r, own, lo, hi in self._cuts(ctx):
            size = hi - lo
            few = np.flatnonzero((size > 0) & (size <= FEW))
            if len(few):
                start = np.cumsum(size[few]) - size[few]
                at = np.repeat(lo[few] - start, size[few]) + np.arange(size[few].sum())
                out[own.start + few] = _few_sums(self._counts(r, at), start)
            many = np.flatnonzero(size > FEW)
            if len(many):
                out[own.start + many] = self.array(r, "sums")[np.searchsorted(self.array(r, "many"), ctx[own][many])]
        return out


def _sums(c: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The total of each group of counts that begins at `start`, and how many are 1, 2 and more."""
    return np.stack([np.add.reduceat(x.astype(np.int64), start) for x in (c, c == 1, c == 2, c > 2)], 1)


def _few_sums(c: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The same of groups of at most FEW counts, in two passes."""
    kinds = np.add.reduceat(np.array([0, 1, 1 << 16, 1 << 32], np.int64)[np.minimum(c, 3)], start)
    return np.stack([np.add.reduceat(c, start), kinds & 0xFFFF, kinds >> 16 & 0xFFFF, kinds >> 32], 1)


def _finish(folder: str, n: int, r: int, starts: np.ndarray, first: int, c: np.ndarray) -> None:
    """Writes the counts of a range whose first context is `first`, the sums after its contexts of many words, and its counts of counts."""
    size = np.diff(starts.astype(np.int64))
    there = np.flatnonzero(size)
    many = size[there] > FEW
    often = np.flatnonzero(c >= 255)
    of = np.array([(c == i).sum() for i in (1, 2, 3, 4)], np.int64)
    for what, x in (("times", np.minimum(c, 255).astype(np.uint8)), ("often", often), ("most", c[often]), ("many", there[many] + first), ("sums", _sums(c, starts[there].astype(np.int64))[many]), ("of", of)):
        _save(_path(folder, what, n, r), x)


def discounts(n: list[int]) -> list[float]:
    """The three discounts from how many kinds have count 1, 2, 3 and 4; 0.5, 1 and 1.5 where these don't allow it, as none may be 0."""
    if min(n[:4]) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        found = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
        if all(0 < d <= k for k, d in enumerate(found, 1)):
            return found
    return [0.5, 1.0, 1.5]


def _less(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def train(docs: DataFrame, order: int = 2) -> NgramModel:
    """The model of the text column of all rows."""
    if order < 2:
        raise ValueError("the order is two or more")
    spark = docs.sparkSession
    folder = new_shared_path(spark, "ngrams")
    counted = docs.select("text").mapInArrow(_unigrams, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    # unsigned order of hashes is that of their signed values with the top bit turned
    turned = counted.select((F.col("h").bitwiseXOR(F.lit(-(1 << 63)))).alias("k"), "c")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in batches:
            k.append(b.column(0).to_numpy(zero_copy_only=False))
            c.append(b.column(1).to_numpy(zero_copy_only=False))
        k, c = np.concatenate(k), np.concatenate(c)
        if len(k):
            h = k.view(np.uint64) ^ _U(1 << 63)
            order = np.argsort(h)
            name = f"{int(h[order[0]]):020d}.npy"
            _save(os.path.join(folder, "counts-" + name), c[order])
            _save(os.path.join(folder, "words-" + name), h[order])
            yield pa.RecordBatch.from_arrays([pa.array([len(k)]), pa.array([int(c.sum())])], names=["kinds", "tokens"])

    total = turned.repartitionByRange("k").mapInArrow(write, "kinds long, tokens long").agg(F.sum("kinds"), F.sum("tokens")).first()
    kinds, tokens = total[0] or 0, total[1] or 0
    del counted, turned
    release(spark)
    ranges, bits, sizes = max(1, -(-tokens // max(RANGE, math.isqrt(ROOT * tokens)))), kinds.bit_length(), [kinds]
    contexts = [kinds + 1]  # the start mark has the number past the last word's
    for n in range(2, order + 1):
        if (contexts[-1] - 1).bit_length() + bits > 63:
            raise ValueError(f"more distinct words and {n - 1}-grams than 63 bits")
        _count(docs, folder, n, order, ranges, kinds, contexts, bits)
        release(spark)
        each = [len(np.load(x, mmap_mode="r")) if os.path.exists(x := _path(folder, "last", n, r)) else 0 for r in range(ranges)]
        _save(os.path.join(folder, f"sizes-{n}.npy"), np.array(each, np.int64))
        sizes.append(sum(each))
        contexts.append(sizes[-1])
        for r in range(ranges):
            if n > 2 and os.path.exists(x := _path(folder, "raw", n - 1, r)):
                os.remove(x)
    of = [sum((np.load(x) for r in range(ranges) if os.path.exists(x := _path(folder, "of", n, r))), np.zeros(4, np.int64)).tolist() for n in range(1, order + 1)]
    low, pairs = discounts(of[0]), sizes[1]
    gamma = (low[0] * of[0][0] + low[1] * of[0][1] + low[2] * (kinds - of[0][0] - of[0][1])) / pairs if pairs else 1.0
    return NgramModel(folder, tokens, kinds, ranges, sizes, low, [discounts(x) for x in of[1:]], pairs, gamma)


def _levels(folder: str, n: int, ranges: int, contexts: list[int], bits: int) -> list[_Level]:
    """The orders from 2 to n."""
    return [_opened(_Level, folder, k, ranges, contexts[k - 2], bits) for k in range(2, n + 1)]


def _count(docs: DataFrame, folder: str, n: int, order: int, ranges: int, kinds: int, contexts: list[int], bits: int) -> None:
    """Writes the n-grams, the counts of the order below, and if n is the highest order its own."""
    first, mask = _edges(ranges, contexts[n - 2]), _U((1 << bits) - 1)
    edge = first.astype(np.uint64) << _U(bits)

    def sent(runs: list[tuple[np.ndarray, np.ndarray]], edges: np.ndarray) -> pa.RecordBatch:
        k, c = _merged(runs)
        cut = np.searchsorted(k, edges)
        own = [(r, pack(k[cut[r] : cut[r + 1]], c[cut[r] : cut[r + 1]])) for r in range(ranges) if cut[r + 1] > cut[r]]
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in own], pa.int32()), pa.array([x for _, x in own], pa.binary())], names=["r", "run"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngrams", _OPEN.clear)
        words, levels, held, size = _opened(_Vocabulary, folder), _levels(folder, n - 1, ranges, contexts, bits), [], 0
        for b in slices(batches, "text"):
            if b.num_rows:
                number, _, ends = _tokens(b.column(0).to_pylist(), words)
                ctx = _before(number, ends, kinds)
                for level in levels:
                    ctx = _before(level.find(ctx, number)[0], ends, -1)
                ok = ctx >= 0
                k, c = np.unique(ctx[ok].astype(np.uint64) << _U(bits) | number[ok].astype(np.uint64), return_counts=True)
                held.append((k, c.astype(np.int64)))
                size += len(k)
                if size > max(4_000_000, 64 * ranges):
                    yield sent(held, edge)
                    held.clear()
                    size = 0
        if held:
            yield sent(held, edge)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Ranges with their merged runs."""
        now, held = None, []
        for b in batches:
            for r, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if r != now and now is not None:
                    yield now, *_merged(held)
                    held = []
                now = r
                if run is not None:
                    held.append(unpack(run))
                if len(held) > 1 and sum(len(x[0]) for x in held) > 2 * RANGE:
                    held = [_merged(held)]
        if now is not None:
            yield now, *_merged(held)

    def last(levels: list[_Level], ids: np.ndarray) -> np.ndarray:
        """Numbers of the last words but one of n-grams by number, of the order of the last of levels."""
        if not levels:
            raise ValueError("a word has no last words but one")
        before, word = levels[-1].parts(ids)
        return levels[-2].find(last(levels[:-1], before), word)[0] if len(levels) > 1 else word

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = _levels(folder, n - 1, ranges, contexts, bits)
        for r, k, c in ranged(batches):
            ids, at = (k & mask).astype(np.int64), (k >> _U(bits)).astype(np.int64) - first[r]
            starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=first[r + 1] - first[r]))])
            starts = starts.astype(np.uint32 if len(k) < 2**32 else np.uint64)
            _save(_path(folder, "last", n, r), ids.astype(np.uint32 if bits <= 32 else np.uint64))
            _save(_path(folder, "starts", n, r), starts)
            if n == order:
                _finish(folder, n, r, starts, first[r], c)
            else:
                _save(_path(folder, "raw", n, r), c.astype(np.uint32 if c.max() < 2**32 else np.uint64))
            if levels:
                ids = levels[-1].find(last(levels, (k >> _U(bits)).astype(np.int64)), ids)[0]
            u, times = np.unique(ids, return_counts=True)
            yield sent([(u.astype(np.uint64), times.astype(np.int64))], (levels[-1].base if levels else _edges(ranges, kinds)).astype(np.uint64))

    def adjust(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = _levels(folder, n - 1, ranges, contexts, bits)
        for r, k, c in ranged(batches):
            if n == 2:
                edges = _edges(ranges, kinds)
                x = np.zeros(edges[r + 1] - edges[r], np.int64)
                x[k.astype(np.int64) - edges[r]] = c
                _save(_path(folder, "before", 1, r), x)
                _save(_path(folder, "of", 1, r), np.array([(x == i).sum() for i in (1, 2, 3, 4)], np.int64))
            elif levels[-1].sizes[r]:
                x = np.load(_path(folder, "raw", n - 1, r)).astype(np.int64)
                x[k.astype(np.int64) - levels[-1].base[r]] = c  # what nothing comes before begins with the start mark
                _finish(folder, n - 1, r, levels[-1].array(r, "starts"), levels[-1].first[r], x)
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32())], names=["r"])

    runs = docs.select("text").mapInArrow(grams, "r int, run binary").repartition("r").sortWithinPartitions("r")
    every = docs.sparkSession.range(ranges).select(F.col("id").cast("int").alias("r"), F.lit(None).cast("binary").alias("run"))  # no range is left out
    below = runs.mapInArrow(merge, "r int, run binary").union(every).repartition("r").sortWithinPartitions("r")
    below.mapInArrow(adjust, "r int").count()


def score(docs: DataFrame, model: NgramModel) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every text."""
    m = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngrams", _OPEN.clear)
        words, bits = _opened(_Vocabulary, m.folder), m.kinds.bit_length()
        levels = _levels(m.folder, len(m.sizes), m.ranges, [m.kinds + 1, *m.sizes[1:]], bits)
        edges, uniform = _edges(m.ranges, m.kinds), 1 / (m.kinds + 1)
        for b in slices(batches, "text"):
            if not b.num_rows:
                continue
            number, count, ends = _tokens(b.column(1).to_pylist(), words)
            starts = np.concatenate([[0], ends[:-1]])
            base = np.log10((count + 1) / (m.tokens + m.kinds + 1))
            p = np.full(len(number), uniform)
            if m.pairs:
                u, back = np.unique(number, return_inverse=True)
                kinds_before, cut = np.zeros(len(u), np.int64), np.searchsorted(u, edges)
                for r in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                    kinds_before[cut[r] : cut[r + 1]] = np.load(_path(m.folder, "before", 1, r), mmap_mode="r")[u[cut[r] : cut[r + 1]] - edges[r]]
                p = (np.maximum(kinds_before - _less(kinds_before, m.low), 0) / m.pairs + m.gamma_low * uniform)[back]
            ctx = _before(number, ends, m.kinds)
            for level, d in zip(levels, m.high):
                ids, c = level.find(ctx, number, counts=True)
                u, back = np.unique(ctx, return_inverse=True)
                rows = np.zeros((len(u), 4), np.int64)
                rows[u >= 0] = level.sums(u[u >= 0])
                total = np.maximum(rows[:, 0], 1)
                gamma = np.where(rows[:, 0] > 0, rows[:, 1:] @ np.array(d) / total, 1.0)
                p = np.maximum(c - _less(c, d), 0) / total[back] + gamma[back] * p
                ctx = _before(ids, ends, -1)
            logs = np.log10(np.maximum(p, 1e-300))
            out = [b.column(0), pa.array(ends - starts), pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)), pa.array(np.full(len(ends), m.tokens)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(logs, starts))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_table(docs: DataFrame, order: int = 2) -> DataFrame:
    """The scores of all documents by a model of those that aren't held out; perplexity is 10 ** (-score / n_tokens)."""
    model = train(docs.where(~held_out(7, 2)), order)
    out = score(docs, model).withColumn("held_out", held_out(7, 2))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
