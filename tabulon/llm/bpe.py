"""Byte-pair encoding and decoding by a prefix-sharing trie.

The encoding of a prefix is settled by its last token alone: a token `t` that ends the prefix is the last one exactly when
it is joined lawfully to the last token of what is before it. So each trie node needs one state, found from its
ancestors' states, and words with a common prefix share all states of that prefix. Distinct words that aren't in the
bounded cache are put into a trie in sorted groups and a depth-first walk fills the states. A trie is TRIE_DEPTH deep; what a word has
beyond that is walked from its node without nodes of its own, so an unbroken text of millions of letters needs a list of tokens.

Defined cases: null text encodes as empty (no ids, decoded ""); an empty table gives an empty table; the strings of special
tokens in a text give their ids; repeated rows and any doc_id, null too, pass through row by row. Columns other than the
text stay untouched; the result column replaces one of the same name. Texts are encoded whole whatever their length, one at a time if
they are longer than a slice.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, slices

#: Entries of a worker's cache of encoded pieces, distinct words put into one trie, and characters of the texts whose
#: new pieces are encoded together, bytes of texts in hand, and joins of two tokens whose lawfulness is remembered.
CACHE_PIECES, TRIE_WORDS, GROUP_CHARS, SLICE, JOINS_HELD = 700_000, 20_000, 1 << 20, 4 << 20, 500_000
#: Characters that one trie holds at most, its depth, and the longest piece that the cache keeps beyond its group.
TRIE_CHARS, TRIE_DEPTH, KEPT_CHARS = 1 << 18, 64, 64
_REST = "more"  # of a node: words that go on below the trie's depth
_SPACE = regex.compile(r"\p{White_Space}+")
_ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class TrieBpe:
    """A vocabulary file of the tokenizers library (model BPE, byte-level) with encoding by last-token states.

    Tokens are known by rank inside: single symbols first, then merges in their order.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError("a BPE vocabulary is needed")
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in pairs}
        self.suffix = model.get("end_of_word_suffix") or ""
        ranks = {t: i for i, t in enumerate(sorted((t for t in vocab if t not in made), key=vocab.get))}
        self.base = len(ranks)
        self.split: list[tuple[int, int]] = [(i, i) for i in range(self.base)]
        self.pairs: dict[tuple[int, int], int] = {}
        self._valid: dict[tuple[int, int], bool] = {}
        sound = [True] * self.base
        for a, b in pairs:
            left, right, t = ranks[a], ranks[b], len(self.split)
            ranks[a + b] = t
            self.split.append((left, right))
            self.pairs[left, right] = t
        for t in range(self.base, len(self.split)):
            left, right = self.split[t]
            sound.append(sound[left] and sound[right] and self._joins(left, right, t))
        self.ids = np.zeros(len(self.split), np.int32)
        self.mid: dict[str, int] = {}
        self.end: dict[str, int] = {}
        for token, t in ranks.items():
            self.ids[t] = vocab[token]
            if sound[t]:
                if self.suffix and token.endswith(self.suffix):
                    self.end[token[: -len(self.suffix)]] = t
                else:
                    self.mid[token] = t
        for table in (self.mid, self.end):  # every ending of a token leads to the token, or to -1 where it's none itself
            for token in list(table):
                for k in range(1, len(token)):
                    table.setdefault(token[k:], -1)
        if not self.suffix:
            self.end = self.mid
        self.rank_ids = self.ids.tolist()
        self._ends: list[dict[str, tuple[tuple[int, int], ...]]] = [{}, {}]  # of mid and end: the tokens that end a string, longest first
        self.longest = max(map(len, [*self.mid, *self.end]))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._bytes = byte_alphabet()
        self._ascii = {i: c for i, c in enumerate(self._bytes)}
        normal, pre = json.dumps(spec["normalizer"]), spec["pre_tokenizer"]
        self.words = "Lowercase" in normal  # else the vocabulary keeps case and white space
        if self.words:
            pattern = next(p["pattern"]["Regex"] for p in pre["pretokenizers"] if p["type"] == "Split")
        else:
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        # \s is White_Space in the vocabularies' own engine, which leaves out the four ASCII separators
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        # the same borders in ASCII text, found faster
        self._ascii_pattern = None if self.words else re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
        self.cache: dict[str, bytes] = {}
        self.again: set[str] = set()  # cached pieces that a later group asked for

    def _joins(self, one: int, two: int, limit: int = 1 << 60) -> bool:
        """Whether no merge of rank below `limit` would cross the border between tokens `one` and `two`."""
        while True:
            made = self.pairs.get((one, two))
            if made is not None and made < limit:
                return False
            if one > two:
                limit, one = one, self.split[one][1]
                if one == limit:
                    limit, two = two + 1, self.split[two][0]
                    if two + 1 == limit:
                        return True
            else:
                limit, two = two + 1, self.split[two][0]
                if two + 1 == limit:
                    limit, one = one, self.split[one][1]
                    if one == limit:
                        return True

    def symbols(self, word: str) -> str:
        """A word as byte symbols."""
        if word.isascii():
            return word.translate(self._ascii)
        return "".join(map(self._bytes.__getitem__, word.encode("utf-8", "replace")))

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Int32 ids, as bytes, of each distinct non-empty word given in byte symbols: a trie for each sorted group."""
        ids = self.rank_ids
        return self._walked(words, lambda path: array("i", [ids[t] for t in path]).tobytes())

    def count_words(self, words: list[str]) -> dict[str, int]:
        """The number of tokens of each distinct non-empty word given in byte symbols."""
        return self._walked(words, len)

    def _walked(self, words: list[str], of: Callable[[list[int]], object]) -> dict:
        words, out = sorted(set(words)), {}
        collecting = gc.isenabled()
        gc.disable()  # the tries have no cycles; walking them again and again would cost most of the time
        try:
            i = 0
            while i < len(words):
                root, size, stop = {}, 0, min(i + TRIE_WORDS, len(words))
                while i < stop and size < TRIE_CHARS:
                    w, node = words[i], root
                    for c in w[:TRIE_DEPTH]:
                        node = node.setdefault(c, {})
                    if len(w) <= TRIE_DEPTH:
                        node[""] = w
                    else:
                        node.setdefault(_REST, []).append(w)
                    size, i = size + min(len(w), TRIE_DEPTH), i + 1
                self._walk(root, out, of)
        finally:
            if collecting:
                gc.enable()
        return out

    def _last(self, kind: int, tail: str, depth: int, tokens: list[int]) -> int:
        """The last token of the prefix of length `depth` that ends in `tail`; tokens: that of each shorter prefix."""
        table, n = self.end if kind else self.mid, len(tail)
        k = min(n, 4)  # every ending of a string in the table is there too: look for the longest from amid
        own = tail[n - k :]
        if own in table:
            while k < n and tail[n - k - 1 :] in table:
                k += 1
            own = tail[n - k :]
        else:
            while own and own not in table:
                own = own[1:]
        ends = self._ends[kind].get(own)
        if ends is None:
            ends = self._ends[kind][own] = tuple((len(own) - i, table[own[i:]]) for i in range(len(own)) if table[own[i:]] >= 0)
        valid = self._valid
        for size, t in ends:
            if size == depth:
                return t
            pair = (tokens[depth - size], t)
            ok = valid.get(pair)
            if ok is None:
                if len(valid) > JOINS_HELD:
                    valid.clear()
                ok = valid[pair] = self._joins(*pair)
            if ok:
                return t
        raise ValueError("a symbol is missing from the vocabulary")

    def _walk(self, root: dict, out: dict, of: Callable[[list[int]], object]) -> None:
        length, last, longest = self._lengths(), self._last, self.longest
        tokens: list[int] = [-1]

        def path(w: str) -> None:
            """The tokens of a word all of whose shorter prefixes have theirs."""
            at = len(w)
            found = [last(1, w[max(0, at - longest) :], at, tokens)]
            at -= length[found[0]]
            while at:
                found.append(tokens[at])
                at -= length[tokens[at]]
            found.reverse()
            out[w] = of(found)

        stack = [(c, n, 1, "") for c, n in root.items()]
        while stack:
            c, node, depth, tail = stack.pop()
            del tokens[depth:]
            w = node.get("")
            if w is not None:
                path(w)
                if len(node) == 1:
                    continue
            tail = (tail + c)[-longest:]
            tokens.append(last(0, tail, depth, tokens))
            for k, child in node.items():
                if k == _REST:
                    for w in child:
                        del tokens[depth + 1 :]
                        for d in range(depth + 1, len(w)):
                            tokens.append(last(0, w[max(0, d - longest) : d], d, tokens))
                        path(w)
                elif k:
                    stack.append((k, child, depth + 1, tail))

    def _lengths(self) -> list[int]:
        if not hasattr(self, "_length"):
            self._length = [1] * self.base
            for left, right in self.split[self.base :]:
                self._length.append(self._length[left] + self._length[right])
        return self._length

    def scan(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        return (self._ascii_pattern if self._ascii_pattern and text.isascii() else self.pattern).findall(text)

    def _pieces(self, text: str) -> list[str]:
        """A text without special tokens as the pieces that are cached whole."""
        if not self.words:
            return self.scan(text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [p for p in _SPACE.split(text) if p] if _ODD_SPACE.search(text) else text.split()

    def _learn(self, pieces: set[str], wanted: set[str]) -> None:
        """Puts pieces that the cache lacks into it. Where it would outgrow its bound, what no two groups asked for goes, and more if need be."""
        if len(self.cache) + len(pieces) > CACHE_PIECES:
            self.cache = {p: x for p, x in self.cache.items() if p in self.again or p in wanted}
            if len(self.cache) + len(pieces) > 0.9 * CACHE_PIECES:
                self.cache = {p: self.cache[p] for p in wanted if p in self.cache}
            self.again = set()
        # ASCII letters are one word, and their own symbols
        parts = {p: [p] if p.isalpha() and p.isascii() else [self.symbols(w) for w in self.pattern.findall(p)] if self.words else [self.symbols(p)] for p in pieces}
        known = self.encode_words([w for ws in parts.values() for w in ws])
        for p, ws in parts.items():
            self.cache[p] = known[ws[0]] if len(ws) == 1 else b"".join(map(known.__getitem__, ws))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Int32 ids, as bytes, of whole texts; the pieces of some texts at a time share tries."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            held, wanted, lacking, size = [], set(), set(), 0
            while at < len(texts) and size < GROUP_CHARS:
                text = texts[at] or ""
                segments = self._specials.split(text) if self._specials and any(map(text.__contains__, self.special)) else [text]
                split = [np.int32(self.special[s]).tobytes() if s in self.special else self._pieces(s) for s in segments]
                for pieces in split:
                    if isinstance(pieces, list):
                        lacking |= (new := set(pieces)).difference(self.cache)
                        wanted |= new
                held.append(split)
                size, at = size + len(text), at + 1
            self.again |= wanted - lacking
            if lacking:
                self._learn(lacking, wanted)
            known = self.cache.__getitem__
            out.extend(b"".join(x if isinstance(x, bytes) else b"".join(map(known, x)) for x in split) for split in held)
            for p in lacking:
                if len(p) > KEPT_CHARS:
                    del self.cache[p]
        return out


class Decoder:
    """What decoding needs of a vocabulary file, without merges and tries."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.strings = pa.array(_by_id({**spec["model"]["vocab"], **{x["content"]: x["id"] for x in spec["added_tokens"]}}), pa.string())
        self.joined = spec["decoder"] is None
        self.back = {ord(c): b for b, c in enumerate(byte_alphabet())}

    def decode_batch(self, ids: pa.ListArray) -> pa.Array:
        """Texts of id lists: for vocabularies without a decoder the tokens joined by a space, else the bytes they stand for."""
        lists = pa.ListArray.from_arrays(ids.offsets, pc.take(self.strings, ids.values))
        if self.joined:
            return pc.binary_join(lists, " ")
        return pa.array([bytes(self.back[ord(c)] for c in s).decode("utf-8", "replace") for s in pc.binary_join(lists, "").to_pylist()], pa.string())


def _by_id(vocab: dict[str, int]) -> list[str]:
    out = [""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        out[i] = t
    return out


_LOADED: dict[str, TrieBpe] = {}
_DECODERS: dict[str, Decoder] = {}


def tokenizer(path: str) -> TrieBpe:
    """The vocabulary at `path`, loaded once in each process."""
    if path not in _LOADED:
        _LOADED[path] = TrieBpe(path)
    return _LOADED[path]


def decoder(path: str) -> Decoder:
    """The decoder of the vocabulary at `path`, loaded once in each process."""
    if path not in _DECODERS:
        _DECODERS[path] = Decoder(path)
    return _DECODERS[path]


def forget() -> None:
    """Drops the vocabularies and caches of this process."""
    _LOADED.clear()
    _DECODERS.clear()


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def _rows(b: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(b.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), column], names=[*(b.schema.names[i] for i in keep), name])


def _encoder(path: str, text: str, to: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", forget)
        bpe = tokenizer(path)
        for b in slices(batches, text, SLICE):
            got = bpe.encode_batch(b.column(b.schema.get_field_index(text)).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got])]).astype(np.int32)
            yield _rows(b, to, pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(got), np.int32))))

    return run


def _decoder(path: str, ids: str, to: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", forget)
        own = decoder(path)
        for b in slices(batches, ids, SLICE):
            lists = b.column(b.schema.get_field_index(ids))
            lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int32)), lists.flatten())
            yield _rows(b, to, own.decode_batch(flat))

    return run


def bpe_encode(df: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """Adds `to`, the ids of every whole text (array of int)."""
    return df.mapInArrow(_encoder(path, text, to), _with(df, to, T.ArrayType(T.IntegerType())))


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds `to`, the text that the ids stand for; null ids give the empty text."""
    return df.mapInArrow(_decoder(path, ids, to), _with(df, to, T.StringType()))


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, derived from real ids and decoded texts; one worker does both."""
    encode, decode = _encoder(path, "text", "ids"), _decoder(path, "ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in decode(encode(batches)):
            yield b.select(["doc_id", "ids", "decoded"])

    both = docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
