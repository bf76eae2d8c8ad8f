"""Language identification by error-correcting output codes.

Each language has a codeword of bits; one binary classifier over byte n-grams (one to three bytes of lower-cased text, hashed to
DIMENSIONS buckets) predicts each bit. A bit's classifier is a log-odds table, the smoothed mean share of each n-gram in languages
whose bit is 1 against those whose bit is 0, with a border and a scale from the margins that all training documents have by that
table: the border parts the two kinds with errors alike, and their means lie at +1 and -1. Decoding sums for each codeword the bits' losses
exp(-margin), weighted by how well the bit does in training: half the log odds of its being right, by the distance of the
two kinds in their spread. The smallest sum wins; a small lead over the runner-up flags the text as ambiguous.

Two passes over all training documents, each an aggregation: n-gram shares by language, which are folded by bit in Spark, part by part
of the buckets, so that the driver holds one table of DIMENSIONS times bits (bits grow as the logarithm of the languages); then sums of margins
by bit. Nothing but the names of the languages and their numbers of documents grows with them on the driver.

Up to seven languages have the exhaustive code; more have seeded codewords of 15 and ten times the logarithm bits that differ widely.

Defined cases: null text or one without a letter is `und` with score 0; with no learned language all are `und`; of one
language only, all texts with letters are it; ties go to the language first in order; repeated rows and null ids get a row each;
an empty table gives an empty table; only doc_id, text and, in training, lang are read, so columns of other names don't matter. Texts of
any length are read whole and by the same arithmetic.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, cut, slices

DIMENSIONS, PARTS, SMOOTH, AMBIGUOUS = 1 << 15, 32, 0.05, 0.05


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n languages; no column or its opposite comes twice in the exhaustive code."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns).T.astype(float)
    rng, bits, best, far = np.random.default_rng(7), 15 + 10 * int(np.ceil(np.log2(n))), None, -1
    for _ in range(60):
        code = rng.choice((1.0, -1.0), (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        gap = (code.shape[1] - code @ code.T + 2 * code.shape[1] * np.eye(n)).min()
        if gap > far:
            best, far = code, gap
    return best


def buckets(text: str | None) -> np.ndarray | None:
    """Buckets of all n-grams of a whole text, or None without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    b = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(256) + b[1:]
    three = two[:-1] * np.uint32(256) + b[2:]
    spread = lambda x, k: ((x + np.uint32(k)) * np.uint32(2_654_435_761)) >> np.uint32(17)
    return np.concatenate([spread(b, 1 << 28), spread(two, 1 << 29), spread(three, 0)]).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language: the documents' n-gram shares added up, in PARTS rows."""
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for b in slices(batches, "text"):
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            at = buckets(text)
            if at is not None:
                c = np.bincount(at, minlength=DIMENSIONS)
                if lang not in sums:
                    sums[lang], docs[lang] = np.zeros(DIMENSIONS), 0
                sums[lang] += c / len(at)
                docs[lang] += 1
    rows = [(lang, k, docs[lang] if k == 0 else 0, v.tolist()) for lang, s in sums.items() for k, v in enumerate(np.split(s, PARTS))]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64())))], names=["lang", "part", "docs", "sums"])


class EcocModel:
    """weights: a column of log-odds per bit; border, scale and trust per bit."""

    def __init__(self, languages: list[str], weights: np.ndarray | None = None):
        self.languages, self.code = languages, codewords(len(languages))
        bits = self.code.shape[1]
        self.weights = np.zeros((DIMENSIONS, bits), np.float32) if weights is None else weights
        self.border, self.scale, self.trust = np.zeros(bits), np.ones(bits), np.ones(bits)

    def margins(self, at: np.ndarray) -> np.ndarray:
        """The mean log-odds of a text's n-grams for each bit, summed in float64 over its distinct n-grams, whatever its length."""
        times = np.bincount(at, minlength=DIMENSIONS)
        there = np.flatnonzero(times)
        return times[there] @ self.weights[there].astype(np.float64) / len(at)

    def calibrate(self, sums: np.ndarray) -> None:
        """sums: of each bit and each kind (bit 1, bit 0) the number of training documents, of their margins and squared margins."""
        n = np.maximum(sums[..., 0], 1)
        mean = sums[..., 1] / n
        spread = np.sqrt(np.maximum(sums[..., 2] / n - mean**2, 1e-12))
        apart = mean[:, 0] - mean[:, 1]
        good = (sums[..., 0].min(1) > 0) & (apart > 1e-9)
        both = spread.sum(1)
        self.border = np.where(good, (mean[:, 0] * spread[:, 1] + mean[:, 1] * spread[:, 0]) / both, 0.0)
        self.scale = np.where(good, np.maximum(apart / 2, 1e-9), 1.0)
        wrong = np.array([0.5 * math.erfc(d / math.sqrt(2)) for d in apart / both])
        self.trust = np.where(good, 0.5 * np.log((1 - wrong + 1e-3) / (wrong + 1e-3)), 1e-3)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """The weighted mean loss of each language's codeword."""
        z = (margins - self.border) / self.scale
        return (np.exp(np.clip(-self.code * z, -30, 30)) * self.trust).sum(1) / self.trust.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, a score from 0 to 1 and whether it is ambiguous."""
        at = buckets(text) if self.languages else None
        if at is None:
            return "und", 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = self.losses(self.margins(at))
        order = np.argsort(loss, kind="stable")
        near = np.exp(-np.minimum(4 * (loss - loss[order[0]]), 700))
        score = float(near[order[0]] / near.sum())
        return self.languages[order[0]], score, bool(loss[order[1]] - loss[order[0]] < AMBIGUOUS)


def _folded(sums: DataFrame, languages: list[str], docs: list[int]) -> np.ndarray:
    """The log-odds of each bucket and bit, from rows of lang, part and sums."""
    code, row = codewords(len(languages)), {x: i for i, x in enumerate(languages)}
    total, floor = np.array(docs, float), SMOOTH / DIMENSIONS

    def fold(t: pa.Table) -> pa.Table:
        at = np.array([row[x] for x in t.column("lang").to_pylist()])
        order = np.argsort(at)
        shares = np.zeros((len(languages), DIMENSIONS // PARTS))
        for k in order:
            shares[at[k]] = t.column("sums")[int(k)].values.to_numpy()
        p = np.round(shares / total[:, None], 12)
        one, two = (code > 0).astype(float), (code < 0).astype(float)
        odds = np.log((p.T @ one / one.sum(0) + floor) / (p.T @ two / two.sum(0) + floor))
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "odds": pa.array([odds.astype(np.float32).tobytes()], pa.binary())})

    parts = {r["part"]: r["odds"] for r in sums.groupBy("part").applyInArrow(fold, "part int, odds binary").toLocalIterator()}  # PARTS rows
    return np.concatenate([np.frombuffer(parts[k], np.float32).reshape(-1, code.shape[1]) for k in range(PARTS)])


def _sums_of_margins(train: DataFrame, model: EcocModel) -> np.ndarray:
    """Of each bit and kind: documents, and sums of their margins and squared margins."""
    shared, shape = train.sparkSession.sparkContext.broadcast(model), (model.code.shape[1], 2, 3)
    row = {x: i for i, x in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language_id")
        m, out = shared.value, np.zeros(shape)
        for b in slices(batches, "text"):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = buckets(text)
                if at is not None:
                    v = m.margins(at)
                    own = np.stack([np.ones_like(v), v, v * v], 1)
                    side = m.code[row[lang]] > 0
                    out[side, 0] += own[side]
                    out[~side, 1] += own[~side]
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], names=["v"])

    each = train.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    found = {r["at"]: r["v"] for r in each.collect()}  # six numbers a bit
    return np.array([found.get(i, 0.0) for i in range(math.prod(shape))]).reshape(shape)


def fit(train: DataFrame) -> EcocModel:
    """The model of columns text and lang, from all rows with a lang."""
    train = train.where("lang is not null").select("text", "lang")
    counts = train.mapInArrow(_count, "lang string, part int, docs long, sums array<double>")
    each = counts.select("lang", "part", "docs", F.posexplode("sums").alias("at", "v")).groupBy("lang", "part", "at").agg(F.sum("v").alias("v"), F.sum("docs").alias("docs"))
    sums = cut(each.groupBy("lang", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("sums"), F.max("docs").alias("docs")))
    known = sorted((r["lang"], r["docs"]) for r in sums.where("part = 0").select("lang", "docs").toLocalIterator())
    languages = [x for x, _ in known]
    if len(languages) < 2:
        return EcocModel(languages)
    model = EcocModel(languages, _folded(sums.select("lang", "part", "sums"), languages, [n for _, n in known]))
    model.calibrate(np.round(_sums_of_margins(train, model), 6))
    return model


def predict(docs: DataFrame, model: EcocModel) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS floats of 4 bytes for each bit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language_id")
        m = shared.value
        for b in slices(batches, "text"):
            got = [m.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(modulus: int, remainder: int) -> F.Column:
    """Whether crc32 of the id as text leaves the remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))


def language_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learned from documents that aren't held out."""
    model = fit(docs.where(~held_out(5, 0)))
    return predict(docs, model).withColumn("held_out", held_out(5, 0)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
