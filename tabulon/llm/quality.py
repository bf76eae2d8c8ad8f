"""Quality classifier by hierarchical empirical Bayes.

A logistic model of plain text features gives each document's evidence (a log likelihood ratio). Hosts and paths have a rate of
good documents each; the rate of a path is shrunk toward its host's and that of a host toward the global one, by Beta priors whose
strengths are fitted by the method of moments. A document's posterior joins its evidence with its path's rate.

`source` is read as host/path; where it has no path, the language stands for it. The models are fitted on at most `sample`
labelled rows (smallest hashes first); rates come from all documents by grouped aggregation.
The target of `keep` is the label `quality`. The label `toxic` is another matter, as toxic texts may be well written: a second model, of
the hashed words that speak most for the label, gives `toxicity`, the probability by the text alone; it doesn't change `keep`.

Defined cases: null text has the features of the empty text, null source or lang are groups of their own; with no usable
label, or labels of one kind only, every evidence is 0 and the prior is the share of good labels (1 without labels), and toxicity 0;
documents with a null id have no label; labels that repeat or disagree count as they are; a posterior just at the threshold is kept; repeated
rows each get their result; an empty table gives an empty table. Extra columns of any name are kept, but for those named as a result,
which the result replaces. Texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, claim, cut, word_hashes

SAMPLE, THRESHOLD, RIDGE = 20_000, 0.5, 1.0
#: Up to so many bytes, counted before, the rates of paths are broadcast; beyond, they are joined by a shuffle with SALTS copies of each.
BROADCAST_BYTES, SALTS = 8 << 20, 16
#: Words of the second model at most, the documents of the label that each has at least, those without it at most, and the bits of a word's hash.
TOXIC_WORDS, TOXIC_LEAST, TOXIC_SAMPLE, WORD_BITS = 64, 3, 5_000, 20
SLICE = 1 << 20
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_DIGIT, _SPACE, _STOP = b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"-()?"
_SIGN = bytes(i for i in range(33, 127) if not chr(i).isalnum() and i not in _STOP)
_HIGH = bytes(range(128, 256))
_BANG = re.compile(rb"[!?]{2,}|[#$%&*]{2,}|\|")
FEATURES = 12
RESULTS = ["evidence", "toxicity", "host_rate", "path_rate", "posterior", "keep"]


def features(text: str | None) -> list[float]:
    """Shares and means that tell prose from junk, each between about 0 and 1."""
    b = (text or "").encode("utf-8", "replace")
    if not b.strip():
        return [1.0] + [0.0] * (FEATURES - 1)
    n, words = len(b), b.split()
    share = lambda kind: 1 - len(b.translate(None, kind)) / n
    lower = b.lower()
    low = lower.split()
    same = sum(map(bytes.__eq__, low[1:], low)) / max(1, len(low) - 1)
    lines = [x for x in b.split(b"\n") if x.strip()]
    marks = len(_BANG.findall(b)) / len(words)
    upper = share(_UPPER)
    return [1.0, upper, share(_SIGN), share(_DIGIT), share(_STOP), min(1.0, n / len(words) / 20), len(set(low)) / len(low), same, 1 - len(set(lines)) / max(1, len(lines)), min(1.0, marks), min(1.0, upper / (share(_LOWER) + share(_HIGH) + 0.01)), 1 / (1 + len(words) / 8)]


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; zeros where the labels are of one kind."""
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        return w
    ridge = np.full(x.shape[1], RIDGE / 10)
    ridge[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def words_in(texts: list[str | None]) -> list[np.ndarray]:
    """The hashed words, of letters only, of each text."""
    h, ends = word_hashes(texts, LETTERS)
    h = (h & np.uint64((1 << WORD_BITS) - 1)).astype(np.int32)
    return [h[s : e - 1] for s, e in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())]


class Model:
    """What scoring a text needs: the weights of the features, the prior of their sample, and the words and weights for toxicity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, words: list[np.ndarray], toxic: np.ndarray):
        self.weights, self.prior = fit(x, y), 0.0
        if self.weights.any():
            mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
            self.prior = math.log(mean / (1 - mean))
        self.words, self.toxic = np.zeros(0, np.int32), None
        bad, good = np.flatnonzero(toxic > 0), np.flatnonzero(toxic == 0)[:TOXIC_SAMPLE]  # not every label tells
        if len(bad) and len(good):
            n, rest = (np.bincount(np.concatenate([words[i] for i in rows]), minlength=1 << WORD_BITS) for rows in (bad, good))
            often = np.flatnonzero(n >= TOXIC_LEAST)
            odds = np.log((n[often] + 0.5) / len(bad)) - np.log((rest[often] + 0.5) / len(good))
            order = np.lexsort((often, -odds * np.sqrt(n[often])))[:TOXIC_WORDS]
            self.words = np.sort(often[order[odds[order] > 1]]).astype(np.int32)
            both = np.concatenate([bad, good])
            self.toxic = fit(np.array([self._row(words[i]) for i in both]), np.repeat([1.0, 0.0], [len(bad), len(good)]))

    @cached_property
    def _place(self) -> np.ndarray:
        """The column of each hashed word, 0 for others; made where it is used."""
        out = np.zeros(1 << WORD_BITS, np.int16)
        out[self.words] = np.arange(1, len(self.words) + 1)
        return out

    def _row(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.words) + 1)
        out[self._place[words]] = 1.0
        out[0] = 1.0
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_place"}

    def evidence(self, text: str | None) -> float:
        """The log likelihood ratio of a text: the model's logit less that of its own sample's prior."""
        return float(np.clip(np.dot(features(text), self.weights), -30, 30)) - self.prior

    def toxicity(self, words: np.ndarray) -> float:
        if self.toxic is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(np.dot(self._row(words), self.toxic), -30, 30))))


def _parts(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts, some SLICE bytes at a time."""
    step = max(1, int(len(texts) * SLICE / max(1, texts.nbytes)))
    for i in range(0, len(texts), step):
        yield texts.slice(i, step).to_pylist()


def _sample_row(text: Column) -> Column:
    @F.arrow_udf("struct<x:array<double>,words:binary>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim("quality")
        for a in texts:
            rows = [{"x": features(t), "words": w.tobytes()} for part in _parts(a) for t, w in zip(part, map(np.unique, words_in(part)))]
            yield pa.array(rows, pa.struct([("x", pa.list_(pa.float64())), ("words", pa.binary())]))

    return run(text)


def _scores(text: Column, model: Model) -> Column:
    kind = pa.struct([("evidence", pa.float64()), ("toxicity", pa.float64())])

    @F.arrow_udf("struct<evidence:double,toxicity:double>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim("quality")
        for a in texts:
            yield pa.array([{"evidence": model.evidence(t), "toxicity": model.toxicity(w)} for part in _parts(a) for t, w in zip(part, words_in(part))], kind)

    return run(text)


def _evidence(text: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim("quality")
        for a in texts:
            yield pa.array([model.evidence(t) for part in _parts(a) for t in part], pa.float64())

    return run(text)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Model, float]:
    """The models from a bounded sample of labelled rows, and the share of good labels over all of them."""
    good = labels.where("doc_id is not null and quality is not null")
    toxic = F.coalesce(F.col("toxic").cast("int"), F.lit(-1)) if "toxic" in labels.columns else F.lit(-1)
    good = good.select(F.col("doc_id").cast("long").alias("_id"), F.least(F.greatest(F.col("quality").cast("int"), F.lit(0)), F.lit(1)).alias("_y"), F.least(toxic, F.lit(1)).alias("_t"))
    total = good.agg(F.count("*"), F.sum("_y")).first()
    picked = good.orderBy(F.xxhash64("_id", "_y"), "_id", "_y", "_t").limit(sample)
    found = docs.select(F.col("doc_id").cast("long").alias("_d"), "text").join(F.broadcast(picked), F.col("_d") == F.col("_id"))  # at most `sample` rows of three numbers
    rows = found.select(_sample_row(F.col("text")).alias("s"), "_y", "_t").limit(sample).select("s.*", "_y", "_t").toArrow()
    share = (total[1] or 0) / total[0] if total[0] else 1.0
    x = np.array([v for c in rows.column("x").chunks for v in c.flatten().to_numpy()]).reshape(-1, FEATURES)
    words = [np.frombuffer(w.as_buffer(), np.int32) for w in rows.column("words")]
    y, toxic = (rows.column(c).to_numpy() for c in ("_y", "_t"))
    return Model(x, y.astype(float), words, toxic.astype(int)), min(max(share, 1e-3), 1 - 1e-3)


def _strength(n: Column, p: Column, mean: Column) -> Column:
    """The Beta prior's weight in documents, by moments over groups: mean*(1-mean)/variance - 1, kept between 1 and 10,000."""
    spread = F.sum(n * (p - mean) * (p - mean)) / F.sum(n)
    return F.least(F.greatest(F.avg(mean) * (1 - F.avg(mean)) / F.greatest(spread, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(10_000.0))


def host_of() -> Column:
    return F.coalesce(F.split_part(F.col("source"), F.lit("/"), F.lit(1)), F.lit(""))


def path_of() -> Column:
    return F.when(F.instr(F.col("source"), "/") > 0, F.col("source")).otherwise(F.coalesce(F.col("lang"), F.lit("")))


def rates(scored: DataFrame, share: float) -> tuple[DataFrame, int]:
    """host, path, host_rate and path_rate from columns host, path and evidence of all documents; and the bytes of it."""
    p = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(math.log(share / (1 - share))))))
    by_path = cut(scored.select("host", "path", p.alias("p")).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    g = by_host.agg(F.sum("hs") / F.sum("hn")).first()[0]
    g = share if g is None else g
    kh = by_host.agg(_strength(F.col("hn"), F.col("hs") / F.col("hn"), F.lit(g))).first()[0] or 1.0
    hosts = by_host.select("host", ((F.col("hs") + F.lit(kh * g)) / (F.col("hn") + F.lit(kh))).alias("host_rate"))
    paths = by_path.join(hosts, "host")
    kp = paths.agg(_strength(F.col("n"), F.col("s") / F.col("n"), F.col("host_rate"))).first()[0] or 1.0
    size = by_path.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    return paths.select("host", "path", "host_rate", ((F.col("s") + kp * F.col("host_rate")) / (F.col("n") + kp)).alias("path_rate")), size


def _judged(scored: DataFrame, by_path: DataFrame, size: int, threshold: float) -> DataFrame:
    """scored with host_rate, path_rate, posterior and keep, by the rates of paths and their bytes."""
    if size <= BROADCAST_BYTES:
        joined = scored.join(F.broadcast(by_path), ["host", "path"])
    else:  # a path may hold a third of all rows
        spread = by_path.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = scored.withColumn("salt", F.pmod(F.xxhash64("evidence", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, ["host", "path", "salt"]).drop("salt")
    rate = F.least(F.greatest(F.col("path_rate"), F.lit(1e-4)), F.lit(1 - 1e-4))
    return joined.withColumn("posterior", 1 / (1 + F.exp(-(F.col("evidence") + F.log(rate / (1 - rate)))))).withColumn("keep", F.col("posterior") >= threshold)


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs with columns evidence, toxicity, host_rate, path_rate, posterior and keep (posterior >= threshold).

    Evidence is computed twice, for the rates and for the rows, as keeping it with the texts would write all of them once more.
    """
    model, share = train(docs, labels, sample)
    scored = docs.select(F.struct("*").alias("doc"), host_of().alias("host"), path_of().alias("path"), _scores(F.col("text"), model).alias("s")).select("doc", "host", "path", "s.*")
    out = _judged(scored, *rates(docs.select(host_of().alias("host"), path_of().alias("path"), _evidence(F.col("text"), model).alias("evidence")), share), threshold)
    return out.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in RESULTS), *RESULTS)


def quality_table(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, host, path and the results, one row per document, without its text."""
    model, share = train(docs, labels, sample)
    scored = docs.select("doc_id", host_of().alias("host"), path_of().alias("path"), _scores(F.col("text"), model).alias("s"))
    scored = cut(scored.select("doc_id", "host", "path", "s.*"))
    return _judged(scored, *rates(scored, share), threshold).select("doc_id", "host", "path", *RESULTS)
