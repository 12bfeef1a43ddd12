"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of a bounded, stratified sample of labelled documents where they lie; the driver gets one
number for each language and bucket, a size that the parameters fix. Scoring sends the log-probability matrix
(buckets x languages) to the executors and sums, batch by batch, the rows that the n-grams of each text pick out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _text

#: Buckets of the n-gram hash.
BUCKETS = 1 << 15
#: Labelled documents that a model is fitted on, at most in expectation; each language gets an equal share.
FIT_ROWS = 20_000
#: Languages x buckets, at most: the matrix goes to the driver and the executors (16 bytes a cell on the way). More is an error.
MOST_CELLS = 1 << 23
UNKNOWN = "und"


def _grams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams of one, two and three characters, first n-gram of each text). Two spaces stand before and after a text."""
    chars = [len(t) + 2 for t in texts]
    flat = np.frombuffer(("  " + "  ".join(texts) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(flat) - 2
    one, two, three = flat[:n], flat[1 : n + 1], flat[2 : n + 2]
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    uni = one * a
    bi = (uni ^ two) * b
    tri = (bi ^ three) * c
    out = np.empty((n, 3), dtype=np.int64)
    for k, h in enumerate((uni, bi, tri)):
        out[:, k] = (h * a) >> shift
    starts = np.zeros(len(texts), dtype=np.int64)
    np.cumsum(chars[:-1], out=starts[1:])
    return out.reshape(-1), starts * 3


@dataclass
class Model:
    """languages: the label values in order; matrix: buckets x languages, log-probabilities; prior: log."""

    languages: list[str]
    matrix: np.ndarray
    prior: np.ndarray

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability."""
        n = len(self.languages)
        if not n or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        grams, starts = _grams(texts, len(self.matrix))
        total = np.empty((len(texts), n))
        for k in range(0, n, 8):
            total[:, k : k + 8] = np.add.reduceat(np.take(self.matrix[:, k : k + 8], grams, axis=0), starts, axis=0, dtype=np.float64)
        total += self.prior
        best = total.argmax(axis=1)
        top = total[np.arange(len(texts)), best]
        return [self.languages[k] for k in best], 1 / np.exp(total - top[:, None]).sum(axis=1)


def _strings(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> list[str]:
    raw = data[offsets[i] : offsets[j]].tobytes()
    at = (offsets[i : j + 1] - offsets[i]).tolist()
    return [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(at, at[1:])]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", buckets: int = BUCKETS, fit_rows: int = FIT_ROWS, alpha: float = 0.1) -> Model:
    """A model of the rows whose label isn't null; null and empty texts teach nothing. No such row: a model without languages."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.col(key).alias("key")).where("lang is not null and text is not null and text <> ''")
    sizes = {r["lang"]: r["n"] for r in docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_CELLS // buckets + 1).collect()}
    if len(sizes) > MOST_CELLS // buckets:
        raise ValueError(f"over {MOST_CELLS // buckets} languages")
    if not sizes:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0))
    share = fit_rows / len(sizes)
    rate = F.element_at(F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, share / n))))), F.col("lang"))
    sample = rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(1_000_000)) < rate * 1_000_000)

    languages = sorted(sizes)
    number = {x: k for k, x in enumerate(languages)}

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = _text.flat(batch.column(1))
            langs = batch.column(0).to_pylist()
            for i, j in _text.pieces(offsets, 1 << 18):
                grams, starts = _grams(_strings(data, offsets, i, j), buckets)
                cuts = [*starts.tolist(), len(grams)]
                for k in range(j - i):
                    own = total.setdefault(langs[i + k], np.zeros(buckets, np.int64))
                    own += np.bincount(grams[cuts[k] : cuts[k + 1]], minlength=buckets)
        for name, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number[name], np.int32)), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])
        _text.released()

    counted = sample.select("lang", "text").mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    where, bucket, n = (counted.column(c).to_numpy() for c in ("lang", "bucket", "n"))
    taught = np.unique(where)  # a language whose drawn texts are all empty teaches nothing
    languages = [languages[k] for k in taught]
    counts = np.zeros((buckets, len(languages)))
    counts[bucket, np.searchsorted(taught, where)] = n
    matrix = np.log((counts + alpha) / (counts.sum(axis=0) + alpha * buckets))
    prior = np.array([sizes[x] for x in languages], dtype=float)
    return Model(languages, np.ascontiguousarray(matrix.astype(np.float32)), np.log(prior / prior.sum()) if len(prior) else prior)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred and score, a row for each row of docs. A text that is null or has no letter: `und`, score 0."""
    names = [f"k{i}" for i in range(len(keep))]
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        for batch in batches:
            data, offsets = _text.flat(batch.column(len(names)))
            for i, j in _text.pieces(offsets, 1 << 17):  # the rows of the matrix that n-grams pick out are a hundred times their text
                texts = _strings(data, offsets, i, j)
                langs, score = own.score(texts)
                letters = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
                langs = [x if k else UNKNOWN for x, k in zip(langs, letters.tolist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in range(len(names))), pa.array(langs, pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64())], [*names, "lang_pred", "score"])
            _text.released()

    out = docs.select(*(F.col(c).alias(n) for n, c in zip(names, keep)), F.col(text).cast("string").alias("text")).mapInArrow(run, f"{kinds}, lang_pred string, score double")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), "lang_pred", "score")
