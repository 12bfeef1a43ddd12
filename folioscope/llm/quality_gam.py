"""Quality classifier: a generalised additive model with pairwise interactions, boosted in cycles.

Each term is a lookup table over the bins of one feature, or of two. Boosting goes round the features; each visit fits
a shallow tree to the gradients in the feature's bins and adds its leaves to the table. The pairs whose bins explain
most of what is left get tables in the same way. A score is a sum of table entries: additions of looked-up bins, batch
by batch. Features come from the text alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _text

#: Labelled documents that a model is fitted on, at most in expectation.
FIT_ROWS = 20_000

FEATURES = (
    "log_chars", "log_words", "word_length", "letters", "upper", "digits", "stops", "marks", "exclaims", "bars", "log_lines", "line_length",
    "words_distinct", "words_same_as_last", "words_short", "words_long", "words_end_in_symbol", "grams_repeated",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _LOWER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789")
_WIDE = np.arange(256) >= 0x80
_LETTER, _STOP, _MARK, _EXCLAIM, _BAR, _LINE = _UPPER | _LOWER | _WIDE, _class(".,;:?"), _class("#*$%&<>@^~_=+{}[]\\"), _class("!"), _class("|"), _class("\n")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x FEATURES, of whole texts. An empty text has zeros throughout."""
    n = len(offsets) - 1

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    size = np.diff(offsets).astype(float)
    start, end, first = _text.words(data, offsets)
    words = np.diff(first).astype(float)
    doc = np.repeat(np.arange(n), np.diff(first))
    long = end - start
    h = _text.word_hashes(data, start, end)

    def by_doc(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[: len(mask)][mask], minlength=n).astype(float)

    def repeats(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        return np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(40)).astype(np.int64), minlength=n).astype(float)

    grams = _text.rolling(h, 8)
    inside = doc[: len(grams)] == doc[7:] if len(grams) else np.zeros(0, bool)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    lines = count(_LINE[data])
    some, w = np.maximum(size, 1), np.maximum(words, 1)
    columns = [
        np.log1p(size), np.log1p(words), by_doc_sum(long, doc, n) / w, count(_LETTER[data]) / some, count(_UPPER[data]) / some, count(_DIGIT[data]) / some, count(_STOP[data]) / some,
        count(_MARK[data]) / some, count(_EXCLAIM[data]) / some, count(_BAR[data]) / some, np.log1p(lines), np.log1p(size / (lines + 1)), 1 - repeats(h, doc) / w, by_doc(same) / w,
        by_doc(long <= 3) / w, by_doc(long > 14) / w, by_doc(~_LETTER[last] & ~_DIGIT[last] & ~_STOP[last]) / w, repeats(grams[inside], doc[: len(grams)][inside]) / w,
    ]
    return np.stack(columns, axis=1)


def by_doc_sum(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


@dataclass
class Model:
    """edges: bin borders of each feature; tables: a value for each bin; coarse: borders for pairs; pairs: (a, b, table)."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (edge, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edge, x[:, f], "right")]
        bins = {f: np.searchsorted(self.coarse[f], x[:, f], "right") for a, b, _ in self.pairs for f in (a, b)}
        for a, b, table in self.pairs:
            out += table[bins[a], bins[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def _gain(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / (h + l2)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """Leaf values of a shallow tree over ordered bins with gradient sums g and curvature sums h."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, -1)
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gain = _gain(gl, hl, l2) + _gain(g[a:b].sum() - gl, h[a:b].sum() - hl, l2) - _gain(g[a:b].sum(), h[a:b].sum(), l2)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], a + k + 1)
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """A tree of one cut along the first axis and one along the second in each half; its leaf values and gain."""
    best, out = -1.0, np.zeros_like(g)
    for cut in range(1, len(g)):
        value, leaves = 0.0, np.zeros_like(g)
        for part in (slice(0, cut), slice(cut, None)):
            gs, hs = g[part].sum(axis=0), h[part].sum(axis=0)
            leaf = _tree(gs, hs, 2, l2)
            leaves[part] = leaf
            value += float((gs * leaf - 0.5 * hs * leaf * leaf).sum())
        if value > best:
            best, out = value, leaves
    return out, best


def fit_arrays(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.1, bins: int = 32, leaves: int = 4, n_pairs: int = 8, coarse_bins: int = 8, l2: float = 1.0) -> Model:
    """A model of features x and labels y (0 or 1). No row, or one class only: the smoothed share of label 1 for every text."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Model(base)
    borders = lambda v, n: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1]))
    edges = [borders(x[:, f], bins) for f in range(x.shape[1])]
    coarse = [borders(x[:, f], coarse_bins) for f in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    margin = np.full(len(y), base)
    for _ in range(rounds):
        for f in range(x.shape[1]):
            p = 1 / (1 + np.exp(-margin))
            size = len(tables[f])
            step = rate * _tree(np.bincount(at[f], y - p, size), np.bincount(at[f], p * (1 - p), size), leaves, l2)
            tables[f] += step
            margin += step[at[f]]
    low = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    wide = [len(e) + 1 for e in coarse]

    def sums(a: int, b: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = low[a] * wide[b] + low[b]
        shape = (wide[a], wide[b])
        return np.bincount(cell, y - p, wide[a] * wide[b]).reshape(shape), np.bincount(cell, p * (1 - p), wide[a] * wide[b]).reshape(shape)

    p = 1 / (1 + np.exp(-margin))
    ranked = sorted(((_grid_tree(*sums(a, b, p), l2)[1], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)
    grids = {(a, b): np.zeros((wide[a], wide[b])) for _, a, b in ranked[:n_pairs]}
    for _ in range(rounds // 4):
        for (a, b), grid in grids.items():
            p = 1 / (1 + np.exp(-margin))
            step = rate * _grid_tree(*sums(a, b, p), l2)[0]
            grid += step
            margin += step[low[a], low[b]]
    return Model(base, edges, tables, coarse, [(a, b, g) for (a, b), g in grids.items()])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model:
    """A model of the documents that `labels` marks 0 or 1 in column `label`.

    At most about `fit_rows` labelled keys are drawn, by a hash of the key; that bounds both the keys that are
    broadcast and the feature rows that the driver gets. Several labels of one key count by their majority, a tie as
    1; null labels and keys teach nothing.
    """
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y")).where("key is not null and y in (0, 1)")
    n = marked.count()
    if not n:
        return Model(0.0)
    drawn = marked.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < min(1.0, fit_rows / n) * 1_000_000).groupBy("key").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), "key").select("y", "text").mapInArrow(_featured, f"y double, {', '.join(f'{c} double' for c in FEATURES)}").toPandas()
    rows = rows.sort_values(list(rows.columns))  # the model doesn't hang on the order of rows
    return fit_arrays(rows[list(FEATURES)].to_numpy(dtype=float), rows["y"].to_numpy(dtype=float))


def _featured(batches):
    for batch in batches:
        data, offsets = _text.flat(batch.column(1))
        for i, j in _text.pieces(offsets):
            x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *(pa.array(x[:, f]) for f in range(x.shape[1]))], ["y", *FEATURES])


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and score (0 to 1) for each row of docs; a null text scores as an empty one."""
    names = [f"k{i}" for i in range(len(keep))]
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            data, offsets = _text.flat(batch.column(len(names)))
            for i, j in _text.pieces(offsets):
                x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in range(len(names))), pa.array(sent.value.score(x))], [*names, "score"])
        _text.released()

    out = docs.select(*(F.col(c).alias(n) for n, c in zip(names, keep)), F.col(text).cast("string").alias("text")).mapInArrow(run, f"{kinds}, score double")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), "score")
