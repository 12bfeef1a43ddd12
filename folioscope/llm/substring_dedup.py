"""Substring deduplication with fixed-block anchors.

Every text is cut into non-overlapping reference blocks of half a window. A passage of a window's length holds such a
block of each text it stands in, so a block that some other place repeats anchors every repeat. Three passes, each over
chunks of documents (all documents of a chunk lie in one partition, shuffled once):

1. anchors: the hash of every rolling window of a block's length probes the index of block hashes. Both travel as
   sorted byte planes, one row for each chunk and range of hashes, so a probe costs a few bytes, and a hash that many
   documents hold travels once for each chunk.
2. extension: around the anchors that answered, the full windows are hashed anew (96 bits), and the smallest document
   is found for each, again pre-aggregated by chunk.
3. cover: windows that start in a smaller document are joined to maximal repeats and cut out.

A chunk's hashes go to at most FAN ranges, so its rows stay long whatever the table's size. Where one range of these
would be more than a task's, lots of chunks merge what they hold of a range and cut it again into finer ones; answers go
back the same way.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _text

WINDOW = 50
#: Bytes of text in a chunk, and hashes in a range, about. Larger ones mean fewer, longer rows; memory of a task grows with either.
CHUNK_BYTES, RANGE_HASHES = 4 << 20, 2_000_000
#: Ranges that a chunk's hashes are cut into, at most.
FAN = 1_024

_LAST = np.iinfo(np.int64).max
_PACKED = "bucket long, chunk int, n int, body binary"


def _pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of unsigned numbers as byte planes of the widths given; planes that hardly change compress well."""
    return b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for c, w in columns)


def _unpack(body: bytes, n: int, widths: tuple[int, ...]) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(body, np.uint8), [], 0
    for w in widths:
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :w] = raw[at : at + n * w].reshape(w, n).T
        out.append(planes.view("<u8").ravel().astype(np.uint64))
        at += n * w
    return out


@dataclass
class _Words:
    """The words of some texts: hashes, each text's first word (one more at the end), each word's text."""

    h: np.ndarray
    first: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> _Words:
        hs, firsts, base = [], [np.zeros(1, np.int64)], 0
        for i, j in _text.pieces(offsets):
            part = data[offsets[i] : offsets[j]]
            start, end, first = _text.words(part, offsets[i : j + 1] - offsets[i])
            hs.append(_text.word_hashes(part, start, end))
            firsts.append(first[1:] + base)
            base += len(start)
        first = np.concatenate(firsts)
        return cls(np.concatenate(hs) if hs else np.zeros(0, np.uint64), first, np.repeat(np.arange(len(first) - 1), np.diff(first)))

    def windows(self, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the window at each word, whether it ends inside the same text)."""
        h = _text.rolling(self.h, width, which)
        return h, self.doc[: len(h)] == self.doc[width - 1 :] if len(h) else np.zeros(0, bool)


def _spread(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places some half-open range covers."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


class _Set:
    """A sorted array of hashes with a quick no."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self._slot(self.values)] = True

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in x, places in the set) of what both hold."""
        if not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[self._slot(x)])
        k = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        hit = self.values[k] == x[at]
        return at[hit], k[hit]


def _rows(bucket: np.ndarray, chunk: int, body, schema: pa.Schema) -> pa.Table:
    """A packed row for each run of equal buckets; body(a, b) packs the entries a to b."""
    cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    bodies = [body(a, b) for a, b in zip(cut[:-1], cut[1:])]
    return pa.table([pa.array(bucket[cut[:-1]].astype(np.int64)), pa.array(np.full(len(bodies), chunk, np.int32)), pa.array(np.diff(cut).astype(np.int32)), pa.array(bodies, pa.binary())], schema=schema)


_PACKED_ARROW = pa.schema([("bucket", pa.int64()), ("chunk", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])


@dataclass(frozen=True)
class Ranges:
    """coarse ranges of a hash's upper half, each cut into `fine` ones of its lower half; lots of `lot` chunks merge first where fine > 1."""

    coarse: int
    fine: int = 1
    lot: int = 1

    @classmethod
    def of(cls, n: int, chunks: int, fan: int = FAN) -> Ranges:
        coarse = min(n, fan)
        fine = -(-n // coarse)
        return cls(coarse, fine, 1 if fine == 1 else max(1, min(chunks, RANGE_HASHES * coarse * 6 // CHUNK_BYTES)))

    def place(self, h: np.ndarray) -> np.ndarray:
        """The coarse range; it grows with the hash."""
        return ((h >> np.uint64(32)) * np.uint64(self.coarse)) >> np.uint64(32)

    def finer(self, h: np.ndarray) -> np.ndarray:
        """The fine range inside the coarse one, from bits that the coarse one doesn't read."""
        return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(self.fine)) >> np.uint64(32)

    @property
    def width(self) -> int:
        """Bytes of a fingerprint: 40 bits beside those that name the fine range."""
        return min(7, 5 + -(-(self.fine - 1).bit_length() // 8))

    def print(self, h: np.ndarray) -> np.ndarray:
        """The fingerprint of a hash; its lowest bit is left out, which sorting uses as a flag."""
        return (h >> np.uint64(1)) & np.uint64((1 << (8 * self.width)) - 1)


def _anchors(table: pa.Table, block: int, ranges: Ranges) -> pa.Table:
    """The probes and blocks of a chunk: distinct fingerprints by coarse range, whether a block is among them and whether it comes twice."""
    chunk = table.column("chunk")[0].as_py()
    words = _Words.of(*_text.flat(table.column("text")))
    h, inside = words.windows(block)
    at = np.flatnonzero(inside)
    is_block = (at - words.first[words.doc[at]]) % block == 0
    key = np.sort((h[at] & ~np.uint64(1)) | is_block.astype(np.uint64))
    own = key >> np.uint64(1)
    last = np.append(own[1:] != own[:-1], True) if len(own) else np.zeros(0, bool)
    first = np.append(True, last[:-1]) if len(own) else last
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    flag = (key[b] & np.uint64(1)) | ((b > a).astype(np.uint64) << np.uint64(1))
    own = ranges.print(key[a])
    return _rows(ranges.place(key[a]).astype(np.int64), chunk, lambda i, j: _pack((own[i:j], ranges.width), (flag[i:j], 1)), _PACKED_ARROW)


def _merged_anchors(table: pa.Table, ranges: Ranges) -> pa.Table:
    """A lot's rows of a coarse range as rows of fine ones, each fingerprint once."""
    bucket, lot = table.column("bucket")[0].as_py(), table.column("lot")[0].as_py()
    got = [_unpack(body.as_py(), n, (ranges.width, 1)) for body, n in zip(table.column("body"), table.column("n").to_pylist())]
    fp, flag = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    fine = ranges.finer(fp)
    order = np.lexsort((fp, fine))
    fp, flag, fine = fp[order], flag[order], fine[order]
    a = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
    flag = np.bitwise_or.reduceat(flag, a) | ((np.diff(np.append(a, len(fp))) > 1).astype(np.uint64) << np.uint64(1))
    fp, fine = fp[a], fine[a]
    return _rows(fine.astype(np.int64) + bucket * ranges.fine, lot, lambda i, j: _pack((fp[i:j], ranges.width), (flag[i:j], 1)), _PACKED_ARROW)


def _routed_anchors(chunks: pa.Table, answers: pa.Table, ranges: Ranges) -> pa.Table:
    """A lot's answers of a coarse range, for each of its chunks what that holds."""
    if not len(chunks) or not len(answers):
        return _PACKED_ARROW.empty_table()
    live = _Set(np.concatenate([_unpack(body.as_py(), n, (ranges.width,))[0] for body, n in zip(answers.column("body"), answers.column("n").to_pylist())]))
    out = []
    for bucket, chunk, n, body in zip(*(chunks.column(c).to_pylist() for c in ("bucket", "chunk", "n", "body"))):
        own = _unpack(body, n, (ranges.width, 1))[0]
        at, _ = live.find(own)
        if len(at):
            out.append((bucket, chunk, len(at), _pack((own[at], ranges.width))))
    return _packed_table(out)


def _packed_table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PACKED_ARROW)], schema=_PACKED_ARROW)


def _answer_anchors(table: pa.Table, ranges: Ranges) -> pa.Table:
    """For each chunk's row of a range: the fingerprints that are a block somewhere and stand in two places."""
    counts, chunks = table.column("n").to_pylist(), table.column("chunk").to_pylist()
    bucket = table.column("bucket")[0].as_py()
    got = [_unpack(body.as_py(), n, (ranges.width, 1)) for body, n in zip(table.column("body"), counts)]
    fp, flag = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    order = np.argsort(fp, kind="stable")
    fp, flag = fp[order], flag[order]
    begin = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
    many = (np.diff(np.append(begin, len(fp))) > 1) | (np.bitwise_or.reduceat(flag, begin) & np.uint64(2) > 0)
    live = _Set(fp[begin][many & (np.bitwise_or.reduceat(flag, begin) & np.uint64(1) > 0)])
    out = []
    for c, (own, _) in zip(chunks, got):
        at, _ = live.find(own)
        if len(at):
            out.append((bucket, c, len(at), _pack((own[at], ranges.width))))
    return _packed_table(out)


def _windows(docs: pa.Table, answers: pa.Table, window: int, block: int, ranges: Ranges, out_ranges: Ranges) -> pa.Table:
    """The windows around a chunk's answered anchors: hash, second hash, smallest document and whether there are several."""
    if not len(docs) or not len(answers):
        return _PACKED_ARROW.empty_table()
    chunk = docs.column("chunk")[0].as_py()
    words = _Words.of(*_text.flat(docs.column("text")))
    start = _candidates(words, answers, window, block, ranges)
    if not len(start):
        return _PACKED_ARROW.empty_table()
    ids = _ids(docs)
    h, extra = words.windows(window)[0][start], words.windows(window, 1)[0][start] >> np.uint64(32)
    names, own = np.unique(ids[words.doc[start]], return_inverse=True)
    order = np.lexsort((own, extra, h))
    h, extra, own = h[order], extra[order], own[order]
    same = (h[1:] == h[:-1]) & (extra[1:] == extra[:-1])
    a = np.flatnonzero(np.append(True, ~same))
    several = np.maximum.reduceat(own, a) > own[a]
    least = names[own[a]].view(np.uint64)
    return _window_rows(out_ranges.place(h[a]), chunk, h[a], extra[a], least, several)


def _window_rows(bucket: np.ndarray, chunk: int, h: np.ndarray, extra: np.ndarray, least: np.ndarray, several: np.ndarray) -> pa.Table:
    # the smallest documents come first as a list of their own, then each window's place in it
    def body(i: int, j: int) -> bytes:
        lot, place = np.unique(least[i:j], return_inverse=True)
        return np.uint32(len(lot)).tobytes() + lot.tobytes() + _pack((h[i:j], 8), (extra[i:j], 4), (place.astype(np.uint64), 4), (several[i:j].astype(np.uint64), 1))

    return _rows(bucket.astype(np.int64), chunk, body, _PACKED_ARROW)


def _merged_windows(table: pa.Table, ranges: Ranges) -> pa.Table:
    """A lot's rows of a coarse range as rows of fine ones, each window once."""
    bucket, lot = table.column("bucket")[0].as_py(), table.column("lot")[0].as_py()
    got = [_read_windows(n, body.as_py()) for n, body in zip(table.column("n").to_pylist(), table.column("body"))]
    h, extra, least, several = (np.concatenate([g[k] for g in got]) for k in range(4))
    fine = ranges.finer(h)
    order = np.lexsort((least, extra, h, fine))
    h, extra, least, several, fine = (x[order] for x in (h, extra, least, several, fine))
    a = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (extra[1:] != extra[:-1])))
    several = np.maximum.reduceat(several, a) | (np.maximum.reduceat(least, a) > least[a])
    return _window_rows(fine[a].astype(np.int64) + bucket * ranges.fine, lot, h[a], extra[a], least[a].view(np.uint64), several)


def _routed_windows(chunks: pa.Table, answers: pa.Table) -> pa.Table:
    """A lot's answers of a coarse range, for each of its chunks what that holds of them and a smaller document too."""
    if not len(chunks) or not len(answers):
        return _PACKED_ARROW.empty_table()
    parts = [_unpack(body.as_py(), n, (8, 4, 8)) for n, body in zip(answers.column("n").to_pylist(), answers.column("body"))]
    h, extra, top = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((extra, h))
    h, extra, top = h[order], extra[order], top[order].view(np.int64)
    out = []
    for bucket, chunk, n, body in zip(*(chunks.column(c).to_pylist() for c in ("bucket", "chunk", "n", "body"))):
        own, second, least, several = _read_windows(n, body)
        own, second, least, several = (x[np.lexsort((second, own))] for x in (own, second, least, several))
        # both lists sorted as one: a row of the chunk that follows an answer of its own
        both, rest = np.concatenate([h, own]), np.concatenate([extra, second])
        order = np.lexsort((np.repeat([0, 1], [len(h), len(own)]), rest, both))
        a, b = order[:-1], order[1:]
        hit = (a < len(h)) & (b >= len(h)) & (both[a] == both[b]) & (rest[a] == rest[b])
        a, b = a[hit], b[hit] - len(h)
        a, b = (x[(top[a] < least[b]) | several[b]] for x in (a, b))
        if len(a):
            out.append((bucket, chunk, len(a), _pack((h[a], 8), (extra[a], 4), (top[a].view(np.uint64), 8))))
    return _packed_table(out)


def _candidates(words: _Words, answers: pa.Table, window: int, block: int, ranges: Ranges) -> np.ndarray:
    """Starts of the windows that hold an answered anchor."""

    def named(bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return _text.splitmix(bucket) ^ fp

    live = [named(np.full(n, b, np.uint64), _unpack(body, n, (ranges.width,))[0]) for b, n, body in zip(*(answers.column(c).to_pylist() for c in ("bucket", "n", "body")))]
    h, inside = words.windows(block)
    at, _ = _Set(np.concatenate(live)).find(named(ranges.place(h), ranges.print(h)))
    at = at[inside[at]]
    doc = words.doc[at]
    low = np.maximum(words.first[doc], at - (window - block))
    high = np.minimum(at, words.first[doc + 1] - window) + 1
    some = high > low
    return np.flatnonzero(_spread(low[some], high[some], len(words.h)))


def _ids(docs: pa.Table) -> np.ndarray:
    return docs.column("id").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)


def _read_windows(n: int, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = int(np.frombuffer(body, np.uint32, 1)[0])
    lot = np.frombuffer(body[4 : 4 + 8 * size], np.int64)
    h, extra, place, several = _unpack(body[4 + 8 * size :], n, (8, 4, 4, 1))
    return h, extra, lot[place.astype(np.int64)], several > 0


def _answer_windows(table: pa.Table) -> pa.Table:
    """For each chunk's row of a range: the windows that a smaller document holds too, with the smallest of all."""
    bucket = table.column("bucket")[0].as_py()
    got = [_read_windows(n, body.as_py()) for n, body in zip(table.column("n").to_pylist(), table.column("body"))]
    h, extra, least, several = (np.concatenate([g[k] for g in got]) for k in range(4))
    row = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
    order = np.lexsort((least, extra, h))
    h, extra, least, several, row = (x[order] for x in (h, extra, least, several, row))
    begin = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (extra[1:] != extra[:-1])))
    top = np.repeat(least[begin], np.diff(np.append(begin, len(h))))
    keep = (top < least) | several
    chunks = table.column("chunk").to_pylist()
    kept = np.flatnonzero(keep)
    kept = kept[np.argsort(row[kept], kind="stable")]
    cut = np.searchsorted(row[kept], np.arange(len(got) + 1))
    out = [(r, kept[a:b]) for r, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
    rows = [(bucket, chunks[r], len(at), _pack((h[at], 8), (extra[at], 4), (top[at].view(np.uint64), 8))) for r, at in out]
    return _packed_table(rows)


def _cover(docs: pa.Table, answers: pa.Table, window: int, text_out: bool, whole: bool) -> pa.Table:
    """The result of a chunk's documents: words, removed words and the kept words, as text or digest, then the columns from the fifth on."""
    carried = docs.column_names[4:]
    names = ["id", "real", "n_words", "n_removed", "kept", *carried]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), *(docs.schema.field(c).type for c in carried)]
    if not len(docs):
        return pa.table([pa.array([], k) for k in kinds], names=names)
    ids = _ids(docs)
    data, offsets = _text.flat(docs.column("text"))
    raw, at = data.tobytes(), offsets.tolist()
    gone = None
    if len(answers):
        words = _Words.of(data, offsets)
        n_words = np.diff(words.first)
        parts = [_unpack(body, n, (8, 4, 8)) for n, body in zip(answers.column("n").to_pylist(), answers.column("body").to_pylist())]
        h, extra, least = (np.concatenate([p[k] for p in parts]) for k in range(3))
        # a hash and its second half as one key; the first half alone finds candidates
        own, inside = words.windows(window)
        found = _Set(h)
        place, _ = found.find(own)
        place = place[inside[place]]
        if len(place):
            second = words.windows(window, 1)[0][place] >> np.uint64(32)
            known = {}
            for a, b, c in zip(h.tolist(), extra.tolist(), least.view(np.int64).tolist()):
                known[a, b] = c
            smallest = np.array([known.get(k, _LAST) for k in zip(own[place].tolist(), second.tolist())], dtype=np.int64)
            place = place[smallest < ids[words.doc[place]]]
            gone = _spread(place, place + window, len(words.h))
    kept, total, removed = [], [], []
    for d in range(len(ids)):
        own = raw[at[d] : at[d + 1]].split()
        total.append(len(own))
        if gone is not None and len(own):
            mask = gone[words.first[d] : words.first[d + 1]]
            lost = int(mask.sum())
            if lost:
                own = [own[k] for k in np.flatnonzero(~mask).tolist()]
        else:
            lost = 0
        removed.append(lost)
        joined = raw[at[d] : at[d + 1]] if whole and not lost else b" ".join(own)
        kept.append(joined.decode("utf-8", "replace") if text_out else hashlib.sha256(joined).hexdigest())
    real = docs.column("real").combine_chunks()
    return pa.table([pa.array(ids), real, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *(docs.column(c) for c in carried)], names=names)


def _dedup(docs: DataFrame, text: str, key: str, window: int, text_out: bool, keep: tuple[str, ...] = (), whole: bool = False, fan: int = FAN, least_ranges: int = 1) -> DataFrame:
    if window < 2:
        raise ValueError("a window has two words at least")
    block = (window + 1) // 2
    size = _text.text_bytes(docs, text)
    chunks = _text.parts(docs, size, CHUNK_BYTES)
    ranges = Ranges.of(max(least_ranges, _text.parts(docs, size // 5, RANGE_HASHES)), chunks, fan)
    few = Ranges.of(max(least_ranges, _text.parts(docs, size // 20, RANGE_HASHES)), chunks, fan)
    names = [f"k{i}" for i in range(len(keep))]
    own = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(n) for c, n in zip(keep, names)))
    # a null key counts as the largest, and its rows spread by their text
    chunk = F.pmod(F.when(F.col("key").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("key")), F.lit(chunks)).cast("int")
    # all passes read the same columns, so that they read one shuffle
    rows = own.select(F.coalesce("key", F.lit(_LAST)).alias("id"), F.col("key").isNotNull().alias("real"), "text", chunk.alias("chunk"), *names)
    packed = rows.groupBy("chunk").applyInArrow(_one(lambda t: _anchors(t, block, ranges)), _PACKED)
    answered = _answered(packed, ranges, lambda t: _merged_anchors(t, ranges), lambda t: _answer_anchors(t, ranges), lambda a, b: _routed_anchors(a, b, ranges))
    found = rows.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(_two(lambda a, b: _windows(a, b, window, block, ranges, few)), _PACKED)
    judged = _answered(found, few, lambda t: _merged_windows(t, few), _answer_windows, _routed_windows)
    carried = "".join(f", {n} {rows.schema[n].dataType.simpleString()}" for n in names)
    out = rows.groupBy("chunk").cogroup(judged.groupBy("chunk")).applyInArrow(_two(lambda a, b: _cover(a, b, window, text_out, whole)), f"id long, real boolean, n_words long, n_removed long, kept string{carried}")
    return out.select(F.when(F.col("real"), F.col("id")).alias(key), "n_words", "n_removed", F.col("kept").alias("kept_text" if text_out else "kept_sha256"), *(F.col(n).alias(c) for c, n in zip(keep, names)))


def _one(work):
    """`work` over a table, after which the worker's freed memory goes back."""

    def run(t: pa.Table) -> pa.Table:
        out = work(t)
        _text.released()
        return out

    return run


def _two(work):
    """_one() for a pair of tables."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = work(a, b)
        _text.released()
        return out

    return run


def _answered(packed: DataFrame, ranges: Ranges, merge, answer, route) -> DataFrame:
    """Each chunk's rows answered range by range, through merged lots of chunks where ranges are cut twice."""
    if ranges.fine == 1:
        return packed.groupBy("bucket").applyInArrow(answer, _PACKED)
    with_lot = packed.withColumn("lot", F.expr(f"chunk div {ranges.lot}").cast("int"))
    said = with_lot.groupBy("bucket", "lot").applyInArrow(merge, _PACKED).groupBy("bucket").applyInArrow(answer, _PACKED)
    back = said.select(F.expr(f"bucket div {ranges.fine}").alias("bucket"), F.col("chunk").alias("lot"), "n", "body")
    return with_lot.groupBy("bucket", "lot").cogroup(back.groupBy("bucket", "lot")).applyInArrow(route, _PACKED)


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, keep: tuple[str, ...] = (), untouched: bool = False) -> DataFrame:
    """(key, n_words, n_removed, kept_text, *keep): each row's words without those that a smaller document's passages cover.

    A word goes if some window of `window` words around it also starts in a document with a smaller key. The smallest
    document that holds a passage keeps it; rows with one key keep their common passages; rows with a null key count
    as larger than all others and keep what only they hold. Words are split at ASCII white space and rejoined by one
    space; with `untouched`, a text that loses nothing stays as it is. Null texts are empty. Keys must be integers.
    """
    return _dedup(docs, text, key, window, True, keep, untouched)


def dedup_digests(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """deduplicated(), the kept text as lowercase SHA-256, hashed where it is made."""
    return _dedup(docs, text, key, window, False)
