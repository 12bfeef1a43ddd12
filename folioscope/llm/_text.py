"""Flat numpy views of Arrow text columns, shared by the operators that run in Arrow batches.

A text column is seen as one byte buffer plus offsets; nothing here makes a Python object per word.
Null texts read as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folioscope.operators.graph import checkpointed, shared_dir, spread_join

__all__ = ["checkpointed", "crc_mod", "flat", "parts", "pieces", "released", "removed", "rolling", "shared_dir", "splitmix", "spread_join", "text_bytes", "word_hashes", "words"]

#: Bytes of text that one pass of array work covers; bounds the working memory of a Python worker.
PIECE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_M64 = (1 << 64) - 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on unsigned 64-bit values."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random value for each byte.
_BYTE = splitmix(np.arange(1, 257, dtype=np.uint64))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            both = []
            for b in (self.base, self.inv):
                x = np.full(size, b, dtype=np.uint64)
                x[0] = 1
                both.append(np.cumprod(x, dtype=np.uint64))
            self.up, self.down = both
        return self.up[:n], self.down[:n]


_BYTES_POWERS = Powers(0x9E3779B97F4A7C15 | 1)
WORD_POWERS = (Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets has one entry more than the column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunk, or too large for one
            column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of the words `[^\\x20\\x09-\\x0D]+`, and each document's first word number (one more at the end)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]  # a word that touches the one of the next document
    starts[cuts] = True
    ends[cuts - 1] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets, "left")


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: a polynomial over byte values, then mixed with the length."""
    up, down = _BYTES_POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    h = splitmix(((total[end] - total[start]) * down[start]) ^ ((end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
    long = np.flatnonzero(end - start > 256)
    if len(long):  # a polynomial modulo 2**64 is weak on very long patterns
        import xxhash

        raw = data.tobytes()
        for k in long:
            h[k] = xxhash.xxh64_intdigest(raw[start[k] : end[k]], 7)
    return h


def rolling(h: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A hash of each `width` consecutive entries; len(h) - width + 1 values, none if there are fewer entries."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = WORD_POWERS[which].get(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    salt = np.uint64(0x5851F42D4C957F2D * (which + 1) & _M64)
    np.cumsum(splitmix(h ^ salt) * up[:n], out=total[1:])
    return splitmix((total[width:] - total[:-width]) * down[: n - width + 1])


def crc_mod(column, modulus: int):
    """crc32 of an id's decimal text, modulo; a null id counts as the empty text."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def released() -> None:
    """Gives freed memory of this Python worker back to the system; workers live on from stage to stage."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it has


def removed(spark, path: str) -> None:
    """Deletes a folder that isn't read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_bytes(df, text: str) -> int:
    """Bytes of all texts; one narrow scan, used to choose how many parts the work is cut into."""
    from pyspark.sql import functions as F

    return df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def parts(df, size: int, per_part: int) -> int:
    """As many parts as the size asks for, and the session's shuffle partitions at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // per_part), 1)
