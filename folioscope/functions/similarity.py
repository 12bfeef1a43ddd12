"""String similarity: shares of a longest common subsequence, in Arrow batches behind native bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of a longest common subsequence, a machine word (or several) of `a` at a time."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << k)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_lengths(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """lcs_length() of letters `a` with each of `others`, which stand side by side in one row of bits.

    Letters are numbers from 0. A bit that stays 0 parts two neighbours, so no carry passes from one to the next.
    """
    sizes = np.array([len(b) for b in others], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    whole = np.full(int(sizes.sum()) + len(sizes), -1, np.int64)
    inner = np.ones(len(whole), bool)
    inner[starts + sizes] = False
    whole[inner] = np.concatenate(others)
    bits = lambda of: int.from_bytes(np.packbits(of, bitorder="little").tobytes(), "little")
    places = {c: bits(whole == c) for c in np.unique(a).tolist()}
    full = row = bits(inner)
    for c in a.tolist():
        hit = row & places[c]
        if hit:
            row = ((row + hit) | (row ^ hit)) & full
    left = np.unpackbits(np.frombuffer(row.to_bytes((len(whole) + 7) // 8, "little"), np.uint8), count=len(whole), bitorder="little")
    return sizes - np.add.reduceat(left, starts, dtype=np.int64)


def indel_ratio(a: str, b: str) -> float:
    """100 for equal strings, 0 without a common letter; two empty strings are equal."""
    both = len(a) + len(b)
    return 100.0 * 2 * lcs_length(a, b) / both if both else 100.0


@F.pandas_udf(DoubleType())
def _ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def token_sorted(text: Column) -> Column:
    """The words in order, joined by single spaces."""
    return F.array_join(F.array_sort(F.filter(F.split(text, "\\s+"), lambda w: w != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Indel similarity of the sorted words."""
    return sorted_ratio(token_sorted(a), token_sorted(b))


def sorted_ratio(x: Column, y: Column) -> Column:
    """Indel similarity of texts whose words are sorted already."""
    return _ratio(x, y)


def may_reach(a: Column, b: Column, least: float) -> Column:
    """False only if the token sort ratio is certainly below `least`. Native, so it runs before the batches."""
    return sorted_may_reach(token_sorted(a), token_sorted(b), least)


def sorted_may_reach(x: Column, y: Column, least: float) -> Column:
    """may_reach() of texts whose words are sorted already.

    The edits of a single kind (insert, delete) number len(a) + len(b) minus twice the common part, and plain edit
    distance is never more than that; a distance beyond what `least` allows rules the pair out. The bounded distance
    fills only a band of the table and stops early.
    """
    both = F.length(x) + F.length(y)
    most = F.floor((1 - least / 100.0) * both + 1e-9).cast("int")
    return (F.abs(F.length(x) - F.length(y)) <= most) & (F.expr("true") if least <= 0 else F.levenshtein(x, y) <= most)
