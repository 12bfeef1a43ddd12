"""Best-fit packing of documents into sequences of several permitted lengths.

Items are placed longest first. An item goes to the open bin that it leaves the least room in; the bins' room is kept
as a bit set, so the best fit is one shift. If none has room, a bin is opened at the permitted length that costs least
for the tokens it can be expected to hold, judged by filling it with the longest items still waiting. When all items
are placed, each bin shrinks to the smallest permitted length that holds its contents.

Shards of items are packed apart, each as a whole; a shard is a hash of the key, and tokens and items alone say how many
there are, so neither the layout of the input nor the session's settings change a result. Rows of a key that fills a
shard by itself are dealt out by their place. An item longer than the longest permitted length is cut into full pieces
and a rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _text

CAPACITIES = (256, 512, 1024, 2048)
#: Tokens and items of a shard, about: there are as many shards as the scarcer of the two asks for.
SHARD_TOKENS, SHARD_ITEMS = 4_000_000, 50_000
#: What a bin costs besides its tokens: a fixed part, and attention that grows with the square of its length.
BIN_COST, SQUARE_COST = 16.0, 0.25


def bin_cost(capacity: int, longest: int) -> float:
    return capacity * (1 + SQUARE_COST * capacity / longest) + BIN_COST


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, its offset in the bin, final length of each bin) for lengths from 1 to the longest capacity."""
    capacities = tuple(sorted(capacities))
    longest = capacities[-1]
    cost = {c: bin_cost(c, longest) for c in capacities}
    waiting = [0] * (longest + 1)
    for n in lengths:
        waiting[n] += 1
    present = sum(1 << n for n in range(1, longest + 1) if waiting[n])
    room: list[list[int]] = [[] for _ in range(longest + 1)]
    rooms = 0  # bit r: a bin with room r is open
    used: list[int] = []
    bins, offsets = [0] * len(lengths), [0] * len(lengths)

    def expected(space: int) -> int:
        """Tokens that the longest waiting items would put into the space."""
        full, taken = 0, {}
        while space:
            fit = present & ((1 << (space + 1)) - 1)
            while fit:
                n = fit.bit_length() - 1
                free = waiting[n] - taken.get(n, 0)
                if free > 0:
                    break
                fit ^= 1 << n
            if not fit:
                break
            k = min(free, space // n)
            taken[n] = taken.get(n, 0) + k
            full += k * n
            space -= k * n
        return full

    for item in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[item]
        waiting[n] -= 1
        if not waiting[n]:
            present &= ~(1 << n)
        above = rooms >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                rooms &= ~(1 << r)
        else:
            size = min((c for c in capacities if c >= n), key=lambda c: (cost[c] / (n + expected(c - n)), c))
            b, r = len(used), size
            used.append(0)
        bins[item], offsets[item] = b, used[b]
        used[b] += n
        r -= n
        if r:
            room[r].append(b)
            rooms |= 1 << r
    return bins, offsets, [next(c for c in capacities if c >= u) for u in used]


def pack_documents(docs: DataFrame, length: Column, key: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, piece, start, n_tokens, bin_id, bin_offset, bin_capacity, *keep): a row for each piece of each row of docs.

    `length` is the number of tokens of a row. Pieces of a row have numbers from 0 and their first token in `start`. A
    row without tokens (length 0 or null) has one piece of 0 tokens in no bin: bin_id, bin_offset and bin_capacity are
    null. bin_id is unique over shards. Rows with a null key, and those of a key with more rows than a shard has, are
    spread over the shards by their place. Repeated rows are packed each. Results depend on keys, lengths and nothing
    else where keys are unique. An empty table gives an empty one.
    """
    longest = max(capacities)
    if min(capacities) < 1:
        raise ValueError("a capacity must be positive")
    own = [f"k{i}" for i in range(len(keep))]  # names of their own, whatever the columns are called
    rows = _text.checkpointed(docs.select(F.col(key).alias("key"), F.coalesce(length.cast("long"), F.lit(0)).alias("size"), *(F.col(c).alias(n) for c, n in zip(keep, own))))
    total, items = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.greatest(F.ceil(F.col("size") / longest), F.lit(1))), F.lit(0))).first()
    shards = max(-(-total // SHARD_TOKENS), -(-items // SHARD_ITEMS), 1)
    # keys with more rows than a shard has: no more of them than there are shards
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > SHARD_ITEMS) & F.col("key").isNotNull()).select(F.col("key").alias("hot"))
    rows = rows.withColumn("place", F.monotonically_increasing_id()).join(hot, F.col("key") == F.col("hot"), "left")
    dealt_by = F.when(F.col("key").isNull() | F.col("hot").isNotNull(), F.xxhash64("place")).otherwise(F.xxhash64("key"))
    rows = rows.withColumn("shard", F.pmod(dealt_by, F.lit(shards)).cast("int")).drop("hot", "place")
    cuts = F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(longest).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    pieces = rows.select("*", F.posexplode(cuts).alias("piece", "start")).withColumn("n", F.least(F.col("size") - F.col("start"), F.lit(longest)).cast("int"))
    pieces = pieces.select("shard", "n", "key", "piece", "start", *own)
    dealt = pieces.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("n"), F.asc_nulls_last("key"), "piece")
    names = ["key", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_capacity", *own]
    kind = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = f"key {kind['key']}, piece int, start long, n_tokens int, bin_id long, bin_offset int, bin_capacity int" + "".join(f", {c} {kind[c]}" for c in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shards_of = batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(shards_of[1:] != shards_of[:-1]) + 1).tolist(), len(batch)]
            for a, b in zip(cut, cut[1:]):
                if held and b > a and held[0].column(0)[0].as_py() != shards_of[a]:
                    yield from _shard(held, names, capacities)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from _shard(held, names, capacities)

    packed = dealt.mapInArrow(run, schema)
    return packed.select(F.col("key").alias(key), *names[1:7], *(F.col(n).alias(c) for c, n in zip(keep, own)))


def _shard(held: list[pa.RecordBatch], names: list[str], capacities: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Packs one shard; its bins are numbered from 0."""
    table = pa.Table.from_batches(held)
    shard = table.column(0)[0].as_py()
    lengths = table.column(1).to_pylist()
    some = [k for k, n in enumerate(lengths) if n > 0]
    bins, offsets, sizes = pack([lengths[k] for k in some], capacities)
    ids: list[int | None] = [None] * len(lengths)
    at: list[int | None] = [None] * len(lengths)
    size: list[int | None] = [None] * len(lengths)
    for k, b, o in zip(some, bins, offsets):
        ids[k], at[k], size[k] = (shard << 32) + b, o, sizes[b]
    columns = [table.column("key"), table.column("piece"), table.column("start"), table.column("n"), pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(size, pa.int32()), *(table.column(c) for c in names[7:])]
    yield from pa.table(columns, names=names).to_batches()
