"""Shards of equal counts that keep linked documents together, by balanced label propagation.

Rows are linked by what they have in common: a link is a value that two rows or more share. Every linked row starts in
a shard of its own rank, so shards begin even. In a round each row hears in which shards the rows of its links are, and
wants to move where most of them are; ties fall by a hash of link and shard, so all rows of a link lean the same way.
Wishes meet quotas: a shard takes in no more rows than it has seats free or gives up in the same round, and those with
most to gain go first. A full shard that had to refuse some is closed until it has a seat again, so that links too large
for one shard look for their second choice. Rounds end when no row moves. Rows without links fill the seats that are left.

A link's rows are counted by shard (as many numbers as there are shards), never gathered, and a hot link's rows are dealt
over tasks to meet these counts. The driver sees the number of wishes from shard to shard and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _text
from folioscope.llm._ranks import ranked

SHARDS, ROUNDS = 16, 64


def quotas(wishes: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many of the wishes from shard i to j can be met at once: no shard takes in more than it has free or gives up."""
    met = dict(wishes)
    while True:
        over = False
        for j in range(len(free)):
            coming = {k: n for k, n in met.items() if k[1] == j}
            most, n = free[j] + sum(c for k, c in met.items() if k[0] == j), sum(coming.values())
            if n > most:
                over = True
                met |= {k: c * most // n for k, c in coming.items()}
                rest = sorted(coming, key=lambda k: (-(coming[k] * most % n), k))[: most - sum(met[k] for k in coming)]
                met |= {k: met[k] + 1 for k in rest}
        if not over:
            return met


def _wants(linked: DataFrame, labels: DataFrame, shards: int, open_: set[int], total: int) -> DataFrame:
    """(row, place, shard, want, gain, lead): where each row's links would have it, among open shards and its own."""
    heard = [f"v{j}" for j in range(shards)]
    now = linked.join(labels, "row")
    counts = now.groupBy("link").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("shard") == j).alias(v) for j, v in enumerate(heard)))
    told = _text.spread_join(now, counts, "link", total)
    told = told.groupBy("row", "place", "shard").agg(F.min("link").alias("lead"), *(F.sum(v).alias(v) for v in heard))
    vote = lambda j, v: F.struct(F.col(v).alias("rows"), F.xxhash64("lead", F.lit(j)).alias("tie"), F.lit(j).alias("to"))
    votes = F.array(*(F.when(F.lit(j in open_) | (F.col("shard") == j), vote(j, v)) for j, v in enumerate(heard)))
    own = F.element_at(F.array(*heard), F.col("shard") + 1)
    best = F.array_max(votes)  # nulls are passed over
    return told.select("row", "place", "shard", best["to"].alias("want"), (best["rows"] - own).alias("gain"), "lead")


def _seat(rank: Column, seats: list[int]) -> Column:
    """The shard of the rank-th free seat, where shard after shard is filled."""
    ends = [sum(seats[: j + 1]) for j in range(len(seats))]
    return F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: e <= rank))


def propagate(linked: DataFrame, seats: list[int], rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """((row, place, shard) of all rows of `linked` (row, place, link), how many each shard has).

    No shard has more rows than seats. Rows may have several links; each link must be shared.
    """
    shards = len(seats)
    rows = _text.checkpointed(linked.select("row", "place").distinct().withColumn("all", F.lit(0)))
    labels = ranked(rows, ["all"], [F.asc("place"), F.asc("row")]).select("row", "place", F.pmod("rank", F.lit(shards)).cast("int").alias("shard"))
    labels = _text.checkpointed(labels)
    held = [r["n"] for r in sorted(labels.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["shard"])]
    held += [0] * (shards - len(held))
    total, everywhere = linked.count(), set(range(shards))
    open_ = everywhere
    for _ in range(rounds if sum(held) else 0):
        wants = _text.checkpointed(_wants(linked, labels.drop("place"), shards, open_, total))
        wishes = {(r["shard"], r["want"]): r["n"] for r in wants.where("shard <> want").groupBy("shard", "want").agg(F.count(F.lit(1)).alias("n")).collect()}
        met = quotas(wishes, [s - h for s, h in zip(seats, held)])
        if any(met.values()):
            movers = ranked(wants.where("shard <> want"), ["shard", "want"], [F.desc("gain"), F.asc("lead"), F.asc("place"), F.asc("row")])
            quota = F.element_at(F.create_map(*(F.lit(x) for (i, j), n in met.items() for x in (i * shards + j, n))), F.col("shard") * shards + F.col("want"))
            moved = movers.withColumn("shard", F.when(F.col("rank") < quota, F.col("want")).otherwise(F.col("shard")))
            labels = _text.checkpointed(wants.where("shard = want").select("row", "place", "shard").unionByName(moved.select("row", "place", "shard")))
            for (i, j), n in met.items():
                held[i], held[j] = held[i] - n, held[j] + n
        refused = {j for (i, j), n in wishes.items() if met[i, j] < n}
        before, open_ = open_, {j for j in everywhere if held[j] < seats[j] or (j in open_ and j not in refused)}
        if not any(met.values()) and open_ == before:
            break
    return labels, held


def assign(rows: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(row, shard, slot) for each row of `rows` (row, place): counts of shards differ by one at most, slots count up from 0.

    `links` has (row, place, link) of rows and what they may share; null links link nothing. A row's key `row` is unique,
    `place` orders rows (ties fall by row): it deals out the start and the slots. Both tables should be written ones. An
    empty table gives an empty one.
    """
    n = rows.count()
    seats = [n // shards + (j < n % shards) for j in range(shards)]
    shared = links.where("link is not null").groupBy("link").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    linked = _text.checkpointed(_text.spread_join(links, shared, "link", links.count()))
    labels, held = propagate(linked, seats, rounds)
    rest = _text.checkpointed(rows.join(labels.select("row"), "row", "left_anti").select("row", "place", F.lit(0).alias("all")))
    seated = ranked(rest, ["all"], [F.asc("place"), F.asc("row")])
    seated = seated.select("row", "place", _seat(F.col("rank"), [s - h for s, h in zip(seats, held)]).cast("int").alias("shard"))
    every = _text.checkpointed(labels.select("row", "place", "shard").unionByName(seated))
    return ranked(every, ["shard"], [F.asc("place"), F.asc("row")]).select("row", "shard", F.col("rank").alias("slot"))


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(key, size, text_crc32, shard, slot) for each row of docs, where equal texts are linked.

    size is the number of the text's UTF-8 bytes and one more. Null texts are empty ones, and so equal to them; rows with
    a null key, repeated keys and repeated rows are rows each. More copies than a shard has seats fill one shard after
    another. Where keys are unique, the result depends on keys and texts alone.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    known = docs.select(F.col(key).alias("s_key"), (F.octet_length(body) + 1).cast("long").alias("s_size"), F.crc32(body.cast("binary")).alias("s_crc"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("link"))
    known = _text.checkpointed(known.withColumn("row", F.monotonically_increasing_id()).withColumn("place", F.xxhash64("s_key", "link")))
    found = assign(known.select("row", "place"), known.select("row", "place", "link"), shards)
    return known.join(found, "row").select(F.col("s_key").alias(key), F.col("s_size").alias("size"), F.col("s_crc").alias("text_crc32"), "shard", "slot")
