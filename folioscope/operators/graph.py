"""Connected components by DataFrame joins, and what joins and lineage need on a cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key that one task takes in spread_join(), and keys that are dealt over several tasks, at most.
ROWS_A_TASK, MOST_KEYS = 100_000, 100_000
#: Edges that are joined up at once within a partition before rounds of joins begin; bounds what a task holds.
LOT = 200_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which the driver and all executors share.

    The session's setting wins. Where it is unset, a folder below the system's temporary one is used if the session runs
    on this machine alone, as in tests; on a cluster that is an error, as machines don't share such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        root = f"file://{tempfile.gettempdir()}/folioscope-shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage at a copy in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession, "lineage"))
    return df.checkpoint()


def _share(total: int) -> int:
    """Rows of a key that one task takes: ROWS_A_TASK, and more only beyond ROWS_A_TASK * MOST_KEYS rows in all."""
    return max(ROWS_A_TASK, -(-total // MOST_KEYS))


def spread_join(many: DataFrame, one: DataFrame, keys: str | list[str], total: int, how: str = "inner") -> DataFrame:
    """many.join(one, keys, how) where few keys may hold most rows of `many`; `one` has a key once, and in n how many rows of `many` have it.

    `total` is the number of rows of `many`, or more. A key with more rows than a task takes is dealt over as many tasks as
    its rows ask for, and its row of `one` stands in each. Only the names of such keys are broadcast: MOST_KEYS at most, as
    each has over a MOST_KEYS-th of all rows. n isn't returned. Null keys meet nothing.
    """
    keys = [keys] if isinstance(keys, str) else keys
    share = _share(total)
    parts = F.ceil(F.col("n") / share).cast("int")
    hot = one.where(F.col("n") > share).select(*keys, parts.alias("_parts"))
    salt = F.when(F.col("_parts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int")).otherwise(0)
    left = many.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_parts")
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop("n")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def _met(many: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """spread_join() if some key has many rows, which is looked up first; a plain join else, as rounds of plans add up on the driver."""
    if total <= ROWS_A_TASK or one.agg(F.max("n")).first()[0] <= _share(total):
        return many.join(one.drop("n"), key)
    return spread_join(many, one, key, total)


def _stars(lot: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes the edges of a partition, lot by lot, stars: each node tied to the smallest that the lot's edges reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        taken, kind = 0, None

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def told() -> pa.RecordBatch:
            ends = [(x, y) for x in list(parent) if (y := root(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], kind) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                u, v = root(u), root(v)
                parent[max(u, v)] = min(u, v)
                taken += 1
                if taken % lot == 0:
                    yield told()
        if parent:
            yield told()

    return run


def _are_stars(own: DataFrame) -> bool:
    """Whether each node is tied once, and never to one that is tied itself."""
    tied = own.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    return tied.where("n > 1").isEmpty() and own.select("v").distinct().join(own.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def _told(stars: DataFrame) -> DataFrame:
    """(node, root) of all ends."""
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each end of an edge (a, b) reaches.

    Edges are first joined up within their partitions, LOT of them at a time, which leaves stars; where these don't touch,
    as those of a single identifier, that is all. Else large-star and
    small-star by turns: a node's larger neighbours, then its smaller ones, are tied to the smallest it knows, until
    nothing changes. Rounds grow with the logarithm of what is left; only minima are gathered, never a node's neighbours,
    and a hub's edges are dealt over many tasks to meet its minimum. Each round is written to the shared folder, so
    lineage stays short.
    """
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    kind = ends.schema["u"].dataType.simpleString()
    own = checkpointed(ends.mapInArrow(_stars(LOT), f"u {kind}, v {kind}").distinct())
    if _are_stars(own):
        return _told(own)
    of = lambda x: x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    state = of(own)
    n = state[0]
    for _ in range(most_rounds):
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _met(both, least, "u", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        star = large.distinct()
        least = star.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _met(star, least, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        own = checkpointed(small)
        n, _ = now = of(own)
        if now == state:
            return _told(own)
        state = now
    raise RuntimeError("components didn't settle")
