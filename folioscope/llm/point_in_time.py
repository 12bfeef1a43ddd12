"""A point-in-time feature table: what was known of a client when each of its sales was looked at, over windows of days.

Each sale is a probe at a time t. An event (click, sale, line of a sale) counts for a probe while it is known and not too
old: from its arrival (and no earlier than itself) until its own time plus the window. So each event is an interval of
probe times for each window, and features are sums over the intervals that hold t.

Square-root decomposition: the probes of a client, in order, are cut into blocks of equal counts, about the square root
of their number and `BLOCK` at least, so most clients are one block. Of an interval, the blocks between its ends are
covered: what covers a block is summed up once, by pairs of end blocks and then along the blocks of a client. Only the
two blocks that hold its ends get the event itself, which there meets the block's probes. Distinct items are the union
of their intervals: each line keeps the part that no line of the same client and item has covered before, so sets become
sums. The last click is the largest of those that have arrived, as a larger one also leaves a window later.

Nothing gathers a client: ranks come from sorted ranges, events are dealt by client and block, blocks with over `CROWD`
events are dealt out again with all probes of the block beside each part, lines are summed by sale, item and day of
shipping before they meet their sale, and unions of items are taken by slots of time that hand on their maximum.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm import _text
from folioscope.llm._ranks import ranked
from folioscope.llm.merkle import encoded

SECOND = 1_000_000
DAY = 86_400 * SECOND
WINDOWS = (2, 14)
#: Days ahead that a label looks, and minutes from an event's arrival until it may be used.
LABEL_DAYS, DELAY_MINUTES = 7, 240
#: Probes of a block, at least, and events of a block that one task takes beside the probes.
BLOCK, CROWD = 4096, 50_000
#: Rows that a worker handles at once, about, and the slots of time in which the union of an item's intervals is taken.
CHUNK, SLOT = 200_000, DAY // 4

CLICK, SALE, LINE, PROBE = range(4)
#: Bits of an event's row in a block: which of its intervals ends there (two windows, two of items, the label); that it
#: covers the block; that it is the last click before the block.
BITS, WHOLE, LAST = (1, 2, 4, 8, 16), 32, 64
NEVER, NONE = 1 << 60, -(1 << 63)
SUMS = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")


def micros(table: DataFrame, column: str) -> Column:
    """Microseconds since 1970; a time without a zone is UTC, whatever the session's zone."""
    if dict(table.dtypes)[column] == "timestamp":
        return F.unix_micros(column)
    seconds = F.expr(f"CAST(CAST(`{column}` - TIMESTAMP_NTZ '1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(18, 6))")
    return (seconds * SECOND).cast("long")


def cents(value: Column) -> Column:
    return F.coalesce(F.floor(100 * value + 0.5).cast("long"), F.lit(0).cast("long"))


def _events(table: DataFrame, kind: int, client: Column, at: Column, lo: Column, n: Column | int = 1, p: Column | int = 0, money: Column | int = 0, key: Column | None = None, i2: Column | int = NEVER, i14: Column | int = NEVER) -> DataFrame:
    long = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("long")
    return table.select(client.alias("client"), F.lit(kind).cast("int").alias("kind"), long(at).alias("at"), long(lo).alias("lo"), long(i2).alias("i2"), long(i14).alias("i14"), long(n).alias("n"), long(p).alias("p"), long(money).alias("cents"), (F.lit(None) if key is None else key).cast("long").alias("id"))


def click_events(clicks: DataFrame) -> DataFrame:
    """One event for each different click that a window can see; equal rows count once."""
    used = ("click_id", "client_id", "kind", "value")
    rest = [c for c in clicks.columns if c not in (*used, "ts", "arrived_at")]
    rows = clicks.select(*used, micros(clicks, "ts").alias("at"), micros(clicks, "arrived_at").alias("arrived"), F.md5(F.concat(F.lit(""), *(encoded(F.col(c)) for c in rest)).cast("binary")).alias("rest"))
    rows = rows.withColumn("lo", F.greatest("at", F.col("arrived") + DELAY_MINUTES * 60 * SECOND))
    rows = rows.where(F.col("client_id").isNotNull() & F.col("at").isNotNull() & F.col("arrived").isNotNull() & (F.col("lo") < F.col("at") + max(WINDOWS) * DAY)).distinct()
    return _events(rows, CLICK, F.col("client_id"), F.col("at"), F.col("lo"), 1, (F.coalesce(F.col("kind"), F.lit("")) == "purchase").cast("long"), cents(F.col("value")), F.col("click_id"))


def known_sales(sales: DataFrame) -> DataFrame:
    """(sale, client, at, seen, cents, t): the sales that are probes; `seen` is when one may be used, NEVER if it has no arrival."""
    rows = sales.select(F.col("sale_id").alias("sale"), F.col("client_id").alias("client"), micros(sales, "sold_at").alias("at"), micros(sales, "arrived_at").alias("arrived"), cents(F.col("total")).alias("cents"))
    seen = F.coalesce(F.greatest("at", F.col("arrived") + DELAY_MINUTES * 60 * SECOND), F.lit(NEVER))  # greatest passes over nulls
    after = _text.crc_mod(F.col("sale"), 259_200) * SECOND
    return rows.where("client is not null and at is not null").select("sale", "client", "at", F.when(F.col("arrived").isNull(), NEVER).otherwise(seen).alias("seen"), "cents", (F.col("at") + after).alias("t"))


def line_events(lines: DataFrame, sales: DataFrame, written) -> DataFrame:
    """Lines of sales, summed by sale, item and time of shipping, with the intervals by which their item is new to the client."""
    rows = lines.select(F.col("sale_id").alias("sale"), F.col("item_id").alias("item"), micros(lines, "shipped_at").alias("shipped"), cents(F.col("amount")).alias("cents"))
    rows = rows.where("sale is not null and shipped is not null").groupBy("sale", "item", "shipped").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    of = sales.where(f"seen < {NEVER}").select("sale", "client", "at", "seen")
    met = rows.join(of, "sale").withColumn("lo", F.greatest("seen", "shipped")).where(F.col("lo") < F.col("at") + max(WINDOWS) * DAY)
    met = written(met.select("client", "item", F.floor(F.col("lo") / SLOT).cast("long").alias("slot"), "lo", "at", "n", "cents"), "lines")
    own = met.where("item is not null")
    slots = own.groupBy("client", "item", "slot").agg(F.max("at").alias("at"))
    earlier = F.max("at").over(Window.partitionBy("client", "item").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    handed = slots.withColumn("at", earlier).where("at is not null").select("client", "item", "slot", F.lit(NONE).alias("lo"), "at", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("cents"))
    before = F.max("at").over(Window.partitionBy("client", "item", "slot").orderBy("lo", "at").rowsBetween(Window.unboundedPreceding, -1))
    new = own.unionByName(handed).withColumn("before", before).where(F.col("lo") > NONE)
    i2, i14 = (F.greatest(F.col("lo"), F.col("before") + d * DAY) for d in WINDOWS)
    of = lambda x, a, b: _events(x, LINE, F.col("client"), F.col("at"), F.col("lo"), F.col("n"), 0, F.col("cents"), None, a, b)
    return of(new, i2, i14).unionByName(of(met.where("item is null"), NEVER, NEVER))


def intervals(at: Column, lo: Column, i2: Column, i14: Column, kind: Column) -> list[tuple[Column, Column]]:
    """[from, to) of each of BITS, in this order; to is not after from where there is none."""
    near, far = (at + d * DAY for d in WINDOWS)
    label = F.when(kind == SALE, at - LABEL_DAYS * DAY).otherwise(NEVER)
    return [(lo, near), (lo, far), (i2, near), (i14, far), (label, at)]


def _block_of(time: Column) -> Column:
    """The last block of the client's that starts before a time, the first one if none does; looked up in two steps."""
    above = F.size(F.filter("tops", lambda x: x["first"] < time))
    inner = F.size(F.filter(F.element_at("tops", F.greatest(above, F.lit(1)))["starts"], lambda x: x < time))
    return F.greatest((above - 1) * F.col("fan") + inner - 1, F.lit(0)).cast("int")


def probes_in_blocks(sales: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((client, block, row, sale, t) of all probes, (client, blocks, fan, tops) of the clients with several blocks)."""
    rows = _text.checkpointed(sales.select("client", "sale", "t").withColumn("row", F.monotonically_increasing_id()))
    placed = ranked(rows, ["client"], [F.asc("t"), F.asc("row")])
    size = F.greatest(F.lit(least), F.ceil(F.sqrt("total")))
    placed = placed.withColumn("blocks", F.ceil(F.col("total") / size).cast("int"))
    placed = _text.checkpointed(placed.withColumn("block", F.floor(F.col("rank") * F.col("blocks") / F.col("total")).cast("int")))
    starts = placed.where("blocks > 1").groupBy("client", "blocks", "block").agg(F.min("t").alias("start")).withColumn("fan", F.ceil(F.sqrt("blocks")).cast("int"))
    tops = starts.groupBy("client", "blocks", "fan", F.floor(F.col("block") / F.col("fan")).alias("top")).agg(F.min("start").alias("first"), F.sort_array(F.collect_list(F.struct("block", "start"))).alias("own"))
    tops = tops.groupBy("client", "blocks", "fan").agg(F.sort_array(F.collect_list(F.struct("top", "first", F.col("own.start").alias("starts")))).alias("tops"))
    return placed.select("client", "block", "row", "sale", "t"), tops


def _covers(ends: DataFrame) -> DataFrame:
    """What covers blocks, as rows like events: sums along the blocks of each client with several, by kind and interval."""
    several = ends.where("blocks is not null")
    parts = []
    for k, bit in enumerate(BITS):
        once = k > 1  # items and labels count once for each row
        own = several.where(f"q{k} > p{k} + 1").groupBy("client", "kind", f"p{k}", f"q{k}").agg(*((F.count(F.lit(1)) if once and c == "n" else F.sum(F.lit(0).cast("long") if once else F.col(c))).alias(c) for c in ("n", "p", "cents")))
        for sign, block in ((1, F.col(f"p{k}") + 1), (-1, F.col(f"q{k}"))):
            parts.append(own.select("client", "kind", F.lit(bit).alias("bit"), block.alias("block"), *((sign * F.col(c)).alias(c) for c in ("n", "p", "cents"))))
    steps = reduce(DataFrame.unionByName, parts).groupBy("client", "kind", "bit", "block").agg(*(F.sum(c).alias(c) for c in ("n", "p", "cents")))
    along = Window.partitionBy("client", "kind", "bit").orderBy("block")
    sums = steps.select("client", "kind", "bit", "block", F.lead("block").over(along).alias("next"), *(F.sum(c).over(along).alias(c) for c in ("n", "p", "cents"))).where("next is not null and n <> 0")
    whole = sums.select("client", F.explode(F.sequence("block", F.col("next") - 1)).alias("block"), "kind", (F.col("bit") + WHOLE).alias("mask"), F.lit(0).alias("at"), F.lit(0).alias("lo"), "n", "p", "cents", F.lit(None).cast("long").alias("id"))
    latest = several.where(F.col("kind") == CLICK).groupBy("client", "p1").agg(F.max(F.struct("at", F.coalesce("id", F.lit(NONE)).alias("id"))).alias("last"), F.max("blocks").alias("blocks"))
    by = Window.partitionBy("client").orderBy("p1")
    latest = latest.select("client", (F.col("p1") + 1).alias("block"), F.coalesce(F.lead("p1").over(by), F.col("blocks") - 1).alias("until"), F.max("last").over(by).alias("last")).where("block <= until")
    zero = F.lit(0)
    latest = latest.select("client", F.explode(F.sequence("block", "until")).alias("block"), F.lit(CLICK).alias("kind"), F.lit(LAST).alias("mask"), F.col("last.at").alias("at"), zero.alias("lo"), zero.alias("n"), zero.alias("p"), zero.alias("cents"), F.col("last.id").alias("id"))
    return whole.unionByName(latest)


def _places(ends: DataFrame) -> DataFrame:
    """A row for each event and block that holds an end of one of its intervals; `mask` says which."""
    pairs = [(F.col(f"{side}{k}"), bit) for k, bit in enumerate(BITS) for side in "pq"]
    held = F.array_distinct(F.filter(F.array(*(c for c, _ in pairs)), lambda b: b.isNotNull()))
    mask = lambda b: reduce(lambda x, y: x.bitwiseOR(y), (F.when(b.eqNullSafe(F.col(f"p{k}")) | b.eqNullSafe(F.col(f"q{k}")), bit).otherwise(0) for k, bit in enumerate(BITS)))
    some = F.transform(held, lambda b: F.struct(b.alias("block"), mask(b).alias("mask")))
    alone = F.array(F.struct(F.lit(0).alias("block"), F.lit(sum(BITS)).alias("mask")))
    place = F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(some))
    return ends.select("client", "kind", "at", "lo", "i2", "i14", "n", "p", "cents", "id", place.alias("place")).select("client", F.col("place.block").alias("block"), "kind", F.col("place.mask").alias("mask"), "at", "lo", "i2", "i14", "n", "p", "cents", "id")


class _Rows:
    """Numpy columns of whole groups (client, block, part), and what their events come to for each probe."""

    def __init__(self, table: pa.Table):
        def col(name: str) -> np.ndarray:
            own = table.column(name)
            return (own.fill_null(NONE) if own.null_count else own).to_numpy()

        keys = [col(c) for c in ("client", "block", "part")]
        change = np.zeros(len(keys[0]), dtype=bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        group = np.cumsum(change)
        kind = col("kind")
        probe = np.flatnonzero(kind == PROBE)
        probe = probe[np.lexsort((col("lo")[probe], group[probe]))]
        self.row, self.sale, self.t, self.group = col("n")[probe], table.column("id").combine_chunks().take(pa.array(probe)), col("lo")[probe], group[probe]
        self.times = np.unique(self.t)
        self.step = len(self.times) + 1
        self.keyed = self.group * self.step + np.searchsorted(self.times, self.t)
        event = np.flatnonzero(kind != PROBE)
        self.own, self.kind = group[event], kind[event]
        self.mask, self.at, self.lo, self.i2, self.i14, self.n, self.p, self.cents, self.id = (col(c)[event] for c in ("mask", "at", "lo", "i2", "i14", "n", "p", "cents", "id"))
        self.first, self.end = np.searchsorted(self.group, self.own), np.searchsorted(self.group, self.own, "right")

    def place(self, which: np.ndarray, time: np.ndarray) -> np.ndarray:
        """The first probe of each event's group that isn't before a time."""
        return np.searchsorted(self.keyed, self.own[which] * self.step + np.searchsorted(self.times, time))

    def total(self, bit: int, kind: int, start: np.ndarray, stop: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        """Sums, for each probe, of values over the intervals of a kind that hold it."""
        out = [np.zeros(len(self.t) + 1, dtype=np.int64) for _ in values]
        mine = (self.kind == kind) & (self.mask & bit > 0)
        cover = self.mask & WHOLE > 0
        some, all_ = np.flatnonzero(mine & ~cover & (start < stop)), np.flatnonzero(mine & cover)
        a = np.concatenate([self.place(some, start[some]), self.first[all_]])
        b = np.concatenate([self.place(some, stop[some]), self.end[all_]])
        for o, v in zip(out, values):
            v = np.concatenate([v[some], v[all_]])
            np.add.at(o, a, v)
            np.subtract.at(o, b, v)
        return [np.cumsum(o)[:-1] for o in out]

    def last(self) -> tuple[np.ndarray, np.ndarray]:
        """(time, id) of the largest click that has arrived at each probe; NONE if there is none."""
        some = np.flatnonzero((self.kind == CLICK) & (self.mask & (BITS[1] | LAST) > 0) & (self.mask & WHOLE == 0))
        at, key = np.append(self.at[some], NONE), np.append(self.id[some], NONE)
        order = np.lexsort((key[:-1], at[:-1]))
        worth = np.empty(len(some), dtype=np.int64)
        worth[order] = np.arange(1, len(some) + 1)
        where = np.where(self.mask[some] & LAST > 0, self.first[some], self.place(some, self.lo[some]))
        here = where < self.end[some]
        best = np.zeros(len(self.t), dtype=np.int64)
        np.maximum.at(best, where[here], worth[here])
        base = self.group * (len(some) + 1)
        best = np.maximum.accumulate(best + base) - base
        pick = np.append(len(some), order)[best]
        return at[pick], key[pick]

    def features(self) -> Iterator[pa.RecordBatch]:
        at, key = self.last()
        one = np.where(self.mask & WHOLE > 0, self.n, 1)
        label = self.total(BITS[4], SALE, self.at - LABEL_DAYS * DAY, self.at, one)[0] > 0
        for k, d in enumerate(WINDOWS):
            stop = self.at + d * DAY
            clicks = self.total(BITS[k], CLICK, self.lo, stop, self.n, self.p, self.cents)
            sales = self.total(BITS[k], SALE, self.lo, stop, self.n, self.cents)
            n_lines, line_cents = self.total(BITS[k], LINE, self.lo, stop, self.n, self.cents)
            n_items = self.total(BITS[2 + k], LINE, (self.i2, self.i14)[k], stop, one)[0]
            seen = at > self.t - d * DAY
            columns = [self.row, self.sale, np.full(len(self.t), d, np.int32), self.t, label, *clicks, *sales, n_lines, n_items, line_cents, np.where(seen, at, NONE), np.where(seen, key, NONE)]
            names = ["row", "sale", "d", "t", "label", *SUMS, "last_at", "last_id"]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of sorted rows, whole groups of them at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < CHUNK:
            continue
        table = pa.Table.from_batches(held)
        keys = [table.column(c).to_numpy() for c in ("client", "block", "part")]
        change = np.flatnonzero(reduce(np.logical_or, (k[1:] != k[:-1] for k in keys)))
        if len(change):
            cut = int(change[-1]) + 1
            yield from _Rows(table.slice(0, cut)).features()
            held = table.slice(cut).to_batches()
            rows -= cut
    if rows:
        yield from _Rows(pa.Table.from_batches(held)).features()
    _text.released()


def features(clicks: DataFrame, sales: DataFrame, lines: DataFrame, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """(sale_id, d, t_us, label, counts and sums..., last_click_id): a row for each sale with a client and a time, and each window.

    A sale is looked at a pseudo-random time of up to three days after it. Rows that lack a client or time, or an arrival
    where one is needed, count for nothing (a sale without arrival counts for labels); amounts that are null count as 0;
    lines without a sale, an item or a time of shipping have no sale, are no item or aren't there yet. Equal clicks count
    once, sales and lines as often as they come; a sale_id that comes twice has its lines twice. A last click without
    an id is null. Empty tables give an empty table or zeros.
    """
    spark = sales.sparkSession
    folder = _text.shared_dir(spark, "point-in-time")

    def written(table: DataFrame, name: str) -> DataFrame:
        """A table on disk, whose size Spark knows when it chooses how to join it."""
        table.write.parquet(f"{folder}/{name}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{name}")

    known = known_sales(sales)
    probes, tops = probes_in_blocks(known, block)
    tops = written(tops, "tops")
    bought = _events(known, SALE, F.col("client"), F.col("at"), F.col("seen"), 1, 0, F.col("cents"), F.col("sale"))
    events = click_events(clicks).unionByName(bought).unionByName(line_events(lines, known, written))
    ends = events.join(tops, "client", "left")
    times = intervals(*(F.col(c) for c in ("at", "lo", "i2", "i14", "kind")))
    some = [F.col("blocks").isNotNull() & (a < b) for a, b in times]
    ends = ends.select(*events.columns, "blocks", *(F.when(ok, _block_of(x)).alias(f"{side}{k}") for k, (ok, ab) in enumerate(zip(some, times)) for side, x in zip("pq", ab)))
    ends = written(ends, "ends")
    places = _places(ends)
    crowded = places.groupBy("client", "block").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > crowd).select("client", "block", F.ceil(F.col("rows") / crowd).cast("int").alias("parts"))
    crowded = written(crowded, "crowded")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("kind", "at", "lo", "n", "cents", "id"), F.col("parts")))
    columns = ["client", "block", "part", "kind", "mask", "at", "lo", "i2", "i14", "n", "p", "cents", "id"]
    typed = lambda table: table.select("client", *(F.col(c).cast("int").alias(c) for c in columns[1:5]), *(F.col(c).cast("long").alias(c) for c in columns[5:]))
    zero = F.lit(0)
    dealt = typed(places.join(crowded, ["client", "block"], "left").withColumn("part", part))
    covers = typed(_covers(ends).select("*", zero.alias("part"), zero.alias("i2"), zero.alias("i14")))
    looks = probes.join(crowded, ["client", "block"], "left").withColumn("part", F.explode(F.sequence(zero, F.coalesce("parts", F.lit(1)) - 1)))
    looks = typed(looks.select("client", "block", "part", F.lit(PROBE).alias("kind"), zero.alias("mask"), zero.alias("at"), F.col("t").alias("lo"), zero.alias("i2"), zero.alias("i14"), F.col("row").alias("n"), zero.alias("p"), zero.alias("cents"), F.col("sale").alias("id")))
    keys = ["client", "block", "part"]
    rows = dealt.unionByName(covers).unionByName(looks)
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    found = rows.mapInArrow(_in_blocks, "row long, sale long, d int, t long, label boolean, " + ", ".join(f"{c} long" for c in (*SUMS, "last_at", "last_id")))
    last = F.max(F.struct("last_at", "last_id"))["last_id"]
    found = found.groupBy("row", "d").agg(F.first("sale").alias("sale_id"), F.first("t").alias("t_us"), F.max("label").alias("label"), *(F.sum(c).alias(c) for c in SUMS), F.nullif(last, F.lit(NONE)).alias("last_click_id"))
    found = _text.checkpointed(found.select("sale_id", "d", "t_us", "label", "n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents"))
    _text.removed(spark, folder)
    return found
