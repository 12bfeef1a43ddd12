"""SimHash near-duplicates with pivot distance tables.

A fingerprint has a bit for each bit position that is set in over half the hashes of a text's word shingles. Equal
fingerprints are merged first. Candidates for a link of at most `distance` bits agree in some blocks of bits (of
distance + k blocks, k must agree; every choice of k is a key, and k grows with the number of fingerprints, so that
groups don't), and inside a key's group each fingerprint has a row of Hamming distances to many fixed reference
fingerprints. The Hamming distance is a metric: two rows that differ by more than `distance` in any coordinate rule a
pair out. Survivors are compared bit by bit.

Groups give a spanning set of links, never all pairs: once a member's neighbours are linked to it, pairs among those
neighbours are already joined. Components follow from the links by rounds of DataFrame joins.

near_copies() links texts by the Jaccard similarity of their shingles instead. A similarity of 0.8 lets fingerprints
differ in 10 bits on average and in 25 at times, and so many bits leave no block to agree in. There, candidates share a
band of least shingle hashes, the rows of distances and the fingerprints rule pairs out with a bound for that
similarity, and survivors are verified by their whole sets of shingles.
"""

from __future__ import annotations

from itertools import combinations
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _text
from folioscope.operators.graph import components

WORDS, DISTANCE, PIVOTS, SEED = 4, 4, 24, 42

#: Distinct fingerprints of one block value that a task takes; larger groups are cut and their parts compared two by two.
GROUP = 8_192
#: Fingerprints that share a key by chance, about, before keys of more bits are taken; and the most blocks that must agree.
FILL, MOST_AGREE = 64, 4
#: near_copies(): words of a shingle, similarity, bands of so many least hashes.
COPY_WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 25, 6
#: Texts, and shingles, of a part of a band; two parts meet in a task.
CELL_TEXTS, CELL_SHINGLES = 512, 500_000

_REFERENCES = _text.splitmix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def _hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every shingle, first shingle of each text) of lower-cased words joined by one space."""
    import xxhash

    start, end, first = _text.words(data, offsets)
    size = end - start
    low = np.where((data >= 0x41) & (data <= 0x5A), data + 0x20, data).astype(np.uint8)
    # the words in a row with one space after each
    at = np.cumsum(size + 1) - (size + 1)
    total = int(at[-1] + size[-1] + 1) if len(at) else 0
    joined = np.full(total, 0x20, dtype=np.uint8)
    shift = np.repeat(at - start, size)
    inside = np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    joined[inside + shift] = low[inside]
    raw, stop = joined.tobytes(), at + size
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    begin = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(n)), count)
    left = first[doc] + np.arange(int(count.sum())) - begin[doc]
    right = np.minimum(left + words, first[doc + 1]) - 1
    own = xxhash.xxh64_intdigest
    h = [own(raw[a:b], SEED) for a, b in zip(at[left].tolist(), stop[right].tolist())]
    return np.array(h, dtype=np.uint64), np.append(begin, len(h))


def _majority(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The fingerprint of each range of hashes; zero for an empty range."""
    out = np.zeros(len(begin) - 1, dtype=np.uint64)
    if not len(h):
        return out
    some = np.flatnonzero(np.diff(begin) > 0)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, begin[some], axis=0, dtype=np.int32)
    top = ones * 2 > np.diff(begin)[some][:, None]
    out[some] = np.packbits(top, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(key, fp long): the fingerprint of every whole text, its 64 bits as a signed number; zero for a text without words or a null one."""

    def run(batches):
        for batch in batches:
            data, offsets = _text.flat(batch.column(1))
            for i, j in _text.pieces(offsets, 1 << 19):
                fp = _majority(*_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(fp.view(np.int64))], ["key", "fp"])
        _text.released()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, fp long").select(F.col("key").alias(key), "fp")


def _masks(distance: int, n: int) -> list[int]:
    """The bits of each key: all choices of k of distance + k blocks, of which any two fingerprints within the distance agree in one at least."""
    for agree in range(1, MOST_AGREE + 1):
        blocks = distance + agree
        cuts = [64 * k // blocks for k in range(blocks + 1)]
        if n <= FILL << (64 * agree // blocks):
            break
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(x) - (sum(x) >> 63 << 64) for x in combinations(own, agree)]  # as signed numbers


def _linked(fp: np.ndarray, side: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Links that join what is within `distance`, as index pairs. With sides, only pairs of unlike sides count as candidates.

    Goes from one fingerprint to the next: its row of pivot distances selects what can be near among those not yet
    reached from the same component's hub, survivors are verified. Members already joined through a hub are compared
    only with what lies outside their component.
    """
    table = np.bitwise_count(fp[:, None] ^ _REFERENCES[None, :]).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    table, fp = table[order], fp[order]
    own_side = None if side is None else side[order]
    first = table[:, 0]
    parent = np.arange(len(fp))
    out = []
    low, high = np.searchsorted(first, first, "left"), np.searchsorted(first, first + distance, "right")
    low = np.arange(len(fp)) + 1
    for i in range(len(fp)):
        a, b = low[i], high[i]
        if a >= b:
            continue
        near = np.arange(a, b)[parent[a:b] != parent[i]]
        for c in range(1, PIVOTS, 4):
            if not len(near):
                break
            near = near[np.abs(table[near, c : c + 4] - table[i, c : c + 4]).max(axis=1) <= distance]
        if own_side is not None:
            near = near[own_side[near] != own_side[i]]
        near = near[np.bitwise_count(fp[near] ^ fp[i]) <= distance]
        for j in near:
            if parent[j] != parent[i]:
                out.append((int(order[i]), int(order[j])))
                parent[parent == parent[j]] = parent[i]
    return out


def _small_links(fp: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within `distance` of the same group, for groups in a row: a spanning set of each group's."""
    end = np.searchsorted(group, group, "right")
    table = np.bitwise_count(fp[:, None] ^ _REFERENCES[None, :8]).astype(np.int8)
    left, right = [], []
    alive, step = np.arange(len(fp)), 1
    while True:
        alive = alive[alive + step < end[alive]]
        if not len(alive):
            break
        near = alive
        for c in (slice(0, 2), slice(2, 8)):
            near = near[np.abs(table[near, c] - table[near + step, c]).max(axis=1) <= distance]
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= distance]
        left.append(near)
        right.append(near + step)
        step += 1
    left, right = (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))
    keep = _forest(left.tolist(), right.tolist())
    return left[keep], right[keep]


def _forest(left: list[int], right: list[int]) -> np.ndarray:
    """Which of some pairs join what wasn't joined before."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    keep = np.zeros(len(left), dtype=bool)
    for k, (a, b) in enumerate(zip(left, right)):
        a, b = root(a), root(b)
        if a != b:
            parent[a], keep[k] = b, True
    return keep


def links(prints: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within `distance` that join all that the relation joins. `prints` has distinct ones, column fp."""
    masks = _masks(distance, prints.count())
    rows = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(masks)))).alias("x")).select("fp", "x.block", "x.value")
    hot = rows.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).withColumn("cuts", F.ceil(F.col("n") / group).cast("int")).drop("n")
    rows = rows.join(hot, ["block", "value"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    # a group in parts: part p meets part q in the cell (min, max)
    cells = rows.select("fp", "block", "value", "own", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    cells = cells.select("fp", "block", "value", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(n, "block", "value", "p", "q").sortWithinPartitions("block", "value", "p", "q", "fp")

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(len(t) for t in held) >= 50_000:
                table = pa.concat_tables(held)
                cut = _last_group(table)
                if cut:
                    yield from _emit(table.slice(0, cut))
                    held = [table.slice(cut)]
                else:
                    held = [table]
        if held:
            yield from _emit(pa.concat_tables(held))

    def _emit(table: pa.Table):
        columns = [table.column(c).to_numpy() for c in ("block", "value", "p", "q")]
        fp = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        own = table.column("own").to_numpy()
        change = np.zeros(len(fp), dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        number = np.cumsum(change)
        begin = np.append(np.flatnonzero(np.append(True, change[1:])), len(fp)) if len(fp) else np.zeros(1, int)
        size = np.diff(begin)
        a, b = [], []
        small = np.repeat((size <= 256) & (columns[2][begin[:-1]] == columns[3][begin[:-1]]), size) if len(fp) else np.zeros(0, bool)
        x, y = _small_links(fp[small], number[small], distance)
        a.append(fp[small][x])
        b.append(fp[small][y])
        for k in np.flatnonzero((size > 256) | (columns[2][begin[:-1]] != columns[3][begin[:-1]])):
            part = slice(begin[k], begin[k + 1])
            got = _linked(fp[part], None if columns[2][begin[k]] == columns[3][begin[k]] else own[part], distance)
            if got:
                x, y = np.array(got).T
                a.append(fp[part][x])
                b.append(fp[part][y])
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return cells.mapInArrow(run, "a long, b long").distinct()


def _last_group(table: pa.Table) -> int:
    """The row where the last group of a sorted table begins."""
    same = None
    for c in ("block", "value", "p", "q"):
        column = table.column(c)
        eq = pc.equal(column, column[len(table) - 1])
        same = eq if same is None else pc.and_(same, eq)
    return len(table) - int(pc.sum(pc.cast(same, pa.int64())).as_py())


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """(key, fp, component_id): a row for each row of docs; component_id is the smallest key that links reach, itself included.

    Texts without words (empty, null or white space) have the fingerprint zero, which links like any other. A row with
    a null key takes part and gets its component's smallest key, null only if all keys there are null. Repeated rows
    give repeated results. No limit is set on the size of a group or component; rows of a fingerprint, or fingerprints
    of a component, that are many are dealt over many tasks.
    """
    marked = _text.checkpointed(fingerprints(docs, text, key, words).select(F.col(key).alias("key"), "fp"))
    prints = marked.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"))
    joined = components(links(prints.select("fp"), distance))
    roots = prints.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    roots = _text.checkpointed(roots)
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = _text.spread_join(roots.select("fp", "root", F.col("n").alias("rows")), smallest, "root", roots.count())
    named = named.select("fp", "component_id", F.col("rows").alias("n"))
    return _text.spread_join(marked, named, "fp", marked.count()).select(F.col("key").alias(key), "fp", "component_id")


# --- by the similarity of shingles

_ODD = (_text.splitmix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_PLUS = (_text.splitmix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def text_node(text: Column) -> Column:
    """A number of the whole text; 0 for all texts without words, null ones among them."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def widest(similarity: float) -> int:
    """Bits in which the fingerprints of two sets of that Jaccard similarity may differ: the mean and five and a half deviations of it."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return ceil(64 * p + 5.5 * sqrt(64 * p * (1 - p)))


def _mapped(texts: DataFrame, names: tuple[str, ...], schema: str, values) -> DataFrame:
    """(node, *names): columns made of each text's distinct shingle hashes by values(hashes, first of each text)."""

    def run(batches):
        for batch in batches:
            data, offsets = _text.flat(batch.column(1))
            for i, j in _text.pieces(offsets, 1 << 19):
                h, begin = _hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], COPY_WORDS)
                parts = [np.unique(h[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
                h, begin = np.concatenate([np.zeros(0, np.uint64), *parts]), np.cumsum([0, *map(len, parts)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *values(h, begin)], ["node", *names])
            _text.released()

    return texts.select("node", "text").mapInArrow(run, f"node long, {schema}")


def _signed(h: np.ndarray, begin: np.ndarray) -> list[pa.Array]:
    """Fingerprint, distances to eight references as the bytes of a number, and the numbers of the bands."""
    n = len(begin) - 1
    out = np.zeros((n, BANDS), dtype=np.uint64)
    some = np.flatnonzero(np.diff(begin) > 0)
    if len(some):
        low, first = (h >> np.uint64(32)).astype(np.uint32), begin[some]
        for k in range(BANDS):
            value = np.full(len(some), k + 1, dtype=np.uint64)
            for r in range(k * ROWS, (k + 1) * ROWS):
                value = _text.splitmix(value ^ np.minimum.reduceat(low * _ODD[r] + _PLUS[r], first).astype(np.uint64))
            out[some, k] = value
    fp = _majority(h, begin)
    table = np.bitwise_count(fp[:, None] ^ _REFERENCES[None, :8]).astype(np.uint8)
    bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(out.ravel().view(np.int64)))
    return [pa.array(fp.view(np.int64)), pa.array(np.ascontiguousarray(table).view("<i8").ravel()), bands]


def _listed(h: np.ndarray, begin: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(h.view(np.int64)))]


def _can_be(left: str, right: str, distance: int) -> Column:
    """Whether neither the rows of distances nor the fingerprints rule a pair out; over the columns fp and pivots of two structs."""
    part = lambda c, k: F.shiftrightunsigned(F.col(f"{c}.pivots"), 8 * k).bitwiseAND(F.lit(255))
    apart = F.greatest(*(F.abs(part(left, k) - part(right, k)) for k in range(8)))
    return (apart <= distance) & (F.bit_count(F.col(f"{left}.fp").bitwiseXOR(F.col(f"{right}.fp"))) <= distance)


def near_copies(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of the texts that have a near copy: `similarity` or more of five-word shingles, sets compared whole.

    `texts` has node (see text_node) and text; nodes may repeat, and texts without words have none. Two texts of
    similarity s share a band with probability 1 - (1 - s ** ROWS) ** BANDS, 0.9995 at 0.8. So that a large group of
    copies costs links in proportion, the members of a band are first compared with one of them, twice. What then still
    holds several components is cut into parts that meet two by two, where each pair is compared and a spanning set of
    links comes out, never the pairs; there is no limit on a band's size.
    """
    # copies go before anything is joined by node, so that a text with many stands in no task's way
    worded, distance = texts.where("node <> 0").select("node", "text"), widest(similarity)
    prints = _text.checkpointed(_mapped(worded, ("fp", "pivots", "bands"), "fp long, pivots long, bands array<long>", _signed).dropDuplicates(["node"]))
    signed = prints.select("node", F.explode("bands").alias("band"))
    shared = signed.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band")
    met = _text.checkpointed(signed.join(shared, "band").distinct())
    # from here on only texts that share a band count; their fingerprints come along
    some = met.select("node").distinct()
    known = prints.join(some, "node", "left_semi").select("node", F.struct("node", "fp", "pivots").alias("x"))
    met = _text.checkpointed(met.join(known, "node").select("band", "x"))
    held = worded.dropDuplicates(["node"]).join(some, "node", "left_semi")
    sets = _text.checkpointed(_mapped(held, ("shingles",), "shingles array<long>", _listed))

    def compared(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
        common = F.size(F.array_intersect("s", "t"))
        return _text.checkpointed(both.select("a", "b", (common >= similarity * (F.size("s") + F.size("t") - common)).alias("near")))

    done, found = None, None
    for step in ("least", "hashed"):
        own = _rooted(met, found)
        hub = F.min_by(F.struct("x", "root"), F.col("x.node") if step == "least" else F.xxhash64("x.node")).alias("hub")
        mixed = own.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), hub).where("low < high")
        pairs = own.join(mixed.select("band", F.col("hub.x").alias("y"), F.col("hub.root").alias("other")), "band").where("root <> other")
        pairs = pairs.where(_can_be("x", "y", distance)).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        new = compared(pairs)
        done = new if done is None else done.unionByName(new)
        found = _text.checkpointed(components(done.where("near").select("a", "b")))
    rest = _text.checkpointed(_cell_links(_rooted(met, found), sets, similarity, distance))
    if rest.isEmpty():
        return found
    return components(done.where("near").select("a", "b").unionByName(rest))


def _rooted(met: DataFrame, found: DataFrame | None) -> DataFrame:
    """met (band, x) with the root that each text has so far."""
    if found is None:
        return met.withColumn("root", F.col("x.node"))
    return met.join(found, F.col("x.node") == F.col("node"), "left").select("band", "x", F.coalesce("root", "x.node").alias("root"))


def _cell_links(own: DataFrame, sets: DataFrame, similarity: float, distance: int) -> DataFrame:
    """(a, b): links that join what the texts of a band still join, for bands that hold several components."""
    light = own.select("band", "x.node", "x.fp", "root").join(sets.select("node", F.size("shingles").alias("size")), "node")
    mixed = light.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("texts"), F.sum("size").alias("shingles")).where("low < high")
    mixed = mixed.select("band", F.greatest(F.ceil(F.col("texts") / CELL_TEXTS), F.ceil(F.col("shingles") / CELL_SHINGLES)).cast("int").alias("cuts"))
    parts = light.drop("size").join(mixed, "band").withColumn("part", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    cells = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    # the sets come last, so that only those of mixed bands travel, and once
    cells = cells.select("band", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "fp", "root").join(sets, "node")

    def run(table: pa.Table) -> pa.Table:
        node, root, part = (table.column(c).to_numpy() for c in ("node", "root", "part"))
        fp = table.column("fp").to_numpy().view(np.uint64)
        lists = table.column("shingles").combine_chunks()
        flat, at = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        apart = root[:, None] != root[None, :]
        if table.column("p")[0] != table.column("q")[0]:
            apart &= part[:, None] != part[None, :]
        # rows of distances, then the fingerprints, rule pairs out
        pivots = np.bitwise_count(fp[:, None] ^ _REFERENCES[None, :]).astype(np.int8)
        for k in range(PIVOTS):
            apart &= np.abs(pivots[:, None, k] - pivots[None, :, k]) <= distance
        apart &= np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance
        near = np.triu(apart, 1)
        if near.any():
            near &= _alike(flat, at, similarity)
        a, b = np.nonzero(near)
        keep = _forest(root[a].tolist(), root[b].tolist())
        _text.released()
        return pa.table([pa.array(node[a[keep]]), pa.array(node[b[keep]])], names=["a", "b"])

    return cells.groupBy("band", "p", "q").applyInArrow(run, "a long, b long").distinct()


def _alike(flat: np.ndarray, at: np.ndarray, similarity: float, width: int = 4_096) -> np.ndarray:
    """Which pairs of sets, each a range of `flat`, have that Jaccard similarity; the sets' common elements are counted block by block."""
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), size)
    _, name, count = np.unique(flat, return_inverse=True, return_counts=True)
    several = count > 1
    name = np.cumsum(several)[name] - 1, several[name]
    row, column = row[name[1]], name[0][name[1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(size), len(size)), dtype=np.float32)
    for low in range(0, int(several.sum()), width):
        i, j = np.searchsorted(column, (low, low + width))
        block = np.zeros((len(size), width), dtype=np.float32)
        block[row[i:j], column[i:j] - low] = 1
        common += block @ block.T
    return common >= similarity * (size[:, None] + size[None, :] - common)


def hexadecimal(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
