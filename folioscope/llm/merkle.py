"""A Merkle manifest of a dataset: a digest of each row, trees of digests by group, one root, and the proof of each row.

Rows of a group, in order, are the leaves of its tree; runs of `FAN` consecutive nodes become their digest until one is
left, the group's root. The groups' roots are the leaves of a last tree. A level is one window partitioned by group and
parent index: the ordered list of the whole frame is the parent's preimage, and without its own entry the siblings of
each node. One row of each run carries the parent on to the next level. Each level is written once; it is read again on
the way down, when a parent's path (what stands left and right of a node, level by level up to the root) is joined to
its children. Runs have FAN rows at most, so no group, however large, meets in one task, and levels shrink by FAN.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm import _text
from folioscope.llm._ranks import ranked

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What stands left and right of a node in each of its runs, from its own upwards.
_PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value; no two rows of values read the same."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: list[Column]) -> Column:
    return digest(F.concat(*map(encoded, values)))


def folded(path: Column, node: Column) -> Column:
    """The root that a node comes to with the siblings of a path."""
    return F.aggregate(path, node, lambda own, step: digest(F.concat(step["left"], own, step["right"])))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, from the lowest run to the root, each run from left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


@dataclass
class Tree:
    """Levels of all groups' trees from the leaves up, and (groups..., height, node): the root of each group."""

    groups: list[str]
    levels: list[DataFrame]
    roots: DataFrame


def grow(leaves: DataFrame, groups: list[str], keep: tuple[str, ...] = ()) -> Tree:
    """The trees above `leaves` (groups..., rank, total, node), one for each group; the columns in `keep` stay with the lowest level.

    A level has (groups..., rank, total, node, left, right, parent) of all groups that still have several nodes there,
    and the lone ones beside them, whose parent is null. Groups have no nulls. No leaves, no trees.
    """
    level = _text.checkpointed(leaves.select(*groups, "rank", "total", "node", *keep))
    most = level.agg(F.max("total")).first()[0] or 0
    run = Window.partitionBy(*groups, "above").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels, height, roots = [], 0, None
    while True:
        alone = level.where("total = 1").select(*groups, F.lit(height).alias("height"), "node")
        roots = alone if roots is None else roots.unionByName(alone)
        if most <= 1:
            levels.append(level)
            return Tree(groups, levels, _text.checkpointed(roots))
        place = (F.col("rank") % FAN).cast("int")
        wide = level.withColumn("above", F.floor(F.col("rank") / FAN)).withColumn("run", F.collect_list("node").over(run)).withColumn("several", F.col("total") > 1)
        level = _text.checkpointed(
            wide.select(
                *groups, "rank", "total", "node", *(keep if not levels else ()),
                F.array_join(F.slice("run", 1, place), "").alias("left"),
                F.array_join(F.slice("run", place + 2, FAN), "").alias("right"),
                F.when(F.col("several"), digest(F.array_join("run", ""))).alias("parent"),
            )
        )
        levels.append(level)
        # a run's first node stands for its parent, which so comes once
        level = level.where((F.col("rank") % FAN == 0) & F.col("parent").isNotNull()).select(*groups, F.floor(F.col("rank") / FAN).alias("rank"), F.ceil(F.col("total") / FAN).alias("total"), F.col("parent").alias("node"))
        most, height = -(-most // FAN), height + 1
        if most <= 1:
            level = _text.checkpointed(level)


def descend(tree: Tree, crowns: DataFrame, carried: list[str]) -> DataFrame:
    """The leaves of a tree with `path`, and the columns `carried` of their group's crown.

    `crowns` has (groups..., height, path, carried...) for each group: the path from its root on, empty if that is the end.
    """
    groups = tree.groups
    own = tree.levels[0].columns
    paths = None
    for height in range(len(tree.levels) - 1, -1, -1):
        top = crowns.where(F.col("height") == height).select(*groups, "path", *carried)
        columns = own if height == 0 else [*groups, "rank"]
        level = tree.levels[height]
        alone = level.where("total = 1").join(top, groups).select(*columns, "path", *carried)
        if paths is None:
            paths = alone
            continue
        met = level.where("total > 1").withColumn("up", F.floor(F.col("rank") / FAN)).join(paths.withColumnRenamed("rank", "up"), [*groups, "up"])
        step = F.array(F.struct(F.col("left"), F.col("right")))
        paths = met.withColumn("path", F.concat(step, F.col("path"))).select(*columns, "path", *carried).unionByName(alone)
    return paths


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(key, leaf, subroot, root, path, changed_leaf): a row for each row of docs, with the path of its proof.

    Leaves of a group ascend by key (null last, then by leaf); groups ascend by their bytes (null first). `changed` gives
    other values of fields: rows that meet `where` have the leaf of the changed row too, as changed_leaf (null elsewhere),
    and folded(path, changed_leaf) says whether the root notices. Repeated rows are leaves each. A lone leaf is its group's root, a lone group's root is
    the root; their runs add no siblings. An empty table gives an empty one.
    """
    again = F.lit(None).cast("string") if where is None else F.when(where, leaf_of([(changed or {}).get(c, F.col(c)) for c in fields]))
    name = F.col(group).cast("string")
    light = docs.select(name.isNotNull().alias("g_known"), F.coalesce(name, F.lit("")).alias("g_name"), F.col(key).alias("g_key"), leaf_of([F.col(c) for c in fields]).alias("node"), again.alias("g_again"))
    groups = ["g_known", "g_name"]
    light = ranked(_text.checkpointed(light), groups, [F.asc_nulls_last("g_key"), F.asc("node")])
    lower = grow(light, groups, ("g_key", "g_again"))
    subroots = lower.roots.select(F.lit(0).alias("g_all"), *groups, F.col("height").alias("g_height"), "node")
    upper = grow(ranked(subroots, ["g_all"], [F.asc(g) for g in groups]), ["g_all"], (*groups, "g_height"))
    end = upper.roots.select("g_all", "height", F.array().cast(_PATH).alias("path"), F.col("node").alias("g_root"))
    crowns = descend(upper, end, ["g_root"]).select(*groups, F.col("g_height").alias("height"), "path", F.col("node").alias("g_subroot"), "g_root")
    found = descend(lower, _text.checkpointed(crowns), ["g_subroot", "g_root"])
    return found.select(F.col("g_key").alias(key), F.col("node").alias("leaf"), F.col("g_subroot").alias("subroot"), F.col("g_root").alias("root"), "path", F.col("g_again").alias("changed_leaf"))
