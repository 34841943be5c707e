"""Merkle dataset manifest: a digest for every row, one root for the table, and a proof for each row.

Rows get their places by one range sort of ids and digests; texts are hashed where they are read and never travel. A
tree is built in blocks: BLOCK places of one group meet as one array, and array expressions (sequence, transform, slice,
aggregate) collapse its levels, FAN digests at a time, inside the row. The block roots are the places of the next round,
so n rows take log(n) / log(BLOCK) rounds, each BLOCK times smaller. Proofs come down the same way: what a block root
needs is joined to its block, a row for BLOCK rows.

Groups of any size are cut into blocks of fixed size, so a group with a third of all rows, or all of them, is many
blocks. Digests are lowercase hex; an inner digest is that of its children's hex texts, concatenated.

Defined results. Null fields count as such and differ from empty ones. A null group comes first, then groups in the
order of their UTF-8 bytes; within a group rows go by id (null first), then by digest. Rows alike in both are copies of
each other and take places next to each other in any order. A group of one row has that row's digest as its root; an
empty table has no rows and so no root. Columns that are not asked for may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrays import let
from plumbline.llm.common import materialize

#: Children of an inner digest. A fixed value of the contract.
FAN = 8
#: Levels that one block collapses, and its places.
LEVELS = 3
BLOCK = FAN**LEVELS
#: Rows of a sorted part.
ROWS_EACH = 250_000
STEP = "struct<before:string,after:string>"


def field(value: Column) -> Column:
    """A value's part of a row's digest: its length in UTF-8 bytes, a colon and itself; - if it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """The digest of a row's fields."""
    return F.sha2(F.concat(*map(field, values)), 256)


def group_key(group: Column) -> Column:
    """A key that is never null and sorts as the groups do: nulls first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows plus place, the number of each row in its group, from 0, by the columns of order.

    A range sort deals the rows; each part counts its rows per group, and the sums over the parts before it, a row per
    part and group, give the places. Rows are written first: the sort must see the same rows and ties if it runs again.
    """
    rows = materialize(rows, f"{name}-rows")
    keys = [group, *order, "_tie"]
    parts = max(1, -(-rows.count() // ROWS_EACH), min(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), f"{name}-sorted")
    here = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    ahead = dealt_before(here, group)
    return dealt.join(ahead, [group, "_part"]).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("place"))


def dealt_before(here: DataFrame, group: str) -> DataFrame:
    """here(group, _part, _n, _first) plus _before: the rows of the group in earlier parts. A group's rows here are its parts, a few."""
    from pyspark.sql import Window

    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return here.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")


def joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def levels(nodes: Column, depth: Column) -> Column:
    """array<array<string>>: the nodes of a block, then each level above, depth of them."""

    def up(below: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FAN).cast("int"))
        return F.transform(runs, lambda r: F.sha2(joined(F.slice(below, r * FAN + 1, F.lit(FAN))), 256))

    grow = lambda done, k: F.array_append(done, up(F.element_at(done, -1)))
    return F.when(depth > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), F.array(nodes), grow)).otherwise(F.array(nodes))


def depth_of(size: Column) -> Column:
    """Levels that a block of a group of that size has: all of them if there are more blocks, else what one node needs."""
    return reduce(lambda out, k: out + (size > FAN**k).cast("int"), range(LEVELS), F.lit(0))


def siblings(tree: Column, at: Column) -> Column:
    """array<struct<before, after>> of the node at a place (from 0) of the lowest level: per level the digests beside it, joined."""

    def beside(level: Column, k: Column) -> Column:
        # k counts levels from 0; the place shrinks by FAN with each
        own = F.floor(at / F.pow(F.lit(float(FAN)), k)).cast("int")
        first = own - own % FAN
        return F.struct(joined(F.slice(level, first + 1, own - first)).alias("before"), joined(F.slice(level, own + 2, first + FAN - 1 - own)).alias("after"))

    return F.transform(F.slice(tree, F.lit(1), F.size(tree) - 1), beside)


def fold(node: Column, path: Column) -> Column:
    """The root that a digest and its siblings give."""
    return F.aggregate(path, node, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def path_digest(path: Column) -> Column:
    """One digest over all siblings, level by level, left to right."""
    return F.sha2(joined(F.transform(path, lambda s: F.concat(s["before"], s["after"]))), 256)


def blocks(nodes: DataFrame, group: str, keep: list[str], name: str) -> DataFrame:
    """(group, block, size, rows, tree, root) of nodes(group, place, node, *keep); rows are in order of place."""
    sizes = nodes.groupBy(group).agg(F.count("*").alias("size"))
    block = F.floor(F.col("place") / BLOCK).alias("block")
    own = nodes.select(group, block, F.struct("place", "node", *keep).alias("row")).groupBy(group, "block").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    tree = levels(F.transform("rows", lambda r: r["node"]), depth_of(F.col("size")))
    out = own.join(sizes, group).withColumn("tree", tree)
    return materialize(out.withColumn("root", F.element_at(F.element_at("tree", -1), 1)), name)


def climb(nodes: DataFrame, group: str, keep: list[str], name: str) -> list[DataFrame]:
    """The block tables of all rounds, lowest first; the last has one block per group."""
    out = [blocks(nodes, group, keep, f"{name}-0")]
    while out[-1].where("block > 0").limit(1).count():
        up = out[-1].select(group, F.col("block").alias("place"), F.col("root").alias("node"))
        out.append(blocks(up, group, [], f"{name}-{len(out)}"))
    return out


def descend(rounds: list[DataFrame], top: DataFrame, group: str, keep: list[str], name: str) -> DataFrame:
    """(group, block, rows, tree, path, *keep): the lowest blocks with the path from their root to the very top.

    top(group, path, *keep) gives the path of each group's root.
    """
    above = rounds[-1].join(top, group).select(group, "block", "rows", "tree", "path", *keep)
    for k in range(len(rounds) - 2, -1, -1):
        made = let(F.col("tree"), lambda tree: F.transform("rows", lambda r, i: F.struct(r["place"].alias("block"), F.concat(siblings(tree, i), F.col("path")).alias("path"))))
        each = above.select(group, *keep, F.inline(made))
        above = materialize(rounds[k].join(each, [group, "block"]).select(group, "block", "rows", "tree", "path", *keep), f"{name}-down-{k}")
    return above


def manifest(docs: DataFrame, fields: list[str], doc_id: str = "doc_id", group: str = "lang", claimed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each row of docs.

    A leaf is the digest of the fields in their order; every group has a tree, and the groups' roots have one above.
    claimed: the digest that a row claims to have, if not its leaf; folded_root is what it and the proof give.
    """
    rows = docs.select(group_key(F.col(group)).alias("_group"), F.col(doc_id).alias("doc_id"), digest(*[F.col(f) for f in fields]).alias("node"), (claimed if claimed is not None else F.lit(None).cast("string")).alias("claimed"))
    # a claim is kept only where it differs, and so makes no difference to the order
    rows = rows.withColumn("claimed", F.when(F.col("claimed") != F.col("node"), F.col("claimed")))
    low = climb(numbered(rows, "_group", ["doc_id", "node"], "leaves"), "_group", ["doc_id", "claimed"], "trees")
    roots = low[-1].select(F.lit("").alias("_all"), F.col("_group").alias("of"), F.col("root").alias("node"))
    high = climb(numbered(roots, "_all", ["of"], "groups"), "_all", ["of"], "top")
    root = high[-1].select("_all", F.array().cast(f"array<{STEP}>").alias("path"), F.col("root").alias("all_root"))
    tops = descend(high, root, "_all", ["all_root"], "top")
    made = let(F.col("tree"), lambda tree: F.transform("rows", lambda r, i: F.struct(r["of"].alias("_group"), r["node"].alias("subroot"), F.concat(siblings(tree, i), F.col("path")).alias("path"))))
    tops = materialize(tops.select("all_root", F.inline(made)), "roots")
    leaves = descend(low, tops, "_group", ["subroot", "all_root"], "trees")

    def line(r: Column, path: Column) -> Column:
        return F.struct(
            r["doc_id"].alias("doc_id"), r["node"].alias("leaf"), F.col("subroot").alias("subroot"), F.col("all_root").alias("root"),
            path_digest(path).alias("proof_sha256"), fold(F.coalesce(r["claimed"], r["node"]), path).alias("folded_root"),
        )

    made = let(F.col("tree"), lambda tree: F.transform("rows", lambda r, i: let(F.concat(siblings(tree, i), F.col("path")), lambda path: line(r, path))))
    return leaves.select(F.inline(made)).withColumn("verified", F.col("folded_root") == F.col("root"))
