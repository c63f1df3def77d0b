"""Merkle manifest of a table: a digest per row, a tree per group, a proof per row.

1. Leaves: one scan hashes each row's fields; tampered rows get a second digest.
2. Places: rows are range-partitioned and sorted by (group, order, digest). A row's place in its group is
   its place in its partition plus the rows of the group in earlier partitions, so no window spans a group.
3. Trees by slot pivot: the children of a parent become ``FANOUT`` columns by conditional aggregates. The
   columns concatenated are the parent's input; without one slot's column they are that child's siblings.
   ``LEVELS`` levels are built per shuffle, since nodes are dealt by their ancestor that many levels up.
   The slots of such a block, FANOUT^LEVELS leaves at most whatever the group's size, stay one row.
4. The roots of all groups, in order of the groups, are the leaves of one more tree of the same kind.
5. Paths go down again: a block's row meets the path of its top and is spread out level by level, each child
   taking its siblings. Paths of leaves exist only inside that step, which hashes and folds them.

Defined cases: a null field is ``-``, also as group (which comes first) and order (first in its group); an
empty or very long text is hashed whole; rows that tie are ordered by digest, and equal rows are leaves of
their own with their own proofs; an empty table gives no rows; columns that are not fields are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscan.llm.common import written

FANOUT = 3
LEVELS = 6  # levels of a tree that are built per shuffle
GROUP = ["named", "name"]  # whether the group is not null, and its value
PATH = "array<struct<before:string,after:string>>"


@dataclass(frozen=True)
class Manifest:
    """Which columns make a leaf, which one groups leaves (a string), and which one orders them."""

    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    group: str = "source"
    order: str = "doc_id"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: dict[str, Column], manifest: Manifest) -> Column:
    return sha256(F.concat(*(field_text(values[name]) for name in manifest.fields)))


def places(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add ``place``, from 0, and ``total``, the rows of the group.

    The rows must come from a written table, so that all jobs see the same ones.
    """
    ranged = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    numbered = written(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    parts = numbered.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # One row per group, and one more for each partition edge inside a group.
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        *group,
        "part",
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy(*group)).alias("total"),
    )
    placed = numbered.join(starts, [*group, "part"])
    return placed.withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _nodes_at(total: Column, level: int) -> Column:
    """How many nodes a level of a tree of ``total`` leaves has."""
    width = FANOUT**level
    return _div(total + F.lit(width - 1), width)


def _slots() -> list[str]:
    return [f"slot{k}" for k in range(FANOUT)]


def _joined_hashes(children: list[Column]) -> Column:
    return F.concat(F.lit(""), *(F.coalesce(c["hash"], F.lit("")) for c in children))


def pivot(nodes: DataFrame, level: int) -> DataFrame:
    """Parents of the nodes of a level, with ``hash`` and, as ``below``, their slots in order.

    A slot is a column while its children are gathered and an element afterwards, so that types stay small.
    A tree with a single node at this level is finished; the node stands for itself above.
    """
    slot = F.col("place") % FANOUT
    child = F.struct("hash", "below")
    spread = [F.max(F.when(slot == k, child)).alias(name) for k, name in enumerate(_slots())]
    parents = nodes.groupBy(*GROUP, "block", "total", _div(F.col("place"), FANOUT).alias("place")).agg(*spread)
    whole = sha256(_joined_hashes([F.col(c) for c in _slots()]))
    own = F.when(_nodes_at(F.col("total"), level) > 1, whole).otherwise(F.col("slot0.hash"))
    return parents.select(*GROUP, "block", "total", "place", own.alias("hash"), F.array(*_slots()).alias("below"))


def spread_out(parents: DataFrame, level: int, kept: tuple[str, ...]) -> DataFrame:
    """The nodes of a level with their paths, from the pivoted parents with theirs."""
    slots = [F.get("below", k) for k in range(FANOUT)]

    def child(k: int) -> Column:
        step = F.struct(_joined_hashes(slots[:k]).alias("before"), _joined_hashes(slots[k + 1 :]).alias("after"))
        grows = _nodes_at(F.col("total"), level) > 1
        path = F.when(grows, F.concat(F.array(step), F.col("path"))).otherwise(F.col("path"))
        node = F.struct(
            (F.col("place") * FANOUT + k).alias("place"),
            slots[k]["hash"].alias("hash"),
            slots[k]["below"].alias("below"),
            path.alias("path"),
        )
        return F.when(slots[k].isNotNull(), node)

    found = F.explode(F.filter(F.array(*(child(k) for k in range(FANOUT))), lambda c: c.isNotNull()))
    outer = [*GROUP, "total", *kept]
    return parents.select(*outer, found.alias("child")).select(*outer, "child.*")


class _Stage:
    """``LEVELS`` levels of all trees: nodes of level ``base`` dealt by their ancestor ``LEVELS`` up."""

    def __init__(self, nodes: DataFrame, base: int) -> None:
        self.base = base
        block = _div(F.col("place"), FANOUT**LEVELS)
        blocks = nodes.withColumn("block", block).repartition(*GROUP, "block")
        for level in range(base, base + LEVELS):
            blocks = pivot(blocks, level)
        # One row per block; its place is its block, as it is the ancestor.
        self.blocks = written(blocks.drop("place"))

    def roots(self) -> DataFrame:
        return self.blocks.select(*GROUP, "total", F.col("block").alias("place"), "hash", F.lit(None).cast("string").alias("below"))

    def down(self, tops: DataFrame, kept: tuple[str, ...]) -> DataFrame:
        """Nodes of the base level with paths, from the nodes ``LEVELS`` up with theirs."""
        above = tops.select(*GROUP, F.col("place").alias("block"), "path", *kept)
        found = self.blocks.join(above, [*GROUP, "block"]).withColumn("place", F.col("block"))
        for level in reversed(range(self.base, self.base + LEVELS)):
            found = spread_out(found, level, kept)
        return found


def _stages(leaves: DataFrame) -> tuple[list[_Stage], DataFrame]:
    """All stages from the leaves up, and the root of each group as (group, total, hash)."""
    most = leaves.agg(F.max("total")).first()[0] or 0
    stages, level, nodes = [], 0, leaves
    while level == 0 or FANOUT**level < most:
        stages.append(_Stage(nodes, level))
        nodes = stages[-1].roots()
        level += LEVELS
    return stages, nodes.select(*GROUP, "total", "hash")


def _with_paths(stages: list[_Stage], tops: DataFrame, kept: tuple[str, ...]) -> DataFrame:
    """Leaves with paths, from one row per group with the path of its root."""
    found = tops.withColumn("place", F.lit(0).cast("long"))
    for stage in reversed(stages):
        found = stage.down(found, kept)
    return found


def folded(start: Column, path: Column) -> Column:
    """The root that a digest and the siblings on its path lead to."""
    return F.aggregate(path, start, lambda h, step: sha256(F.concat(step["before"], h, step["after"])))


def proof_digest(path: Column) -> Column:
    """The hash of all siblings from the leaf's level to the root."""
    return sha256(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def build_manifest(rows: DataFrame, manifest: Manifest = Manifest(), tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``rows``: the order column, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` replaces fields (name to column) in the copy whose leaves are checked against the proofs of
    the original.
    """
    plain = {name: F.col(f"`{name}`") for name in manifest.fields}
    found = leaf_digest({**plain, **(tampered or {})}, manifest)
    group = plain.get(manifest.group, F.col(f"`{manifest.group}`")).cast("string")
    digests = rows.select(
        F.col(f"`{manifest.order}`").alias("id"),
        group.isNotNull().alias("named"),
        F.coalesce(group, F.lit("")).alias("name"),
        leaf_digest(plain, manifest).alias("hash"),
        found.alias("found"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = written(digests.withColumn("found", F.when(F.col("found") != F.col("hash"), F.col("found"))))
    placed = places(leaves, GROUP, ["id", "hash", "row"])
    placed = placed.select(*GROUP, "total", "place", "hash", F.struct("id", "found").alias("below"))
    stages, roots = _stages(written(placed))

    # The tree over the groups: one group of their roots.
    below = F.struct(*GROUP, "total").alias("below")
    over = roots.select(F.lit(True).alias("named"), F.lit("").alias("name"), "hash", below)
    group_stages, top = _stages(written(places(written(over), GROUP, ["below"])))
    top = top.select(*GROUP, "total", F.array().cast(PATH).alias("path"))
    paths = _with_paths(group_stages, top, ()).withColumn("root", folded(F.col("hash"), F.col("path")))
    tops = written(paths.select("below.*", F.col("hash").alias("subroot"), "path", "root"))

    leaves = _with_paths(stages, tops, ("subroot", "root"))
    back = folded(F.coalesce("below.found", "hash"), F.col("path"))
    return leaves.select(
        F.col("below.id").alias(manifest.order),
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        back.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
