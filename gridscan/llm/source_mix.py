"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

Documents hang in a tree domain - language - source. Every node has a whole-number weight (1 unless given).
A budget of tokens enters at the root and is split among children by weight, but no node receives more than
its subtree can give: a leaf gives its tokens times ``max_epochs``, an inner node the sum of its children.
What a short node leaves over goes to its siblings, in proportion to their weights; only what the whole
family cannot use is missing one level up, where the same rule spreads it. Shares are rounded down to whole
tokens.

A leaf whose share is q times its tokens and a rest is read q times in full (epochs 0 to q-1), and in epoch
q as a prefix: documents in the order of a hash of seed, epoch and id, as long as their running total stays
within the rest. Each selected copy of a document is one row with its ``epoch``.

Defined cases: a null text has no tokens and a document without tokens is never selected in a prefix of a
leaf without tokens; null domain, language or source is a node of its own; a node without a weight has
weight 1, a weight of 0 or less gives nothing; rows that repeat are documents of their own in whole
epochs, and in a prefix those of equal id and text are taken together or not at all; an empty table gives no rows; further columns are kept, ``epoch`` replaces one of its
name.

The order within a leaf is not sorted as a whole. Hash values fall into a fixed number of slots; totals per
(leaf, slot) find the slot in which the prefix ends, and only documents of that one slot are ordered. So a
source with a third of all rows is counted by partial sums, and texts never move in a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscan.llm.common import written

LEVELS = ("mix_domain", "mix_lang", "mix_source")
SLOTS = 4096  # three hex digits of the key
BROADCAST_ROWS = 50_000  # rows of the plan up to which it is broadcast: a few MB
WORD = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Weights are keyed by a node's path: ('web',), ('web', 'en') or ('web', 'en', 'src0')."""

    weights: Mapping[tuple[str, ...], int] = field(default_factory=dict)
    budget_share: float = 1.0  # of the tokens that the input has
    budget: int | None = None  # in tokens; replaces budget_share
    max_epochs: int = 4
    seed: int = 17


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """32 hex digits that order a leaf's documents in an epoch."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.md5(text.cast("binary"))


def _big(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def _weight(path: tuple[str, ...], weights: Mapping[tuple[str, ...], int]) -> Column:
    """The weight of a node, by its path in the first columns of LEVELS."""
    entries = [(k, v) for k, v in weights.items() if len(k) == len(path)]
    if not entries:
        return F.lit(1).cast("long")
    keys = F.create_map(*[F.lit(x) for k, v in entries for x in ("\x1f".join(k), int(v))])
    name = F.concat_ws("\x1f", *(F.coalesce(F.col(c), F.lit("\x00")) for c in path))
    return F.greatest(F.coalesce(F.try_element_at(keys, name), F.lit(1)), F.lit(0)).cast("long")


def share_out(children: DataFrame, parent: list[str], node: str) -> DataFrame:
    """Split column ``given`` of a parent among its children by weight, up to their capacity.

    children: the parent's columns, ``node``, given, capacity, weight. Adds ``share``. Children are taken by
    growing capacity per weight; one whose capacity is below its part of what is left is filled, and
    from the first that is not, all take their part of the rest.
    """
    rank = Window.partitionBy(*parent).orderBy(
        (F.col("capacity") / F.col("weight")).asc_nulls_first(), "capacity", node
    )
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    family = Window.partitionBy(*parent)
    rows = children.where(F.col("weight") > 0).select(
        "*",
        F.row_number().over(rank).alias("place"),
        F.coalesce(F.sum(_big(F.col("capacity"))).over(before), _big(F.lit(0))).alias("filled"),
        (
            F.sum(_big(F.col("weight"))).over(family)
            - F.coalesce(F.sum(_big(F.col("weight"))).over(before), _big(F.lit(0)))
        ).alias("weight_left"),
    )
    left = F.greatest(_big(F.col("given")) - F.col("filled"), _big(F.lit(0)))
    open_ = _big(F.col("capacity")) * F.col("weight_left") > _big(F.col("weight")) * left
    rows = rows.select("*", F.min(F.when(open_, F.col("place"))).over(family).alias("first_open"))
    at_open = F.col("place") == F.col("first_open")
    rows = rows.select(
        "*",
        F.max(F.when(at_open, left)).over(family).alias("rest"),
        F.max(F.when(at_open, F.col("weight_left"))).over(family).alias("rest_weight"),
    )
    is_full = F.col("first_open").isNull() | (F.col("place") < F.col("first_open"))
    part = F.expr("cast((cast(weight as decimal(38,0)) * rest) div rest_weight as bigint)")
    share = F.when(is_full, F.col("capacity")).otherwise(part).cast("long")
    return rows.select(*children.columns, share.alias("share"))


def leaf_shares(leaves: DataFrame, mix: Mix) -> DataFrame:
    """LEVELS, tokens, share: the budget of every leaf of LEVELS, tokens."""
    levels = list(LEVELS)
    base = leaves.select(*levels, "tokens", (F.col("tokens") * mix.max_epochs).alias("capacity"))
    total = base.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"))
    wanted = F.lit(mix.budget).cast("long") if mix.budget is not None else F.floor(F.col("t") * mix.budget_share)
    given = total.select(F.lit(0).alias("root"), wanted.cast("long").alias("given"))
    parent = ["root"]
    for depth in range(1, len(levels) + 1):
        path = levels[:depth]
        if depth < len(levels):
            nodes = base.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        else:
            nodes = base
        nodes = nodes.withColumn("root", F.lit(0)).withColumn("weight", _weight(tuple(path), mix.weights))
        on = [nodes[c].eqNullSafe(given[c]) for c in parent]
        matched = given
        for c in parent:
            matched = matched.withColumnRenamed(c, f"p_{c}")
        on = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in parent]
        joined = nodes.join(matched, on).drop(*(f"p_{c}" for c in parent))
        shared = share_out(joined, parent, path[-1])
        if depth < len(levels):
            given = shared.select(*path, F.col("share").alias("given"))
            parent = path
    return shared.select(*levels, "tokens", "share")


def plan_leaves(rows: DataFrame, mix: Mix) -> DataFrame:
    """LEVELS, full, slot, cut: what is read of each leaf.

    ``full`` whole epochs, and in the next one all documents in slots before ``slot`` and, in it, those up
    to ``cut``; both are null where there is no such part. rows: LEVELS, mix_tokens,
    mix_doc_id, mix_text_hash.
    """
    levels = list(LEVELS)
    leaves = rows.groupBy(*levels).agg(F.sum("mix_tokens").alias("tokens"))
    shares = leaf_shares(leaves, mix)
    has = F.col("tokens") > 0
    full = F.when(has, F.expr("share div tokens")).otherwise(0).cast("long").alias("full")
    rest = F.when(has, F.expr("share % tokens")).otherwise(0).cast("long").alias("rest")
    plan = written(shares.select(*levels, full, rest))
    some = attach(rows, plan.where(F.col("rest") > 0), "inner", ["full", "rest"])
    some = some.select(*levels, "rest", "mix_tokens", place(mix.seed, F.col("full")).alias("place"))
    slots = some.groupBy(*levels, slot_of(F.col("place")).alias("slot")).agg(
        F.sum("mix_tokens").alias("slot_tokens"), F.max("rest").alias("rest")
    )
    up_to = Window.partitionBy(*levels).orderBy("slot")
    slots = slots.select("*", (F.sum("slot_tokens").over(up_to) - F.col("slot_tokens")).alias("before"))
    ends = (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("slot_tokens") > F.col("rest"))
    ends = written(slots.where(ends).select(*levels, "slot", "before"))
    last = attach(some, ends, "inner", ["slot", "before"]).where(slot_of(F.col("place")) == F.col("slot"))
    running = Window.partitionBy(*levels).orderBy("place")  # rows that tie are taken together
    last = last.select(*levels, "rest", "place", (F.col("before") + F.sum("mix_tokens").over(running)).alias("total"))
    cut = last.where(F.col("total") <= F.col("rest")).groupBy(*levels).agg(F.max("place").alias("cut"))
    return written(attach(attach(plan, ends, "left", ["slot"]), cut, "left", ["cut"]))


def place(seed: int, epoch: Column) -> Column:
    """Where a document stands in its leaf in an epoch: (key, id, hash of the text)."""
    return F.struct(
        order_key(seed, epoch, F.col("mix_doc_id")).alias("key"),
        F.col("mix_doc_id").cast("string").alias("id"),
        F.col("mix_text_hash").alias("hash"),
    )


def slot_of(place_: Column) -> Column:
    return F.conv(F.substring(place_["key"], 1, 3), 16, 10).cast("int")


def attach(rows: DataFrame, plan: DataFrame, how: str, columns: list[str]) -> DataFrame:
    """Join per-leaf columns to rows; the small side is broadcast only where its size is checked."""
    names = {c: f"p_{c}" for c in LEVELS}
    small = plan.select(*(F.col(c).alias(names[c]) for c in LEVELS), *columns)
    if len(plan.limit(BROADCAST_ROWS + 1).select(F.lit(1)).take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS:
        small = F.broadcast(small)
    on = [F.col(c).eqNullSafe(F.col(names[c])) for c in LEVELS]
    return rows.join(small, on, how).drop(*names.values())


def mix_sources(
    documents: DataFrame,
    mix: Mix,
    domain: Column,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """The selected documents, one row per copy, with all their columns and ``epoch``."""
    body = F.col(f"`{text}`")
    helpers = {
        "mix_domain": domain.cast("string"),
        "mix_lang": F.col(f"`{lang}`").cast("string"),
        "mix_source": F.col(f"`{source}`").cast("string"),
        "mix_doc_id": F.col(f"`{doc_id}`"),
        "mix_text_hash": F.xxhash64(body),
    }
    columns = [c for c in documents.columns if c.lower() != "epoch"]
    whole = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("mix_doc")
    rows = documents.select(*(v.alias(k) for k, v in helpers.items()), count_tokens(body).alias("mix_tokens"), whole)
    narrow = written(rows.drop("mix_doc"))
    plan = plan_leaves(narrow, mix)
    chosen = attach(rows.drop("mix_tokens"), plan, "inner", ["full", "slot", "cut"])
    here = place(mix.seed, F.col("full"))
    slot = slot_of(here)
    also = (slot < F.col("slot")) | ((slot == F.col("slot")) & (here <= F.col("cut")))
    last = F.col("full") - F.when(F.coalesce(also, F.lit(False)), 0).otherwise(1)
    epochs = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))
    out = chosen.select("mix_doc", F.explode(epochs).alias("epoch"))
    return out.select(*(F.col("mix_doc")[c].alias(c) for c in columns), "epoch")
