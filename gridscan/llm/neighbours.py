"""Approximate nearest neighbours by largest inner product: NN-descent graph and greedy graph search.

Equal vectors are one node. A node's point is its vector scaled by the largest norm, with one further
coordinate that makes all norms 1: then the nearest points by angle are those of largest inner product for
vectors of any length, and for queries of the form (vector, 0).

1. First edges: random hyperplanes deal the points into cells, cells of any size are dealt into buckets of
   bounded size, and each point takes its nearest in its bucket. Several rounds use other hyperplanes.
2. NN-descent: every node brings together the nodes that have an edge to or from it (a Spark join and a
   grouping; a node with very many such edges is split into groups of bounded size). Pairs with an edge that
   is new since the last iteration are compared, and each side keeps the other if it is nearer than its
   worst. This repeats until few edges change.
3. Search: a query starts at its own node's edges and at the nodes of largest norm, and keeps the best nodes
   seen. Each hop joins the best ones not yet visited with their neighbours. It ends when all kept
   nodes have been visited.
4. Exact scores in double precision on the original vectors order what was found; nodes become rows again.
   Of the nodes that a query kept, those are scored that could be among its nearest given the rounding.

A node with its edges, and a query with the nodes it keeps, are one row with lists of bounded length, sorted
from near to far. Tasks cut what they find to the best of each owner before it moves, so that an iteration or
a hop merges lists in one shuffle. The graph holds points in half precision; rounding only matters for which
nodes are seen.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, as
do rows with a null id; missing last components of shorter vectors count as 0; rows that repeat an id and a
vector are one; a query never finds its own id; fewer candidates than ``top`` give fewer rows; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscan.llm.common import written

H = np.float16
PENDING = 1_000_000  # found nodes that a task holds before it cuts them to the best of each owner
SHARING = 1000  # queries of one vector that are answered together, about
LISTS = "node long, ids array<long>, close array<float>, known array<tinyint>"


@dataclass(frozen=True)
class Descent:
    edges: int = 24  # kept per node
    rounds: int = 6  # of first edges
    bucket: int = 400  # points compared with each other for first edges, about
    group: int = 96  # nodes brought together at once, about
    iterations: int = 6  # at most
    change: float = 0.03  # share of edges that may change when it ends
    beam: int = 384  # nodes that a query keeps
    step: int = 64  # nodes that a query visits in a hop, at most
    entries: int = 16  # nodes of largest norm at which all queries start
    seed: int = 11


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, v: the rows that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    rows = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v"))
    rows = rows.where("id is not null and v is not null")
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def nodes_of(rows: DataFrame, top: int) -> DataFrame:
    """node, ids, v: equal vectors together, with their first ids; the node is named by the smallest."""
    first = Window.partitionBy("v").orderBy("id")
    ranked = rows.select("id", "v", F.dense_rank().over(first).alias("place")).where(F.col("place") <= top + 1)
    nodes = ranked.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    # Two vectors may share an id: the smallest id and the vector's hash make the name.
    return nodes.select(F.xxhash64(F.col("ids")[0], "v").alias("node"), "ids", "v")


def _stack(values: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=H).reshape(-1, width).astype(np.float32)


def points_of(nodes: DataFrame, width: int, longest: float) -> DataFrame:
    """node, norm, point: width + 1 half-precision coordinates as bytes."""

    @F.pandas_udf("norm double, point binary")
    def place(vectors: pd.Series) -> pd.DataFrame:
        x = np.zeros((len(vectors), width + 1))
        for i, v in enumerate(vectors):
            x[i, : len(v)] = v
        x /= longest
        norms = np.sqrt((x * x).sum(axis=1))
        x[:, width] = np.sqrt(np.maximum(0, 1 - norms * norms))
        return pd.DataFrame({"norm": norms, "point": [p.tobytes() for p in x.astype(H)]})

    return nodes.select("node", place("v").alias("p")).select("node", "p.norm", "p.point")


def _best_of(
    owner: np.ndarray, other: np.ndarray, close: np.ndarray, known: np.ndarray, keep: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each owner's nearest others, each of them once, by owner and from near to far."""
    order = np.lexsort((other, owner))
    owner, other, close, known = owner[order], other[order], close[order], known[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    first = np.flatnonzero(new)
    if len(first) < len(owner):
        owner, other = owner[first], other[first]
        close, known = np.maximum.reduceat(close, first), np.maximum.reduceat(known, first)
    order = np.lexsort((other, -close, owner))
    owner, other, close, known = owner[order], other[order], close[order], known[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = owner[1:] != owner[:-1]
    first = np.flatnonzero(new)
    place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    near = place < keep
    return owner[near], other[near], close[near], known[near]


def _lists(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], keep: int) -> Iterator[pd.DataFrame]:
    """Rows of LISTS with the nearest of each owner, from arrays owner, other, close; nothing is known yet."""

    def cut(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        owner, other, close = (np.concatenate(z) for z in zip(*held))
        owner, *rest = _best_of(owner, other, close.astype(np.float32), np.zeros(len(owner), np.int8), keep)
        names, first = np.unique(owner, return_index=True)
        ids, near, known = (np.split(z, first[1:]) for z in rest)
        return pd.DataFrame({"node": names, "ids": ids, "close": near, "known": known})

    held, n = [], 0
    for part in parts:
        if not len(part[0]):
            continue
        held.append(part)
        n += len(part[0])
        if n >= PENDING:
            yield cut(held)
            held, n = [], 0
    if held:
        yield cut(held)


def merged(rows: DataFrame, keep: int, step: int = 0) -> DataFrame:
    """One row for each node, with its point and the nearest of its lists; one of a node's rows has the point.

    ahead: the nearest ``step`` that were not known, which now are.
    """

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = [len(x) for x in pdf["ids"]]
            owner = np.repeat(np.arange(len(pdf)), sizes)
            columns = [np.concatenate([np.asarray(x, t) for x in pdf[c]]) for c, t in _TYPES]
            owner, *rest = _best_of(owner, *columns, keep)
            new = rest[2] == 0
            before = np.append(0, np.cumsum(new))
            turn = before[1:] - before[np.searchsorted(owner, owner)]
            ahead = new & (turn <= step)
            rest[2] = rest[2] | ahead
            cuts = np.cumsum(np.bincount(owner, minlength=len(pdf)))[:-1]
            lists = {c: np.split(z, cuts) for (c, _), z in zip(_TYPES, rest)}
            lists["ahead"] = np.split(rest[0][ahead], np.cumsum(np.bincount(owner[ahead], minlength=len(pdf)))[:-1])
            yield pd.DataFrame({"node": pdf["node"], "point": pdf["point"], **lists})

    parts = [F.flatten(F.collect_list(c)).alias(c) for c, _ in _TYPES]
    rows = rows.groupBy("node").agg(F.first("point", ignorenulls=True).alias("point"), *parts)
    return rows.mapInPandas(merge, f"point binary, {LISTS}, ahead array<long>")


_TYPES = (("ids", np.int64), ("close", np.float32), ("known", np.int8))


def _without_point(lists: DataFrame) -> DataFrame:
    return lists.select("node", F.lit(None).cast("binary").alias("point"), "ids", "close", "known")


def _edges_among(ids: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each point among the others."""
    close = points @ points.T
    np.fill_diagonal(close, -np.inf)
    k = min(k, len(ids) - 1)
    if k < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    best = np.argpartition(-close, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[best.ravel()], np.take_along_axis(close, best, axis=1).ravel()


def first_edges(points: DataFrame, width: int, n: int, config: Descent) -> DataFrame:
    """LISTS: the nearest of each node in its buckets, several rows for each."""
    bits = max(0, math.ceil(math.log2(max(1, n / config.bucket))))
    planes = np.random.default_rng(config.seed).standard_normal((config.rounds, bits, width + 1)).astype(np.float32)

    @F.pandas_udf("array<long>")
    def cells(batch: pd.Series) -> pd.Series:
        side = np.einsum("nd,rbd->nrb", _stack(batch, width + 1), planes) > 0
        codes = (side * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
        return pd.Series(list(codes.astype(np.int64)))

    dealt = points.select("node", "point", F.posexplode(cells("point")).alias("round", "cell"))
    sizes = dealt.groupBy("round", "cell").agg(F.count("*").alias("n"))
    parts = F.greatest(F.lit(1), F.round(F.col("n") / config.bucket)).cast("long")
    dealt = dealt.join(sizes.select("round", "cell", parts.alias("parts")), ["round", "cell"])
    part = F.pmod(F.xxhash64("node", "round"), F.col("parts")).alias("part")
    buckets = dealt.groupBy("round", "cell", part).agg(
        F.collect_list("node").alias("ids"), F.collect_list("point").alias("points")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for pdf in batches for row in zip(pdf["ids"], pdf["points"]))
        found = (_edges_among(np.asarray(ids), _stack(packed, width + 1), config.edges) for ids, packed in rows)
        yield from _lists(found, config.edges)

    return buckets.select("ids", "points").mapInPandas(compare, LISTS)


def gathered(graph: DataFrame, config: Descent) -> DataFrame:
    """center, part, ids, points, worst, known: the nodes with an edge from or to each center.

    worst: how near the last edge of each node is, below any value where it has fewer edges than it may.
    known: 0 if an edge between the node and the center is new.
    """
    edges = graph.select(F.col("node").alias("a"), F.explode(F.arrays_zip("ids", "known")).alias("e"))
    edges = edges.select("a", F.col("e.ids").alias("b"), F.col("e.known").alias("known"))
    # Only numbers are joined to the few centers that are split; points follow.
    sizes = edges.groupBy(F.col("b").alias("center")).agg((F.count("*") + config.edges).alias("n"))
    parts = F.round(F.col("n") / config.group).cast("long").alias("parts")
    hubs = written(sizes.select("center", parts).where("parts > 1"))
    ends = edges.select(F.col("a").alias("center"), F.col("b").alias("node"), "known", F.lit(True).alias("end"))
    starts = edges.select(F.col("b").alias("center"), F.col("a").alias("node"), "known", F.lit(False).alias("end"))
    part = F.pmod(F.xxhash64("node", "center"), F.coalesce("parts", F.lit(1))).alias("part")
    rows = ends.union(starts).join(hubs, "center", "left").select("center", part, "node", "known", "end")
    worst = F.when(F.size("ids") < config.edges, F.lit(-9.0)).otherwise(F.element_at("close", -1)).cast("float")
    others = graph.select("node", "point", worst.alias("worst"), "ids", F.col("known").alias("flags"))
    rows = rows.join(others, "node")
    # Of two edges between a node and a center one brings the point, unless only the other one is new.
    back = F.get("flags", F.array_position("ids", F.col("center")).cast("int") - 1) <= F.col("known")
    rows = rows.where(~(F.col("end") & F.coalesce(back, F.lit(False))))
    return rows.groupBy("center", "part").agg(
        F.collect_list("node").alias("ids"),
        F.collect_list("point").alias("points"),
        F.collect_list("worst").alias("worst"),
        F.collect_list("known").alias("known"),
    )


def improved_edges(groups: DataFrame, width: int, config: Descent) -> DataFrame:
    """LISTS: edges between nodes of a group that are nearer than the worst that their owner has."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for pdf in batches:
                for ids, packed, worst, known in zip(pdf["ids"], pdf["points"], pdf["worst"], pdf["known"]):
                    ids, new = np.asarray(ids), np.asarray(known) == 0
                    if len(ids) < 2 or not new.any():
                        continue
                    x = _stack(packed, width + 1)
                    close = x @ x.T
                    wanted = (new[:, None] | new[None, :]) & (close > np.asarray(worst)[:, None])
                    wanted &= ids[:, None] != ids[None, :]
                    i, j = np.nonzero(wanted)
                    yield ids[i], ids[j], close[i, j]

        yield from _lists(found(), config.edges)

    return groups.select("ids", "points", "worst", "known").mapInPandas(compare, LISTS)


def neighbour_graph(points: DataFrame, width: int, n: int, config: Descent) -> DataFrame:
    """node, point, ids, close, known: the nodes with their edges after NN-descent."""
    none = [F.array().cast(t).alias(c) for c, t in (("ids", "array<long>"), ("close", "array<float>"), ("known", "array<tinyint>"))]
    first = points.select("node", "point", *none).union(_without_point(first_edges(points, width, n, config)))
    graph = written(merged(first, config.edges))
    for _ in range(config.iterations):
        better = improved_edges(gathered(graph, config), width, config)
        known = F.transform("ids", lambda _: F.lit(1).cast("tinyint")).alias("known")
        old = graph.select("node", "point", "ids", "close", known)
        graph = written(merged(old.union(_without_point(better)), config.edges))
        new = F.size(F.filter("known", lambda x: x == 0))
        fresh, every = graph.agg(F.sum(new), F.sum(F.size("ids"))).first()
        if (fresh or 0) <= config.change * (every or 0):
            break
    return graph


def search_graph(points: DataFrame, graph: DataFrame, queries: DataFrame, width: int, config: Descent) -> DataFrame:
    """query, ids, close: the nodes that queries (query: a node) end with, from near to far, their own first."""
    spark = points.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = gathered(graph, config).select("center", "ids", F.array_join(F.transform("points", F.hex), "").alias("p"))
    blocks = written(blocks.select("center", "ids", F.unhex("p").alias("points")))
    blocks = blocks.repartition(parts, "center").sortWithinPartitions("center").persist(StorageLevel.MEMORY_AND_DISK)

    def seen(visits: DataFrame) -> DataFrame:
        """LISTS, the nodes being queries: the nodes of the blocks they visit that are nearer than floor."""

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                for pdf in batches:
                    if not len(pdf):
                        continue
                    q = _stack(pdf["of"], width + 1)
                    q[:, width] = 0
                    for query, x, floor, ids, block in zip(pdf["query"], q, pdf["floor"], pdf["ids"], pdf["points"]):
                        close = np.frombuffer(block, dtype=H).reshape(-1, width + 1).astype(np.float32) @ x
                        near = close > floor
                        yield np.full(near.sum(), query), np.asarray(ids)[near], close[near]

            yield from _lists(found(), config.beam)

        return visits.select("query", "of", "floor", "ids", "points").mapInPandas(compare, LISTS)

    asked = queries.join(points, queries["query"] == points["node"]).select("query", F.col("point").alias("of"))
    asked = written(asked.withColumn("floor", F.lit(-9.0)))
    far = points.orderBy(F.col("norm").desc(), "node").limit(config.entries)  # a bounded table
    far = far.agg(F.collect_list("node").alias("ids"), F.array_join(F.collect_list(F.hex("point")), "").alias("p"))
    entry = asked.crossJoin(F.broadcast(far.select("ids", F.unhex("p").alias("points"))))
    one = F.array(F.lit(1).cast("tinyint")).alias("known")
    itself = asked.select(
        F.col("query").alias("node"), F.col("of").alias("point"), F.array("query").alias("ids"),
        F.array(F.lit(9.0).cast("float")).alias("close"), one,
    )
    try:
        own = seen(asked.join(blocks, F.col("query") == F.col("center")))
        start = itself.union(_without_point(own)).union(_without_point(seen(entry)))
        pool = written(merged(start, config.beam, config.step))
        floor = F.when(F.size("ids") >= config.beam, F.element_at("close", -1)).otherwise(F.lit(-9.0)).alias("floor")
        while not pool.where(F.size("ahead") > 0).isEmpty():
            visits = pool.select(F.col("node").alias("query"), F.col("point").alias("of"), floor, F.explode("ahead").alias("center"))
            found = _without_point(seen(visits.join(blocks, "center")))
            kept = pool.select("node", "point", "ids", "close", "known")
            pool = written(merged(kept.union(found), config.beam, config.step))
        return pool.select(F.col("node").alias("query"), "ids", "close")
    finally:
        blocks.unpersist()


def inner_product(a: Column, b: Column) -> Column:
    """In double precision, from the first component to the last."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def nearest(
    rows: DataFrame,
    is_query: Column,
    top: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    config: Descent = Descent(),
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest rows of each query row; is_query is a condition on ``id``."""
    rows = usable(rows, vec_id, vector)
    nodes = written(nodes_of(rows, top))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    n, width, longest = nodes.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    width, longest = width or 1, longest or 1.0
    points = written(points_of(nodes, width, longest))
    asking = rows.where(is_query).join(nodes, "v").select("id", F.col("node").alias("query")).distinct()
    asking = written(asking)
    queries = asking.select("query").distinct()
    found = search_graph(points, neighbour_graph(points, width, n, config), queries, width, config)
    # Nodes farther than the rounding of both points allows can't be among the nearest of those found.
    unsure = 2 * (1.1 * 2.0**-10 + width * 2.0**-22)
    last = F.coalesce(F.get("close", F.lit(top + 2)), F.lit(-9.0)).cast("double")
    near = F.filter(F.arrays_zip("ids", "close"), lambda z: z["close"] >= F.col("last") - unsure)
    found = found.withColumn("last", last).select("query", F.explode(near).alias("z")).select("query", F.col("z.ids").alias("node"))
    of = nodes.select(F.col("node").alias("query"), F.col("v").alias("of"))
    exact = found.join(nodes, "node").join(of, "query")
    exact = exact.select("query", inner_product(F.col("of"), F.col("v")).alias("score"), F.explode("ids").alias("vec_id"))
    order = [F.col("score").desc(), F.col("vec_id")]
    exact = exact.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    by_node = Window.partitionBy("query").orderBy(*order)
    # One more than asked for: the query's own row is among them.
    some = exact.select("*", F.row_number().over(by_node).alias("place")).where(F.col("place") <= top + 1)
    # A vector that many queries share is dealt in parts of a bounded number of queries.
    sharing = asking.groupBy("query").agg(F.ceil(F.count("*") / SHARING).alias("salts"))
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
    some = some.join(sharing, "query").select("query", "vec_id", "score", salt)
    asking = asking.join(sharing, "query").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))
    pairs = asking.select("id", "query", "salt").join(some, ["query", "salt"]).where("id != vec_id")
    by_id = Window.partitionBy("id").orderBy(*order)
    out = pairs.select(F.col("id").alias("query_id"), F.row_number().over(by_id).alias("rank"), "vec_id", "score")
    return out.where(F.col("rank") <= top)
