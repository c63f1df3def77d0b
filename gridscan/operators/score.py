"""Scores of leaves and points: the path score and the box score.

Everything is computed per leaf or per node and joined to points once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscan.config import Params
from gridscan.functions import deviation
from gridscan.functions import geometry as G
from gridscan.operators.assign import join_codes, leaf_distance, outside_points
from gridscan.operators.cells import NODE, leaf_cells
from gridscan.operators.codes import levels_between
from gridscan.operators.grids import add_offsets, code_points, code_points_in
from gridscan.operators.paths import along_path, path_counts
from gridscan.operators.tiles import PLACE, place_codes, place_points

POINT = ["point_id", "batch_id", "ts", "x", "y"]
# Unique in a deduplicated batch, whatever the ids are. The id leads, as sorts first compare the first column.
KEY = ["point_id", "batch_id", "x", "y"]
SCORED = [*POINT, "tree", "node_id", "distance", "score"]


def score_path(cells: DataFrame, params: Params) -> DataFrame:
    """Path score of every non-empty leaf: (tree, level, cell, path_counts, score)."""
    leaves = leaf_cells(path_counts(cells.where(F.col("n") > 0), params))
    score = deviation.path_score(F.col("path_counts"), params.exact)
    return leaves.select(*NODE, "path_counts", score.alias("score"))


def frontier_moments(cells: DataFrame, params: Params) -> DataFrame:
    """Count, square and cube sums of every frontier: (tree, sampling_level, cell, counting_level).

    Cubes are summed in two parts, which hold windows of up to 10^15 points; ``s3`` is their
    sum, or NULL where it has more than 38 digits.

    The frontier of a sampling cell at a counting level, up to alpha levels below, holds the
    cells under it at that level and the leaves above it. Each cell adds itself to the
    frontiers of its nearest ancestors; a leaf stands in for its missing descendants.
    """
    level, alpha = F.col("level"), F.lit(params.alpha)
    sampling = F.explode(levels_between(F.greatest(level - alpha, F.lit(0)), level))
    deepest = F.least(F.col("sampling_level") + alpha, F.lit(params.max_depth))
    counting = F.explode(F.sequence(level, F.when(F.col("is_leaf"), deepest).otherwise(level)))
    count = F.col("n").cast(deviation.COUNT)
    return (
        cells.where(F.col("n") > 0)
        .withColumn("sampling_level", sampling)
        .withColumn("counting_level", counting)
        .groupBy(
            "tree",
            "sampling_level",
            G.cell_at(F.col("cell"), level, F.col("sampling_level")).alias("cell"),
            "counting_level",
        )
        .agg(
            F.sum("n").alias("n"),
            F.sum((count * count).cast(deviation.WIDE)).alias("s2"),
            *deviation.cube_sums(count),
        )
        .withColumn("s3", deviation.whole_cubes(F.col("s3_high"), F.col("s3_low")))
    )


def pair_scores(cells: DataFrame, moments: DataFrame, params: Params) -> DataFrame:
    """Deviation of each counting cell under the sampling cells it is compared with.

    A cell at level alpha or below is compared with its ancestor alpha levels up; a leaf
    also with all its nearer ancestors and itself.
    """
    level, alpha = F.col("level"), F.lit(params.alpha)
    far = F.greatest(level - alpha, F.lit(0))
    compared = (
        F.when(F.col("is_leaf"), F.sequence(far, level))
        .when(level >= alpha, F.array(far))
        .otherwise(F.array().cast("array<int>"))
    )
    nodes = (
        cells.where(F.col("n") > 0)
        .select(*NODE, "n", "is_leaf", F.explode(compared).alias("sampling_level"))
        .withColumn("sampling_cell", G.cell_at(F.col("cell"), level, F.col("sampling_level")))
    )
    sums = moments.select(
        "tree",
        "sampling_level",
        F.col("cell").alias("sampling_cell"),
        F.col("counting_level").alias("level"),
        F.col("n").alias("n_sampling"),
        "s2",
        "s3_high",
        "s3_low",
    )
    # At most 4^alpha counting cells share a frontier, so no join key is hot.
    return nodes.join(sums, ["tree", "sampling_level", "sampling_cell", "level"]).select(
        *NODE,
        "n",
        "is_leaf",
        "sampling_level",
        "sampling_cell",
        deviation.mdef_norm(
            F.col("n_sampling"), F.col("s2"), F.col("s3_low"), F.col("n"), F.col("s3_high")
        ).alias("score"),
    )


def box_profiles(cells: DataFrame, params: Params) -> DataFrame:
    """``profile`` of every non-empty leaf: its pair score per sampling level 0..leaf level.

    Entry a compares the cell at level min(a + alpha, leaf level) with the ancestor at level
    a. Far entries belong to ancestors of the leaf and are handed down along the path.
    """
    level, alpha = F.col("level"), F.lit(params.alpha)
    is_far = level - F.col("sampling_level") == alpha
    near = F.when(~is_far, F.struct("sampling_level", "score"))
    per_node = (
        pair_scores(cells, frontier_moments(cells, params), params)
        .groupBy(*NODE)
        .agg(
            F.max(F.when(is_far, F.col("score"))).alias("far"),
            F.array_sort(F.collect_list(near)).alias("near"),
        )
    )
    nodes = cells.where(F.col("n") > 0).join(per_node, NODE, "left")
    handed = along_path(nodes, "far", "fars", params).where("is_leaf")
    # Below level alpha nothing is handed down, and the near entries start at level 0.
    inherited = F.slice("fars", params.alpha + 1, F.size("fars"))
    return handed.select(
        *NODE, F.concat(inherited, F.transform("near", lambda p: p["score"])).alias("profile")
    )


def score_box(cells: DataFrame, params: Params) -> DataFrame:
    """Box score of every non-empty leaf within its own tree, and its ``profile``.

    The largest entry up to the first sampling level whose counting cell would lie below
    the leaf; at least zero.
    """
    used = F.greatest(F.col("level") + 1 - params.alpha, F.lit(0)) + 1
    best = F.greatest(F.array_max(F.slice("profile", 1, used)), F.lit(0.0))
    return box_profiles(cells, params).withColumn("score", best)


def score_leaves(cells: DataFrame, params: Params) -> DataFrame:
    """Leaf scores of the configured scorer."""
    return score_box(cells, params) if params.scorer == "box" else score_path(cells, params)


def score_codes(leaves_by_code: DataFrame, leaf_scores: DataFrame, params: Params) -> DataFrame:
    """Hand the leaf scores to the codes in the leaves.

    A leaf holds at most N codes, or one at the depth limit, so no join key is hot.
    """
    extra = ["profile"] if params.scorer == "box" and params.trees > 1 else []
    scores = leaf_scores.select(
        "tree", F.col("level").alias("leaf_level"), F.col("cell").alias("leaf_cell"), "score", *extra
    )
    return leaves_by_code.join(scores, ["tree", "leaf_level", "leaf_cell"]).drop("n")


def nearest_grid(located: DataFrame, level: int, params: Params) -> DataFrame:
    """For each point the tree whose deepest cell at or above ``level`` has the nearest centre.

    Ties go to the lowest tree. Points of a batch are told apart by id and coordinates.
    """
    node_level = F.least(F.col("leaf_level"), F.lit(level))
    candidate = F.struct(
        leaf_distance(node_level, params).alias("distance"),
        F.col("tree"),
        node_level.alias("node_level"),
        G.cell_at(F.col("leaf_cell"), F.col("leaf_level"), node_level).alias("node_cell"),
    )
    return (
        located.groupBy(*KEY)
        .agg(F.min(candidate).alias("best"))
        .select(*KEY, "best.*")
    )


def score_points(scored: DataFrame, params: Params) -> DataFrame:
    """One row per point: the score of the tree whose leaf centre is nearest.

    ``scored`` has a row per point and tree, with ``node_id`` or the leaf's level and cell. With
    one tree there is nothing to choose and nothing to shuffle. With several, no two of a point's
    rows come from one task: they are shuffled as they are, and sorted once.
    """
    if params.trees == 1:
        return _named(scored).select(*SCORED)
    node = ["node_id"] if "node_id" in scored.columns else ["leaf_level", "leaf_cell"]
    best = F.min(F.struct("distance", "tree", "score", *node, "ts")).alias("best")
    # A grouping changes its floating-point keys first, so it only takes over a shuffle by other keys.
    spot = F.xxhash64("batch_id", "x", "y")
    rows = scored.select(*POINT, "tree", "distance", "score", *node).repartition("point_id", spot)
    chosen = rows.groupBy("point_id", spot.alias("spot"), "batch_id", "x", "y").agg(best)
    return _named(chosen.select(*KEY, "best.*")).select(*SCORED)


def _named(rows: DataFrame) -> DataFrame:
    """Add ``node_id`` from the leaf's level and cell, where it is not there."""
    if "node_id" in rows.columns:
        return rows
    return rows.withColumn("node_id", G.node_id(F.col("leaf_level"), F.col("leaf_cell")))


def _box_over_grids(trees: Column, params: Params) -> Column:
    """Box score of a point from its leaf in every tree.

    Walks the counting levels from alpha on; at each one the tree with the nearest cell
    centre supplies the pair score. The walk ends with the first level whose chosen cell
    is a leaf from a coarser level.
    """
    alpha = params.alpha
    deepest = F.array_max(F.transform(trees, lambda t: t["leaf_level"]))
    levels = F.sequence(F.lit(alpha), F.greatest(deepest + 1, F.lit(alpha)))

    def chosen(level: Column) -> Column:
        def candidate(t: Column) -> Column:
            return F.struct(
                F.get(t["distances"], F.least(level, t["leaf_level"])).alias("distance"),
                t["tree"].alias("tree"),
                (t["leaf_level"] < level).alias("ends"),
                # A leaf compared with itself does not deviate.
                F.coalesce(F.get(t["profile"], level - alpha), F.lit(0.0)).alias("score"),
            )

        return F.array_min(F.transform(trees, candidate))

    walk = F.transform(levels, chosen)
    # The last level ends in every tree, so the position is never zero.
    steps = F.array_position(F.transform(walk, lambda s: s["ends"]), True).cast("int")
    scores = F.transform(walk, lambda s: s["score"])
    return F.greatest(F.array_max(F.slice(scores, 1, steps)), F.lit(0.0))


def _distances(params: Params) -> Column:
    """Distances of a point with offsets to the centres of its cells down to the leaf."""
    levels = F.sequence(F.lit(0), F.col("leaf_level"))
    return F.transform(levels, lambda level: leaf_distance(level, params))


def score_points_box(located: DataFrame, params: Params) -> DataFrame:
    """Box score per point over several trees, from one row per point and tree with ``profile``.

    Groups are as large as the number of trees. Tree, node and distance are those of the
    nearest leaf, as for the path score.
    """
    tree = F.struct("tree", "leaf_level", _distances(params).alias("distances"), "profile")
    best = F.min(F.struct("distance", "tree", "node_id", "ts")).alias("best")
    grouped = (
        located.withColumn("_tree", tree)
        .groupBy(*KEY)
        .agg(best, F.collect_list("_tree").alias("trees"))
        .withColumn("score", _box_over_grids(F.col("trees"), params))
    )
    outside = (*KEY, "score")
    return grouped.select(
        *[F.col(c) if c in outside else F.col("best")[c].alias(c) for c in SCORED]
    )


def score_coded(
    coded: DataFrame, codes_with_score: DataFrame, hot: DataFrame, params: Params
) -> DataFrame:
    """Scored points from coded points and the scores of their codes."""
    located = add_offsets(join_codes(coded, codes_with_score, hot), params)
    located = located.withColumn("distance", leaf_distance(F.col("leaf_level"), params))
    if params.scorer == "box" and params.trees > 1:
        inside = score_points_box(_named(located), params)
    else:
        inside = score_points(located, params)
    return inside.unionByName(outside_points(coded).select(*SCORED))


def score_placed(
    points: DataFrame, codes_with_score: DataFrame, hot: DataFrame, params: Params
) -> DataFrame:
    """Scored points over a few trees, from points with their ``tile`` and codes with their ``corners``.

    All joins have the place in their keys, by which both sides are shuffled: there is one shuffle
    of the points for all trees, and their rows stay whole.
    """
    box = params.scorer == "box"
    extra = ["profile"] if box else []
    rows = place_points(points, hot)
    nearest, leaves = None, []
    for tree in range(params.trees):
        codes = codes_with_score.where(F.col("tree") == tree)
        codes = place_codes(codes.select("code", "corners", "leaf_level", "score", *extra), hot)
        rows = code_points_in(rows, tree, params).join(codes, [*PLACE, "code"])
        leaf = F.struct(
            leaf_distance(F.col("leaf_level"), params).alias("distance"),
            F.lit(tree).alias("tree"),
            "score",
            "leaf_level",
            G.cell_at(F.col("code"), params.max_depth, F.col("leaf_level")).alias("leaf_cell"),
        )
        found = {"nearest": leaf if nearest is None else F.least(nearest, leaf)}
        if box:
            distances = _distances(params).alias("distances")
            found[f"_leaf{tree}"] = F.struct(F.lit(tree).alias("tree"), "leaf_level", distances, "profile")
            leaves.append(F.col(f"_leaf{tree}"))
        rows = rows.withColumns(found).drop("u", "v", "ix", "iy", "code", "leaf_level", "score", *extra)
        nearest = F.col("nearest")
    inside = rows.select(*POINT, "nearest.*", *leaves)
    if box:
        inside = inside.withColumn("score", _box_over_grids(F.array(*leaves), params))
    outside = outside_points(code_points(points, params))
    return _named(inside).select(*SCORED).unionByName(outside.select(*SCORED))
