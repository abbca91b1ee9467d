"""Density clusters with outliers (DBSCAN, Ester et al. 1996) by hashed cells."""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

#: Points of a cell that one task compares with a neighbouring cell; a fuller cell is
#: dealt over several tasks.
CELL_ROWS = 20_000


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _gap(low: Column, high: Column, low_b: Column, high_b: Column) -> Column:
    """Least squared distance between two boxes."""
    apart = F.zip_with(
        F.zip_with(low, high_b, lambda a, b: a - b),
        F.zip_with(low_b, high, lambda a, b: a - b),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    return F.aggregate(apart, F.lit(0.0), lambda s, v: s + v * v)


def _reach(low: Column, high: Column, low_b: Column, high_b: Column) -> Column:
    """Greatest squared distance between two boxes."""
    across = F.zip_with(
        F.zip_with(high, low_b, lambda a, b: a - b),
        F.zip_with(high_b, low, lambda a, b: a - b),
        lambda x, y: F.greatest(x, y),
    )
    return F.aggregate(across, F.lit(0.0), lambda s, v: s + v * v)


def _box(dims: int) -> list[Column]:
    """Aggregates: the tight box of the points ``v`` of a group."""
    return [
        F.array(*[F.min(F.col("v")[i]) for i in range(dims)]).alias("low"),
        F.array(*[F.max(F.col("v")[i]) for i in range(dims)]).alias("high"),
    ]


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of ``nodes`` (node) and undirected ``links`` (a, b): the smallest
    node that can be reached.

    Each round a node takes the least root among its neighbours, all nodes of a root
    take the least that one of them found, and each then jumps to its root's root, so
    long chains shorten.  Rounds are written tables; only whether one changed anything
    reaches the driver.
    """
    ways = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ways = materialize(ways.where("a <> b").distinct(), "links")
    current = materialize(nodes.select("node", F.col("node").alias("root")).distinct(), "roots")
    while True:
        # Every node takes the least root among its neighbours.
        of_b = current.select(F.col("node").alias("b"), F.col("root").alias("seen"))
        seen = ways.join(of_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        found = current.join(seen, "node", "left").select(
            "node", "root", F.least("root", F.coalesce("seen", "root")).alias("found")
        )
        hooks = found.groupBy(F.col("root").alias("old")).agg(F.min("found").alias("least"))
        hooks = hooks.where("least < old")
        moved = found.withColumnRenamed("root", "old").join(hooks, "old", "left").select(
            "node", F.coalesce("least", "found").alias("root")
        )
        moved = materialize(moved, "roots")
        above = moved.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = materialize(moved.join(above, "root").select("node", F.col("above").alias("root")), "roots")
        changed = after.alias("x").join(current.alias("y"), "node").where("x.root <> y.root")
        if changed.isEmpty():
            return after
        current = after


def _near_cells(cells: DataFrame, eps: float, side: float) -> DataFrame:
    """(a, b, salts_b, within): ordered pairs of cells, a cell with itself too, whose
    boxes come within ``eps``; ``within`` when all their points do.

    Cells meet in coarse cells of side ``2 * eps``: one is posted at its lower corner,
    the other goes wherever the lower corner of a cell within ``eps`` of its box can
    lie, at most three places along each axis.
    """
    def coarse(x: Column) -> Column:
        return F.floor(x / (2 * eps))

    below, above = (eps + side) * (1 + 1e-9), eps * (1 + 1e-9)
    spans = F.zip_with("low", "high", lambda a, b: F.sequence(coarse(a - below), coarse(b + above)))
    touched = F.aggregate(
        spans,
        F.array(F.array().cast("array<bigint>")),
        lambda sofar, span: F.flatten(
            F.transform(sofar, lambda head: F.transform(span, lambda x: F.concat(head, F.array(x))))
        ),
    )
    sent = cells.select(
        F.col("cell").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"),
        F.explode(touched).alias("_at"),
    )
    posted = cells.select(
        F.col("cell").alias("b"), "low", "high", "salts",
        F.transform("low", coarse).alias("_at"),
    )
    boxes = [F.col(c) for c in ("low_a", "high_a", "low", "high")]
    return (
        sent.join(posted, "_at")
        .where(_gap(*boxes) <= eps * eps)
        .select("a", "b", F.col("salts").alias("salts_b"), (_reach(*boxes) <= eps * eps).alias("within"))
    )


def _full_links(points: DataFrame, pairs: DataFrame, eps: float, side: float, dims: int) -> DataFrame:
    """(a, b): of pairs of full cells those that hold two points within ``eps``.

    Boxes are halved along every axis in each round, around the points they hold.  Two
    boxes wholly within ``eps`` of each other link their cells, boxes farther apart
    drop out, and only the others go on; a linked pair of cells goes no further.  Equal
    points are one, so a box ends as a point and each comparison is decided.
    """
    linked = None
    level, width = 0, side
    whole = F.array().cast("array<bigint>")
    left = pairs.select("a", "b", whole.alias("pa"), whole.alias("pb"))
    while True:
        level, width = level + 1, width / 2
        inside = F.transform("v", lambda x: F.floor(x / width))
        parent = F.transform("sub", lambda x: F.shiftright(x, 1)) if level > 1 else whole
        boxes = points.groupBy("cell", inside.alias("sub")).agg(*_box(dims)).withColumn("parent", parent)
        boxes = materialize(boxes, "boxes")
        one = boxes.select(F.col("cell").alias("a"), F.col("parent").alias("pa"), F.col("sub").alias("sa"),
                           F.col("low").alias("low_a"), F.col("high").alias("high_a"))
        two = boxes.select(F.col("cell").alias("b"), F.col("parent").alias("pb"), F.col("sub").alias("sb"),
                           "low", "high")
        sides = [F.col(c) for c in ("low_a", "high_a", "low", "high")]
        judged = (
            left.join(one, ["a", "pa"]).join(two, ["b", "pb"])
            .where(_gap(*sides) <= eps * eps)
            .select("a", "b", F.col("sa").alias("pa"), F.col("sb").alias("pb"),
                    (_reach(*sides) <= eps * eps).alias("done"))
        )
        judged = materialize(judged, "boxes-met")
        new = judged.where("done").select("a", "b").distinct()
        linked = new if linked is None else linked.unionAll(new)
        left = materialize(judged.join(new, ["a", "b"], "left_anti").drop("done"), "boxes-left")
        if left.isEmpty():
            return linked
        # Points of cells that are still compared.
        still = left.select(F.col("a").alias("cell")).unionAll(left.select(F.col("b").alias("cell"))).distinct()
        points = materialize(points.join(still, "cell", "left_semi"), "points-left")


def density_clusters(
    vectors: DataFrame,
    eps: float,
    min_points: int = 10,
    min_size: int = 1,
    column: str = "embedding",
    doc_id: str = "doc_id",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(doc_id, topic_id, core): the clusters of DBSCAN, noise -1.

    A row is core when at least ``min_points`` rows, itself included, lie within
    ``eps`` of it; core rows within ``eps`` of each other share a cluster; another row
    within ``eps`` of core rows joins the nearest one's cluster (ties to the cluster
    with the smallest point), and the rest is noise.  Clusters of fewer than
    ``min_size`` rows are noise too; the others are numbered by size, then by their
    smallest point.  Rows whose vector is null, empty, of another length than most
    (the longest of the most frequent) or holds a null or non-finite component, or one
    beyond 2 ** 60 times ``eps``, are noise and not core.  Meant for few dimensions (after ``apply_reduction``): cells
    are found by the ``3 ** dims`` places around one at most.

    Equal points are merged first and count by their rows.  Cells have the diagonal
    ``eps``: a cell with ``min_points`` rows is core throughout, and no two rows of it
    are compared.  A cell with fewer is compared with the cells around it, so there
    are at most a constant times ``min_points`` comparisons for each point; a full
    cell's side of them is dealt over tasks.  Two full cells meet by boxes
    (``_full_links``).  Nothing but counts reaches the driver.
    """
    v = F.transform(column, lambda x: x.cast("double"))
    if eps <= 0:
        raise ValueError("eps must be above 0")
    big = F.lit(2.0**60 * eps)  # cell numbers are longs
    rows = vectors.select(F.col(doc_id).alias("doc_id"), v.alias("v"))
    sound = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & (F.size("v") > 0))
    usual = sound.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), F.desc("d")
    ).limit(1).collect()
    if not usual:
        return rows.select(F.col("doc_id").alias(doc_id), F.lit(-1).alias("topic_id"), F.lit(False).alias("core"))
    dims = usual[0].d
    # A little less than eps / sqrt(dims), so that rounding cannot widen a cell.
    side = eps / sqrt(dims) * (1 - 1e-9)
    sound = sound.where(F.size("v") == dims)
    points = sound.groupBy("v").agg(F.count(F.lit(1)).alias("w"))
    points = materialize(points.withColumn("cell", F.transform("v", lambda x: F.floor(x / side))), "points")
    sizes = points.groupBy("cell").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), *_box(dims))
    sizes = materialize(
        sizes.select("cell", "low", "high", (F.col("w") >= min_points).alias("full"),
                     F.ceil(F.col("n") / cell_rows).cast("int").alias("salts")),
        "cells",
    )
    near = materialize(_near_cells(sizes, eps, side), "near-cells")

    full = sizes.where("full").select("cell")
    of_cells = points.join(sizes.select("cell", "full", "salts"), "cell")
    sparse = of_cells.where("not full").select(F.col("cell").alias("a"), F.col("v").alias("p"))
    dealt = of_cells.select(
        F.col("cell").alias("b"), F.col("v").alias("q"), "w", "full",
        F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"),
    )
    # Every point of a cell that is not full, with all points within eps of it.
    asked = sparse.join(near, "a").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("salts_b") - 1))
    )
    beside = asked.join(dealt, ["b", "salt"]).withColumn("d", _squared(F.col("p"), F.col("q")))
    beside = beside.where(F.col("d") <= eps * eps)
    counted = beside.groupBy("a", "p").agg(F.sum("w").alias("w"))
    core_sparse = counted.where(F.col("w") >= min_points).select(F.col("a").alias("cell"), F.col("p").alias("v"))
    core = points.join(full, "cell", "left_semi").select("cell", "v").unionAll(core_sparse)
    core = materialize(core, "core-points")
    core_cells = core.select(F.col("cell").alias("node")).distinct()

    # The nearest core point of each neighbouring cell, for links and for edges.
    to_core = beside.drop("full").join(core.select(F.col("v").alias("q")), "q", "left_semi")
    to_core = materialize(to_core.groupBy("a", "p", "b").agg(F.min("d").alias("d")), "to-core")
    links = to_core.join(core.select(F.col("v").alias("p")), "p", "left_semi").select("a", "b")
    both = (
        near.where(F.col("a") < F.col("b"))
        .join(full.select(F.col("cell").alias("a")), "a", "left_semi")
        .join(full.select(F.col("cell").alias("b")), "b", "left_semi")
    )
    links = links.unionAll(both.where("within").select("a", "b"))
    # Full cells that other cells join already need no comparison.
    joined = connected(core_cells, links)
    root = {c: joined.select(F.col("node").alias(c), F.col("root").alias("root_" + c)) for c in ("a", "b")}
    apart = both.where("not within").join(root["a"], "a").join(root["b"], "b").where("root_a <> root_b")
    apart = materialize(apart.select("a", "b"), "cells-apart")
    if not apart.isEmpty():
        mine = apart.select(F.col("a").alias("cell")).unionAll(apart.select(F.col("b").alias("cell"))).distinct()
        more = _full_links(
            points.join(mine, "cell", "left_semi").select("cell", "v"), apart, eps, side, dims
        )
        joined = connected(core_cells, joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))
    joined = joined.withColumnRenamed("node", "cell")

    # A cluster's name is its smallest core point.
    of_core = core.join(joined, "cell")
    names = of_core.groupBy("root").agg(F.min("v").alias("name"))
    of_core = of_core.join(names, "root").select("v", "name", F.lit(True).alias("core"))
    edges = (
        to_core.join(core.select(F.col("v").alias("p")), "p", "left_anti")
        .join(joined.select(F.col("cell").alias("b"), "root"), "b").join(names, "root")
        .groupBy(F.col("p").alias("v")).agg(F.min(F.struct("d", "name"))["name"].alias("name"))
        .withColumn("core", F.lit(False))
    )
    placed = points.select("v", "w").join(of_core.unionByName(edges), "v")
    placed = materialize(placed, "placed-points")
    kept = placed.groupBy("name").agg(F.sum("w").alias("n")).where(F.col("n") >= min_size)
    numbered = _numbered(materialize(kept, "clusters"))
    placed = placed.join(numbered, "name", "left").select("v", "topic_id", "core")
    return rows.join(placed, "v", "left").select(
        F.col("doc_id").alias(doc_id),
        F.coalesce("topic_id", F.lit(-1)).cast("int").alias("topic_id"),
        F.coalesce("core", F.lit(False)).alias("core"),
    )


def _numbered(clusters: DataFrame) -> DataFrame:
    """(name, topic_id): one row per cluster, the largest first."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "name")
    return clusters.select("name", (F.row_number().over(order) - 1).alias("topic_id"))
