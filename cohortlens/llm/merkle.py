"""A Merkle manifest of a table: a hash per row, a tree per group, one root, and for
every row the siblings that prove it.

Nodes of a level are pivoted: conditional aggregates put the children of a parent into
columns, the columns joined are hashed, and all columns but a child's own are its
siblings.  One exchange pivots ``fanout ** LEVELS`` columns and serves ``LEVELS`` levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import let
from ..session import materialize
from .positions import coded, in_order, numbered

#: Children that one exchange spreads into columns, at most.
WIDEST = 64


def leaf_hash(*columns: Column) -> Column:
    """SHA-256 (hexadecimal) of the columns' codes, nulls told from empty texts."""
    return F.sha2(F.concat(*[coded(c) for c in columns]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and its siblings give."""
    return F.aggregate(
        proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256)
    )


def siblings(proof: Column) -> Column:
    """All siblings of a proof joined, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


def _levels_up(nodes: Column, fanout: int, levels: Column) -> Column:
    """The nodes of a block and of every level above it, an array per level."""

    def parents(below: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / fanout).cast("int"))
        return F.transform(
            runs,
            lambda run: let(
                F.array_join(F.slice(below, run * fanout + 1, fanout), ""),
                # No child, no parent: the columns beyond the last node are null.
                lambda joined: F.when(joined != "", F.sha2(joined, 256)),
            ),
        )

    return F.aggregate(
        levels,
        F.array(nodes),
        lambda up, _: F.concat(up, F.array(parents(F.element_at(up, -1)))),
    )


def _steps(up: Column, slot: Column, fanout: int) -> Column:
    """The siblings of the child in ``slot``, level by level inside its block."""

    def step(nodes: Column, level: Column) -> Column:
        own = F.floor(slot / F.pow(F.lit(float(fanout)), level)).cast("int")
        start = own - own % fanout
        return F.struct(
            F.array_join(F.slice(nodes, start + 1, own % fanout), "").alias("before"),
            F.array_join(F.slice(nodes, own + 2, fanout - 1 - own % fanout), "").alias("after"),
        )

    return F.transform(F.slice(up, 1, F.size(up) - 1), step)


def _blocks(nodes: DataFrame, fanout: int, levels: int, done: int, name: str) -> DataFrame:
    """Pivot (tree, at, height, node, carried) into one row per block of
    ``fanout ** levels`` neighbours, with the levels above them up to the tree's top."""
    width = fanout**levels
    spread = nodes.groupBy("tree", F.floor(F.col("at") / width).alias("block")).agg(
        F.max("height").alias("height"),
        *[
            F.first(F.when(F.col("at") % width == i, F.struct("node", "carried")), ignorenulls=True).alias(f"c{i}")
            for i in range(width)
        ],
    )
    children = F.array(*[f"c{i}" for i in range(width)])
    above = F.filter(
        F.sequence(F.lit(1), F.lit(levels)), lambda level: level <= F.col("height") - F.lit(done)
    )
    return materialize(
        spread.select(
            "tree", "block", "height",
            F.transform(children, lambda c: c["carried"]).alias("carried"),
            _levels_up(F.transform(children, lambda c: c["node"]), fanout, above).alias("up"),
        ),
        name,
    )


def _heights(size: str, fanout: int) -> Column:
    """Levels above the leaves of a tree: the least h with fanout ** h >= size."""
    return F.size(
        F.filter(F.sequence(F.lit(0), F.lit(62)), lambda h: F.pow(F.lit(float(fanout)), h) < F.col(size))
    )


def _climb(nodes: DataFrame, fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every round, from the leaves up, and the top node of every tree."""
    levels = 1
    while fanout ** (levels + 1) <= WIDEST:
        levels += 1
    tallest = nodes.agg(F.max("height")).first()[0] or 0  # one number
    rounds, done = [], 0
    while True:
        blocks = _blocks(nodes, fanout, levels, done, name)
        rounds.append(blocks)
        done += levels
        nodes = blocks.select(
            "tree", F.col("block").alias("at"), "height",
            F.element_at(F.element_at("up", -1), 1).alias("node"),
            F.lit(None).cast("int").alias("carried"),
        )
        if done >= tallest:
            return rounds, nodes.select("tree", "node")


def _descend(rounds: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """Per leaf (tree, node, carried, proof, rest): its siblings up to its tree's top
    and beyond it what ``tops`` (tree, proof, rest) says."""
    above = tops.select("tree", F.lit(0).cast("bigint").alias("at"), "proof", "rest")
    for number in range(len(rounds) - 1, -1, -1):
        blocks = rounds[number]
        joined = blocks.join(above.withColumnRenamed("at", "block"), ["tree", "block"])
        width = F.size(F.element_at("up", 1))
        found = joined.select(
            "tree", "block", "up", "carried", "proof", "rest", width.alias("width"),
            F.posexplode(F.element_at("up", 1)).alias("slot", "node"),
        ).where(F.col("node").isNotNull())
        above = found.select(
            "tree",
            (F.col("block") * F.col("width") + F.col("slot")).alias("at"),
            "node",
            F.element_at("carried", F.col("slot") + 1).alias("carried"),
            F.concat(_steps(F.col("up"), F.col("slot"), fanout), F.col("proof")).alias("proof"),
            "rest",
        )
        if number:
            above = materialize(above.drop("node", "carried"), "proofs")
    return above


def manifest(
    rows: DataFrame, leaf: Column, group: str, order: str, keep: dict[str, Column], fanout: int = 2
) -> DataFrame:
    """Per row the ``keep`` columns and leaf, subroot, root, proof.

    Leaves of a ``group`` ascend by ``order``, nulls first, equal ones by their hash.
    While a level has several nodes, every ``fanout`` consecutive ones become the hash
    of their joined text, the last run as long as it is.  The top is the group's
    subroot; the subroots, by ``group`` (null first, by bytes), give the root alike.
    ``proof`` holds, per level from the row to the root, the siblings before and after
    the node on the way; ``fold`` and ``siblings`` read it.

    Any column may be null; a null group is a group.  Repeated rows are leaves of their
    own.  An empty table has no rows and no root.  A lone row's proof is empty.  ``keep``
    columns named leaf, subroot, root or proof are left out; any other name may occur.

    Texts are read once and only hashes leave the scan.  The leaves are numbered in
    ranges, so a group or key with a third of all rows is spread over tasks, and every
    exchange is on (group, block): no task gathers more than ``WIDEST`` children at a time.
    """
    made = ("leaf", "subroot", "root", "proof")
    names = [c for c in keep if c.lower() not in made]
    hashed = rows.select(
        leaf.alias("node"),
        coded(F.col(group)).alias("tree"),
        F.col(group).cast("string").alias("name"),
        F.col(order).alias("by"),
        F.struct(F.lit(0).alias("_"), *[keep[c].alias(f"k{i}") for i, c in enumerate(names)]).alias("carried"),
    )
    placed = numbered(in_order(hashed, ["name", "by", "node"], "leaves"), "tree", "at", "size")
    leaves = placed.select("tree", "at", "node", "carried", "name", _heights("size", fanout).alias("height"))
    rounds, tops = _climb(leaves, fanout, "blocks")

    # The tree of the groups' tops: one row per group.
    named = tops.join(placed.select("tree", "name").distinct(), "tree").select(
        F.lit("all").alias("whole"), F.col("tree").alias("of"), "node", "name"
    )
    groups = numbered(in_order(named, ["name"], "subroots"), "whole", "at", "size").select(
        F.col("whole").alias("tree"), "at", "node", F.col("of").alias("carried"),
        _heights("size", fanout).alias("height"),
    )
    upper, root = _climb(groups, fanout, "top-blocks")
    no_steps = F.array().cast("array<struct<before:string,after:string>>")
    whole = root.select("tree", no_steps.alias("proof"), F.col("node").alias("rest"))
    of_groups = _descend(upper, whole, fanout).select(
        F.col("carried").alias("tree"), "proof",
        F.struct(F.col("node").alias("subroot"), F.col("rest").alias("root")).alias("rest"),
    )
    found = _descend(rounds, materialize(of_groups, "group-proofs"), fanout)
    return found.select(
        *[F.col("carried")[f"k{i}"].alias(c) for i, c in enumerate(names)],
        F.col("node").alias("leaf"),
        F.col("rest")["subroot"].alias("subroot"),
        F.col("rest")["root"].alias("root"),
        "proof",
    )
