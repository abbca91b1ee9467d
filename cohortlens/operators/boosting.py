"""Second-order gradient boosting on histograms, many models in one pass.

Rows are binned once and kept in blocks.  A pass is one job: every task adds up, for
each model that is being fitted, the gradients of its rows per (leaf, feature, bin); the
sums come back and the leaves are split.  All models of a search (settings, folds, feature
sets) share the passes, so a search takes as many jobs as its slowest model.

A tree grows by the best leaf next, as far as its number of leaves or its depth allows.
The children of all leaves that may be split are measured in the same pass, ahead of the
order in which they are taken; only one child is measured, its sibling is the difference.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, ship_package

#: Bins of a feature, rows of a block, cells of a partition, trees between two rewrites
#: of the margins, margins of blocks that a worker remembers.
BINS, BLOCK_ROWS, PART_CELLS, KEEP_TREES, REMEMBERED = 64, 4096, 16_000_000, 20, 2048
#: Partitions' worth of cells of a table that one task still takes, where there are no
#: more models than cores.
TASK_PARTS = 3


@dataclass(frozen=True)
class Settings:
    """How one model is fitted.  ``leaves`` or ``depth`` None is no limit; ``patience``
    rounds without a lower loss on the held rows end the fit and the best round stays."""

    rounds: int = 200
    rate: float = 0.1
    leaves: int | None = None
    depth: int | None = 6
    row_share: float = 0.8
    column_share: float = 0.8
    l2: float = 1.0
    min_hessian: float = 1.0
    min_rows: int = 1
    min_gain: float = 0.0
    patience: int | None = None
    seed: int = 42


@dataclass
class Fit:
    """A model to fit: its table, the column of row weights (0: not a training row) and,
    for ``patience``, the column that marks held rows."""

    settings: Settings
    weight: str
    held: str | None = None
    table: int = 0


@dataclass
class Tree:
    """Flat arrays; a leaf's ``left`` is -1.  Rows with bin <= ``bin`` go left."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, grad: float, hess: float, settings: Settings) -> int:
        self.feature.append(0)
        self.bin.append(0)
        self.left.append(-1)
        self.value.append(-settings.rate * grad / (hess + settings.l2) if hess + settings.l2 > 0 else 0.0)
        self.cover.append(hess)
        self.gain.append(0.0)
        return len(self.left) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return (
            np.array(self.feature, np.int32), np.array(self.bin, np.int16),
            np.array(self.left, np.int32), np.array(self.value),
        )


def descend(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf of every row; the right child follows the left one."""
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while True:
        inner = left[at] >= 0
        if not inner.any():
            return at
        goes_right = x[rows, feature[at]] > cut[at]
        at = np.where(inner, left[at] + goes_right, at)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn_rows(keys: np.ndarray, settings: Settings, number: int) -> np.ndarray:
    """Which rows take part in tree ``number``: by their key alone, so a retry agrees."""
    if settings.row_share >= 1:
        return np.ones(len(keys), bool)
    salt = np.uint64((settings.seed * 1_000_003 + number * 7_919 + 1) % (1 << 63))
    return _mixed(keys ^ _mixed(np.array([salt]))[0]) < np.uint64(int(settings.row_share * 2.0**64))


def drawn_columns(n: int, settings: Settings, number: int) -> np.ndarray:
    if settings.column_share >= 1:
        return np.arange(n)
    size = max(1, int(n * settings.column_share))
    return np.sort(np.random.default_rng((settings.seed, number)).choice(n, size, replace=False))


def gradients(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return weight * (p - y), np.maximum(weight * p * (1 - p), 1e-16 * (weight > 0))


def best_split(hist: np.ndarray, settings: Settings) -> tuple[float, int, int, np.ndarray] | None:
    """(gain, column, bin, sums of the left side) of a (3, columns, bins) histogram."""
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    total = hist[:, 0, :].sum(axis=1)
    right = total[:, None, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (
            left[0] ** 2 / (left[1] + settings.l2)
            + right[0] ** 2 / (right[1] + settings.l2)
            - total[0] ** 2 / (total[1] + settings.l2)
        ) / 2
    few = 0.5  # counts are whole; sums by difference are not exactly
    allowed = (
        (np.minimum(left[1], right[1]) >= settings.min_hessian)
        & (np.minimum(left[2], right[2]) > settings.min_rows - few)
    )
    gain = np.where(allowed & np.isfinite(gain), gain, -np.inf)
    # Splits that part the rows alike differ by rounding only: the first one counts.
    most = gain.max()
    at = int(np.argmax(gain >= most - 1e-9 * abs(most))) if np.isfinite(most) else 0
    column, cut = divmod(at, gain.shape[1])
    if not gain[column, cut] > max(settings.min_gain, 1e-12):
        return None
    return float(gain[column, cut]), column, cut, left[:, column, cut].copy()


class Grower:
    """One model while it grows.  ``ahead``: the children of all leaves that may be split
    are measured at once, for the fewest passes; else those of the next leaf only."""

    def __init__(self, fit: Fit, width: int, ahead: bool = True):
        self.fit, self.settings, self.width = fit, fit.settings, width
        self.ahead = ahead or fit.settings.leaves is None
        self.trees: list[Tree] = []
        self.losses: list[float] = []
        self.base, self.done = 0, False
        self._next_tree()

    def _next_tree(self) -> None:
        self.tree = Tree()
        self.columns = drawn_columns(self.width, self.settings, len(self.trees))
        self.hist: dict[int, np.ndarray] = {}
        self.split: dict[int, tuple] = {}
        self.depth: dict[int, int] = {}
        self.sides: dict[int, tuple[int, int]] = {}
        self.waiting = {0: None}  # node to measure -> (parent, sibling) or None

    def request(self) -> dict:
        """What the next pass has to measure."""
        s = self.settings
        if not self.tree.left:
            self.tree.add(0.0, 0.0, s)
        return {
            "trees": [t.arrays() for t in self.trees[self.base :]],
            "number": len(self.trees),
            "grown": self.tree.arrays(),
            "nodes": sorted(self.waiting),
            "columns": self.columns,
            "settings": s,
            "weight": self.fit.weight,
            "held": self.fit.held,
            "table": self.fit.table,
            "fresh": not self.sides,
        }

    def take(self, sums: dict[int, np.ndarray], loss: np.ndarray | None) -> None:
        """Use what a pass measured: split as far as known, or end the tree."""
        s = self.settings
        if loss is not None and self.trees:
            self.losses.append(loss[0] / loss[1] if loss[1] else math.inf)
            best = int(np.argmin(self.losses))
            if s.patience and len(self.losses) - 1 - best >= s.patience:
                self.done = True
        if self.done or (len(self.trees) >= s.rounds and self.fit.held):
            self.finish()
            return
        shape = (3, len(self.columns), BINS)
        for node, from_ in self.waiting.items():
            own = sums.get(node, np.zeros(shape))
            self.hist[node] = own
            if from_ is not None:
                parent, other = from_
                rest = self.hist[parent] - own
                rest[:, rest[2] < 0.5] = 0.0  # no rows, no rounding
                self.hist[other] = rest
                del self.hist[parent]
        if 0 in self.waiting:
            grad, hess, _ = self.hist[0][:, 0, :].sum(axis=1)
            self.tree = Tree()
            self.tree.add(grad, hess, s)
            self.depth[0] = 0
        for node in [n for n in self.hist if n not in self.split]:
            deep = s.depth is not None and self.depth[node] >= s.depth
            self.split[node] = None if deep else best_split(self.hist[node], s)
        self.waiting = {}
        if not self._expand():
            self._end_tree()

    def _taken(self) -> tuple[list[int], int]:
        """Best leaf next, as far as children are known: nodes split so far, and how many
        more may be."""
        leaves, taken, front = 1, [], {0}
        while s_open := [n for n in front if self.split.get(n)]:
            if self.settings.leaves is not None and leaves >= self.settings.leaves:
                return taken, 0
            node = max(s_open, key=lambda n: (self.split[n][0], -n))
            if node not in self.sides:
                break
            front.remove(node)
            front |= set(self.sides[node])
            taken.append(node)
            leaves += 1
        room = len(self.hist) + 1 if self.settings.leaves is None else self.settings.leaves - leaves
        return taken, room

    def _expand(self) -> bool:
        """Give children to all leaves that may be split next; False if there are none."""
        s = self.settings
        _, room = self._taken()
        could = [n for n in self.hist if self.split.get(n) and n not in self.sides]
        could.sort(key=lambda n: (-self.split[n][0], n))
        room = room if self.ahead else min(room, 1)
        for node in could[:room]:
            gain, column, cut, left = self.split[node]
            total = self.hist[node][:, 0, :].sum(axis=1)
            one = self.tree.add(left[0], left[1], s)
            two = self.tree.add(total[0] - left[0], total[1] - left[1], s)
            self.tree.feature[node], self.tree.bin[node] = int(self.columns[column]), cut
            self.tree.left[node], self.tree.gain[node] = one, gain
            self.sides[node] = (one, two)
            self.depth[one] = self.depth[two] = self.depth[node] + 1
            if s.depth is not None and self.depth[one] >= s.depth:
                self.split[one] = self.split[two] = None  # no histogram needed
                del self.hist[node]
            elif left[2] <= total[2] - left[2]:
                self.waiting[one] = (node, two)
            else:
                self.waiting[two] = (node, one)
        if could[:room] and not self.waiting:
            return self._expand()
        return bool(self.waiting)

    def _end_tree(self) -> None:
        taken, _ = self._taken()
        kept, new = Tree(), {}
        order = [0]
        while order:
            node = order.pop(0)
            if node not in new:
                new[node] = self._copy(kept, node)
            if node in taken:
                one, two = self.sides[node]
                new[one] = self._copy(kept, one)
                new[two] = self._copy(kept, two)
                at = new[node]
                kept.feature[at], kept.bin[at] = self.tree.feature[node], self.tree.bin[node]
                kept.left[at], kept.gain[at] = new[one], self.tree.gain[node]
                order += [one, two]
        self.trees.append(kept)
        self._next_tree()
        if len(self.trees) >= self.settings.rounds and not self.fit.held:
            self.done = True

    def _copy(self, kept: Tree, node: int) -> int:
        kept.feature.append(0)
        kept.bin.append(0)
        kept.left.append(-1)
        kept.value.append(self.tree.value[node])
        kept.cover.append(self.tree.cover[node])
        kept.gain.append(0.0)
        return len(kept.left) - 1

    def finish(self) -> None:
        self.done = True
        if self.losses and self.settings.patience:
            self.trees = self.trees[: int(np.argmin(self.losses)) + 1]


# --- tasks ------------------------------------------------------------------------

_MARGINS: dict = {}


def _margin(run: str, block: dict, fit: int, ask: dict, bins: np.ndarray) -> np.ndarray:
    """Sum of the trees so far: the written margin and the trees since, of which a worker
    remembers what it has added up."""
    key = (run, block["block"], fit)
    written, count = block["margins"].get(fit, (None, 0))
    known = _MARGINS.get(key)
    if known is None or known[0] > ask["number"] or known[0] < ask["number"] - len(ask["trees"]):
        known = (ask["number"] - len(ask["trees"]), np.zeros(len(bins)) if written is None else written)
    count, margin = known
    skip = count - (ask["number"] - len(ask["trees"]))
    for feature, cut, left, value in ask["trees"][skip:]:
        margin = margin + value[descend(bins, feature, cut, left)]
    if len(_MARGINS) >= REMEMBERED:
        _MARGINS.clear()
    _MARGINS[key] = (ask["number"], margin)
    return margin


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in batch.to_pylist():
            n = row["n"]
            row["bins"] = np.frombuffer(row["bins"], np.uint8).reshape(n, -1)
            row["y"] = np.frombuffer(row["y"])
            row["keys"] = np.frombuffer(row["keys"], np.uint64)
            row["sides"] = {c["name"]: np.frombuffer(c["values"]) for c in row["sides"]}
            row["margins"] = {m["fit"]: (np.frombuffer(m["values"]), 0) for m in row["margins"]}
            yield row


def _sums(block: dict, ask: dict, margin: np.ndarray, kept: dict | None = None) -> dict[int, np.ndarray]:
    """One block's share of what a model asks for: (3, columns, bins) per node and, under
    -1, the loss of the held rows and their number.  ``kept`` holds, between the steps of
    a tree, the rows that take part with their leaves, gradients and bins."""
    found: dict[int, np.ndarray] = {}
    if ask["held"] and ask["fresh"]:
        held = block["sides"][ask["held"]] > 0
        loss = np.logaddexp(0, np.where(block["y"] > 0, -margin, margin))[held]
        found[-1] = np.array([loss.sum(), held.sum()])
    nodes, columns = ask["nodes"], ask["columns"]
    feature, cut, left, _ = ask["grown"]
    state = {} if kept is None or ask["fresh"] else kept
    if not state:
        y, weight = block["y"], block["sides"][ask["weight"]]
        rows = np.flatnonzero((weight > 0) & drawn_rows(block["keys"], ask["settings"], ask["number"]))
        grad, hess = gradients(margin[rows], y[rows], weight[rows])
        bins = block["bins"][rows]
        state = {
            "bins": bins, "grad": grad, "hess": hess, "at": np.zeros(len(rows), np.int64),
        }
        if len(rows) > BLOCK_ROWS:  # a column at a time: no copies as wide as the table
            state["columns"] = np.ascontiguousarray(bins[:, columns].T)
        else:
            state["spots"] = np.arange(len(columns), dtype=np.int32) * BINS + bins[:, columns]
        if kept is not None:
            kept.clear()
            kept.update(state)
    at = state["at"]
    while len(moving := np.flatnonzero(left[at] >= 0)):  # one level a step, if leaves are kept
        here = at[moving]
        at[moving] = left[here] + (state["bins"][moving, feature[here]] > cut[here])
    place = np.full(len(left), -1)
    place[nodes] = np.arange(len(nodes))
    # Nodes that are measured have no children yet; their rows end there.
    mine = np.flatnonzero(place[at] >= 0)
    if "columns" in state:
        grad, hess, offset = state["grad"][mine], state["hess"][mine], place[at[mine]] * BINS
        sums = np.empty((3, len(nodes), len(columns), BINS))
        for j, column in enumerate(state["columns"]):
            spot = offset + column[mine]
            for kind, v in enumerate((grad, hess, None)):
                sums[kind, :, j] = np.bincount(spot, v, len(nodes) * BINS).reshape(-1, BINS)
        return found | {node: sums[:, i] for i, node in enumerate(nodes)}
    cells = len(columns) * BINS
    spot = ((place[at[mine]] * cells)[:, None] + state["spots"][mine]).ravel()
    sums = np.stack([
        np.bincount(spot, v if v is None else np.repeat(v[mine], len(columns)), len(nodes) * cells)
        for v in (state["grad"], state["hess"], None)
    ]).reshape(3, len(nodes), len(columns), BINS)
    return found | {node: sums[:, i] for i, node in enumerate(nodes)}


def _measure(run: str, asked: dict[int, dict]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for block in _blocks(batches):
            for fit, ask in asked.items():
                if ask["table"] == block["table"]:
                    margin = _margin(run, block, fit, ask, block["bins"])
                    for node, value in _sums(block, ask, margin).items():
                        found[(fit, node)] = found.get((fit, node), 0) + value
        yield _sum_rows(found)

    return task


def _joined(blocks: list[dict]) -> dict:
    """One block of some blocks' rows."""
    if len(blocks) == 1:
        return blocks[0]
    whole = {k: np.concatenate([b[k] for b in blocks]) for k in ("bins", "y", "keys")}
    sides = {name: np.concatenate([b["sides"][name] for b in blocks]) for name in blocks[0]["sides"]}
    return {**blocks[0], **whole, "sides": sides, "n": len(whole["y"])}


def _grow_here(fits: Sequence[Fit], widths: list[int]):
    """Grow one model where all blocks of its table have met: the same steps without the
    way back to the driver after each of them."""

    def grow(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = key[0].as_py()
        fit = fits[number]
        grower = Grower(fit, widths[fit.table], ahead=False)
        blocks = [_joined(sorted(_blocks(batches), key=lambda b: b["block"]))]
        margins, kept = [np.zeros(b["n"]) for b in blocks], [{} for _ in blocks]
        while not grower.done:
            ask = grower.request()
            for feature, cut, left, value in ask["trees"]:
                margins = [m + value[descend(b["bins"], feature, cut, left)] for m, b in zip(margins, blocks)]
            grower.base = len(grower.trees)
            found: dict = {}
            for block, margin, leaves in zip(blocks, margins, kept):
                for node, value in _sums(block, ask, margin, leaves).items():
                    found[node] = found.get(node, 0) + value
            grower.take(found, found.pop(-1, None))
        trees = json.dumps([t.__dict__ for t in grower.trees])
        yield pa.RecordBatch.from_pydict({"fit": pa.array([number], pa.int64()), "trees": [trees]})

    return grow


def _sum_rows(found: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "fit": pa.array([k[0] for k in found], pa.int64()),
            "node": pa.array([k[1] for k in found], pa.int64()),
            "sums": pa.array([np.ascontiguousarray(v, np.float64).tobytes() for v in found.values()], pa.binary()),
        }
    )


def _add_up(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for part in tables:
        for value in part.column("sums").to_pylist():
            total = total + np.frombuffer(value)
    yield _sum_rows({tuple(k.as_py() for k in key): total})


_SUMS = "fit bigint, node bigint, sums binary"
_BLOCK = (
    "block string, table bigint, n bigint, bins binary, y binary, keys binary,"
    " sides array<struct<name:string,values:binary>>, margins array<struct<fit:bigint,values:binary>>"
)


def _rewrite(run: str, asked: dict[int, dict]):
    """Blocks with the margins of all models written down."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row, block in zip(rows, _blocks(iter([batch]))):
                row["margins"] = [
                    {"fit": fit, "values": _margin(run, block, fit, ask, block["bins"]).tobytes()}
                    for fit, ask in asked.items()
                    if ask["table"] == block["table"]
                ]
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return task


# --- fitting ----------------------------------------------------------------------


def feature_cuts(df: DataFrame, column: str = "features", bins: int = BINS) -> list[np.ndarray]:
    """Ascending cuts per feature from quantiles of all rows; as many as features times
    bins.  A feature with few values is cut at each of them."""
    shares = [i / bins for i in range(1, bins)]
    cells = df.select(F.posexplode(vector_to_array(F.col(column))).alias("f", "x"))
    rows = cells.groupBy("f").agg(
        F.percentile_approx("x", F.array(*[F.lit(s) for s in shares]), F.lit(20 * bins)).alias("q")
    ).collect()
    cuts = [np.empty(0)] * len(rows)
    for row in rows:
        cuts[row["f"]] = np.unique(np.array(row["q"]))
    return cuts


def _to_blocks(table: int, names: list[str], cuts: list[np.ndarray]):
    """Blocks named by their place, so sums over them are added in the same order again."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part_id, made = TaskContext.get().partitionId(), 0
        for pdf in batches:
            for start in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[start : start + BLOCK_ROWS]
                x = np.stack(part["x"].to_numpy())
                bins = np.empty(x.shape, np.uint8)
                for j, cut in enumerate(cuts):
                    bins[:, j] = np.searchsorted(cut, x[:, j], side="left")
                name, made = f"{part_id:08d}-{made:08d}", made + 1
                yield pd.DataFrame(
                    [(
                        name, table, len(part), bins.tobytes(),
                        part["y"].to_numpy(np.float64).tobytes(),
                        part["key"].to_numpy(np.int64).tobytes(),
                        [{"name": c, "values": part[c].to_numpy(np.float64).tobytes()} for c in names],
                        [],
                    )],
                    columns=["block", "table", "n", "bins", "y", "keys", "sides", "margins"],
                )

    return task


def fit_many(
    tables: Sequence[DataFrame],
    label: str,
    ids: list[str] | None,
    fits: Sequence[Fit],
    column: str = "features",
) -> list[BoostedTrees]:
    """Fit all ``fits`` in shared passes.  ``tables`` hold the features, the 0/1 label,
    the ids (None: rows are told apart by their features) and the fits' weight and held
    columns (numbers or booleans; null is 0).

    Tables of at most ``PART_CELLS`` cells meet the models in one task each (few models:
    ``TASK_PARTS`` times as many cells); larger ones stay in blocks and every pass is a
    job.  The trees are the same either way.  The driver
    holds the cuts and, per model that grows in passes, a histogram per open leaf: leaves
    x features x bins, whatever the number of rows.
    """
    spark = tables[0].sparkSession
    ship_package(spark)
    run, cuts, blocks, parts = uuid.uuid4().hex, [], None, 0
    for number, df in enumerate(tables):
        names = sorted({c for f in fits if f.table == number for c in (f.weight, f.held) if c})
        own = feature_cuts(df, column)
        cuts.append(own)
        n = df.count()
        wanted = max(1, -(-n * max(1, len(own)) // PART_CELLS))
        parts += wanted
        slim = df.select(
            vector_to_array(F.col(column)).alias("x"), F.col(label).cast("double").alias("y"),
            F.xxhash64(*(ids or [vector_to_array(F.col(column))])).alias("key"),
            *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names],
        ).coalesce(wanted).sortWithinPartitions("key")
        made = slim.mapInPandas(_to_blocks(number, names, own), _BLOCK)
        blocks = made if blocks is None else blocks.unionByName(made)
    blocks = materialize(blocks, "boost-blocks")
    growers = [Grower(f, len(cuts[f.table])) for f in fits]
    few = len(fits) <= spark.sparkContext.defaultParallelism
    if parts <= len(tables) * (TASK_PARTS if few else 1):
        # Every table fits one task: models are dealt to the tasks, not rows.
        wanted = spark.createDataFrame([(i, f.table) for i, f in enumerate(fits)], "fit bigint, table bigint")
        if parts == len(tables):
            meet = wanted.join(F.broadcast(blocks), "table")
        else:
            meet = blocks.join(F.broadcast(wanted), "table").select("table", "fit", *[c for c in blocks.columns if c != "table"])
        meet = meet.repartition(len(fits), "fit")
        grow = _grow_here(list(fits), [len(c) for c in cuts])
        for row in meet.groupBy("fit").applyInArrow(grow, "fit bigint, trees string").collect():
            growers[row["fit"]].trees = [Tree(**t) for t in json.loads(row["trees"])]
    else:
        _grow_in_passes(run, blocks.coalesce(parts), growers)
    return [BoostedTrees.of(g.trees, cuts[g.fit.table], column) for g in growers]


def _grow_in_passes(run: str, blocks: DataFrame, growers: list[Grower]) -> None:
    """One job per step of all models, over all rows."""
    state = blocks.persist()
    try:
        while active := {i: g for i, g in enumerate(growers) if not g.done}:
            if any(len(g.trees) - g.base >= KEEP_TREES for g in active.values()):
                asked = {i: g.request() for i, g in active.items()}
                fresh = materialize(state.mapInArrow(_rewrite(run, asked), _BLOCK), "boost-blocks")
                state.unpersist()
                state = fresh.persist()
                for g in active.values():
                    g.base = len(g.trees)
            asked = {i: g.request() for i, g in active.items()}
            sums = state.mapInArrow(_measure(run, asked), _SUMS).groupBy("fit", "node").applyInArrow(_add_up, _SUMS)
            found: dict = {i: {} for i in asked}
            for row in sums.toArrow().to_pylist():
                value = np.frombuffer(row["sums"])
                found[row["fit"]][row["node"]] = value if row["node"] < 0 else value.reshape(3, -1, BINS)
            for i, g in active.items():
                g.take(found[i], found[i].pop(-1, None))
    finally:
        state.unpersist()


class BoostedTrees(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees as a model: transform gives rawPrediction, probability, prediction."""

    trees = Param(Params._dummy(), "trees", "trees as JSON: a list of flat arrays", TypeConverters.toString)
    width = Param(Params._dummy(), "width", "number of features", TypeConverters.toInt)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees=None, width=None, featuresCol="features"):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @classmethod
    def of(cls, trees: list[Tree], cuts: list[np.ndarray], column: str) -> BoostedTrees:
        """Bins become thresholds of the features: x <= threshold goes left."""
        flat = [
            {
                "feature": t.feature, "left": t.left, "value": t.value, "cover": t.cover, "gain": t.gain,
                "threshold": [float(cuts[f][b]) if l >= 0 else 0.0 for f, b, l in zip(t.feature, t.bin, t.left)],
            }
            for t in trees
        ]
        return cls(trees=json.dumps(flat), width=len(cuts), featuresCol=column)

    def flat(self) -> list[dict]:
        return json.loads(self.getOrDefault(self.trees))

    @property
    def featureImportances(self) -> np.ndarray:
        """Total gain per feature, adding up to 1."""
        total = np.zeros(self.getOrDefault(self.width))
        for tree in self.flat():
            np.add.at(total, np.array(tree["feature"]), np.array(tree["gain"]))
        return total / total.sum() if total.sum() > 0 else total

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        margin = F.pandas_udf(margin_of(self.flat()), "double")
        raw = margin(vector_to_array(F.col(self.getOrDefault(self.featuresCol))))
        marked = dataset.withColumn("_margin", raw)
        p = 1 / (1 + F.exp(-F.col("_margin")))
        return marked.withColumns(
            {
                "rawPrediction": array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))),
                "probability": array_to_vector(F.array(1 - p, p)),
                "prediction": (p > 0.5).cast("double"),
            }
        ).drop("_margin")


def margin_of(trees: list[dict]):
    packed = [
        (np.array(t["feature"]), np.array(t["threshold"]), np.array(t["left"]), np.array(t["value"])) for t in trees
    ]

    def margins(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
        total = np.zeros(len(rows))
        for feature, threshold, left, value in packed:
            total += value[descend(rows, feature, threshold, left)]
        return pd.Series(total)

    return margins

