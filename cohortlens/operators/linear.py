"""Penalized logistic regressions, many in one pass.

Every pass adds up, for all models at once, the gradient, the weighted Gram matrix and
the loss of all rows; the quadratic model they make is then minimized here, by coordinate
descent where weights are pushed to zero.  Settings, folds and elimination steps share
passes and start from each other's weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, ship_package

#: Most features: the driver holds features squared numbers for every model.
WIDEST = 1000
BLOCK_ROWS, PART_CELLS = 4096, 4_000_000


@dataclass
class LinearFit:
    """One model: the column of row weights, C (1 / penalty) and the kind of penalty."""

    weight: str
    C: float = 1.0
    l1: bool = False
    features: Sequence[int] | None = None
    start: np.ndarray | None = None


class _Descent:
    """Newton steps of one model; a step that does not lower the objective is halved."""

    def __init__(self, fit: LinearFit, width: int):
        self.fit = fit
        self.alive = np.zeros(width + 1, bool)
        self.alive[list(range(width)) if fit.features is None else list(fit.features)] = True
        self.alive[width] = True  # the intercept, not penalized
        self.beta = np.zeros(width + 1) if fit.start is None else np.where(self.alive, fit.start, 0.0)
        self.best, self.objective, self.done, self.steps = self.beta, np.inf, False, 0

    def penalty(self, beta: np.ndarray) -> float:
        w = beta[:-1]
        return np.abs(w).sum() if self.fit.l1 else (w @ w) / 2

    def take(self, sums: np.ndarray, tolerance: float, most: int) -> None:
        d = len(self.beta)
        loss, grad, gram = sums[0], sums[1 : d + 1], sums[d + 1 :].reshape(d, d)
        objective = self.fit.C * loss + self.penalty(self.beta)
        self.steps += 1
        if objective > self.objective:
            if np.abs(self.beta - self.best).max() < 1e-10 or self.steps >= most:
                self.beta, self.done = self.best, True
            else:
                self.beta = (self.beta + self.best) / 2
            return
        small = self.objective - objective <= tolerance * (1 + abs(objective))
        self.best, self.objective = self.beta, objective
        if small or self.steps >= most:
            self.done = True
            return
        self.beta = self._minimize(self.fit.C * grad, self.fit.C * gram)

    def _minimize(self, grad: np.ndarray, gram: np.ndarray) -> np.ndarray:
        at, on = self.best, np.flatnonzero(self.alive)
        g, h = grad[on], gram[np.ix_(on, on)] + 1e-10 * np.eye(len(on))
        old = at[on]
        free = on == len(at) - 1
        if not self.fit.l1:
            ridge = np.where(free, 0.0, 1.0)
            step = np.linalg.solve(h + np.diag(ridge), -(g + ridge * old))
        else:
            step, slope = np.zeros(len(on)), g.copy()  # slope of the quadratic at old + step
            for _ in range(200):
                moved = 0.0
                for j in range(len(on)):
                    want = old[j] + step[j] - slope[j] / h[j, j]
                    if not free[j]:
                        want = np.sign(want) * max(abs(want) - 1 / h[j, j], 0.0)
                    change = want - old[j] - step[j]
                    if change:
                        step[j] += change
                        slope += change * h[:, j]
                        moved = max(moved, abs(change))
                if moved < 1e-10:
                    break
        out = np.zeros(len(at))
        out[on] = old + step
        return out


_BLOCK = "n bigint, x binary, y binary, sides array<struct<name:string,values:binary>>"
_SUMS = "fit bigint, sums binary"


def _to_blocks(names: list[str]):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[start : start + BLOCK_ROWS]
                sides = [{"name": c, "values": part[c].to_numpy(np.float64).tobytes()} for c in names]
                x, y = np.stack(part["x"].to_numpy()), part["y"].to_numpy(np.float64)
                yield pd.DataFrame([(len(part), x.tobytes(), y.tobytes(), sides)], columns=["n", "x", "y", "sides"])

    return task


def _measure(asked: dict[int, tuple[str, np.ndarray]]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["x"]).reshape(row["n"], -1)
                x = np.hstack([x, np.ones((len(x), 1))])
                y = np.frombuffer(row["y"])
                sides = {c["name"]: np.frombuffer(c["values"]) for c in row["sides"]}
                for fit, (name, beta) in asked.items():
                    w, z = sides[name], x @ beta
                    p = 1 / (1 + np.exp(-z))
                    loss = w @ np.logaddexp(0, np.where(y > 0, -z, z))
                    gram = x.T @ (x * (w * p * (1 - p))[:, None])
                    sums = np.concatenate([[loss], x.T @ (w * (p - y)), gram.ravel()])
                    total[fit] = total.get(fit, 0) + sums
        yield _rows(total)

    return task


def _rows(total: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"fit": pa.array(list(total), pa.int64()), "sums": pa.array([v.tobytes() for v in total.values()], pa.binary())}
    )


def _add_up(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for part in parts:
        for value in part.column("sums").to_pylist():
            total = total + np.frombuffer(value)
    yield _rows({key[0].as_py(): total})


class SharedRows:
    """A table laid out for passes; use as a context."""

    def __init__(self, df: DataFrame, label: str, weights: Sequence[str], column: str = "features"):
        ship_package(df.sparkSession)
        first = df.select(F.size(vector_to_array(F.col(column)))).first()
        self.width = first[0] if first else 0
        if self.width > WIDEST:
            raise ValueError(f"{self.width} features; the passes hold at most {WIDEST} squared")
        names = sorted(set(weights))
        parts = max(1, -(-df.count() * max(1, self.width) // PART_CELLS))
        slim = df.select(
            vector_to_array(F.col(column)).alias("x"), F.col(label).cast("double").alias("y"),
            *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names],
        )
        self.alone = parts == 1
        blocks = materialize(slim.coalesce(parts).mapInPandas(_to_blocks(names), _BLOCK), "linear-blocks")
        self.blocks = blocks.coalesce(parts)

    def __enter__(self) -> SharedRows:
        self.blocks = self.blocks.persist()
        return self

    def __exit__(self, *error) -> None:
        self.blocks.unpersist()

    def fit(self, fits: Sequence[LinearFit], tolerance: float = 1e-12, most: int = 100) -> list[np.ndarray]:
        """Weights per fit, the intercept last."""
        running = [_Descent(f, self.width) for f in fits]
        while asked := {i: (r.fit.weight, r.beta) for i, r in enumerate(running) if not r.done}:
            sums = self.blocks.mapInArrow(_measure(asked), _SUMS)
            if not self.alone:
                sums = sums.groupBy("fit").applyInArrow(_add_up, _SUMS)
            found = {row["fit"]: np.frombuffer(row["sums"]) for row in sums.toArrow().to_pylist()}
            for i in asked:
                if i in found:
                    running[i].take(found[i], tolerance, most)
                else:  # no rows
                    running[i].done = True
        return [r.best for r in running]
