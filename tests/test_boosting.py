"""Boosted trees against a plain version: one leaf after the other, no blocks, no
subtraction, all rows at hand."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlens.operators import boosting as bo

N, WIDTH = 500, 6


def data():
    r = np.random.default_rng(1)
    x = r.normal(size=(N, WIDTH))
    x[:, 3] = np.round(x[:, 3])  # few values
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + r.normal(size=N) * 0.5) > 0.4).astype(float)
    return x, y


def frame(spark, x, y):
    rows = [(i, float(y[i]), [float(v) for v in x[i]]) for i in range(len(x))]
    df = spark.createDataFrame(rows, "row_id bigint, label double, x array<double>")
    return (
        df.withColumn("features", array_to_vector("x"))
        .withColumn("w", F.when(F.col("row_id") % 4 == 0, 0.0).otherwise(1.0 + F.col("label")))
        .withColumn("held", F.col("row_id") % 4 == 0)
    )


def plain_tree(bins, grad, hess, rows, columns, s):
    """Lists of (depth, rows, value, split) grown best leaf first."""
    def sums(members):
        hist = np.zeros((3, len(columns), bo.BINS))
        for i in members:
            for c, column in enumerate(columns):
                hist[:, c, bins[i, column]] += (grad[i], hess[i], 1)
        return hist

    def leaf(members, depth):
        hist = sums(members)
        g, h = grad[members].sum(), hess[members].sum()
        split = None if s.depth is not None and depth >= s.depth else bo.best_split(hist, s)
        return {"rows": members, "depth": depth, "value": -s.rate * g / (h + s.l2), "split": split, "sides": None}

    root = leaf(rows, 0)
    open_ = [root]
    leaves = 1
    while s.leaves is None or leaves < s.leaves:
        could = [x for x in open_ if x["split"]]
        if not could:
            break
        node = max(could, key=lambda x: x["split"][0])
        _, c, cut, _ = node["split"]
        right = bins[node["rows"], columns[c]] > cut
        node["sides"] = [leaf(node["rows"][~right], node["depth"] + 1), leaf(node["rows"][right], node["depth"] + 1)]
        open_ = [x for x in open_ if x is not node]
        open_ += node["sides"]
        leaves += 1
    return root


def plain_values(node, bins, columns, out, everyone):
    if node["sides"] is None:
        out[everyone] = node["value"]
        return
    _, c, cut, _ = node["split"]
    right = bins[everyone, columns[c]] > cut
    plain_values(node["sides"][0], bins, columns, out, everyone[~right])
    plain_values(node["sides"][1], bins, columns, out, everyone[right])


def plain_margins(x, y, w, held, keys, cuts, s):
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin, losses, margins = np.zeros(len(x)), [], []
    for number in range(s.rounds):
        columns = bo.drawn_columns(x.shape[1], s, number)
        grad, hess = bo.gradients(margin, y, w)
        rows = np.flatnonzero((w > 0) & bo.drawn_rows(keys, s, number))
        tree, out = plain_tree(bins, grad, hess, rows, columns, s), np.zeros(len(x))
        plain_values(tree, bins, columns, out, np.arange(len(x)))
        margin = margin + out
        margins.append(margin)
        p = 1 / (1 + np.exp(-margin))
        losses.append(-np.mean(np.log(np.where(y > 0, p, 1 - p)[held])))
        if s.patience and number - int(np.argmin(losses)) >= s.patience:
            break
    return margins[int(np.argmin(losses))] if s.patience else margin


SETTINGS = [
    bo.Settings(rounds=12, depth=3),
    bo.Settings(rounds=8, leaves=9, depth=None, l2=0.0, min_hessian=1e-3, min_rows=20),
    bo.Settings(rounds=40, leaves=6, depth=None, rate=0.6, row_share=1.0, column_share=1.0, patience=4),
    bo.Settings(rounds=5, depth=5, min_gain=0.3, min_hessian=3.0, seed=7),
]


@pytest.mark.parametrize("passes", [False, True])
def test_equals_plain_version(spark, monkeypatch, passes):
    if passes:  # rows in many blocks and tasks, margins written down every few trees
        monkeypatch.setattr(bo, "PART_CELLS", 900)
        monkeypatch.setattr(bo, "BLOCK_ROWS", 70)
        monkeypatch.setattr(bo, "KEEP_TREES", 3)
    x, y = data()
    df = frame(spark, x, y).repartition(5).persist()
    settings = [SETTINGS[1], SETTINGS[2]] if passes else SETTINGS
    fits = [bo.Fit(s, "w", "held" if s.patience else None) for s in settings]
    models = bo.fit_many([df], "label", ["row_id"], fits)
    keys = {r.row_id: r.k for r in df.select("row_id", F.xxhash64("row_id").alias("k")).collect()}
    keys = np.array([keys[i] for i in range(N)], np.int64).view(np.uint64)
    cuts, held = bo.feature_cuts(df), np.arange(N) % 4 == 0
    w = np.where(held, 0.0, 1.0 + y)
    for s, model in zip(settings, models):
        want = plain_margins(x, y, w, held, keys, cuts, s)
        rows = model.transform(df).select("row_id", "rawPrediction", "probability", "prediction").collect()
        found = {r.row_id: r for r in rows}
        got = np.array([found[i].rawPrediction[1] for i in range(N)])
        assert np.allclose(got, want, atol=1e-9), (s, np.abs(got - want).max())
        assert all((r.probability[1] > 0.5) == (r.prediction == 1.0) for r in rows)
        assert abs(model.featureImportances.sum() - 1) < 1e-9
    df.unpersist()


def test_saved_and_loaded(spark, tmp_path):
    x, y = data()
    df = frame(spark, x, y)
    [model] = bo.fit_many([df], "label", None, [bo.Fit(bo.Settings(rounds=3), "w")])
    PipelineModel(stages=[model]).write().overwrite().save(f"{tmp_path}/m")
    back = PipelineModel.load(f"{tmp_path}/m")
    one = [tuple(r) for r in model.transform(df).orderBy("row_id").select("probability").collect()]
    assert one == [tuple(r) for r in back.transform(df).orderBy("row_id").select("probability").collect()]


def test_several_tables_and_one_class(spark):
    x, y = data()
    one, two = frame(spark, x, y), frame(spark, x[:, :2], y)
    flat = one.withColumn("label", F.lit(1.0))
    models = bo.fit_many(
        [one, two, flat], "label", ["row_id"], [bo.Fit(bo.Settings(rounds=2), "w", table=t) for t in (0, 1, 2)]
    )
    assert [len(m.featureImportances) for m in models] == [6, 2, 6]
    alone = bo.fit_many([two], "label", ["row_id"], [bo.Fit(bo.Settings(rounds=2), "w")])[0]
    assert alone.flat() == models[1].flat()
    assert all(len(t["left"]) >= 1 for t in models[2].flat())


def test_order_of_blocks_is_fixed(spark):
    x, y = data()
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # many blocks
    try:
        fits = [bo.Fit(bo.Settings(rounds=4), "w")]
        made = [bo.fit_many([frame(spark, x, y).repartition(n)], "label", ["row_id"], fits)[0].flat() for n in (3, 7)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert made[0] == made[1]


def test_rows_keep_their_leaves_while_a_tree_grows(monkeypatch):
    x, y = data()
    bins = np.clip((x + 3) * 10, 0, 63).astype(np.uint8)
    block = {
        "block": "0", "table": 0, "n": N, "bins": bins.tobytes(), "y": y.tobytes(), "keys": np.arange(N).tobytes(),
        "sides": [{"name": "w", "values": np.ones(N).tobytes()}], "margins": [],
    }
    walks, plain = [], bo.descend
    monkeypatch.setattr(bo, "descend", lambda *a: walks.append(1) or plain(*a))
    fits = [bo.Fit(bo.Settings(rounds=3, leaves=15, depth=None), "w")]
    key = (pa.scalar(0),)
    [kept] = bo._grow_here(fits, [WIDTH])(key, iter([pa.RecordBatch.from_pylist([block])]))
    assert len(walks) <= 3  # a finished tree is walked once for the margins, no tree while it grows
    sums = bo._sums
    monkeypatch.setattr(bo, "_sums", lambda b, ask, margin, _: sums(b, ask, margin))
    [fresh] = bo._grow_here(fits, [WIDTH])(key, iter([pa.RecordBatch.from_pylist([block])]))
    assert kept.column("trees") == fresh.column("trees")


def test_one_task_measures_the_next_leaf_only():
    """The same trees as with all leaves measured ahead, by far fewer splits looked for."""
    rng = np.random.default_rng(3)
    n = 900
    block = {
        "bins": rng.integers(0, 64, (n, 6)).astype(np.uint8), "y": (rng.random(n) < 0.4) * 1.0,
        "keys": rng.integers(0, 1 << 62, n).astype(np.uint64), "sides": {"w": np.ones(n)},
    }
    grown = {}
    for ahead in (True, False):
        grower, kept, margin = bo.Grower(bo.Fit(SETTINGS[1], "w"), 6, ahead), {}, np.zeros(n)
        looked = 0
        while not grower.done:
            ask = grower.request()
            for feature, cut, left, value in ask["trees"]:
                margin = margin + value[bo.descend(block["bins"], feature, cut, left)]
            grower.base = len(grower.trees)
            looked += len(ask["nodes"])
            grower.take(bo._sums(block, ask, margin, kept), None)
        grown[ahead] = (looked, [t.__dict__ for t in grower.trees])
    assert grown[True][1] == grown[False][1]
    assert grown[False][0] <= 8 * 9 < grown[True][0]


def test_a_larger_table_meets_few_models_in_a_task(spark, monkeypatch):
    x, y = data()
    df = frame(spark, x, y)
    fits = [bo.Fit(SETTINGS[0], "w")]
    want = bo.fit_many([df], "label", ["row_id"], fits)[0].flat()
    monkeypatch.setattr(bo, "PART_CELLS", x.size // 3)
    monkeypatch.setattr(bo, "_grow_in_passes", None)
    got = bo.fit_many([df], "label", ["row_id"], fits)[0].flat()
    assert [(t["feature"], t["left"], t["threshold"]) for t in got] == [(t["feature"], t["left"], t["threshold"]) for t in want]


@pytest.mark.parametrize("nodes", [1, 3])
def test_wide_blocks_are_summed_by_columns(monkeypatch, nodes):
    rng = np.random.default_rng(4)
    n, s = 700, SETTINGS[0]
    block = {
        "bins": rng.integers(0, 64, (n, 6)).astype(np.uint8), "y": (rng.random(n) < 0.4) * 1.0,
        "keys": rng.integers(0, 1 << 62, n).astype(np.uint64), "sides": {"w": np.ones(n)},
    }
    tree = bo.Tree([0, 1, 0, 0, 0], [30, 20, 0, 0, 0], [1, 3, -1, -1, -1], [0.0] * 5, [0.0] * 5, [0.0] * 5)
    ask = {
        "held": None, "fresh": True, "nodes": [2, 3, 4][:nodes], "columns": np.array([0, 2, 5]), "grown": tree.arrays(),
        "weight": "w", "settings": s, "number": 0,
    }
    want = bo._sums(block, ask, np.zeros(n))
    monkeypatch.setattr(bo, "BLOCK_ROWS", 100)
    kept = {}
    got = bo._sums(block, ask, np.zeros(n), kept)
    assert "columns" in kept and "spots" not in kept
    assert all((got[k] == want[k]).all() for k in want) and len(got) == nodes
