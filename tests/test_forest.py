"""Forests grown in tasks: against a plain tree, saved, scored and explained."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlens.operators import boosting as bo, explain as ex, forest as fo, train as tr
from cohortlens.sources import models as md


def gini(y, w):
    p = (w * y).sum() / w.sum()
    return 2 * p * (1 - p) * w.sum()


def plain_tree(x, y, w, depth, least):
    """Leaves as (rows, value) by trying every cut of every feature."""
    best, value = (1e-9 * w.sum(), None), (w * y).sum() / w.sum()
    for j in range(x.shape[1]) if depth else ():
        for cut in range(31):
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= least:
                gain = gini(y, w) - gini(y[left], w[left]) - gini(y[~left], w[~left])
                if gain > best[0] + 1e-9:
                    best = (gain, left)
    if best[1] is None:
        return np.full(len(y), value), np.full(len(y), value), True
    out, mean = np.empty(len(y)), np.full(len(y), value)
    sides = []
    for side in (best[1], ~best[1]):
        out[side], _, alone = plain_tree(x[side], y[side], w[side], depth - 1, least)
        sides.append((alone, out[side][0] > 0.5))
    merged = sides[0] == sides[1] and sides[0][0]
    return (mean if merged else out), mean, merged


@pytest.mark.parametrize("cells", [1 << 21, 200])
def test_a_tree_takes_the_best_cuts(monkeypatch, cells):
    monkeypatch.setattr(fo, "HIST_CELLS", cells)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 32, (300, 4)).astype(np.uint8)
    y = ((x[:, 0] > 12) ^ (x[:, 2] > 20) ^ (rng.random(300) < 0.2)).astype(float)
    w = np.where(y > 0, 1.7, 0.6)
    tree = fo.grow_tree(x, y, w, fo.Settings(numTrees=1, maxDepth=6, minInstancesPerNode=3), 0)
    want, _, _ = plain_tree(x, y, w, 6, 3)
    assert fo.leaf_values(x, tree)[:, 0] == pytest.approx(want)
    assert tree["cover"][0] == pytest.approx(w.sum()) and len(tree["left"]) > 9


def test_large_forest_stays_in_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tr, "FOREST_NODES", 0)
    monkeypatch.setattr(fo, "EXPLAIN_ROWS", 100)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 64)
    cells = [F.pmod(F.xxhash64("id", F.lit(j)), F.lit(97)).cast("double") for j in range(5)]
    rows = spark.range(400).select("id", array_to_vector(F.array(*cells)).alias("features"), F.lit("kept").alias("more"))
    noise = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(8)) == 0
    df = rows.withColumn("label", F.when(noise, 1).otherwise((cells[0] > 60).cast("int")))
    model = tr.train_model("random_forest", df, "label", params={"numTrees": 7, "maxDepth": 9})
    assert isinstance(model, fo.Forest) and model.getNumTrees == 7 and model.frame(spark).count() == 7
    assert len(model.extractParamMap()[model.cuts]) < 20_000  # no tree among the parameters
    scores = {r["id"]: r["y_prob"] for r in tr.score(model, df, ["id", "more"]).collect()}
    assert len(scores) == 400 and len(set(scores.values())) > 5
    labels = {r["id"]: r["label"] for r in df.collect()}
    assert np.mean([labels[i] == (p > 0.5) for i, p in scores.items()]) > 0.8 and model.featureImportances.argmax() == 0
    again = tr.train_model("random_forest", df.repartition(5), "label", params={"numTrees": 7, "maxDepth": 9})
    assert {r["id"]: r["y_prob"] for r in tr.score(again, df, ["id"]).collect()} == scores
    md.save_models(spark, {("random_forest", "x"): model}, ("random_forest", "x"), str(tmp_path / "saved"))
    loaded = md.load_best(spark, str(tmp_path / "saved"))
    assert loaded.stages[0].getOrDefault("path").startswith(str(tmp_path))
    assert {r["id"]: r["y_prob"] for r in tr.score(loaded, df, ["id"]).collect()} == scores
    for r in ex.contributions(model, df, df, "id").collect():
        assert r["base"] + sum(r["contributions"]) == pytest.approx(scores[r["id"]], abs=1e-9)
        assert len(r["x"]) == 5
