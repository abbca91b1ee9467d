"""Ranking, metrics, fairness, selection, training and explanation."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortlens.operators import evaluate as ev, explain as ex, fairness as fr, linear, ranking as rk
from cohortlens.operators import features as of, select as sel, topics as tp, train as tr


def scored(spark, rows):
    return spark.createDataFrame(rows, "y_true int, y_prob double")


@pytest.mark.parametrize("partitions", [1, 17])
def test_areas_against_brute_force(spark, partitions):
    rng = random.Random(5)
    # A third of the scores are one value.
    rows = [(int(rng.random() < 0.3), 0.5 if i % 3 == 0 else round(rng.random(), 2)) for i in range(300)]
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    ap, seen = 0.0, 0.0
    for cut in sorted({p for _, p in rows}, reverse=True):
        tp = sum(p >= cut for p in pos)
        recall = tp / len(pos)
        ap += (recall - seen) * tp / (tp + sum(p >= cut for p in neg))
        seen = recall
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = rk.rank_sums(rk.label_totals(scored(spark, rows), [], "y_prob", "y_true"), []).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got["roc_auc"] == pytest.approx(auc) and got["pr_auc"] == pytest.approx(ap)


def test_perfect_constant_and_one_class(spark):
    perfect = ev.binary_metrics(scored(spark, [(0, 0.1), (0, 0.2), (1, 0.9)]), []).first()
    assert perfect["roc_auc"] == 1.0 and perfect["pr_auc"] == 1.0
    constant = ev.binary_metrics(scored(spark, [(0, 0.4), (1, 0.4), (1, 0.4), (0, 0.4)]), []).first()
    assert constant["roc_auc"] == 0.5 and constant["pr_auc"] == 0.5
    lone = scored(spark, [(0, 0.4), (0, 0.7)])
    assert ev.binary_metrics(lone, []).first()["roc_auc"] == 0.0
    assert sorted((r["fpr"], r["tpr"]) for r in ev.roc_points(lone, []).collect()) == [(0, 0), (1, 1)]
    assert sorted((r["precision"], r["recall"]) for r in ev.pr_points(lone, []).collect()) == [(0, 1), (1, 0)]


def test_threshold(spark):
    got = ev.best_threshold(scored(spark, [(0, 0.29), (1, 0.3), (1, 0.8), (0, 0.1)]), []).first()
    assert (got["threshold"], got["value"]) == (0.3, 1.0)
    none = ev.best_threshold(scored(spark, [(0, 0.9), (0, 0.1)]), []).first()
    assert (none["threshold"], none["value"]) == (0.5, 0.0)
    with pytest.raises(ValueError):
        ev.best_threshold(scored(spark, [(0, 0.9)]), [], metric="x")


def test_quantile(spark):
    df = spark.createDataFrame([(float(v),) for v in (5, 1, 1, 1, 9, 2)] + [(None,)], "v double")
    assert rk.exact_quantile(df, [], "v").first()[0] == 1.5


def audit_rows(spark):
    y = [0, 1, 0, 1, 0, 1, 0, 0, 1, 1]
    p = [0, 1, 0, 0, 0, 1, 1, 0, 1, 0]
    g = "M M F F M M F F M F".split()
    return spark.createDataFrame(list(zip(y, p, g)), "y_true int, y_pred int, gender string")


def test_group_metrics(spark):
    counts = fr.group_counts(audit_rows(spark), ["gender", "unknown"])
    got = {r["group"]: r for r in fr.group_metrics(counts).collect()}
    assert (got["M"]["n_samples"], got["M"]["accuracy"], got["M"]["fpr"], got["M"]["selection_rate"]) == (5, 1.0, 0.0, 0.6)
    assert (got["F"]["accuracy"], got["F"]["fpr"], got["F"]["fnr"], got["F"]["selection_rate"]) == (0.4, 0.3333, 1.0, 0.2)
    gap = fr.disparities(counts).first()
    assert tuple(gap)[1:] == (0.4, 1.0, 0.3333, 1.0)


# Published audit: counts (TP, FP, FN, TN) and the gaps they must give.
GOLDEN = {
    "gender": ({"F": (2, 1, 0, 12), "M": (1, 3, 1, 7)}, (0.1333, 0.5, 0.2231, 0.5)),
    "insurance": (
        {"Medicaid": (0, 3, 0, 4), "Medicare": (2, 0, 1, 6), "Other": (1, 1, 0, 9)},
        (0.2468, 1.0, 0.4286, 0.3333),
    ),
    "age_group": (
        {"40-65": (0, 3, 0, 2), "65+": (3, 1, 1, 14), "<40": (0, 0, 0, 3)},
        (0.6, 0.75, 0.6, 0.25),
    ),
}


@pytest.mark.parametrize("attribute", sorted(GOLDEN))
def test_golden_audit(spark, attribute):
    groups, gaps = GOLDEN[attribute]
    rows = []
    for name, (tp, fp, fn, tn) in groups.items():
        rows += [(1, 1, name)] * tp + [(0, 1, name)] * fp + [(1, 0, name)] * fn + [(0, 0, name)] * tn
    df = spark.createDataFrame(rows, f"y_true int, y_pred int, {attribute} string")
    got = fr.fairness_audit(df, [attribute])["disparities"].first()
    assert tuple(got)[1:] == gaps


# --- vectors ---------------------------------------------------------------------


def toy(spark, n=120, dims=5, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x[:, dims - 1] = 3.0
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.3, size=n) > 0.4).astype(int)
    rows = [(i, int(y[i]), Vectors.dense(x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, ["row_id", "label", "features"])
    return of.name_vector(df, "features", [f"f{i}" for i in range(dims)]), x, y


def test_selection(spark):
    df, x, y = toy(spark)
    assert sel.variance_selection(df) == [0, 1, 2, 3]
    assert 0 in sel.univariate_selection(df.drop("row_id"), "label", 2)
    kept = sel.rfe_selection(df, "label", 2, 0.2, max_iter=20)
    assert len(kept) == 2 and 0 in kept
    sliced = sel.apply_selection(df, [1, 3])
    assert of.vector_names(sliced) == ["f1", "f3"]
    assert list(sliced.orderBy("row_id").first()["features"]) == pytest.approx([x[0, 1], x[0, 3]])
    with pytest.raises(ValueError):
        sel.select_features(df, "label", "guess")


def brute_shapley(x, trees, d):
    """Shapley values of the path-dependent game by listing all subsets."""

    def value(tree, node, known):
        left, right = tree["left"][node], tree["right"][node]
        if left < 0:
            return tree["value"][node]
        if tree["feature"][node] in known:
            return value(tree, left if x[tree["feature"][node]] <= tree["threshold"][node] else right, known)
        share = tree["cover"][left] / tree["cover"][node]
        return share * value(tree, left, known) + (1 - share) * value(tree, right, known)

    def game(known):
        return sum(value(t, 0, known) for t in trees)

    out = np.zeros(d)
    for f in range(d):
        rest = [g for g in range(d) if g != f]
        for r in range(d):
            for subset in itertools.combinations(rest, r):
                weight = math.factorial(r) * math.factorial(d - r - 1) / math.factorial(d)
                out[f] += weight * (game({*subset, f}) - game(set(subset)))
    return out


@pytest.mark.parametrize("name,params", [
    ("random_forest", {"numTrees": 3, "maxDepth": 9, "minInstancesPerNode": 1}),
    ("gbt_depthwise", {"rounds": 4, "depth": 6, "min_hessian": 0.1}),
    ("gbt_leafcapped", {"rounds": 3, "leaves": 20, "min_rows": 2}),
])
def test_tree_contributions_against_all_subsets(spark, name, params):
    df, x, _ = toy(spark)
    model = tr.train_model(name, df, "label", params=params)
    trees = ex.flat_trees(model)
    assert max(ex._depth(t) for t in trees) > 5  # features come again on the way down
    fast = ex.path_contributions(x[:6], trees)
    for i in range(6):
        assert fast[i] == pytest.approx(brute_shapley(x[i], trees, 5), abs=1e-9)
    table = ex.contributions(model, df, df, "row_id").collect()
    scores = {r["row_id"]: r["y_prob"] for r in tr.score(model, df, ["row_id"]).collect()}
    for r in table:
        total = r["base"] + sum(r["contributions"])
        want = scores[r["row_id"]]
        assert (total if name == "random_forest" else 1 / (1 + math.exp(-total))) == pytest.approx(want, abs=1e-9)


def plain_logistic(x, y, w, C, l1):
    """Proximal gradient steps on all rows, many of them."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x1.shape[1])
    rate = 1 / (C * 0.25 * np.linalg.norm(x1 * np.sqrt(w)[:, None], 2) ** 2 + 1)
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-x1 @ beta))
        grad = C * x1.T @ (w * (p - y))
        if not l1:
            grad[:-1] += beta[:-1]
        beta = beta - rate * grad
        if l1:
            beta[:-1] = np.sign(beta[:-1]) * np.maximum(np.abs(beta[:-1]) - rate, 0)
    return beta


@pytest.mark.parametrize("parts", [1, 7])
def test_logistic_models_in_shared_passes(spark, monkeypatch, parts):
    df, x, y = toy(spark)
    if parts > 1:
        monkeypatch.setattr(linear, "PART_CELLS", len(x) * 5 // parts)
        monkeypatch.setattr(linear, "BLOCK_ROWS", 16)
    df = df.withColumn("w", F.lit(1.0) + F.col("label")).withColumn("v", (F.col("row_id") % 3 != 0).cast("int"))
    ids = np.array([r["row_id"] for r in df.orderBy("row_id").collect()])
    y = np.array(y, float)
    fits = [linear.LinearFit("w", 0.1), linear.LinearFit("w", 0.05, l1=True), linear.LinearFit("v", 1.0),
            linear.LinearFit("v", 0.02, l1=True), linear.LinearFit("w", 1.0, features=[0, 3])]
    with linear.SharedRows(df, "label", ["w", "v"]) as rows:
        found = rows.fit(fits)
    weights = {"w": 1 + y, "v": (ids % 3 != 0).astype(float)}
    for fit, beta in zip(fits[:4], found):
        assert beta == pytest.approx(plain_logistic(x, y, weights[fit.weight], fit.C, fit.l1), abs=2e-4)
    part = plain_logistic(x[:, [0, 3]], y, weights["w"], 1.0, False)
    assert found[4][[0, 3, 5]] == pytest.approx(part, abs=2e-4) and not found[4][[1, 2, 4]].any()
    assert (found[3][:-1] == 0).any()


def test_local_explanation(spark):
    table = spark.createDataFrame(
        [(1, [1.0, 2.0, 3.0], [0.5, -2.0, 0.1], 0.25)],
        "row_id int, x array<double>, contributions array<double>, base double",
    )
    got = ex.local_explanations(table, ["a", "b", "c"], "row_id", 2)
    row = got.first()
    assert row["prediction"] == pytest.approx(-1.15)
    assert [(f["feature"], f["direction"]) for f in row["top_features"]] == [
        ("b", "decreases risk"), ("a", "increases risk")]
    shape = ex.explanation_shape(got, "row_id").first()
    assert (shape["n_raising"], shape["n_lowering"], shape["shares"]) == (1, 1, [1.0, 0.25])


def test_smote_reaches_parity_inside_the_minority_hull(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 0, Vectors.dense(rng.normal(size=3))) for i in range(60)]
    rows += [(100 + i, 1, Vectors.dense(5 + rng.random(3))) for i in range(7)]
    df = spark.createDataFrame(rows, ["row_id", "label", "features"])
    out = tr.smote(df, "label", "row_id")
    sizes = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert sizes == {0: 60, 1: 60}
    new = [r["features"] for r in out.where("label = 1").collect()]
    assert all(5 <= v <= 6 for f in new for v in f)
    half = df.where("row_id < 10 or row_id >= 100")
    assert tr.smote(half, "label", "row_id").count() == half.count()


@pytest.mark.parametrize("n", [300, 3000])
def test_smote_takes_one_way_at_any_size(spark, n):
    """Partners come from the same cluster, and a second run gives the same points."""
    rng = np.random.default_rng(1)
    centres = 20 * rng.normal(size=(10, 4))
    rows = [(i, 1, Vectors.dense(centres[i % 10] + rng.normal(size=4))) for i in range(n)]
    rows += [(n + i, 0, Vectors.dense(rng.normal(size=4))) for i in range(3 * n)]
    df = spark.createDataFrame(rows, ["row_id", "label", "features"])
    new = tr.smote(df, "label", "row_id").where("label = 1")
    points = sorted(tuple(r["features"]) for r in new.collect())
    assert len(points) == 3 * n
    gaps = np.linalg.norm(np.array(points)[:, None] - centres[None], axis=2).min(axis=1)
    assert (gaps < 6).mean() > 0.98
    assert points == sorted(tuple(r["features"]) for r in tr.smote(df, "label", "row_id").where("label = 1").collect())


def test_grid_draws():
    grid = tr.PARAM_GRIDS["logistic_regression"]
    assert tr.grid_size(grid) == 14
    points = tr.draw_settings(grid, 30)
    assert len(points) == 14 == len({tuple(sorted(p.items())) for p in points})
    assert tr.grid_size(tr.PARAM_GRIDS["gbt_depthwise"]) == 3888
    with pytest.raises(ValueError):
        tr.estimator("unknown", "label")


# --- topics -----------------------------------------------------------------------


def test_labels_and_repeats(spark):
    words = spark.createDataFrame(
        [(0, 0, "Heart"), (0, 1, "valve"), (1, 0, "heart"), (2, 0, "zzz"), (3, 0, "lung"), (3, 1, "heart")],
        "topic_id int, position int, word string",
    )
    keywords = spark.createDataFrame(
        [("Cardio", 0, "heart"), ("Cardio", 0, "valve"), ("Lungs", 1, "lung")],
        "category string, category_order int, keyword string",
    )
    got = {r["topic_id"]: r["label"] for r in tp.label_topics(words, keywords).collect()}
    assert got == {0: "Cardio", 1: "Cardio (2)", 2: "Topic 2", 3: "Cardio (3)"}


def test_window_counts_against_brute_force(spark):
    rng = random.Random(2)
    docs = [[rng.choice("abcde") for _ in range(rng.randint(0, 40))] for _ in range(20)]
    df = spark.createDataFrame([(d,) for d in docs], "tokens array<string>")
    words = ["a", "b", "c"]
    for window in (None, 4):
        expected = {}
        for doc in docs:
            spans = [doc] if window is None or len(doc) <= window else [
                doc[s:s + window] for s in range(len(doc) - window + 1)]
            expected[(-1, -1)] = expected.get((-1, -1), 0) + len(spans)
            for span in spans:
                for i, j in itertools.combinations_with_replacement(range(3), 2):
                    if words[i] in span and words[j] in span:
                        expected[(i, j)] = expected.get((i, j), 0) + 1
        got = {(r["i"], r["j"]): r["n"] for r in tp.cooccurrence(df, words, window).collect()}
        assert got == expected


def test_outcome_test_p_value(spark):
    rows = [(0, float(i), int(i >= 10)) for i in range(20)]
    rows += [(1, 1.0, i % 2) for i in range(20)] + [(2, 0.5, 0)]
    df = spark.createDataFrame(rows, "topic_id int, weight double, label int")
    got = {r["topic_id"]: r for r in tp.topic_outcome_test(df).collect()}
    assert set(got) == {0, 1}
    assert got[0]["u_statistic"] == 100.0 and got[0]["p_value"] == 0.0002 and got[0]["significant"]
    assert got[1]["u_statistic"] == 50.0 and got[1]["p_value"] == 1.0


def test_topic_size_rule():
    assert [tp.min_topic_size(n) for n in (30, 200, 499, 500)] == [5, 20, 49, 50]
