"""A null group key is a group like any other."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import cohort, evaluate, ranking

ROWS = [("a", 1, 0.9, 1), ("a", 0, 0.2, 2), ("a", 1, 0.4, 3), (None, 1, 0.7, 4), (None, 0, 0.1, 5)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "grp string, y_true int, y_prob double, id bigint")


def test_ranks(rows):
    got = {(r.grp, r.y_prob): r.avg_rank for r in ranking.average_ranks(rows, ["grp"], "y_prob").collect()}
    assert got == {("a", 0.2): 1, ("a", 0.4): 2, ("a", 0.9): 3, (None, 0.1): 1, (None, 0.7): 2}


def test_medians_and_histogram(rows):
    assert {r.grp: r.median for r in cohort.medians(rows, "y_prob", ["grp"]).collect()} == {"a": 0.4, None: 0.4}
    counted = cohort.histogram(rows, "y_prob", 2, ["grp"]).groupBy("grp").agg(F.sum("n").alias("n")).collect()
    assert {r.grp: r.n for r in counted} == {"a": 3, None: 2}


def test_metrics_and_curves(rows):
    got = {r.grp: r for r in evaluate.binary_metrics(rows, ["grp"]).collect()}
    assert (got["a"].tp, got["a"].fn, got["a"].tn, got["a"].roc_auc) == (1, 1, 1, 1.0)
    assert (got[None].tp, got[None].tn, got[None].roc_auc, got[None].accuracy) == (1, 1, 1.0, 1.0)
    for points in (evaluate.roc_points, evaluate.pr_points):
        assert {r.grp for r in points(rows, ["grp"]).collect()} == {"a", None}


def test_curves_keep_every_point_of_one_class_and_count_no_unknown_label(spark):
    rows = [("a", 0, 0.2), ("a", 0, 0.4), ("b", None, 0.9), ("b", 1, 0.7), ("b", None, 0.7), ("b", None, 0.5), ("b", 0, 0.1)]
    df = spark.createDataFrame(rows, "grp string, y_true int, y_prob double")
    found = evaluate.pr_points(df, ["grp"], lone_ends=False).where("threshold < 2").collect()
    got = {(r.grp, r.threshold): (r.precision, "nan" if r.recall != r.recall else r.recall) for r in found}
    assert got == {
        ("a", 0.2): (0, "nan"), ("a", 0.4): (0, "nan"),
        ("b", 0.9): (None, None), ("b", 0.7): (1, 1), ("b", 0.5): (1, 1), ("b", 0.1): (0.5, 1),
    }
    found = evaluate.roc_points(df, ["grp"], lone_ends=False).where("threshold < 2 AND grp = 'b'").collect()
    assert {r.threshold: (r.fpr, r.tpr) for r in found} == {0.7: (0, 1), 0.1: (1, 1)}
    got = {r.grp: r.roc_auc for r in evaluate.binary_metrics(df, ["grp"]).collect()}
    assert got == {"a": 0, "b": 1}


def test_splits_and_folds(spark):
    table = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("int")).alias("y"))
    split = ranking.stratified_split(table, "y", ["id"])
    assert {r.y: r["count"] for r in split.groupBy("y").count().collect()} == {None: 100, 1: 100, 2: 100}
    assert {r.y: r["count"] for r in split.where("split = 'test'").groupBy("y").count().collect()} == {None: 20, 1: 20, 2: 20}
    folds = ranking.stratified_folds(table, "y", ["id"], 5).groupBy("y", "fold").count().collect()
    assert len(folds) == 15 and {r["count"] for r in folds} == {20}


def test_repeated_subject_is_an_error(spark):
    notes = spark.createDataFrame([(1, 1, "a")], "subject_id int, hadm_id int, text string")
    stays = spark.sql("SELECT 1 AS subject_id, 1 AS hadm_id, timestamp'2020-01-01' AS admittime, timestamp'2020-01-03' AS dischtime")
    subjects = spark.createDataFrame([(1, 50), (None, 60), (None, 70)], "subject_id int, anchor_age int")
    assert cohort.join_cohort(notes, stays, subjects).first().los_days == 2.0
    with pytest.raises(Exception, match="repeated subject 1"):
        cohort.join_cohort(notes, stays, subjects.union(subjects)).collect()
