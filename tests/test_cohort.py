"""Literal cases for stays, ages, joins and samples."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import cohort as fc
from cohortlens.operators import cohort as oc, ranking as rk
from cohortlens.plans.cohort import build_cohort, load_cohort


def stays(spark, rows):
    return spark.createDataFrame(
        rows,
        "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz,"
        " hospital_expire_flag int",
    )


DAY0 = dt.datetime(2020, 1, 1)


def at(days=0.0):
    return DAY0 + dt.timedelta(days=days)


def test_label_window(spark):
    rows = [
        (1, 1, at(0), at(2), 0),  # next starts 30 d 23 h after the end
        (1, 2, at(2 + 30 + 23 / 24), at(40), 0),  # next starts 31 d after
        (1, 3, at(71), at(80), 0),  # next starts before the end
        (1, 4, at(79), at(81), 1),  # died
        (1, 5, at(90), at(91), 0),  # last
        (2, 6, at(0), None, 0),  # undatable gap
        (2, 7, at(5), at(6), None),
    ]
    got = oc.return_label(stays(spark, rows)).orderBy("hadm_id").collect()
    assert [r["readmission_30day"] for r in got] == [1, 0, 1, -1, -1, 0, -1]


def test_label_kept_when_present(spark):
    df = stays(spark, [(1, 1, at(0), at(1), 0)]).withColumn("readmission_30day", F.lit(7))
    assert oc.return_label(df).first()["readmission_30day"] == 7


def test_utilization(spark):
    rows = [(1, i, at(10 * i), at(10 * i + 3.5), int(i == 1)) for i in range(3)]
    got = oc.utilization(stays(spark, rows)).orderBy("hadm_id").collect()
    assert [r["num_prior_admissions"] for r in got] == [0, 1, 2]
    assert [r["days_since_last_admission"] for r in got] == [-1, 6, 6]
    assert [r["prior_expire_flag"] for r in got] == [0, 0, 1]


@pytest.mark.parametrize("partitions", [1, 17])
def test_hot_subject_equals_plain_window(spark, partitions):
    # One subject holds a third of the rows, many with the same start time.
    rows = [
        (0 if i % 3 == 0 else i % 50 + 1, i, at((i * 7) % 40), at((i * 7) % 40 + i % 5), i % 2)
        for i in range(900)
    ]
    df = stays(spark, rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for fn in (oc.return_label, oc.utilization):
            plain, split = fn(df), fn(df, hot_rows=20)
            assert plain.count() == split.count() == 900
            assert plain.exceptAll(split).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_age_bins(spark):
    ages = [0, 1, 39, 40, 64, 65, 120, 121, None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, age int")
    got = df.select("i", fc.age_group(F.col("age")).alias("g")).orderBy("i").collect()
    assert [r["g"] for r in got] == [None, "<40", "<40", "40-65", "40-65", "65+", "65+", None, None]


def test_day_gap_is_floored(spark):
    df = spark.createDataFrame(
        [(at(0), at(-1 / 24)), (at(0), at(0.99)), (at(0), at(200_000))],
        "a timestamp_ntz, b timestamp_ntz",
    )
    got = [r[0] for r in df.select(fc.whole_days_between(F.col("a"), F.col("b"))).collect()]
    assert got == [-1, 0, 200_000]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="hadm_id"):
        oc.require_columns(spark.range(1), ["id", "hadm_id"])


def test_cohort_from_csv(spark, tmp_path):
    note = 'line "one"\n\nAllergies:\nnone, really'
    notes = spark.createDataFrame(
        [(1, 1, 1, "Discharge summary", "2020-01-02 00:00:00", note),
         (2, 1, 1, "Radiology", "x", "scan"),
         (3, 2, 3, "Discharge summary", "bad", note)],
        "note_id long, subject_id long, hadm_id long, note_type string, charttime string, text string",
    )
    rows = [(1, 1, "2020-01-01 00:00:00", "2020-01-03 12:00:00", 0),
            (1, 2, "2020-01-20 00:00:00", "2020-01-21 00:00:00", 0),
            (2, 3, "2020-01-01 00:00:00", "oops", 0)]
    adm = spark.createDataFrame(
        rows, "subject_id long, hadm_id long, admittime string, dischtime string,"
        " hospital_expire_flag int")
    pat = spark.createDataFrame([(1, "M", 70)], "subject_id long, gender string, anchor_age int")
    for name, df in (("notes", notes), ("adm", adm), ("pat", pat)):
        df.coalesce(1).write.options(header=True, escape='"').csv(str(tmp_path / name))
    got = load_cohort(spark, *(str(tmp_path / n) for n in ("notes", "adm", "pat")))
    got = {r["note_id"]: r for r in got.collect()}
    assert set(got) == {1, 3}
    assert got[1]["text"] == note and got[1]["los_days"] == 2.5
    assert got[1]["readmission_30day"] == 1 and got[1]["age_group"] == "65+"
    assert got[3]["charttime"] is None and got[3]["los_days"] is None and got[3]["age_group"] is None


def test_split_sizes_70_30(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") >= 70).cast("int").alias("y"))
    got = rk.stratified_split(df, "y", ["id"])
    sizes = {(r["split"], r["y"]): r["count"] for r in got.groupBy("split", "y").count().collect()}
    assert sizes == {("train", 0): 49, ("train", 1): 21, ("val", 0): 7, ("val", 1): 3,
                     ("test", 0): 14, ("test", 1): 6}
    assert got.select("id").distinct().count() == 100


def test_sample_is_exact_and_stable(spark):
    df = spark.range(5000)
    one = {r[0] for r in rk.sample_exact(df, ["id"], 321, 1).collect()}
    two = {r[0] for r in rk.sample_exact(df.repartition(13), ["id"], 321, 1).collect()}
    assert len(one) == 321 and one == two
    assert {r[0] for r in rk.sample_exact(df, ["id"], 321, 2).collect()} != one
    assert rk.sample_exact(df, ["id"], 9999).count() == 5000


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 9, 10, 10)], "v double")
    got = {r["bin"]: r["n"] for r in oc.histogram(df, "v", 5).collect()}
    assert got == {0: 2, 4: 3}
    lone = oc.histogram(df.where("v = 10"), "v", 4).first()
    assert (lone["bin"], lone["n"], lone["bin_start"]) == (2, 2, 10.0)
