"""What scoring of requests sends to the driver does not follow the partitions or the rows."""

from cohortlens.catalog import models as cm
from cohortlens.operators import train as tr
from cohortlens.operators.features import STRUCTURED_COLUMNS
from cohortlens.streaming import scoring as sc

D = "/root/testdata/sf0.001"


def test_request_models_are_fitted_on_few_partitions(spark, monkeypatch):
    seen, plain = [], sc.Pipeline.fit
    monkeypatch.setattr(sc.Pipeline, "fit", lambda self, data: seen.append(data.rdd.getNumPartitions()) or plain(self, data))
    rows = [(i % 2, *[float((i * (j + 3)) % 11) for j in range(len(STRUCTURED_COLUMNS))]) for i in range(90)]
    train = spark.createDataFrame(rows, ["label", *STRUCTURED_COLUMNS]).repartition(40)
    model = sc.fit_request_model(train, "label")
    assert seen == [1] and len(model.stages[-1].coefficients) == len(STRUCTURED_COLUMNS)


def test_even_rows_follow_the_cells(spark, monkeypatch):
    monkeypatch.setattr(tr, "FOREST_CELLS", (10, 50))
    df = spark.range(100)
    assert tr.even_rows(df, 10).rdd.getNumPartitions() == 20
    assert tr.even_rows(df, 1).rdd.getNumPartitions() == 8


def test_scores_are_compared_without_a_broadcast(spark):
    out = cm.QUERIES["r1_stream_equals_batch"](spark, D)
    row = out.first()
    assert row["n_rows"] == row["n_equal"] > 0
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
