"""Model queries fit the presets as they are, and the grid all of them."""

from cohortlens.catalog import models as queries
from cohortlens.operators import train as tr

SF_DIR = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


def test_presets_are_fitted_as_they_are(spark, monkeypatch):
    calls = []

    def stop(name, train, label, val=None, params=None, **more):
        calls.append((name, params, more))
        raise Seen

    monkeypatch.setattr(tr, "train_model", stop)
    for query in ("m5_gbt_depthwise", "m6_gbt_leafcapped"):
        try:
            queries.QUERIES[query](spark, SF_DIR)
        except Seen:
            pass
    assert calls == [("gbt_depthwise", None, {}), ("gbt_leafcapped", None, {})]


def test_grid_has_all_models(spark, monkeypatch):
    given = {}
    monkeypatch.setattr(queries, "prediction_grid", lambda *args, **kwargs: given.update(kwargs) or {"results": None})
    queries.QUERIES["m13_prediction_grid"](spark, SF_DIR)
    assert (given.get("models") or tr.MODEL_NAMES) == tr.MODEL_NAMES
    assert not given.get("params")


def test_forest_grows_to_the_limit(spark):
    made = tr.estimator("random_forest", "label")
    assert (made.getMaxDepth(), made.getNumTrees()) == (30, 200)


def test_metrics_sql_states_the_rule_of_the_split(spark, tmp_path):
    import duckdb

    from cohortlens.catalog import models

    rows = [(i, 0 if i < 6 else 5, [float(i + j) for j in range(64)]) for i in range(13)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").coalesce(1).write.parquet(
        str(tmp_path / "embeddings.parquet")
    )
    test = models.part(models.split_vectors(spark, str(tmp_path)), "test")
    ours = test.selectExpr("count(1)", "sum(label)").first()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    # Three of thirteen rows; rounding each class by itself gave two.
    stated = con.execute(models.SQL["m9_metrics_of_models"]).fetchall()
    assert {tuple(r[1:3]) for r in stated} == {tuple(ours)} == {(3, 1)}


def test_forest_meets_few_partitions(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from cohortlens.operators import train as tr

    x = array_to_vector(F.array(F.col("id").cast("double"), F.lit(1.0)))
    rows = spark.range(0, 2000, 1, 64).select((F.col("id") % 2).cast("int").alias("label"), x.alias("features"))
    assert tr.forest_rows(rows, "features").rdd.getNumPartitions() == 1
    model = tr.train_model("random_forest", rows, "label", params={"numTrees": 3, "maxDepth": 4})
    assert model.getOrDefault("cacheNodeIds") and model.getNumTrees == 3


def test_plain_metrics_share_the_pairs_of_a_model(spark):
    from cohortlens.catalog import models

    rows = [(m, int(i * 7 % 5 < 2), (i * 13 % 17) / 17) for m in ("a", "b") for i in range(60)]
    scores = spark.createDataFrame(rows, "model string, label int, y_prob double")
    one, many = (spark.sql(models.PLAIN_METRICS, scores=scores, parts=n) for n in (1, 5))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    pairs = [(p, n) for m, y, p in rows if m == "a" and y for k, z, n in rows if k == "a" and not z]
    want = sum((p > n) + 0.5 * (p == n) for p, n in pairs) / len(pairs)
    assert {r.model: abs(r.roc_auc - want) < 1e-12 for r in many.collect()} == {"a": True, "b": True}
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("part#") > 4 and "BroadcastNestedLoopJoin" not in plan
