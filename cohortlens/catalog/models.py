"""Selection, training, search, explanation and scoring over the vectors."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from ..operators import evaluate as ev, explain as ex, features as of, ranking as rk, select as sel
from ..operators import train as tr
from ..plans.notes import fit_note_model
from ..plans.prediction import explain_best, prediction_grid
from ..session import materialize, scratch_path
from ..streaming import scoring as sc
from .common import r6, spread, sql_r6, subjects, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


DIMS = 64


def vectors(spark, d):
    """row_id, label (class < 2), features, named e0..e63."""
    out = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        (F.col("label") < 2).cast("int").alias("label"),
        array_to_vector("embedding").alias("features"),
    )
    return of.name_vector(out, "features", [f"e{i}" for i in range(DIMS)])


def split_vectors(spark, d):
    rows = vectors(spark, d)
    split = rk.stratified_split(rows.select("row_id", "label"), "label", ["row_id"])
    joined = rows.join(split.select("row_id", "split"), "row_id")
    return of.name_vector(joined, "features", [f"e{i}" for i in range(DIMS)]).persist()


def part(data, name):
    return data.where(F.col("split") == name)


_LONG = """v AS (SELECT vec_id AS row_id, CAST(label < 2 AS INTEGER) AS label,
  unnest(embedding)::DOUBLE AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS feature_id
  FROM embeddings)"""

# --- selection ------------------------------------------------------------------------


@query(
    "q1_variances",
    f"WITH {_LONG} SELECT feature_id, {sql_r6('var_pop(x)')} AS variance FROM v GROUP BY 1",
)
def q1(spark, d):
    out = sel.variances(vectors(spark, d))
    return out.withColumn("variance", r6(F.col("variance")))


@query(
    "q2_anova_f",
    f"""WITH {_LONG}, c AS (SELECT feature_id, label, count(*)::DOUBLE AS n, avg(x) AS m, var_samp(x) AS s
        FROM v GROUP BY 1, 2), t AS (SELECT feature_id, avg(x) AS gm FROM v GROUP BY 1)
        SELECT feature_id, {sql_r6("(sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum((n - 1) * s) / (sum(n) - count(*)))")}
        AS score FROM c JOIN t USING (feature_id) GROUP BY feature_id""",
)
def q2_f(spark, d):
    return sel.anova_f(vectors(spark, d), "label").withColumn("score", r6(F.col("score")))


def positive_vectors(spark, d):
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        (F.col("label") < 2).cast("int").alias("label"),
        array_to_vector(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("features"),
    )
    return rows


@query(
    "q2_chi_square",
    f"""WITH {_LONG}, o AS (SELECT feature_id, label, sum(abs(x)) AS o, count(*)::DOUBLE AS n FROM v GROUP BY 1, 2),
        t AS (SELECT feature_id, sum(o) AS so, sum(n) AS sn FROM o GROUP BY 1)
        SELECT feature_id, {sql_r6("sum((o - so * n / sn) * (o - so * n / sn) / (so * n / sn))")} AS score
        FROM o JOIN t USING (feature_id) GROUP BY 1""",
)
def q2_chi(spark, d):
    out = sel.chi_square(positive_vectors(spark, d), "label")
    return out.withColumn("score", r6(F.col("score")))


@query(
    "q2_mutual_information",
    f"""WITH {_LONG}, l AS (SELECT feature_id, min(x) AS lo, max(x) AS hi FROM v GROUP BY 1),
        b AS (SELECT feature_id, label, least(floor((x - lo) / (hi - lo) * 10), 9) AS bin FROM v JOIN l USING (feature_id)),
        j AS (SELECT feature_id, bin, label, count(*)::DOUBLE AS n FROM b GROUP BY 1, 2, 3),
        w AS (SELECT *, sum(n) OVER (PARTITION BY feature_id, bin) AS nb,
              sum(n) OVER (PARTITION BY feature_id, label) AS nc,
              sum(n) OVER (PARTITION BY feature_id) AS nt FROM j)
        SELECT feature_id, {sql_r6("sum(n / nt * ln(n * nt / (nb * nc)))")} AS score FROM w GROUP BY 1""",
)
def q2_mi(spark, d):
    out = sel.mutual_information(vectors(spark, d), "label")
    return out.withColumn("score", r6(F.col("score")))


@query("q3_l1_selection")
def q3(spark, d):
    kept = sel.l1_selection(vectors(spark, d).persist(), "label", C=0.05)
    return spark.createDataFrame([(i,) for i in kept], "feature_id int")


@query("q4_rfe_selection", "SELECT 16::BIGINT AS n_selected FROM embeddings LIMIT 1")
def q4(spark, d):
    kept = sel.rfe_selection(vectors(spark, d), "label", 16, 0.25)
    out = spark.createDataFrame([(i,) for i in kept], "feature_id int")
    return out.agg(F.count_distinct("feature_id").alias("n_selected"))


@query("q5_contribution_selection", "SELECT 10::BIGINT AS n_selected FROM embeddings LIMIT 1")
def q5(spark, d):
    kept = sel.contribution_selection(vectors(spark, d).persist(), "label", 10)
    out = spark.createDataFrame([(i,) for i in kept], "feature_id int")
    return out.agg(F.count_distinct("feature_id").alias("n_selected"))


@query(
    "q6_sliced_features",
    f"""WITH {_LONG} SELECT row_id, 'e' || feature_id AS name, {sql_r6('x')} AS value
        FROM v WHERE feature_id IN (3, 17, 40)""",
)
def q6(spark, d):
    sliced = sel.apply_selection(vectors(spark, d), [3, 17, 40])
    names = F.array(*[F.lit(n) for n in of.vector_names(sliced)])
    cells = F.arrays_zip(names.alias("name"), vector_to_array("features").alias("value"))
    return sliced.select("row_id", F.explode(cells).alias("e")).select(
        "row_id", "e.name", r6(F.col("e.value")).alias("value")
    )


@query(
    "q7_selection_report",
    f"""WITH {_LONG}, c AS (SELECT feature_id, label, count(*)::DOUBLE AS n, avg(x) AS m, var_samp(x) AS s
        FROM v GROUP BY 1, 2), t AS (SELECT feature_id, avg(x) AS gm FROM v GROUP BY 1),
        f AS (SELECT feature_id, sum(n * (m - gm) * (m - gm)) / (sum((n - 1) * s) / (sum(n) - count(*))) AS score
              FROM c JOIN t USING (feature_id) GROUP BY feature_id)
        SELECT 'e' || feature_id AS name, 64 AS n_before, 12 AS n_after FROM f ORDER BY score DESC LIMIT 12""",
)
def q7(spark, d):
    out = sel.select_features(vectors(spark, d), "label", "univariate", k=12)
    rows = [(n, out["n_before"], out["n_after"]) for n in out["names"]]
    return spark.createDataFrame(rows, "name string, n_before int, n_after int")


# --- training -------------------------------------------------------------------------


@query(
    "m1_class_weights",
    f"""WITH c AS (SELECT CAST(label < 2 AS INTEGER) AS label, count(*) AS n_class FROM embeddings GROUP BY 1)
        SELECT label, n_class, {sql_r6("(SELECT sum(n_class) FROM c) / (2.0 * n_class)")} AS weight,
        {sql_r6("(SELECT n_class FROM c WHERE label = 0) / (SELECT n_class FROM c WHERE label = 1)::DOUBLE")}
          AS pos_ratio FROM c""",
)
def m1(spark, d):
    out = tr.class_weight_table(vectors(spark, d), "label")
    return out.withColumns({c: r6(F.col(c)) for c in ("weight", "pos_ratio")})


@query(
    "m2_smote_sizes",
    """WITH c AS (SELECT CAST(label < 2 AS INTEGER) AS label, count(*) AS n FROM embeddings GROUP BY 1)
       SELECT label, CASE WHEN (SELECT min(n) / max(n)::DOUBLE FROM c) >= 0.4 THEN n
         ELSE (SELECT max(n) FROM c) END AS n FROM c""",
)
def m2(spark, d):
    out = tr.smote(vectors(spark, d), "label", "row_id")
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def fitted(spark, d, name):
    data = split_vectors(spark, d)
    model = tr.train_model(name, part(data, "train"), "label", part(data, "val"))
    return data, model


def _test_metrics(name):
    def run(spark, d):
        data, model = fitted(spark, d, name)
        test = tr.score(model, part(data, "test"), ["row_id", "label"])
        return ev.binary_metrics(test, [], "label").withColumn("model", F.lit(name))

    return run


for _id, _name in (
    ("m3", "logistic_regression"), ("m4", "random_forest"),
    ("m5", "gbt_depthwise"), ("m6", "gbt_leafcapped"),
):
    query(f"{_id}_{_name}")(_test_metrics(_name))


#: Metrics from the scores by their definitions: all pairs of a positive and a negative
#: row, and a precision per distinct score.  One side is in parts, each with all of the
#: other, so that the pairs of a model are shared among the tasks.
PLAIN_METRICS = """
WITH s AS (SELECT model, label, y_prob, pmod(xxhash64(y_prob, label), {parts}) AS part FROM {scores}),
every AS (SELECT model, label, y_prob, explode(sequence(0, {parts} - 1)) AS part FROM s),
auc AS (SELECT /*+ SHUFFLE_HASH(n) */ p.model, avg(CASE WHEN p.y_prob > n.y_prob THEN 1D WHEN p.y_prob = n.y_prob THEN 0.5D ELSE 0D END) AS roc_auc
  FROM s p JOIN every n ON p.model = n.model AND p.part = n.part WHERE p.label = 1 AND n.label = 0 GROUP BY p.model),
cuts AS (SELECT /*+ SHUFFLE_HASH(r) */ c.model, c.y_prob, sum(r.label) AS tp, count(1) AS chosen
  FROM (SELECT DISTINCT model, y_prob, pmod(xxhash64(y_prob), {parts}) AS part FROM s) c
  JOIN every r ON r.model = c.model AND r.part = c.part AND r.y_prob >= c.y_prob GROUP BY c.model, c.y_prob),
steps AS (SELECT *, tp - coalesce(lag(tp) OVER (PARTITION BY model ORDER BY y_prob DESC), 0) AS more,
  max(tp) OVER (PARTITION BY model) AS positives FROM cuts),
ap AS (SELECT model, sum(more / positives * tp / chosen) AS pr_auc FROM steps GROUP BY model)
SELECT model, count(1) AS n_test, sum(label) AS n_positive,
  avg(CASE WHEN (y_prob >= 0.5D) = (label = 1) THEN 1D ELSE 0D END) AS accuracy,
  2 * sum(CASE WHEN y_prob >= 0.5D THEN label ELSE 0 END)
    / (sum(CASE WHEN y_prob >= 0.5D THEN 1 ELSE 0 END) + sum(label)) AS f1,
  any_value(roc_auc) AS roc_auc, any_value(pr_auc) AS pr_auc
FROM s JOIN auc USING (model) JOIN ap USING (model) GROUP BY model"""


@query(
    "m9_metrics_of_models",
    """WITH c AS (SELECT CAST(label < 2 AS INTEGER) AS y, count(*) AS n FROM embeddings GROUP BY 1),
       q AS (SELECT *, ceil(0.2::DOUBLE * sum(n) OVER ()) AS take, sum(n) OVER () AS total FROM c),
       f AS (SELECT *, floor(n * take / total::DOUBLE) AS base,
         n * take / total::DOUBLE - floor(n * take / total::DOUBLE) AS rest FROM q),
       t AS (SELECT y, CAST(base + CAST(row_number() OVER (ORDER BY rest DESC, y)
         <= take - sum(base) OVER () AS INTEGER) AS BIGINT) AS n_test FROM f)
       SELECT model, sum(n_test) AS n_test, sum(CASE WHEN y = 1 THEN n_test ELSE 0 END) AS n_positive,
         true AS metrics_agree
       FROM t, (VALUES ('logistic_regression'), ('gbt_depthwise'), ('gbt_leafcapped')) m(model) GROUP BY model""",
)
def m9_models(spark, d):
    scored = None
    for name in ("logistic_regression", "gbt_depthwise", "gbt_leafcapped"):
        data, model = fitted(spark, d, name)
        part_ = tr.score(model, part(data, "test"), ["row_id", "label"]).withColumn("model", F.lit(name))
        scored = part_ if scored is None else scored.unionByName(part_)
    scored = materialize(scored, "model-scores")
    plain = spark.sql(PLAIN_METRICS, scores=scored, parts=rk.bucket_count(scored))
    ours = ev.binary_metrics(scored, ["model"], "label", digits=None)
    names = ("accuracy", "f1", "roc_auc", "pr_auc")
    agree = [F.abs(F.col(f"o.{c}") - F.col(f"p.{c}").cast("double")) < 1e-9 for c in names]
    both = ours.alias("o").join(plain.alias("p"), F.col("o.model") == F.col("p.model"))
    return both.select(
        "p.model", "p.n_test", "p.n_positive",
        (agree[0] & agree[1] & agree[2] & agree[3]).alias("metrics_agree"),
    )


@query("m7_trained_with_smote")
def m7(spark, d):
    data = split_vectors(spark, d)
    model = tr.train_model(
        "logistic_regression", part(data, "train"), "label",
        use_smote=True, row_id="row_id",
    )
    return ev.binary_metrics(tr.score(model, part(data, "test"), ["label"]), [], "label")


@query("m8_random_search")
def m8(spark, d):
    train = part(split_vectors(spark, d), "train")
    best, value = tr.tune("logistic_regression", train, "label", ["row_id"])
    return spark.createDataFrame(
        [(best["C"], best["penalty"], value)], "C double, penalty string, cv_score double"
    )


@query("m12_cross_validation")
def m12(spark, d):
    _, summary = tr.cross_validate(
        "logistic_regression", vectors(spark, d), "label", ["row_id"]
    )
    return summary


def _structured(spark, d):
    """A customer's balance, nation and orders, under the key of the vectors."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("row_id")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("o_totalprice").cast("double").alias("spent")
    )
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").alias("row_id"), F.col("c_acctbal").cast("double").alias("balance"),
        *[(F.col("c_nationkey") == n).cast("double").alias(f"nation_{n}") for n in range(25)],
    )
    names = ["balance", *[f"nation_{n}" for n in range(25)], "n", "spent"]
    filled = rows.join(orders, "row_id", "left").select(
        "row_id", array_to_vector(F.array(*[F.coalesce(F.col(n), F.lit(0.0)) for n in names])).alias("features")
    )
    return of.name_vector(filled, "features", names)


def _grid(spark, d):
    rows = vectors(spark, d)
    labels = rows.select("row_id", "label")
    return prediction_grid(
        spark,
        {"embeddings": rows.select("row_id", "features"), "structured": _structured(spark, d)},
        labels,
        row_id="row_id",
        feature_types=["embeddings", "structured", "not_there"],
        selection={"method": "univariate", "k": 20, "apply_to": ["embeddings"]},
    )


@query("m13_prediction_grid")
def m13(spark, d):
    return _grid(spark, d)["results"]


# --- explanations ---------------------------------------------------------------------

WEIGHTS = [(j % 7 - 3) / 10 for j in range(DIMS)]


def linear_table(spark, d):
    rows = vectors(spark, d)
    mean = rows.agg(Summarizer.mean(F.col("features")).alias("m"))
    return ex.linear_contributions(rows, WEIGHTS, 0.25, mean, "row_id")


_CONTRIB = f"""WITH {_LONG}, m AS (SELECT feature_id, avg(x) AS mean FROM v GROUP BY 1),
c AS (SELECT row_id, feature_id, 'e' || feature_id AS feature, x,
      ((feature_id % 7 - 3) / 10.0::DOUBLE) * (x - mean) AS shap FROM v JOIN m USING (feature_id)),
b AS (SELECT 0.25 + sum(((feature_id % 7 - 3) / 10.0::DOUBLE) * mean) AS base FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(shap) DESC, feature) - 1 AS position FROM c)"""


@query(
    "h2_linear_contributions",
    f"""{_CONTRIB} SELECT row_id, feature_id, {sql_r6('shap')} AS shap, {sql_r6('base')} AS base FROM c, b""",
)
def h2(spark, d):
    return linear_table(spark, d).select(
        "row_id", r6(F.col("base")).alias("base"),
        F.posexplode("contributions").alias("feature_id", "shap"),
    ).withColumn("shap", r6(F.col("shap")))


@query(
    "h4_global_importance",
    f"""{_CONTRIB} SELECT feature, {sql_r6('avg(abs(shap))')} AS mean_abs_shap FROM c GROUP BY 1
        ORDER BY avg(abs(shap)) DESC LIMIT 20""",
)
def h4(spark, d):
    names = [f"e{i}" for i in range(DIMS)]
    out = ex.global_importance(linear_table(spark, d), names, 20)
    return out.select("feature", r6(F.col("mean_abs_shap")).alias("mean_abs_shap"))


@query(
    "h5_local_explanations",
    f"""{_CONTRIB} SELECT row_id, CAST(position AS INTEGER) AS position, feature, {sql_r6('x')} AS value,
        {sql_r6('shap')} AS shap, CASE WHEN shap > 0 THEN 'increases risk' ELSE 'decreases risk' END AS direction,
        {sql_r6('base + sum(shap) OVER (PARTITION BY row_id)')} AS prediction
        FROM k, b QUALIFY position < 5""",
)
def h5(spark, d):
    out = ex.local_explanations(linear_table(spark, d), [f"e{i}" for i in range(DIMS)], "row_id", 5)
    rows = ex.explanation_rows(out, "row_id")
    return rows.select(
        "row_id", "position", "feature", r6(F.col("value")).alias("value"),
        r6(F.col("shap")).alias("shap"), "direction", r6(F.col("prediction")).alias("prediction"),
    )


@query(
    "k4_top_features",
    f"""{_CONTRIB} SELECT row_id, string_agg(feature, ',' ORDER BY position) AS features
        FROM k WHERE position < 3 GROUP BY 1""",
)
def k4(spark, d):
    out = ex.local_explanations(linear_table(spark, d), [f"e{i}" for i in range(DIMS)], "row_id", 3)
    names = F.transform("top_features", lambda f: f["feature"])
    return out.select("row_id", F.array_join(names, ",").alias("features"))


@query(
    "k5_largest_totals",
    f"""{_CONTRIB} SELECT row_id, {sql_r6('sum(shap)')} AS total FROM c GROUP BY 1
        ORDER BY sum(shap) DESC LIMIT 3""",
)
def k5(spark, d):
    return ex.largest_total(linear_table(spark, d), "row_id", 3).withColumn("total", r6(F.col("total")))


@query(
    "k10_explained_sample",
    "SELECT least(100, count(*)) AS n, least(100, count(*)) AS n_distinct FROM embeddings",
)
def k10(spark, d):
    picked = rk.sample_exact(vectors(spark, d), ["row_id"], 100, 42)
    return picked.agg(F.count("row_id").alias("n"), F.count_distinct("row_id").alias("n_distinct"))


@query(
    "h7_explanation_shape",
    f"""{_CONTRIB} SELECT row_id, count(*) FILTER (shap > 0) AS n_raising, count(*) FILTER (shap <= 0) AS n_lowering,
        {sql_r6('sum(abs(shap)) / greatest(max(abs(shap)), 1e-9)')} AS total_share
        FROM k WHERE position < 10 GROUP BY 1""",
)
def h7(spark, d):
    out = ex.local_explanations(linear_table(spark, d), [f"e{i}" for i in range(DIMS)], "row_id", 10)
    shape = ex.explanation_shape(out, "row_id")
    return shape.select(
        "row_id",
        F.col("n_raising").cast("long").alias("n_raising"),
        F.col("n_lowering").cast("long").alias("n_lowering"),
        r6(F.aggregate("shares", F.lit(0.0), lambda a, v: a + v)).alias("total_share"),
    )


@query(
    "h3_tree_additivity",
    """SELECT m AS model, (SELECT count(*) FROM embeddings) AS n_rows, true AS additive
       FROM (VALUES ('random_forest'), ('gbt_depthwise')) t(m)""",
)
def h3(spark, d):
    out = None
    for name in ("random_forest", "gbt_depthwise"):
        data, model = fitted(spark, d, name)
        table_ = ex.contributions(model, data, data, "row_id")
        total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v)
        output = F.col("p") if name == "random_forest" else F.col("raw")
        scored = model.transform(data).select(
            "row_id",
            vector_to_array("probability")[1].alias("p"),
            vector_to_array("rawPrediction")[1].alias("raw"),
        )
        check = table_.join(scored, "row_id").agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.bool_and(F.abs(total - output) < 1e-6).alias("additive"),
        ).withColumn("model", F.lit(name))
        out = check if out is None else out.unionByName(check)
    return out


@query("h1_contributions_by_family")
def h1(spark, d):
    out = None
    for name in ("logistic_regression", "gbt_leafcapped"):
        data, model = fitted(spark, d, name)
        table_ = ex.contributions(model, part(data, "test"), part(data, "train"), "row_id")
        top = ex.global_importance(table_, of.vector_names(data), 5).withColumn("model", F.lit(name))
        out = top if out is None else out.unionByName(top)
    return out


@query("h6_best_model_explained")
def h6(spark, d):
    return explain_best(_grid(spark, d), "row_id", 10)["global_importance"]


# --- scoring --------------------------------------------------------------------------


def _request_model(spark, d):
    """Returning customers (more than 10 orders) from their structured columns."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("subject_id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rows = subjects(spark, d).join(orders, "subject_id", "left")
    label = (F.coalesce("n", F.lit(0)) > 10).cast("int")
    train = of.request_row(
        rows.withColumn("label", label), ["subject_id", "label"], age="anchor_age", los="n"
    ).persist()
    return train, sc.fit_request_model(train, "label")


_REQUEST = {"age": "anchor_age", "los": None}


@query(
    "r1_stream_equals_batch",
    "SELECT count(*) AS n_rows, count(*) AS n_equal FROM customer",
)
def r1(spark, d):
    _, model = _request_model(spark, d)
    requests = subjects(spark, d).drop("insurance").withColumn("insurance", F.lit("Medicare Plus"))
    folder, out = scratch_path(spark, "requests"), scratch_path(spark, "scores")
    requests.write.parquet(folder)
    stream = spark.readStream.schema(requests.schema).parquet(folder)
    job = sc.start_scoring(
        model, stream, ["subject_id"], out, scratch_path(spark, "progress"), True, **_REQUEST
    )
    job.awaitTermination()
    batch = sc.score_requests(model, requests, ["subject_id"], **_REQUEST)
    streamed = spark.read.parquet(out).select("subject_id", F.col("risk_level").alias("r"),
                                              F.col("probability").alias("p"))
    same = (F.col("r") == F.col("risk_level")) & (F.col("p") == F.col("probability"))
    # The files of the scores are small, their rows are not: no side is broadcast.
    return batch.join(streamed.hint("shuffle_hash"), "subject_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(same).alias("n_equal")
    )


@query(
    "r2_explained_requests",
    "SELECT count(*) AS n_rows, true AS complete FROM customer",
)
def r2(spark, d):
    train, model = _request_model(spark, d)
    rows = of.request_row(subjects(spark, d), ["subject_id"], **_REQUEST)
    out = sc.explain_rows(model, rows, train, "subject_id", top_n=5)
    return out.agg(
        F.count(F.lit(1)).alias("n_rows"), F.bool_and(F.size("top_features") == 5).alias("complete")
    )


# --- raw notes ------------------------------------------------------------------------


def _note_model(spark, d):
    """Documents labelled good or bad, as notes with an age and an insurance."""
    notes = spread(table(spark, d, "documents")).select(
        "doc_id", "text", (F.col("doc_id") % 90).alias("years"), F.col("source").alias("payer")
    )
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    train = notes.join(labels, "doc_id")
    model = fit_note_model(
        train, "label", topics=3, inputs={"age": "years", "gender": None, "insurance": "payer", "los": None}
    )
    path = scratch_path(spark, "note-model")
    model.write().save(path)
    return notes, train, PipelineModel.load(path)


@query(
    "r1_note_stream_equals_batch",
    """SELECT count(*) AS n_rows, count(*) AS n_equal,
       (SELECT count(DISTINCT doc_id) FROM labels JOIN documents USING (doc_id)) AS n_labelled, true AS learned
       FROM documents""",
)
def r1_notes(spark, d):
    notes, train, model = _note_model(spark, d)
    folder, out = scratch_path(spark, "notes"), scratch_path(spark, "note-scores")
    notes.write.parquet(folder)
    stream = spark.readStream.schema(notes.schema).parquet(folder)
    sc.start_note_scoring(model, stream, ["doc_id"], out, scratch_path(spark, "progress"), True).awaitTermination()
    streamed = spark.read.parquet(out).select(
        "doc_id", F.col("risk_level").alias("r"), F.col("probability").alias("p"), F.col("predicted_label").alias("y")
    )
    batch = sc.score_rows(model, notes, ["doc_id"]).join(streamed, "doc_id")
    same = (F.col("r") == F.col("risk_level")) & (F.col("p") == F.col("probability")) & (F.col("y") == F.col("predicted_label"))
    judged = train.select("doc_id", "label").withColumnRenamed("doc_id", "of")
    right = F.avg((F.col("label") == F.col("y")).cast("double"))
    return batch.join(judged, F.col("doc_id") == F.col("of"), "left").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(same).alias("n_equal"), F.count("of").alias("n_labelled"),
        (right > 0.9).alias("learned"),
    )


@query("r2_explained_notes", "SELECT count(*) AS n_rows, true AS additive, true AS complete FROM documents")
def r2_notes(spark, d):
    notes, train, model = _note_model(spark, d)
    out = sc.explain_notes(model, notes, train, "doc_id", 5)
    scores = sc.score_rows(model, notes, ["doc_id"]).select("doc_id", "probability")
    p = 1 / (1 + F.exp(-F.col("prediction")))
    return out.join(scores, "doc_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bool_and(F.abs(p - F.col("probability")) < 1e-4).alias("additive"),
        F.bool_and(F.size("top_features") == 5).alias("complete"),
    )
