"""Payloads, saved tables and saved models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators import fairness as fr, train as tr
from ..session import scratch_path
from ..sources import export as xp, models as md, tables as src
from .common import (
    r6, raw_documents, scored, sql_documents, sql_r6, sql_words, with_scored,
)
from .evaluation import _GAPS, _GROUPS, ATTRIBUTES, results, with_results
from .models import fitted
from .topics import _DOC_TOPICS, N_TOPICS, _SOURCE, doc_topics, source_words

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


@query(
    "s5_landed_parquet",
    f"""SELECT lang, count(*) AS n, CAST(sum(len({sql_words('text')})) AS BIGINT) AS n_words
        FROM documents GROUP BY lang""",
)
def s5(spark, d):
    rows = raw_documents(spark, d).select("doc_id", "lang", ft.word_count(F.col("text")).alias("w"))
    path = src.land_parquet(rows, scratch_path(spark, "processed"), ["lang"])
    return src.read_parquet(spark, path).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("n_words")
    )


@query(
    "s6_results_payload",
    with_results(
        f""" SELECT (SELECT count(DISTINCT model) FROM results) AS n_models,
          (SELECT count(DISTINCT feature_type) FROM results) AS n_feature_sets,
          CAST(row_number() OVER (ORDER BY seq) - 1 AS INTEGER) AS position, model, feature_type, roc_auc,
          (SELECT model || '/' || feature_type FROM results ORDER BY roc_auc DESC, seq LIMIT 1) AS best
        FROM results"""
    ),
)
def s6(spark, d):
    payload = xp.results_payload(results(spark, d))
    return payload.select(
        "n_models", "n_feature_sets",
        F.concat("best.model", F.lit("/"), "best.feature_type").alias("best"),
        F.posexplode("results").alias("position", "r"),
    ).select(
        "n_models", "n_feature_sets", "best", "position", "r.model", "r.feature_type", "r.roc_auc"
    )


def _fairness(spark, d):
    counts = fr.group_counts(scored(spark, d), ATTRIBUTES)
    return fr.group_metrics(counts), fr.disparities(counts)


@query(
    "s7_fairness_payload",
    with_scored(
        _GROUPS + _GAPS
        + """ SELECT attribute, grp AS "group", round_even(f1, 4) + 0 AS f1,
          demographic_parity_difference, fnr_difference FROM cr JOIN dis USING (attribute)"""
    ),
)
def s7(spark, d):
    payload = xp.fairness_payload(*_fairness(spark, d))
    rows = payload.select(F.explode("attributes").alias("a"))
    return rows.select(
        "a.attribute", "a.demographic_parity_difference", "a.fnr_difference",
        F.explode("a.groups").alias("g"),
    ).select("attribute", "g.group", "g.f1", "demographic_parity_difference", "fnr_difference")


def _topics(spark, d):
    return xp.topic_export_rows(
        source_words(spark, d), None, doc_topics(spark, d), N_TOPICS
    )


_TOPIC_EXPORT = f"""WITH {sql_documents()}, {_SOURCE}, {_DOC_TOPICS},
tx AS (SELECT topic_id, 'Topic ' || topic_id AS label, count(*) AS n_words,
       string_agg(word, ' ' ORDER BY position) AS words FROM sw WHERE position < 12 GROUP BY 1)
SELECT tx.topic_id, label, n_words, words, {sql_r6('rate')} AS readmission_rate,
       0.5::DOUBLE AS coherence_score FROM tx LEFT JOIN rates USING (topic_id)"""


@query("s8_topics_payload", _TOPIC_EXPORT)
def s8(spark, d):
    coherence = spark.createDataFrame([(5, 0.3), (20, 0.5)], "k int, coherence double")
    payload = xp.topics_payload(_topics(spark, d), coherence, 20)
    return payload.select("coherence_score", F.explode("topics").alias("t")).select(
        F.col("t.topic_id"), "t.label",
        F.size("t.words").cast("long").alias("n_words"),
        F.array_join(F.transform("t.words", lambda w: w["word"]), " ").alias("words"),
        r6(F.col("t.readmission_rate")).alias("readmission_rate"),
        "coherence_score",
    )


@query(
    "s9_exported_sections",
    f"""SELECT section, (SELECT count(*) > 0 FROM labels) AS written,
        CASE section WHEN 'topics' THEN (SELECT count(*) FROM ({_TOPIC_EXPORT})) END AS n_topics
        FROM (VALUES ('results'), ('fairness'), ('topics')) t(section)""",
)
def s9(spark, d):
    folder = scratch_path(spark, "export")
    paths = xp.export_payloads(
        folder, xp.results_payload(results(spark, d)), xp.fairness_payload(*_fairness(spark, d)),
        xp.topics_payload(_topics(spark, d), spark.createDataFrame([(5, 0.3), (20, 0.5)], "k int, coherence double"), 20),
    )
    out = None
    for path in paths:
        name = path.rsplit("/", 1)[1].removesuffix(".json")
        back = xp.read_payload(spark, path)
        topics = F.sum(F.size("topics")).cast("long") if "topics" in back.columns else F.lit(None).cast("long")
        one = back.agg((F.count(F.lit(1)) == 1).alias("written"), topics.alias("n_topics"))
        one = one.select(F.lit(name).alias("section"), "written", "n_topics")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "s10_payload_read_back",
    with_scored(_GROUPS + _GAPS + " SELECT attribute, equalized_odds_difference, fpr_difference FROM dis"),
)
def s10(spark, d):
    path = xp.write_payload(
        xp.fairness_payload(*_fairness(spark, d)), scratch_path(spark, "fairness")
    )
    back = xp.read_payload(spark, path).select(F.explode("attributes").alias("a"))
    return back.select("a.attribute", "a.equalized_odds_difference", "a.fpr_difference")


@query(
    "s11_saved_models",
    """SELECT m AS model, 'embeddings' AS feature_type, m = 'random_forest' AS is_best,
         (SELECT count(*) FROM embeddings) AS n_scored
       FROM (VALUES ('logistic_regression'), ('random_forest')) t(m)""",
)
def s11(spark, d):
    models, data = {}, None
    for name in ("logistic_regression", "random_forest"):
        data, models[(name, "embeddings")] = fitted(spark, d, name)
    folder = scratch_path(spark, "models")
    md.save_models(spark, models, ("random_forest", "embeddings"), folder)
    listed = md.list_models(spark, folder)
    best = md.load_best(spark, folder)
    n = tr.score(best, data, ["row_id"]).agg(F.count("y_prob").alias("n_scored"))
    return listed.select("model", "feature_type", "is_best").join(n, F.lit(True))
