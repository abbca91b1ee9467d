"""Result tables as nested payloads and JSON folders.

Every payload is one row built from tens of result rows (models, groups, topics);
the data behind them has been aggregated before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.bands import DISPARITY_NAMES
from ..functions.numeric import safe_double
from ..operators.evaluate import METRICS, best_row
from ..operators.topics import rate_by_dominant_topic, with_label

GROUP_FIELDS = ["accuracy", "precision", "recall", "f1", "fpr", "selection_rate"]
TOPIC_WORDS = 12


def results_payload(results: DataFrame, order: str = "seq") -> DataFrame:
    """results (in ``order``), best (first highest ROC-AUC), distinct counts."""
    clean = results.select(
        order,
        F.coalesce("model", F.lit("unknown")).alias("model"),
        F.coalesce("feature_type", F.lit("unknown")).alias("feature_type"),
        *[safe_double(F.col(m)).alias(m) for m in METRICS],
    )
    row = F.struct("model", "feature_type", *METRICS)
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r"))))
    summary = clean.agg(
        F.transform(listed, lambda s: s["r"]).alias("results"),
        F.count_distinct("model").alias("n_models"),
        F.count_distinct("feature_type").alias("n_feature_sets"),
    )
    best = best_row(clean, [], "roc_auc", order).select(row.alias("best"))
    return summary.join(best, F.lit(True), "left").select(
        "results", "best", "n_models", "n_feature_sets"
    )


def fairness_rows(groups: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row per attribute: its groups and four disparities."""
    cell = F.struct(
        F.col("group").cast("string").alias("group"),
        *[safe_double(F.col(m)).alias(m) for m in GROUP_FIELDS],
    )
    listed = groups.groupBy("attribute").agg(F.sort_array(F.collect_list(cell)).alias("groups"))
    values = [F.coalesce(safe_double(F.col(d)), F.lit(0.0)).alias(d) for d in DISPARITY_NAMES]
    return listed.join(gaps, "attribute", "left").select("attribute", "groups", *values)


def fairness_payload(groups: DataFrame, gaps: DataFrame) -> DataFrame:
    rows = fairness_rows(groups, gaps)
    item = F.struct("attribute", "groups", *DISPARITY_NAMES)
    return rows.agg(F.sort_array(F.collect_list(item)).alias("attributes"))


def topic_export_rows(
    words: DataFrame,
    labels: DataFrame | None,
    doc_topics: DataFrame | None = None,
    n_topics: int | None = None,
    outcome: str = "label",
) -> DataFrame:
    """(topic_id, label, words, readmission_rate); first 12 words."""
    top = words.where(F.col("position") < TOPIC_WORDS).groupBy("topic_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "word", "weight"))).alias("_w")
    )
    listed = top.select(
        F.col("topic_id").cast("int").alias("topic_id"),
        F.transform("_w", lambda w: F.struct(w["word"], safe_double(w["weight"]).alias("weight")))
        .alias("words"),
    )
    out = with_label(listed, labels)
    if doc_topics is not None:
        rates = rate_by_dominant_topic(doc_topics, n_topics, outcome)
        out = out.join(rates.withColumnRenamed("rate", "readmission_rate"), "topic_id", "left")
    else:
        out = out.withColumn("readmission_rate", F.lit(None).cast("double"))
    return out.select("topic_id", "label", "words", "readmission_rate")


def topics_payload(
    rows: DataFrame, coherence: DataFrame | None = None, chosen: int | None = None
) -> DataFrame:
    """topics, coherence_score (of the chosen count, else the highest), n_topics."""
    item = F.struct("topic_id", "label", "words", "readmission_rate")
    body = rows.agg(
        F.sort_array(F.collect_list(item)).alias("topics"), F.count(F.lit(1)).alias("_n")
    )
    if coherence is None:
        body = body.withColumn("coherence_score", F.lit(None).cast("double"))
    else:
        mine = F.max(F.when(F.col("k") == F.lit(chosen), F.col("coherence")))
        one = coherence.agg(F.coalesce(mine, F.max("coherence")).alias("coherence_score"))
        body = body.join(one, F.lit(True))
    total = F.lit(chosen).cast("long") if chosen else F.col("_n")
    return body.select("topics", "coherence_score", total.alias("n_topics"))


def write_payload(payload: DataFrame, path: str) -> str:
    payload.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)
    return path


def export_payloads(
    folder: str,
    results: DataFrame | None = None,
    fairness: DataFrame | None = None,
    topics: DataFrame | None = None,
) -> list[str]:
    """Write the given sections; returns the paths written."""
    sections = {"results": results, "fairness": fairness, "topics": topics}
    return [
        write_payload(payload, f"{folder.rstrip('/')}/{name}.json")
        for name, payload in sections.items()
        if payload is not None
    ]


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
