"""All feature sets over the eligible rows, one table each, keyed by row id."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ..functions import text as ft
from ..operators import cohort as oc, embed as oe, features as of, text as ot
from ..session import materialize


def build_feature_sets(
    processed: DataFrame,
    row_id: str = "doc_id",
    label: str | None = "readmission_30day",
    train: DataFrame | None = None,
    doc_topics: DataFrame | None = None,
    topic_names: list[str] | None = None,
    cluster_topics: DataFrame | None = None,
    embeddings: DataFrame | None = None,
    reduce_to: int | None = 50,
    text_from: str = "cleaned_text",
    original: str | None = "text",
    tfidf: dict | None = None,
    structured: dict | None = None,
) -> dict[str, DataFrame]:
    """``{name: (row_id, features)}``; a set whose input is missing is left out.

    ``train`` holds the training rows' ids: vocabulary, idf, medians, scaling and
    components are fitted on them and applied to the rest (None: on all rows).
    ``processed`` carries tokens, cleaned text and the structured columns, with
    prior stays already counted over all stays (``utilization``).
    """
    rows = oc.keep_eligible(processed, label) if label else processed
    sets: dict[str, DataFrame] = {}

    def fitted(part: DataFrame) -> DataFrame:
        return part if train is None else part.join(train.select(row_id), row_id, "left_semi")

    # Terms, text statistics and the sets made from them are read several times.
    terms = ft.terms(F.array_join("tokens", " ")).alias("terms")
    words = materialize(rows.select(row_id, terms), "terms")
    vocab = ot.fit_bigram_vocabulary(fitted(words), F.col("terms"), **(tfidf or {}))
    weighted = ot.tfidf_vectors(words, ft.ngrams(F.col("terms")), vocab, out="features")
    weighted = materialize(weighted.select(row_id, "features"), "tfidf")
    sets["tfidf"] = of.name_vector(weighted, "features", vocab.terms)

    if doc_topics is not None:
        vec = rows.select(row_id).join(doc_topics, row_id).select(
            row_id, array_to_vector("topics").alias("features")
        )
        sets["topic_lda"] = of.name_vector(vec, "features", topic_names) if topic_names else vec
    if cluster_topics is not None:
        sets["topic_clusters"] = rows.select(row_id).join(cluster_topics, row_id).select(
            row_id, array_to_vector("topics").alias("features")
        )
    if embeddings is not None:
        mine = of.align(rows.select(row_id), embeddings, row_id)
        if reduce_to:
            base = mine if train is None else of.align(fitted(rows.select(row_id)), embeddings, row_id)
            model = oe.fit_reduction(base, reduce_to)
            sets["embeddings"] = oe.apply_reduction(mine, model).select(row_id, "features")
        else:
            sets["embeddings"] = mine.select(
                row_id, array_to_vector("embedding").alias("features")
            )

    table = of.structured_features(rows, [row_id], fitted(rows), **(structured or {}))
    sets["structured"] = of.assemble(table, of.STRUCTURED_COLUMNS).select(row_id, "features")

    stats = materialize(of.text_statistics(rows, [row_id], text=text_from, original=original), "text-stats")
    scaler = of.fit_scaler(fitted(stats), of.TEXT_STATISTICS)
    stats = of.apply_scaler(stats, scaler, of.TEXT_STATISTICS)
    sets["text_stats"] = of.assemble(stats, of.TEXT_STATISTICS).select(row_id, "features")

    combined = {"tfidf": sets["tfidf"]}
    if "topic_lda" in sets:
        combined["topics"] = sets["topic_lda"]
    if "embeddings" in sets:
        combined["embeddings"] = sets["embeddings"]
    combined["structured"], combined["text_stats"] = sets["structured"], sets["text_stats"]
    sets["combined"] = of.combine_feature_sets(combined, row_id)
    return sets
