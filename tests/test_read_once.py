"""Work that several steps share is done once, and on all cores."""

import pytest
from pyspark.sql import functions as F

from cohortlens.catalog import text as ct, topics as cp
from cohortlens.operators import explain as ex, topics as tp
from cohortlens.plans.notes import fit_note_model

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["u2_keyword_hits", "x6_topic_labels", "w5_repeated_labels", "x11_compare_models"])
def test_documents_are_tokenized_once(spark, monkeypatch, name):
    made, plain = [], cp.documents
    monkeypatch.setattr(cp, "documents", lambda *a: made.append(1) or plain(*a))
    assert cp.QUERIES[name](spark, D).count() > 0
    assert len(made) == 1


@pytest.mark.parametrize("name", ["t5_phrase_scores", "t5_phrase_npmi"])
def test_phrases_are_scored_from_written_tokens(spark, monkeypatch, name):
    seen, plain = [], ct.ot.phrase_scores
    monkeypatch.setattr(ct.ot, "phrase_scores", lambda df, *a: seen.append(df) or plain(df, *a))
    ct.QUERIES[name](spark, D)
    assert "regexp" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_notes_of_one_partition_are_fitted_on_all_cores(spark, monkeypatch):
    seen, plain = [], tp.train_lda
    monkeypatch.setattr(
        tp, "train_lda",
        lambda v, *a, **k: seen.append((v.columns, v.rdd.getNumPartitions())) or plain(v, *a, **k, passes=1),
    )
    rows = [(i, ("good walk home" if i % 2 else "bad fever shock") + f" day{i % 5}", i % 2) for i in range(60)]
    train = spark.createDataFrame(rows, "doc_id int, text string, label int").coalesce(1)
    fit_note_model(
        train, "label", topics=2, min_df=2, max_df=1.0, inputs={"age": None, "gender": None, "insurance": None, "los": None}
    )
    assert seen[0][0] == ["note_counts"] and seen[0][1] > 1


def test_top_of_wide_vectors_with_ties(spark):
    r = [[float((i * 7 + j) % 11 - 5) for j in range(40)] for i in range(5)]
    table = spark.createDataFrame([(i, v, v, 0.0) for i, v in enumerate(r)], "row_id int, x array<double>, contributions array<double>, base double")
    names = [f"n{j:02d}" for j in range(40)]
    for top_n in (3, 10, 60):
        out = ex.local_explanations(table, names, "row_id", top_n)
        # Only what can be among the top is sorted as cells.
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "sort_array" in plan
        for row in out.select("row_id", F.expr("transform(top_features, f -> f.feature)").alias("f")).collect():
            want = sorted(range(40), key=lambda j: (-abs(r[row.row_id][j]), names[j]))[:top_n]
            assert row.f == [names[j] for j in want]


@pytest.mark.parametrize("name, at", [("x5_lda_topic_words", "train_lda"), ("x7_document_topics", "train_lda"), ("x4_optimal_topics", "optimal_topics"), ("x12_topic_study", "optimal_topics")])
def test_topic_models_keep_no_tokens(spark, monkeypatch, name, at):
    seen = []

    def stop(vectors, *args, **kwargs):
        seen.append((vectors.columns, vectors.storageLevel.useMemory))
        raise InterruptedError

    from cohortlens.catalog import topics as queries

    monkeypatch.setattr(tp, at, stop)
    with pytest.raises(InterruptedError):
        queries.QUERIES[name](spark, D)
    assert seen == [(["doc_id", "counts"], True)]
