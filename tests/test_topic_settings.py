"""Topic queries hand the operators no smaller work than the operators' defaults."""

import threading

import numpy as np

from cohortlens.catalog import topics as queries
from cohortlens.operators import text as ot, topics as tp

SF_DIR = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


def seen(monkeypatch, owner, name, spark, query):
    """The arguments with which ``query`` first calls ``owner.name``."""
    calls = []

    def stop(*args, **kwargs):
        calls.append((args, kwargs))
        raise Seen

    monkeypatch.setattr(owner, name, stop)
    try:
        queries.QUERIES[query](spark, SF_DIR)
    except Seen:
        pass
    return calls[0]


def test_lda_makes_fifteen_passes(monkeypatch):
    given = {}

    class Stub:
        def __init__(self, **kwargs):
            given.update(kwargs)

        def fit(self, vectors):
            return self

    monkeypatch.setattr(tp, "LDA", Stub)
    tp.train_lda(None, 3)
    assert round(given["maxIter"] * given["subsamplingRate"]) == 15
    tp.train_lda(None, 3, subsampling=0.2)
    assert given["maxIter"] == 75


def test_models_are_trained_at_the_defaults(spark, monkeypatch):
    for query in ("x5_lda_topic_words", "x7_document_topics"):
        args, kwargs = seen(monkeypatch, tp, "train_lda", spark, query)
        assert len(args) == 2 and not kwargs
    args, kwargs = seen(monkeypatch, tp, "optimal_topics", spark, "x4_optimal_topics")
    assert len(args) == 3 and not kwargs
    args, kwargs = seen(monkeypatch, queries, "topic_study", spark, "x12_topic_study")
    assert len(args) == 2 and not kwargs
    args, kwargs = seen(monkeypatch, tp, "cluster_topics", spark, "x9_cluster_topics")
    assert len(args) == 1 and set(kwargs) == {"min_size"}


def test_vocabulary_keeps_rare_terms(spark, monkeypatch):
    args, kwargs = seen(monkeypatch, ot, "fit_vocabulary", spark, "x4_optimal_topics")
    assert args[4] == 100_000


def test_models_of_a_grid_are_fitted_at_one_time(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ["a", "b", "c", "d"][: 1 + i % 4]) for i in range(12)], "doc_id long, tokens array<string>")
    vocab = ot.fit_vocabulary(docs, "tokens", 1, 1.0, 10)
    vectors = ot.count_vectors(docs, "tokens", vocab).persist()
    alone = {k: tp.train_lda(vectors, k, passes=1, subsampling=0.5).topicsMatrix() for k in (2, 3)}
    fit, meet = tp.train_lda, threading.Barrier(2)

    def both(*args, **kwargs):
        meet.wait(60)
        return fit(*args, **kwargs)

    monkeypatch.setattr(tp, "train_lda", both)
    best, models, _ = tp.optimal_topics(vectors, docs, vocab, [2, 3], passes=1, subsampling=0.5)
    assert list(models) == [2, 3] and best in models
    for k, model in models.items():
        assert np.allclose(model.topicsMatrix().toArray(), alone[k].toArray())
