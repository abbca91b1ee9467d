"""Density clusters against a plain DBSCAN."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import density
from cohortlens.plans.topics import cluster_study


def plain(points, eps, min_points):
    d = ((points[:, None] - points[None]) ** 2).sum(2)
    near = d <= eps * eps
    core = near.sum(1) >= min_points
    cluster, n = np.full(len(points), -1), 0
    for i in np.flatnonzero(core):
        if cluster[i] < 0:
            stack, cluster[i] = [i], n
            while stack:
                for q in np.flatnonzero(near[stack.pop()] & core & (cluster < 0)):
                    cluster[q] = n
                    stack.append(q)
            n += 1
    return core, cluster, d


def check(spark, points, eps, min_points, **how):
    core, cluster, d = plain(points, eps, min_points)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>")
    out = density.density_clusters(df, eps, min_points, **how).orderBy("doc_id").toPandas()
    topic = out.topic_id.to_numpy()
    assert (out.core.to_numpy() == core).all()
    pairs = set(zip(cluster[core], topic[core]))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == cluster.max() + 1
    for i in np.flatnonzero(~core):
        reached = core & (d[i] <= eps * eps)
        if not reached.any():
            assert topic[i] == -1
        else:
            assert topic[i] in topic[reached & (d[i] <= d[i][reached].min() + 1e-12)]
    sizes = [(topic == t).sum() for t in range(topic.max() + 1)]
    assert sizes == sorted(sizes, reverse=True)


def blobs(dims):
    r = np.random.default_rng(dims)
    far = np.eye(dims)[0] * 3
    return np.concatenate([
        r.normal(0, 0.35, (700, dims)), r.normal(far, 0.3, (500, dims)), r.uniform(-4, 6, (300, dims)),
        np.repeat(far[None] * 1.5 + 1, 400, 0), np.linspace(-3, 5, 100)[:, None] * np.ones(dims),
    ])


@pytest.mark.parametrize("dims, eps, min_points", [(2, 0.3, 8), (3, 0.5, 6)])
def test_two_thousand_points(spark, dims, eps, min_points):
    check(spark, np.round(blobs(dims), 3), eps, min_points, cell_rows=16)


def test_full_cells_meet_by_boxes(spark):
    """Two crowded lines a hair under, at and over the radius."""
    line = np.stack([np.linspace(0, 0.4, 60), np.zeros(60)], 1)
    for gap in (0.4999, 0.5, 0.5001):
        check(spark, np.concatenate([line, line + [0, gap]]), 0.5, 20)


def test_a_long_chain_is_one_cluster(spark):
    check(spark, np.arange(200)[:, None] * 0.9, 1.0, 2)


def test_defined_cases(spark):
    rows = [(i, [0.0, 0.0]) for i in range(5)] + [
        (5, None), (6, []), (7, [1.0]), (8, [None, 0.0]), (9, [float("nan"), 0.0]), (10, [float("inf"), 0.0]),
        (11, [1e300, 0.0]), (None, [0.1, 0.0]), (0, [0.0, -0.0]),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>")
    df = df.withColumn("w", F.lit(1)).withColumn("cell", F.lit("x"))
    got = sorted(map(str, density.density_clusters(df, 1.0, 6).select("doc_id", "topic_id").collect()))
    want = [(i, 0) for i in range(5)] + [(None, 0), (0, 0)] + [(i, -1) for i in range(5, 12)]
    assert got == sorted(f"Row(doc_id={a}, topic_id={b})" for a, b in want)
    assert {r.topic_id for r in density.density_clusters(df, 1.0, 6, min_size=8).collect()} == {-1}
    assert density.density_clusters(df.limit(0), 1.0).count() == 0
    with pytest.raises(ValueError):
        density.density_clusters(df, 0.0)


def test_connected(spark):
    nodes = spark.range(12).withColumnRenamed("id", "node")
    links = spark.createDataFrame([(i, i + 1) for i in range(7)] + [(9, 11), (11, 9), (8, 8)], "a bigint, b bigint")
    got = dict(density.connected(nodes, links).collect())
    assert got == {**{i: 0 for i in range(8)}, 8: 8, 9: 9, 10: 10, 11: 9}


def test_study(spark):
    words = [["heart", "rate"], ["lung", "air"]]
    docs = spark.createDataFrame(
        [(i, words[i % 2] * (3 + i % 3)) for i in range(60)] + [(60, ["heart", "lung"]), (61, [])],
        "doc_id bigint, tokens array<string>",
    )
    study = cluster_study(docs, eps=0.1, min_points=5, n_components=2, n_words=2)
    assert {r.topic_id: r.n_docs for r in study["sizes"].collect()} == {0: 30, 1: 30, -1: 2}
    found = {}
    for r in study["words"].collect():
        found.setdefault(r.topic_id, set()).add(r.word)
    assert sorted(map(sorted, found.values())) == [["air", "lung"], ["heart", "rate"]]
