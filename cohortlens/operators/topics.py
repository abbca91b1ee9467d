"""Topic models, coherence, labels, outcome association."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erfc, sqrt
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.numeric import ratio, round_even
from ..session import materialize
from .ranking import label_totals, rank_sums
from .text import Vocabulary, exploded

EPSILON = 1e-12
# Sliding window of each coherence measure (None: whole document).
COHERENCE_WINDOWS = {"u_mass": None, "c_v": 110, "c_uci": 10, "c_npmi": 10}


def train_lda(
    vectors: DataFrame,
    k: int,
    passes: float = 15,
    subsampling: float = 0.05,
    doc_concentration: list[float] | None = None,
    topic_concentration: float | None = None,
    column: str = "counts",
    seed: int = 42,
):
    """Online variational LDA.  An iteration samples a share of ``subsampling`` of the
    documents; there are as many as ``passes`` over all of them take.  The document
    prior is learned unless given."""
    lda = LDA(
        k=k,
        maxIter=ceil(passes / subsampling),
        optimizer="online",
        subsamplingRate=subsampling,
        optimizeDocConcentration=doc_concentration is None,
        featuresCol=column,
        seed=seed,
    )
    if doc_concentration is not None:
        lda = lda.setDocConcentration(doc_concentration)
    if topic_concentration is not None:
        lda = lda.setTopicConcentration(topic_concentration)
    return lda.fit(vectors)


def topic_words(model, vocab: Vocabulary, n: int = 15, digits: int | None = 4) -> DataFrame:
    """(topic_id, position, word, weight), best first."""
    spark = model.describeTopics(1).sparkSession
    described = model.describeTopics(n).select(
        F.col("topic").alias("topic_id"),
        F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("position", "t"),
    )
    weight = F.col("t.termWeights")
    return described.join(
        F.broadcast(vocab.frame(spark).select("term_id", "term")),  # capped vocabulary
        F.col("t.termIndices") == F.col("term_id"),
    ).select(
        "topic_id",
        "position",
        F.col("term").alias("word"),
        (round_even(weight, digits) if digits is not None else weight).alias("weight"),
    )


def document_topics(model, vectors: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, topics): the distribution over all topics."""
    return model.transform(vectors).select(
        doc_id, vector_to_array("topicDistribution").alias("topics")
    )


def topic_rows(doc_topics: DataFrame, keep: list[str]) -> DataFrame:
    return doc_topics.select(*keep, F.posexplode("topics").alias("topic_id", "weight"))


def dominant_topic(doc_topics: DataFrame, out: str = "topic_id") -> DataFrame:
    """Index of the largest weight, the first one on ties."""
    place = F.array_position("topics", F.array_max("topics")) - 1
    return doc_topics.withColumn(out, place.cast("int"))


# --- labels -------------------------------------------------------------------


def keyword_hits(words: DataFrame, keywords: DataFrame) -> DataFrame:
    """(topic_id, category, category_order, n): words a topic shares with a category."""
    mine = words.select("topic_id", F.lower("word").alias("keyword")).distinct()
    return mine.join(keywords.dropDuplicates(["category", "keyword"]), "keyword").groupBy(
        "topic_id", "category", "category_order"
    ).agg(F.count(F.lit(1)).alias("n"))


def label_topics(words: DataFrame, keywords: DataFrame) -> DataFrame:
    """(topic_id, label) for (topic_id, word) rows: the category of ``keywords``
    (category, category_order, keyword) with most hits, the first on ties, none
    gives ``Topic N``.  A repeated label gets `` (2)``, `` (3)``, ..."""
    best = keyword_hits(words, keywords).groupBy("topic_id").agg(
        F.max_by("category", F.struct("n", -F.col("category_order"))).alias("category")
    )
    topics = words.select("topic_id").distinct().join(best, "topic_id", "left")
    # A handful of topics per category.
    nth = F.row_number().over(Window.partitionBy("category").orderBy("topic_id"))
    label = (
        F.when(F.col("category").isNull(), F.concat(F.lit("Topic "), F.col("topic_id")))
        .when(F.col("_nth") == 1, F.col("category"))
        .otherwise(F.concat("category", F.lit(" ("), F.col("_nth"), F.lit(")")))
    )
    return topics.withColumn("_nth", nth).select("topic_id", label.alias("label"))


def with_label(df: DataFrame, labels: DataFrame | None, topic: str = "topic_id") -> DataFrame:
    """Attach ``label``; a topic without one is ``Topic N``."""
    fallback = F.concat(F.lit("Topic "), F.col(topic).cast("string"))
    if labels is None:
        return df.withColumn("label", fallback)
    return df.join(labels, topic, "left").withColumn("label", F.coalesce("label", fallback))


def topic_table(words: DataFrame, labels: DataFrame | None, n: int = 10) -> DataFrame:
    """(topic_id, label, top_words, top_word_weights)."""
    top = words.where(F.col("position") < n).groupBy("topic_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "word", "weight"))).alias("_w")
    )
    listed = top.select(
        "topic_id",
        F.array_join(F.transform("_w", lambda w: w["word"]), ", ").alias("top_words"),
        F.transform("_w", lambda w: round_even(w["weight"], 4)).alias("top_word_weights"),
    )
    return with_label(listed, labels).select("topic_id", "label", "top_words", "top_word_weights")


def diversity(words: DataFrame, n: int = 10, by: list[str] | None = None) -> DataFrame:
    """Distinct words over all words among each topic's top ``n``."""
    top = words.where(F.col("position") < n)
    return top.groupBy(*(by or [])).agg(
        round_even(F.count_distinct("word") / F.count(F.lit(1)), 4).alias("topic_diversity")
    )


# --- coherence ----------------------------------------------------------------


def cooccurrence(
    docs: DataFrame, words: list[str], window: int | None, tokens: str = "tokens"
) -> DataFrame:
    """(i, j, n) for i <= j: in how many windows words i and j both occur (i = j:
    how many hold the word), and (-1, -1, n): the number of windows.

    ``words`` are the topics' top words, a fixed number.  Each task adds up one
    word-by-word matrix over its documents, so what is shuffled does not grow with
    the data.  A window slides by one token; a shorter document is one window.
    """
    size = len(words)
    step = 4096
    # Only the hits leave the JVM: positions and word numbers, and the length.
    known = F.array(*[F.lit(w) for w in words])
    found = F.filter(tokens, lambda t: t.isin(words))
    slim = docs.select(
        F.size(tokens).alias("length"),
        F.filter(
            F.transform(tokens, lambda t, at: F.when(t.isin(words), at)), lambda p: p.isNotNull()
        ).alias("spots"),
        F.transform(found, lambda t: (F.array_position(known, t) - 1).cast("int")).alias("ids"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((size, size), dtype=np.int64)
        windows = 0
        for pdf in batches:
            for length, at, numbers in zip(pdf["length"], pdf["spots"], pdf["ids"]):
                count = 1 if window is None else max(1, length - window + 1)
                windows += count
                if len(at) == 0:
                    continue
                ids, row = np.unique(numbers, return_inverse=True)
                if count == 1:
                    both[np.ix_(ids, ids)] += 1
                    continue
                # A word at p is in the windows that start in p - window + 1 .. p.
                for begin in range(0, count, step):
                    end = min(begin + step, count)
                    edge = np.zeros((len(ids), end - begin + 1), dtype=np.int32)
                    first = np.clip(at - window + 1, begin, end) - begin
                    after = np.clip(at + 1, begin, end) - begin
                    np.add.at(edge, (row, first), 1)
                    np.add.at(edge, (row, after), -1)
                    present = (edge.cumsum(axis=1)[:, :-1] > 0).astype(np.float64)
                    both[np.ix_(ids, ids)] += (present @ present.T).astype(np.int64)
        i, j = np.nonzero(np.triu(both))
        yield pd.DataFrame(
            {
                "i": np.append(i, -1).astype(np.int32),
                "j": np.append(j, -1).astype(np.int32),
                "n": np.append(both[i, j], windows),
            }
        )

    partial = slim.mapInPandas(run, "i int, j int, n long")
    return partial.groupBy("i", "j").agg(F.sum("n").alias("n"))


def coherence(
    docs: DataFrame,
    words: DataFrame,
    measure: str = "c_v",
    top_n: int = 20,
    by: list[str] | None = None,
    tokens: str = "tokens",
    digits: int | None = 4,
) -> DataFrame:
    """Mean topic coherence per ``by`` (e.g. a model or a topic count); ``words``
    has (by..., topic_id, position, word).  All models share one pass over the
    documents."""
    if measure not in COHERENCE_WINDOWS:
        raise ValueError(f"unknown coherence {measure!r}")
    by = by or []
    spark = docs.sparkSession
    top = words.where(F.col("position") < top_n).select(*by, "topic_id", "position", "word")
    rows = top.collect()  # models x topics x top_n words, whatever the data
    top = spark.createDataFrame(rows, top.schema)
    listed = sorted({r["word"] for r in rows})
    counts = cooccurrence(docs, listed, COHERENCE_WINDOWS[measure], tokens)
    counts = counts.persist()  # a fixed-size table, used three times below
    total = counts.agg(F.max(F.when(F.col("i") == -1, F.col("n"))).alias("_total"))
    single = counts.where(F.col("i") == F.col("j")).select(
        F.col("i").alias("_id"), F.col("n").alias("_n")
    )
    ids = spark.createDataFrame([(w, i) for i, w in enumerate(listed)], "word string, _id int")
    top = top.join(ids, "word").join(single, "_id", "left").fillna(0, ["_n"])
    key = [*by, "topic_id"]
    left = top.select(*key, F.col("position").alias("p"), F.col("_id").alias("a"), F.col("_n").alias("na"))
    right = top.select(*key, F.col("position").alias("q"), F.col("_id").alias("b"), F.col("_n").alias("nb"))
    pairs = left.join(right, key)  # top_n squared per topic
    if measure == "u_mass":
        pairs = pairs.where(F.col("q") < F.col("p"))
    elif measure != "c_v":
        pairs = pairs.where(F.col("q") != F.col("p"))
    pairs = pairs.join(
        counts.select("i", "j", F.col("n").alias("nab")),
        (F.col("i") == F.least("a", "b")) & (F.col("j") == F.greatest("a", "b")),
        "left",
    ).fillna(0, ["nab"]).join(F.broadcast(total), F.lit(True))  # one row
    p_ab = F.col("nab") / F.col("_total")
    p_a, p_b = F.col("na") / F.col("_total"), F.col("nb") / F.col("_total")
    possible = (F.col("na") > 0) & (F.col("nb") > 0)
    lift = F.when(possible, F.ln(F.try_divide(p_ab + EPSILON, p_a * p_b))).otherwise(0.0)
    if measure == "u_mass":
        value = F.when(F.col("nb") > 0, F.ln(F.try_divide(p_ab + EPSILON, p_b))).otherwise(0.0)
    elif measure == "c_uci":
        value = lift
    else:
        value = lift / -F.ln(p_ab + EPSILON)
    scored = pairs.select(*key, "p", "q", value.alias("v"))
    per_topic = (
        _context_similarity(scored, key) if measure == "c_v" else
        scored.groupBy(*key).agg(F.avg("v").alias("v"))
    )
    mean = F.avg("v")
    return per_topic.groupBy(*by).agg(
        (round_even(mean, digits) if digits is not None else mean).alias("coherence")
    )


def _context_similarity(scored: DataFrame, key: list[str]) -> DataFrame:
    """Mean cosine between each word's row of values and the sum of all rows."""
    whole = scored.groupBy(*key, "q").agg(F.sum("v").alias("s"))
    cells = scored.join(whole, [*key, "q"]).groupBy(*key, "p").agg(
        F.sum(F.col("v") * F.col("s")).alias("_vs"),
        F.sum(F.col("v") * F.col("v")).alias("_vv"),
        F.sum(F.col("s") * F.col("s")).alias("_ss"),
    )
    cosine = ratio(F.col("_vs"), F.sqrt("_vv") * F.sqrt("_ss"))
    return cells.groupBy(*key).agg(F.avg(cosine).alias("v"))


def optimal_topics(
    vectors: DataFrame,
    docs: DataFrame,
    vocab: Vocabulary,
    topic_range: list[int] | None = None,
    measure: str = "c_v",
    tokens: str = "tokens",
    **lda,
) -> tuple[int, dict, DataFrame]:
    """Train one model per topic count, all at a time; the highest coherence wins, the first on
    ties.  Returns the count, the models and (k, coherence)."""
    topic_range = topic_range or [5, 10, 15, 20]
    words = None
    # An iteration is a few short jobs around work on the driver: models fitted side by
    # side fill the cores that one leaves idle.
    with ThreadPool(len(topic_range)) as pool:
        fitted = pool.map(inheritable_thread_target(vectors.sparkSession)(lambda k: train_lda(vectors, k, **lda)), topic_range)
    models = dict(zip(topic_range, fitted))
    for k in topic_range:
        mine = topic_words(models[k], vocab, 20, None).withColumn("k", F.lit(k))
        words = mine if words is None else words.unionByName(mine)
    scores = coherence(docs, words, measure, by=["k"], tokens=tokens)
    found = {r["k"]: r["coherence"] for r in scores.collect()}  # one row per count
    best = max(topic_range, key=lambda k: (found[k], -topic_range.index(k)))
    return best, models, docs.sparkSession.createDataFrame(
        [(k, found[k]) for k in topic_range], "k int, coherence double"
    )


# --- outcome ------------------------------------------------------------------


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: erfc(abs(v) / sqrt(2.0)))


def topic_outcome_test(
    doc_topics: DataFrame,
    labels: DataFrame | None = None,
    label: str = "label",
    alpha: float = 0.05,
) -> DataFrame:
    """Mann-Whitney U per topic of (topic_id, weight, label 0/1) rows, two-sided
    normal approximation with tie and continuity corrections.  Topics with an empty
    class are left out.  ``z`` is kept beside the p-value."""
    rows = doc_topics.where(F.col(label).isin(0, 1))
    sums = rank_sums(label_totals(rows, ["topic_id"], "weight", label), ["topic_id"])
    means = rows.groupBy("topic_id").agg(
        F.avg(F.when(F.col(label) == 1, F.col("weight"))).alias("_m1"),
        F.avg(F.when(F.col(label) == 0, F.col("weight"))).alias("_m0"),
    )
    n1, n0 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    n = n1 + n0
    u = F.greatest(F.col("u_statistic"), n1 * n0 - F.col("u_statistic"))
    spread = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.try_divide(F.col("tie_term"), n * (n - 1))))
    z = F.coalesce(F.try_divide(u - n1 * n0 / 2 - 0.5, spread), F.lit(0.0))
    tested = sums.where((n1 > 0) & (n0 > 0)).withColumn("z", z).join(means, "topic_id")
    tested = with_label(tested, labels).withColumn("_p", F.least(two_sided_p("z"), F.lit(1.0)))
    # Below the mean after the correction: no evidence either way.
    p = F.when(F.col("z") < 0, 1.0).otherwise(F.col("_p"))
    return tested.select(
        "topic_id",
        "label",
        round_even(F.col("_m1"), 4).alias("mean_readmitted"),
        round_even(F.col("_m0"), 4).alias("mean_not_readmitted"),
        round_even(F.col("u_statistic"), 2).alias("u_statistic"),
        "z",
        round_even(p, 4).alias("p_value"),
        (p < alpha).alias("significant"),
    )


def rate_by_dominant_topic(doc_topics: DataFrame, n_topics: int, label: str = "label") -> DataFrame:
    """(topic_id, rate): mean label of the documents a topic dominates, null when
    there are none."""
    rates = dominant_topic(doc_topics).groupBy("topic_id").agg(F.avg(label).alias("rate"))
    return topic_ids(doc_topics.sparkSession, n_topics).join(rates, "topic_id", "left")


def topic_ids(spark, n_topics: int) -> DataFrame:
    return spark.range(n_topics).select(F.col("id").cast("int").alias("topic_id"))


def mean_weight_by_outcome(topic_weights: DataFrame, label: str = "label") -> DataFrame:
    """Topic by outcome, mean weight."""
    return topic_weights.groupBy("topic_id").pivot(label, [0, 1]).agg(F.avg("weight"))


def riskiest_topic(rates: DataFrame) -> DataFrame:
    known = rates.where(F.col("rate").isNotNull())
    return known.agg(
        F.max_by(F.struct("topic_id", "rate"), F.struct("rate", -F.col("topic_id"))).alias("b")
    ).select("b.*")


def topics_by_rate(rates: DataFrame) -> DataFrame:
    return rates.orderBy(F.desc(F.coalesce("rate", F.lit(0.0))), "topic_id")


# --- cluster topics -------------------------------------------------------------


def min_topic_size(n_docs: int, wanted: int = 50) -> int:
    """Below 500 documents a tenth of them, at least 5."""
    return max(5, min(wanted, n_docs // 10)) if n_docs < 500 else wanted


def cluster_topics(
    vectors: DataFrame,
    k: int = 20,
    min_size: int = 50,
    outlier_quantile: float = 0.95,
    column: str = "embedding",
    doc_id: str = "doc_id",
    max_iter: int = 20,
    seed: int = 42,
) -> DataFrame:
    """(doc_id, topic_id): k-means on unit vectors; documents of small clusters or
    beyond the distance quantile are -1; topics are numbered by size."""
    array = F.col(column)
    norm = F.sqrt(F.aggregate(array, F.lit(0.0), lambda acc, v: acc + v * v))
    data = vectors.select(doc_id, array_to_vector(column).alias("_v"), norm.alias("_norm"))
    usable = data.where(F.col("_norm") > 0)
    model = KMeans(
        k=k, featuresCol="_v", predictionCol="_c", distanceMeasure="cosine",
        maxIter=max_iter, seed=seed,
    ).fit(usable)
    centers = vectors.sparkSession.createDataFrame(
        [(i, [float(x) for x in c / np.linalg.norm(c)]) for i, c in enumerate(model.clusterCenters())],
        "_c int, _center array<double>",
    )
    dot = F.aggregate(
        F.zip_with(vector_to_array("_v"), "_center", lambda a, b: a * b),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    assigned = model.transform(usable).join(F.broadcast(centers), "_c")  # k rows
    assigned = assigned.select(doc_id, "_c", (1 - dot / F.col("_norm")).alias("_d"))
    limit = assigned.approxQuantile("_d", [outlier_quantile], 0.001)[0]
    near = F.col("_d") <= limit
    sizes = assigned.where(near).groupBy("_c").agg(F.count(F.lit(1)).alias("_n"))
    kept = sizes.where(F.col("_n") >= min_size).withColumn(
        "_topic", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_n"), "_c")) - 1
    )
    topic = F.when(near, F.col("_topic"))
    placed = assigned.join(F.broadcast(kept), "_c", "left").select(doc_id, topic.alias("_t"))
    return vectors.select(doc_id).join(placed, doc_id, "left").select(
        doc_id, F.coalesce("_t", F.lit(-1)).cast("int").alias("topic_id")
    )


def topic_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_docs"))


def class_tfidf(
    assigned_tokens: DataFrame, n: int = 15, topic: str = "topic_id", tokens: str = "tokens"
) -> DataFrame:
    """(topic_id, position, word, weight): tf within the topic times
    ln(1 + mean words per topic / corpus frequency), the ``n`` best per topic."""
    counts = (
        exploded(
            assigned_tokens.where(F.col(topic) >= 0),
            [F.col(topic).alias("topic_id")], F.col(tokens), "word",
        )
        .groupBy("topic_id", "word")
        .agg(F.count(F.lit(1)).alias("_tf"))
    )
    counts = materialize(counts, "topic-words")  # read four times below
    per_topic = counts.groupBy("topic_id").agg(F.sum("_tf").alias("_size"))
    per_word = counts.groupBy("word").agg(F.sum("_tf").alias("_f"))
    mean = per_topic.agg(F.avg("_size").alias("_mean"))
    weighted = (
        counts.join(per_topic, "topic_id").join(per_word, "word")
        .join(F.broadcast(mean), F.lit(True))  # one row
        .select(
            "topic_id",
            "word",
            (F.col("_tf") / F.col("_size") * F.ln(1 + F.col("_mean") / F.col("_f"))).alias("weight"),
        )
    )
    # rank <= n right above the window: each task keeps n rows per topic first.
    w = Window.partitionBy("topic_id").orderBy(F.desc("weight"), "word")
    return (
        weighted.withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= n)
        .select("topic_id", (F.col("_rank") - 1).alias("position"), "word", "weight")
    )


def one_hot_topics(assigned: DataFrame, n_topics: int, keep: list[str]) -> DataFrame:
    """(keep, topics): 1 at the assigned topic, all 0 for an outlier."""
    n = max(n_topics, 1)
    flags = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda t: (t == F.col("topic_id")).cast("double"),
    )
    return assigned.select(*keep, flags.alias("topics"))


def compare_topic_models(
    words: DataFrame, docs: DataFrame | None = None, tokens: str = "tokens", top_n: int = 10
) -> DataFrame:
    """One row per ``model``: topics, c_v over the top words, diversity."""
    sizes = words.groupBy("model").agg(F.count_distinct("topic_id").alias("num_topics"))
    out = sizes.join(diversity(words, top_n, ["model"]), "model")
    if docs is None:
        return out.withColumn("coherence_c_v", F.lit(None).cast("double"))
    scores = coherence(docs, words, "c_v", top_n, ["model"], tokens)
    return out.join(scores.withColumnRenamed("coherence", "coherence_c_v"), "model")
