"""Topic models and outcome association."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.bands import rate_band
from ..operators import density, text as ot, topics as tp
from ..plans.topics import cluster_study, topic_study
from ..session import materialize
from .common import documents, r6, sql_r6, table, with_docs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


# --- a given document-topic table: the coordinates of the vectors as weights -------

N_TOPICS = 64


def doc_topics(spark, d):
    weight = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        weight.alias("topics"),
        (F.col("label") < 2).cast("int").alias("label"),
    )


_DOC_TOPICS = """
dt AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS topics,
       CAST(label < 2 AS INTEGER) AS label FROM embeddings),
tr AS (SELECT doc_id, label, CAST(generate_subscripts(topics, 1) - 1 AS INTEGER) AS topic_id,
       unnest(topics) AS weight FROM dt),
dom AS (SELECT doc_id, label, CAST(list_position(topics, list_max(topics)) - 1 AS INTEGER) AS topic_id
        FROM dt),
rates AS (SELECT CAST(t AS INTEGER) AS topic_id, r.rate FROM range(64) x(t)
          LEFT JOIN (SELECT topic_id, avg(label) AS rate FROM dom GROUP BY 1) r ON t = r.topic_id)
"""


def _with_topics(body: str) -> str:
    return f"WITH {_DOC_TOPICS} {body}"


def rates(spark, d):
    return tp.rate_by_dominant_topic(doc_topics(spark, d), N_TOPICS)


@query("w6_dominant_topic", _with_topics("SELECT doc_id, topic_id FROM dom"))
def w6(spark, d):
    return tp.dominant_topic(doc_topics(spark, d)).select("doc_id", "topic_id")


@query(
    "a7_mean_weight_by_outcome",
    _with_topics(
        f"""SELECT topic_id, {sql_r6('avg(weight) FILTER (label = 0)')} AS other,
            {sql_r6('avg(weight) FILTER (label = 1)')} AS returned FROM tr GROUP BY topic_id"""
    ),
)
def a7(spark, d):
    wide = tp.mean_weight_by_outcome(tp.topic_rows(doc_topics(spark, d), ["label"]))
    return wide.select("topic_id", r6(F.col("0")).alias("other"), r6(F.col("1")).alias("returned"))


@query("a10_rate_by_dominant_topic", _with_topics(f"SELECT topic_id, {sql_r6('rate')} AS rate FROM rates"))
def a10(spark, d):
    return rates(spark, d).withColumn("rate", r6(F.col("rate")))


@query(
    "a11_riskiest_topic",
    _with_topics(
        f"""SELECT topic_id, {sql_r6('rate')} AS rate FROM rates WHERE rate IS NOT NULL
            ORDER BY rate DESC, topic_id LIMIT 1"""
    ),
)
def a11(spark, d):
    return tp.riskiest_topic(rates(spark, d)).withColumn("rate", r6(F.col("rate")))


@query(
    "k7_topics_by_rate",
    _with_topics(f"SELECT topic_id, {sql_r6('coalesce(rate, 0)')} AS rate FROM rates ORDER BY 2 DESC"),
)
def k7(spark, d):
    out = tp.topics_by_rate(rates(spark, d))
    return out.withColumn("rate", r6(F.coalesce("rate", F.lit(0.0))))


@query(
    "p16_rate_band",
    _with_topics(
        """SELECT topic_id, CASE WHEN rate > 0.3 THEN 'danger' WHEN rate > 0.2 THEN 'warning'
           ELSE 'success' END AS band FROM rates"""
    ),
)
def p16(spark, d):
    return rates(spark, d).select("topic_id", rate_band(F.col("rate")).alias("band"))


@query(
    "x3_outcome_test",
    _with_topics(
        f""", r AS (SELECT topic_id, label, weight,
               rank() OVER (PARTITION BY topic_id ORDER BY weight)
                 + (count(*) OVER (PARTITION BY topic_id, weight) - 1) / 2.0::DOUBLE AS rk FROM tr),
          t AS (SELECT topic_id, sum(c * c * c - c)::DOUBLE AS ties FROM
                (SELECT topic_id, count(*)::DOUBLE AS c FROM tr GROUP BY topic_id, weight) GROUP BY 1),
          s AS (SELECT topic_id, sum(label)::DOUBLE AS n1, sum(1 - label)::DOUBLE AS n0,
                sum(rk) FILTER (label = 1) AS r1, avg(weight) FILTER (label = 1) AS m1,
                avg(weight) FILTER (label = 0) AS m0 FROM r GROUP BY 1),
          u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1 FROM s JOIN t USING (topic_id))
        SELECT topic_id, 'Topic ' || topic_id AS label, round_even(m1, 4) + 0 AS mean_readmitted,
          round_even(m0, 4) + 0 AS mean_not_readmitted, round_even(u1, 2) + 0 AS u_statistic,
          {sql_r6("(greatest(u1, n1 * n0 - u1) - n1 * n0 / 2 - 0.5) / sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1))))")} AS z
        FROM u"""
    ),
)
def x3(spark, d):
    tested = tp.topic_outcome_test(tp.topic_rows(doc_topics(spark, d), ["label"]))
    return tested.drop("p_value", "significant").withColumn("z", r6(F.col("z")))


@query("x3_p_values")
def x3_p(spark, d):
    tested = tp.topic_outcome_test(tp.topic_rows(doc_topics(spark, d), ["label"]))
    return tested.select("topic_id", "p_value", "significant").orderBy("p_value")


# --- topic words: the most frequent tokens of a source (20) or a language (4) ------


def _frequent(spark, d, group, n, docs=None):
    counts = (
        ot.exploded(docs if docs is not None else documents(spark, d), [group.alias("topic_id")], F.col("tokens"), "word")
        .groupBy("topic_id", "word").agg(F.count(F.lit(1)).alias("c"))
    )
    w = Window.partitionBy("topic_id").orderBy(F.desc("c"), "word")
    return (
        counts.withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= n)
        .select("topic_id", (F.col("_rank") - 1).alias("position"), "word", (F.col("c") / 1000).alias("weight"))
    )


def word_table(spark, d):
    """Tokens with their groups, written once for all that count them."""
    return materialize(documents(spark, d).select("lang", "source", "tokens"), "tokens")


def source_words(spark, d, n=15, docs=None):
    return _frequent(spark, d, F.substring("source", 4, 10).cast("int"), n, docs)


LANGUAGES = ["de", "en", "es", "fr"]


def language_words(spark, d, n=8, docs=None):
    codes = F.array(*[F.lit(x) for x in LANGUAGES])
    return _frequent(spark, d, (F.array_position(codes, F.col("lang")) - 1).cast("int"), n, docs)


def keywords(spark, d, docs=None):
    """The 40 most frequent words of each language as its category's keywords."""
    names = F.array(*[F.lit(x) for x in LANGUAGES])
    return language_words(spark, d, 40, docs).select(
        F.get(names, F.col("topic_id")).alias("category"),
        F.col("topic_id").alias("category_order"),
        F.col("word").alias("keyword"),
    )


def _sql_frequent(name, group, n):
    return f"""{name} AS (SELECT topic_id, CAST(row_number() OVER (PARTITION BY topic_id
        ORDER BY c DESC, word) - 1 AS INTEGER) AS position, word, c / 1000.0::DOUBLE AS weight
      FROM (SELECT {group} AS topic_id, t AS word, count(*) AS c
            FROM (SELECT source, lang, unnest(tokens) AS t FROM docs) GROUP BY 1, 2)
      QUALIFY position < {n})"""


_SOURCE = _sql_frequent("sw", "CAST(substr(source, 4) AS INTEGER)", 15)
_LANG = "CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END"
_KEYWORDS = _sql_frequent("lw40", _LANG, 40) + """,
kw AS (SELECT ['de', 'en', 'es', 'fr'][topic_id + 1] AS category, topic_id AS category_order,
       word AS keyword FROM lw40)"""
_HITS = f""", {_SOURCE}, {_KEYWORDS},
hits AS (SELECT sw.topic_id, category, category_order, count(*) AS n
         FROM (SELECT DISTINCT topic_id, word FROM sw) sw JOIN kw ON word = keyword GROUP BY 1, 2, 3)"""


@query("u2_keyword_hits", with_docs(_HITS + " SELECT topic_id, category, n FROM hits"))
def u2(spark, d):
    docs = word_table(spark, d)
    hits = tp.keyword_hits(source_words(spark, d, docs=docs), keywords(spark, d, docs))
    return hits.select("topic_id", "category", "n")


_LABELS = _HITS + """,
best AS (SELECT topic_id, arg_max(category, n * 10 - category_order) AS category FROM hits GROUP BY 1),
named AS (SELECT t.topic_id, category, row_number() OVER (PARTITION BY category ORDER BY t.topic_id) AS nth
          FROM (SELECT DISTINCT topic_id FROM sw) t LEFT JOIN best USING (topic_id)),
labels_t AS (SELECT topic_id, CASE WHEN category IS NULL THEN 'Topic ' || topic_id
       WHEN nth = 1 THEN category ELSE category || ' (' || nth || ')' END AS label FROM named)"""


@query("x6_topic_labels", with_docs(_LABELS + " SELECT topic_id, label FROM labels_t"))
def x6(spark, d):
    docs = word_table(spark, d)
    words = materialize(source_words(spark, d, docs=docs), "topic-words")  # read twice
    return tp.label_topics(words, keywords(spark, d, docs))


@query(
    "w5_repeated_labels",
    with_docs(
        f""", {_SOURCE}, {_KEYWORDS},
        hit AS (SELECT DISTINCT topic_id FROM sw JOIN kw ON word = keyword
                WHERE category = 'en' AND topic_id % 2 = 0)
        SELECT t.topic_id, CASE WHEN h.topic_id IS NULL THEN 'Topic ' || t.topic_id
          WHEN row_number() OVER (PARTITION BY h.topic_id IS NULL ORDER BY t.topic_id) = 1 THEN 'en'
          ELSE 'en (' || row_number() OVER (PARTITION BY h.topic_id IS NULL ORDER BY t.topic_id) || ')'
          END AS label
        FROM (SELECT DISTINCT topic_id FROM sw) t LEFT JOIN hit h USING (topic_id)"""
    ),
)
def w5(spark, d):
    # Odd topics get words no category knows.
    docs = word_table(spark, d)
    words = source_words(spark, d, docs=docs).withColumn(
        "word",
        F.when(F.col("topic_id") % 2 == 0, F.col("word")).otherwise(F.concat("word", F.lit("#"))),
    )
    words = materialize(words, "topic-words")  # read twice
    return tp.label_topics(words, keywords(spark, d, docs).where(F.col("category") == "en"))


@query(
    "j6_label_lookup",
    with_docs(
        f""", {_SOURCE} SELECT DISTINCT topic_id,
        CASE WHEN topic_id % 2 = 0 THEN 'even ' || topic_id ELSE 'Topic ' || topic_id END AS label FROM sw"""
    ),
)
def j6(spark, d):
    topics = source_words(spark, d).select("topic_id").distinct()
    labels = topics.where(F.col("topic_id") % 2 == 0).withColumn(
        "label", F.concat(F.lit("even "), F.col("topic_id"))
    )
    return tp.with_label(topics, labels)


@query(
    "u3_diversity",
    with_docs(
        f""", {_SOURCE} SELECT round_even(count(DISTINCT word) / count(*)::DOUBLE, 4) + 0
            AS topic_diversity FROM sw WHERE position < 10"""
    ),
)
def u3(spark, d):
    return tp.diversity(source_words(spark, d), 10)


@query(
    "x8_topic_table",
    with_docs(
        f""", {_SOURCE} SELECT topic_id, 'Topic ' || topic_id AS label,
          string_agg(word, ', ' ORDER BY position) AS top_words,
          {sql_r6('sum(weight)')} AS total_weight FROM sw WHERE position < 10 GROUP BY topic_id"""
    ),
)
def x8(spark, d):
    out = tp.topic_table(source_words(spark, d), None, 10)
    total = F.aggregate("top_word_weights", F.lit(0.0), lambda acc, v: acc + v)
    return out.select("topic_id", "label", "top_words", r6(total).alias("total_weight"))


def _sql_coherence(window: int | None, measure: str, words: str = _sql_frequent("lw", _LANG, 8)) -> str:
    """Window counts by listing every window a word's occurrence touches."""
    if window is None:
        spots = "spots AS (SELECT DISTINCT doc_id, 0 AS s, word FROM occ)"
        total = "(SELECT count(*) FROM docs)"
    else:
        spots = f"""spots AS (SELECT DISTINCT doc_id, word, unnest(range(greatest(pos - {window - 1}, 0),
            least(pos, greatest(n - {window}, 0)) + 1)) AS s FROM occ)"""
        total = f"(SELECT sum(greatest(len(tokens) - {window - 1}, 1)) FROM docs)"
    pairs = {
        "u_mass": "y.position < x.position",
        "c_npmi": "y.position <> x.position",
        "c_uci": "y.position <> x.position",
        "c_v": "true",
    }[measure]
    lift = "ln((coalesce(nab, 0) / t + 1e-12) / ((na / t) * (nb / t)))"
    value = {
        "u_mass": "ln((coalesce(nab, 0) / t + 1e-12) / (nb / t))",
        "c_npmi": f"{lift} / -ln(coalesce(nab, 0) / t + 1e-12)",
        "c_uci": lift,
        "c_v": f"{lift} / -ln(coalesce(nab, 0) / t + 1e-12)",
    }[measure]
    final = (
        "per AS (SELECT topic_id, avg(v) AS c FROM val GROUP BY 1)"
        if measure != "c_v"
        else """tot AS (SELECT topic_id, q, sum(v) AS sv FROM val GROUP BY 1, 2),
          cos AS (SELECT topic_id, p, sum(v * sv) / (sqrt(sum(v * v)) * sqrt(sum(sv * sv))) AS c
                  FROM val JOIN tot USING (topic_id, q) GROUP BY 1, 2),
          per AS (SELECT topic_id, avg(c) AS c FROM cos GROUP BY 1)"""
    )
    return with_docs(
        f""", {words},
        occ AS (SELECT doc_id, pos, n, word FROM (SELECT doc_id, unnest(tokens) AS word, len(tokens) AS n,
                  generate_subscripts(tokens, 1) - 1 AS pos FROM docs)
                SEMI JOIN lw USING (word)),
        {spots},
        single AS (SELECT word, count(*)::DOUBLE AS n FROM spots GROUP BY 1),
        both_w AS (SELECT a.word AS wa, b.word AS wb, count(*)::DOUBLE AS n FROM spots a
                 JOIN spots b ON a.doc_id = b.doc_id AND a.s = b.s GROUP BY 1, 2),
        val AS (SELECT x.topic_id, x.position AS p, y.position AS q, {value} AS v
          FROM lw x JOIN lw y ON x.topic_id = y.topic_id AND {pairs}
          JOIN (SELECT word, n AS na FROM single) sa ON sa.word = x.word
          JOIN (SELECT word, n AS nb FROM single) sb ON sb.word = y.word
          LEFT JOIN (SELECT wa, wb, n AS nab FROM both_w) m ON m.wa = x.word AND m.wb = y.word,
          (SELECT {total}::DOUBLE AS t)),
        {final}
        SELECT round_even(avg(c), 4) + 0 AS coherence FROM per"""
    )


def _coherence(measure):
    def run(spark, d):
        docs = materialize(documents(spark, d).select("lang", "tokens"), "tokens")
        return tp.coherence(docs, language_words(spark, d, docs=docs), measure)

    return run


for _measure in ("u_mass", "c_npmi", "c_uci", "c_v"):
    query(
        f"x2_coherence_{_measure}",
        _sql_coherence(tp.COHERENCE_WINDOWS[_measure], _measure),
    )(_coherence(_measure))


_SOURCE_TOP = f"{_SOURCE}, lw AS (SELECT * FROM sw WHERE position < 10)"


@query(
    "x11_compare_models",
    with_docs(
        f""", {_SOURCE}, {_sql_frequent("lw", _LANG, 8)},
        m AS (SELECT 'by_source' AS model, * FROM sw UNION ALL SELECT 'by_language', * FROM lw),
        c1 AS ({_sql_coherence(tp.COHERENCE_WINDOWS["c_v"], "c_v")}),
        c2 AS ({_sql_coherence(tp.COHERENCE_WINDOWS["c_v"], "c_v", _SOURCE_TOP)}),
        scores AS (SELECT 'by_language' AS model, coherence FROM c1 UNION ALL SELECT 'by_source', coherence FROM c2)
        SELECT model, count(DISTINCT topic_id) AS num_topics,
               round_even(count(DISTINCT word) / count(*)::DOUBLE, 4) + 0 AS topic_diversity,
               any_value(coherence) AS coherence_c_v
        FROM m JOIN scores USING (model) WHERE position < 10 GROUP BY model"""
    ),
)
def x11(spark, d):
    docs = word_table(spark, d)
    words = source_words(spark, d, docs=docs).withColumn("model", F.lit("by_source")).unionByName(
        language_words(spark, d, docs=docs).withColumn("model", F.lit("by_language"))
    )
    return tp.compare_topic_models(words, docs).select("model", "num_topics", "topic_diversity", "coherence_c_v")


# --- LDA ---------------------------------------------------------------------------


def _vectors(spark, d):
    docs = materialize(documents(spark, d).select("doc_id", "tokens"), "tokens")
    vocab = ot.fit_vocabulary(docs, F.col("tokens"), 5, 0.95, 100_000, rank_by="df")
    # The vectors are kept while a model is fitted: without the tokens.
    return docs, vocab, ot.count_vectors(docs, "tokens", vocab).drop("tokens")


@query("x5_lda_topic_words")
def x5(spark, d):
    _, vocab, vectors = _vectors(spark, d)
    model = tp.train_lda(vectors.persist(), 4)
    return tp.topic_words(model, vocab, 10)


@query(
    "x7_document_topics",
    "SELECT doc_id, CAST(3 AS BIGINT) AS n_topics, true AS sums_to_one FROM documents",
)
def x7(spark, d):
    _, _, vectors = _vectors(spark, d)
    model = tp.train_lda(vectors.persist(), 3)
    total = F.aggregate("topics", F.lit(0.0), lambda acc, v: acc + v)
    # A document without a known term has no distribution.
    flat = F.abs(total - 1) < 1e-6
    return tp.document_topics(model, vectors).select(
        "doc_id", F.size("topics").cast("long").alias("n_topics"),
        (flat | (total == 0)).alias("sums_to_one"),
    )


@query("x4_optimal_topics")
def x4(spark, d):
    docs, vocab, vectors = _vectors(spark, d)
    best, _, scores = tp.optimal_topics(vectors.persist(), docs, vocab)
    return scores.withColumn("chosen", F.col("k") == best)


@query("x12_topic_study")
def x12(spark, d):
    docs = materialize(documents(spark, d).select("doc_id", "tokens"), "tokens")
    return topic_study(docs, keywords(spark, d))["table"]


# --- cluster topics ------------------------------------------------------------------


@query("x9_cluster_topics")
def x9(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    size = tp.min_topic_size(vectors.count(), 20)
    return tp.topic_sizes(tp.cluster_topics(vectors, min_size=size))


#: Three sums of a vector's coordinates, radius and least neighbours of its clusters.
DENSITY_EPS, DENSITY_POINTS, DENSITY_SIZE = 0.2, 5, 5


def _sum_of_thirds(at: int):
    every_third = F.filter("embedding", lambda x, i: i % 3 == at)
    return F.aggregate(every_third, F.lit(0.0), lambda s, x: s + x.cast("double"))


@query(
    "x9_density_topics",
    f"""WITH RECURSIVE p AS (SELECT vec_id AS doc_id, {', '.join(
          f"list_sum(list_transform(range({at}, len(embedding), 3), lambda i: embedding[i + 1]::DOUBLE)) AS x{at}"
          for at in range(3))} FROM embeddings),
        near AS (SELECT a.doc_id AS a, b.doc_id AS b, {' + '.join(
          f"(a.x{at} - b.x{at}) * (a.x{at} - b.x{at})" for at in range(3))} AS d
          FROM p a, p b WHERE d <= {DENSITY_EPS}::DOUBLE * {DENSITY_EPS}::DOUBLE),
        core AS (SELECT a AS doc_id FROM near GROUP BY a HAVING count(*) >= {DENSITY_POINTS}),
        links AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
        reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        named AS (SELECT a AS doc_id, min([x0, x1, x2]) AS name FROM reach JOIN p ON b = doc_id GROUP BY a),
        edge AS (SELECT a AS doc_id, arg_min(name, (d, name)) AS name FROM near JOIN named ON b = doc_id
          WHERE a NOT IN (FROM core) GROUP BY a),
        placed AS (SELECT doc_id, name FROM named UNION ALL SELECT doc_id, name FROM edge),
        topics AS (SELECT name, row_number() OVER (ORDER BY count(*) DESC, name) - 1 AS topic_id
          FROM placed GROUP BY name HAVING count(*) >= {DENSITY_SIZE})
        SELECT p.doc_id, CAST(coalesce(topic_id, -1) AS INTEGER) AS topic_id,
          p.doc_id IN (FROM core) AS core
        FROM p LEFT JOIN placed USING (doc_id) LEFT JOIN topics USING (name)""",
)
def x9_density(spark, d):
    points = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.array(*[_sum_of_thirds(at) for at in range(3)]).alias("embedding")
    )
    return density.density_clusters(points, DENSITY_EPS, DENSITY_POINTS, DENSITY_SIZE)


@query("x9_density_topic_words")
def x9_density_words(spark, d):
    study = cluster_study(documents(spark, d), eps=0.05, n_components=3)
    return study["words"].withColumn("weight", r6(F.col("weight")))


@query(
    "x9_class_tfidf",
    with_docs(
        f""", w AS (SELECT CAST(substr(source, 4) AS INTEGER) AS topic_id, unnest(tokens) AS word FROM docs),
        tf AS (SELECT topic_id, word, count(*) AS tf FROM w GROUP BY 1, 2),
        sz AS (SELECT topic_id, sum(tf) AS size FROM tf GROUP BY 1),
        f AS (SELECT word, sum(tf) AS f FROM tf GROUP BY 1),
        s AS (SELECT topic_id, word, tf / size::DOUBLE * ln(1 + (SELECT avg(size) FROM sz) / f::DOUBLE) AS weight
              FROM tf JOIN sz USING (topic_id) JOIN f USING (word))
        SELECT topic_id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, word) - 1
          AS INTEGER) AS position, word, {sql_r6('weight')} AS weight FROM s QUALIFY position < 15"""
    ),
)
def x9_words(spark, d):
    topics = documents(spark, d).select(
        F.substring("source", 4, 10).cast("int").alias("topic_id"), "tokens"
    )
    return tp.class_tfidf(topics, 15).withColumn("weight", r6(F.col("weight")))


@query(
    "x10_one_hot_topics",
    """SELECT vec_id AS doc_id, CAST(t AS INTEGER) AS topic_id,
       CAST(label - 2 = t AS INTEGER)::DOUBLE AS weight FROM embeddings, range(8) x(t)""",
)
def x10(spark, d):
    assigned = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.when(F.col("label") >= 2, F.col("label") - 2).otherwise(-1).alias("topic_id"),
    )
    flags = tp.one_hot_topics(assigned, 8, ["doc_id"])
    return tp.topic_rows(flags, ["doc_id"])
