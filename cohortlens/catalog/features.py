"""Structured and text features, assembling, chunks and embeddings."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators import cohort as oc, embed as oe, features as of, ranking as rk
from ..plans.features import build_feature_sets
from ..session import materialize
from .cohort import cohort_frame
from .common import (
    documents, r6, scored, sql_documents, sql_list, sql_r6, sql_words, stays, subjects, table, with_docs,
    with_scored, with_stays,
)
from .text import sql_tfidf

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
    "a14_z_scores",
    f"""SELECT o_orderkey, {sql_r6('(o_totalprice - m) / s')} AS o_totalprice, 7.0::DOUBLE AS flat
        FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)""",
)
def a14(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(7.0).alias("flat"))
    columns = ["o_totalprice", "flat"]
    out = of.apply_scaler(orders, of.fit_scaler(orders, columns), columns)
    return out.withColumn("o_totalprice", r6(F.col("o_totalprice")))


@query(
    "a15_median_imputed",
    with_stays(
        f"""SELECT subject_id, {sql_r6('coalesce(anchor_age, (SELECT median(anchor_age) FROM subjects))')}
            AS anchor_age FROM subjects"""
    ),
)
def a15(spark, d):
    rows = subjects(spark, d)
    out = of.impute_median(rows, "anchor_age", of.median_row(rows, "anchor_age"))
    return out.select("subject_id", r6(F.col("anchor_age")).alias("anchor_age"))


_STRUCTURED = """, f AS (SELECT hadm_id,
  coalesce(anchor_age, (SELECT median(anchor_age) FROM labelled LEFT JOIN subjects USING (subject_id)))
    ::DOUBLE AS age,
  coalesce(CAST(upper(gender) = 'M' AS INTEGER), 0) AS gender_male,
  CAST(coalesce(insurance, 'Other') = 'Medicare' AS INTEGER) AS insurance_medicare,
  CAST(coalesce(insurance, 'Other') = 'Medicaid' AS INTEGER) AS insurance_medicaid,
  CAST(coalesce(insurance, 'Other') = 'Other' AS INTEGER) AS insurance_other,
  CAST(replace(upper(coalesce(admission_type, 'EMERGENCY')), 'EW EMER.', 'EMERGENCY') = 'EMERGENCY'
    AS INTEGER) AS admtype_emergency,
  CAST(upper(coalesce(admission_type, '')) = 'ELECTIVE' AS INTEGER) AS admtype_elective,
  CAST(upper(coalesce(admission_type, '')) = 'URGENT' AS INTEGER) AS admtype_urgent,
  ln(1 + date_diff('microsecond', admittime, dischtime) / 86400000000.0::DOUBLE) AS log_los,
  num_prior_admissions::DOUBLE AS num_prior_admissions,
  days_since_last_admission::DOUBLE AS days_since_last_admission, prior_expire_flag
  FROM labelled LEFT JOIN subjects USING (subject_id))"""


def _z(column: str) -> str:
    scaled = f"({column} - avg({column}) OVER ()) / stddev_samp({column}) OVER ()"
    return f"{sql_r6(scaled)} AS {column}"


@query(
    "f1_structured_features",
    with_stays(
        _STRUCTURED
        + f""" SELECT hadm_id, {_z('age')}, gender_male, insurance_medicare, insurance_medicaid,
          insurance_other, admtype_emergency, admtype_elective, admtype_urgent, {_z('log_los')},
          {_z('num_prior_admissions')}, {_z('days_since_last_admission')}, prior_expire_flag FROM f"""
    ),
)
def f1(spark, d):
    out = of.structured_features(_structured_input(spark, d), ["hadm_id"])
    return out.withColumns({c: r6(F.col(c)) for c in of.STRUCTURED_NUMERIC})


def _structured_input(spark, d):
    from ..functions.cohort import length_of_stay

    rows = oc.utilization(stays(spark, d)).join(subjects(spark, d), "subject_id", "left")
    return rows.withColumn("los_days", length_of_stay(F.col("admittime"), F.col("dischtime")))


_HEAD_SUM = " + ".join(
    f"CAST(contains(lower(text), '{h}') AS INTEGER)" for h in ft.COUNTED_HEADERS
)


@query(
    "f2_text_statistics",
    with_docs(
        rf""", s AS (SELECT doc_id, text, cleaned_text, {sql_words('cleaned_text')} AS ws FROM docs)
        SELECT doc_id, len(ws) AS note_length_words,
          len(list_filter(regexp_extract_all(lower(cleaned_text), '[\p{{L}}\p{{N}}_\p{{M}}]+'),
            lambda w: w IN ({sql_list(ft.NEGATION_CUES)}))) AS num_negations,
          {_HEAD_SUM} AS num_section_headers,
          CASE WHEN len(ws) > 0 THEN {sql_r6("round_even(length(array_to_string(ws, '')) / len(ws)::DOUBLE, 3)")}
            ELSE 0 END AS avg_word_length,
          CASE WHEN len(ws) > 0 THEN {sql_r6("round_even(len(list_distinct(ws)) / len(ws)::DOUBLE, 4)")}
            ELSE 0 END AS type_token_ratio FROM s"""
    ),
)
def f2(spark, d):
    out = of.text_statistics(documents(spark, d), ["doc_id"])
    return out.select(
        "doc_id",
        F.col("note_length_words").cast("long").alias("note_length_words"),
        F.col("num_negations").cast("long").alias("num_negations"),
        "num_section_headers",
        r6(F.col("avg_word_length")).alias("avg_word_length"),
        r6(F.col("type_token_ratio")).alias("type_token_ratio"),
    )


@query(
    "p18_request_rows",
    with_stays(
        f"""SELECT subject_id, coalesce(anchor_age::DOUBLE, 65) AS age,
          coalesce(CAST(starts_with(upper(gender), 'M') AS INTEGER), 0) AS gender_male,
          CAST(contains(lower(coalesce(insurance, '')), 'medicare') AS INTEGER) AS insurance_medicare,
          CAST(contains(lower(coalesce(insurance, '')), 'medicaid') AS INTEGER) AS insurance_medicaid,
          CAST(NOT contains(lower(coalesce(insurance, '')), 'medicare')
            AND NOT contains(lower(coalesce(insurance, '')), 'medicaid') AS INTEGER) AS insurance_other,
          1 AS admtype_emergency, 0 AS admtype_elective, 0 AS admtype_urgent,
          {sql_r6('ln(1 + CASE WHEN subject_id % 4 = 0 THEN 5 ELSE subject_id % 30 END)')} AS log_los,
          0 AS num_prior_admissions, 0 AS days_since_last_admission, 0 AS prior_expire_flag
          FROM subjects"""
    ),
)
def p18(spark, d):
    rows = subjects(spark, d).withColumn(
        "los", F.when(F.col("subject_id") % 4 != 0, F.col("subject_id") % 30)
    )
    out = of.request_row(rows, ["subject_id"], age="anchor_age", los="los")
    return out.withColumn("log_los", r6(F.col("log_los")))


# --- alignment and assembling ---------------------------------------------------


@query(
    "j3_attributes_to_scores",
    with_scored("SELECT row_id, y_true, lang FROM scored"),
)
def j3(spark, d):
    rows = scored(spark, d).select("row_id", "y_true")
    attributes = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    return of.align(rows, attributes, "row_id")


@query(
    "j4_embeddings_to_rows",
    """SELECT vec_id AS doc_id, quality, len(embedding) AS dims
       FROM labels JOIN embeddings ON doc_id = vec_id""",
)
def j4(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = table(spark, d, "labels").select("doc_id", "quality")
    return of.align(rows, vectors).select(
        "doc_id", "quality", F.size("embedding").cast("long").alias("dims")
    )


@query(
    "j5_combined_sets",
    """WITH c AS (SELECT o_orderkey AS doc_id, o_totalprice, o_custkey FROM orders)
       SELECT doc_id, 'price__o_totalprice' AS name, o_totalprice AS value FROM c
       UNION ALL SELECT doc_id, 'who__o_custkey', o_custkey::DOUBLE FROM c
       UNION ALL SELECT doc_id, 'who__flat', 1.0::DOUBLE FROM c""",
)
def j5(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "doc_id")
    orders = orders.withColumn("flat", F.lit(1.0))
    sets = {
        "price": of.assemble(orders.select("doc_id", "o_totalprice"), ["o_totalprice"]),
        "missing": None,
        "who": of.assemble(orders.select("doc_id", "o_custkey", "flat"), ["o_custkey", "flat"]),
    }
    merged = of.combine_feature_sets(sets)
    names = F.array(*[F.lit(n) for n in of.vector_names(merged)])
    return merged.select(
        "doc_id",
        F.explode(F.arrays_zip(names.alias("name"), vector_to_array("features").alias("value")))
        .alias("e"),
    ).select("doc_id", "e.name", "e.value")


@query(
    "f4_feature_sets",
    f"""WITH {sql_documents()} {sql_tfidf('tf')},
    n AS (SELECT count(*) AS n FROM docs), v AS (SELECT count(*) AS v FROM vocab)
    SELECT 'tfidf' AS feature_set, n AS n_rows, v AS n_features FROM n, v
    UNION ALL SELECT 'structured', n, 12 FROM n UNION ALL SELECT 'text_stats', n, 5 FROM n
    UNION ALL SELECT 'combined', n, v + 17 FROM n, v""",
)
def f4(spark, d):
    docs = documents(spark, d)
    rows = docs.join(
        _structured_input(spark, d).withColumnRenamed("hadm_id", "doc_id"), "doc_id"
    )
    # Read by every set: cut the lineage once.
    sets = build_feature_sets(materialize(rows, "processed"), label=None)
    out = None
    # A sparse vector carries its size.
    parts = F.unwrap_udt("features")
    size = F.coalesce(parts["size"], F.size(parts["values"]))
    for name in ("tfidf", "structured", "text_stats", "combined"):
        part = sets[name].agg(
            F.count("features").alias("n_rows"),
            F.max(size).cast("long").alias("n_features"),
        ).withColumn("feature_set", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# --- chunks and embeddings --------------------------------------------------------


@query(
    "e1_chunks",
    with_docs(
        """, c AS (SELECT doc_id, tokens, len(tokens) AS n,
                CAST(ceil(greatest(len(tokens) - 62, 0) / 32.0) AS BIGINT) AS last FROM docs)
        SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, CAST(i * 32 AS INTEGER) AS chunk_start,
               len(tokens[i * 32 + 1 : i * 32 + 62]) AS n_tokens,
               md5(array_to_string(tokens[i * 32 + 1 : i * 32 + 62], ' ')) AS digest
        FROM (SELECT *, unnest(range(0, last + 1)) AS i FROM c)"""
    ),
)
def e1(spark, d):
    out = oe.chunk_rows(documents(spark, d), max_length=64, stride=32)
    return out.select(
        "doc_id", "chunk_no", "chunk_start",
        F.size("chunk").cast("long").alias("n_tokens"),
        F.md5(F.array_join("chunk", " ")).alias("digest"),
    )


@query("e2_embedded_documents")
def e2(spark, d):
    out = oe.embed_documents(documents(spark, d).select("doc_id", "tokens"), dims=32)
    return out.select("doc_id", "n_chunks", "embedding")


@query(
    "e3_pooled_vectors",
    f"""SELECT doc_id, CAST(p - 1 AS INTEGER) AS position, count(*) AS n_chunks,
        {sql_r6('CAST(avg(x) AS FLOAT)')} AS value
        FROM (SELECT vec_id % 60 AS doc_id, unnest(embedding)::DOUBLE AS x,
              generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY 1, 2""",
)
def e3(spark, d):
    chunks = table(spark, d, "embeddings").select(
        (F.col("vec_id") % 60).alias("doc_id"), "embedding"
    )
    pooled = oe.pool_documents(chunks)
    return pooled.select(
        "doc_id", "n_chunks", F.posexplode("embedding").alias("position", "value")
    ).withColumn("value", r6(F.col("value")))


@query(
    "e4_reduced_vectors",
    """SELECT count(*) AS n_rows, CAST(8 AS BIGINT) AS n_components, true AS centered FROM embeddings""",
)
def e4(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    model = oe.fit_reduction(rows, 8)
    reduced = oe.apply_reduction(rows, model).select(
        "vec_id", vector_to_array("features").alias("x")
    )
    first = F.col("x")[0]
    return reduced.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.size("x")).cast("long").alias("n_components"),
        (F.abs(F.avg(first)) < 1e-6).alias("centered"),
    )
