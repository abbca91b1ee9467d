"""The given tables in the roles of the cohort, on both sides of the comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import ENGLISH_STOPWORDS, MEDICAL_STOPWORDS, tokenize
from ..operators.text import add_clean_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column: Column) -> Column:
    return F.round(column.cast("double"), 6) + F.lit(0.0)


def sql_r6(expression: str) -> str:
    return f"(round(CAST({expression} AS DOUBLE), 6) + 0)"


# --- stays, subjects, notes ---------------------------------------------------


def stays(spark: SparkSession, d: str) -> DataFrame:
    """Orders as stays; a stay lasts one day per line item."""
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("hadm_id")).agg(
        F.count(F.lit(1)).alias("n_items")
    )
    priority = F.col("o_orderpriority")
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_orderdate").alias("admittime"),
        F.when(priority == "1-URGENT", "Urgent")
        .when(priority == "2-HIGH", "EW EMER.")
        .when(priority == "3-MEDIUM", "Elective")
        .when(priority == "5-LOW", "OBSERVATION")
        .alias("admission_type"),
        (F.col("o_orderstatus") == "F").cast("int").alias("hospital_expire_flag"),
    )
    n = F.coalesce("n_items", F.lit(0)).cast("int")
    out = orders.join(items, "hadm_id", "left").withColumn("_n", n)
    return out.withColumn("dischtime", F.expr("admittime + make_dt_interval(_n)")).select(
        "subject_id", "hadm_id", "admittime", "dischtime", "admission_type",
        "hospital_expire_flag",
    )


def subjects(spark: SparkSession, d: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("subject_id"),
        F.when(F.col("c_nationkey") % 3 == 0, "M").when(F.col("c_nationkey") % 3 == 1, "f")
        .alias("gender"),
        F.when(F.col("c_custkey") % 11 != 0, (F.col("c_custkey") % 123)).cast("int")
        .alias("anchor_age"),
        F.when(segment == "AUTOMOBILE", "Medicare")
        .when(segment == "BUILDING", "Medicaid")
        .when(segment == "FURNITURE", "Other")
        .when(segment == "HOUSEHOLD", "HOUSEHOLD")
        .alias("insurance"),
    )


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as notes of the order with the same number."""
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderdate").alias("ordered"),
    )
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return docs.join(orders, "doc_id").select(
        F.col("doc_id").alias("note_id"),
        "subject_id",
        F.col("doc_id").alias("hadm_id"),
        F.when(F.col("lang") == "en", "Discharge summary").otherwise("Radiology").alias(
            "note_type"
        ),
        F.when(F.col("doc_id") % 7 == 0, "unknown")
        .otherwise(F.date_format("ordered", "yyyy-MM-dd HH:mm:ss"))
        .alias("charttime"),
        "text",
    )


STAYS = """
items AS (SELECT l_orderkey AS hadm_id, count(*) AS n_items FROM lineitem GROUP BY l_orderkey),
stays AS (
  SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate AS admittime,
         o_orderdate + to_days(CAST(coalesce(n_items, 0) AS INTEGER)) AS dischtime,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'EW EMER.'
           WHEN '3-MEDIUM' THEN 'Elective' WHEN '5-LOW' THEN 'OBSERVATION' END AS admission_type,
         CAST(o_orderstatus = 'F' AS INTEGER) AS hospital_expire_flag
  FROM orders LEFT JOIN items ON o_orderkey = hadm_id),
subjects AS (
  SELECT c_custkey AS subject_id,
         CASE c_nationkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'f' END AS gender,
         CAST(CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 123 END AS INTEGER) AS anchor_age,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Medicare' WHEN 'BUILDING' THEN 'Medicaid'
           WHEN 'FURNITURE' THEN 'Other' WHEN 'HOUSEHOLD' THEN 'HOUSEHOLD' END AS insurance
  FROM customer),
linked AS (
  SELECT *, lead(admittime) OVER w AS next_start, lag(dischtime) OVER w AS prev_end,
         lag(hospital_expire_flag) OVER w AS prev_flag,
         row_number() OVER w AS seq,
         count(*) OVER (PARTITION BY subject_id) AS n_stays
  FROM stays WINDOW w AS (PARTITION BY subject_id ORDER BY admittime, hadm_id)),
labelled AS (
  SELECT subject_id, hadm_id, admittime, dischtime, admission_type, hospital_expire_flag,
         CASE WHEN hospital_expire_flag = 1 OR seq = n_stays THEN -1
              WHEN floor(date_diff('microsecond', dischtime, next_start) / 86400000000.0) <= 30
              THEN 1 ELSE 0 END AS readmission_30day,
         CAST(seq - 1 AS BIGINT) AS num_prior_admissions,
         CASE WHEN seq = 1 THEN -1 ELSE greatest(CAST(floor(
           date_diff('microsecond', prev_end, admittime) / 86400000000.0) AS BIGINT), 0) END
           AS days_since_last_admission,
         CASE WHEN seq = 1 THEN 0 ELSE prev_flag END AS prior_expire_flag
  FROM linked),
notes AS (
  SELECT doc_id AS note_id, o_custkey AS subject_id, doc_id AS hadm_id,
         CASE WHEN lang = 'en' THEN 'Discharge summary' ELSE 'Radiology' END AS note_type,
         CASE WHEN doc_id % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END
           AS charttime, text
  FROM documents JOIN orders ON doc_id = o_orderkey),
cohort AS (
  SELECT n.note_id, n.subject_id, n.hadm_id, n.text, l.admittime, l.dischtime,
         l.admission_type, l.hospital_expire_flag, l.readmission_30day,
         l.num_prior_admissions, l.days_since_last_admission, l.prior_expire_flag,
         s.gender, s.anchor_age, s.insurance,
         round_even(greatest(date_diff('microsecond', l.admittime, l.dischtime)
           / 86400000000.0, 0), 2) AS los_days,
         CASE WHEN anchor_age > 0 AND anchor_age <= 39 THEN '<40'
              WHEN anchor_age > 39 AND anchor_age <= 64 THEN '40-65'
              WHEN anchor_age > 64 AND anchor_age <= 120 THEN '65+' END AS age_group
  FROM notes n JOIN labelled l ON n.subject_id = l.subject_id AND n.hadm_id = l.hadm_id
  LEFT JOIN subjects s ON n.subject_id = s.subject_id)
"""


def with_stays(body: str) -> str:
    return f"WITH {STAYS} {body}"


# --- scored rows ----------------------------------------------------------------


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with a score made from their number and label."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    rows = table(spark, d, "labels").join(docs, "doc_id")
    place = F.pmod(F.col("doc_id") * 7919 + 300 * F.col("quality"), F.lit(1000))
    return rows.select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").alias("y_true"),
        (place / 1000).alias("y_prob"),
        (place >= 500).cast("int").alias("y_pred"),
        "lang",
        F.when(F.col("source") != "src3", F.col("source")).alias("source"),
        (F.col("doc_id") % 3).cast("int").alias("fold"),
    )


SCORED = """
scored AS (
  SELECT l.doc_id AS row_id, quality AS y_true,
         ((l.doc_id * 7919 + 300 * quality) % 1000) / 1000.0::DOUBLE AS y_prob,
         CAST((l.doc_id * 7919 + 300 * quality) % 1000 >= 500 AS INTEGER) AS y_pred,
         lang, CASE WHEN source <> 'src3' THEN source END AS source,
         CAST(l.doc_id % 3 AS INTEGER) AS fold
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
"""


def with_scored(body: str) -> str:
    return f"WITH {SCORED} {body}"


def sales(spark: SparkSession, d: str) -> DataFrame:
    """Line items as a large ranked table with three keys."""
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("grp"),
        F.col("l_extendedprice").alias("value"),
        (F.col("l_linestatus") == "F").cast("int").alias("outcome"),
    )


# --- text -------------------------------------------------------------------------


def sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


WS = r"[\t\n\x0B\f\r\x{0085}\p{Z}]"


def sql_clean(column: str) -> str:
    """The cleaning steps with Unicode classes spelled out."""
    steps = [
        (r"_{2,}", " "),
        (rf"\[{WS}*[xX]?{WS}*\]", " "),
        (r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", " "),
        (r"\b\d{4}-\d{2}-\d{2}\b", " "),
        (rf"\(?\d{{3}}\)?({WS}|-)\d{{3}}({WS}|-)\d{{4}}", " "),
        (rf"(?i)\b\d+\.?\d*{WS}*(?:mg|ml|mcg|mmol|meq|mm|cm|kg|lb|units?)\b", " "),
    ]
    out = f"coalesce({column}, '')"
    for pattern, to in steps:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    out = f"lower({out})"
    out = f"regexp_replace({out}, '[ \\t]+', ' ', 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    edge = r"[\t\n\x0B\f\r\x{0085}\p{Z}\x{1c}-\x{1f}]+"
    return f"regexp_replace({out}, '^{edge}|{edge}$', '', 'g')"


def sql_words(column: str) -> str:
    edge = r"[\t\n\x0B\f\r\x{0085}\p{Z}\x{1c}-\x{1f}]+"
    return f"list_filter(regexp_split_to_array({column}, '{edge}'), lambda w: w <> '')"


def sql_tokens(column: str) -> str:
    stop = sql_list(sorted(set(ENGLISH_STOPWORDS) | set(MEDICAL_STOPWORDS)))
    bare = r"regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')"
    return (
        f"list_filter(list_transform(regexp_split_to_array(lower({column}), '{WS}+'), "
        f"lambda w: {bare}), "
        rf"lambda w: regexp_full_match(w, '\p{{L}}{{2,}}') AND w NOT IN ({stop}))"
    )


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input has fewer splits than cores (one small file);
    a table of many splits is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def raw_documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "lang", "source", "text"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, lang, source, text, cleaned_text, tokens."""
    docs = raw_documents(spark, d)
    cleaned = add_clean_text(docs)
    return cleaned.withColumn("tokens", tokenize(F.col("cleaned_text")))


def sql_documents() -> str:
    return f"""
cleaned AS (SELECT doc_id, lang, source, text, {sql_clean('text')} AS cleaned_text FROM documents),
docs AS (SELECT *, {sql_tokens('cleaned_text')} AS tokens FROM cleaned)
"""


def with_docs(body: str) -> str:
    return f"WITH {sql_documents()} {body}"
