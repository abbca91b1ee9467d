"""Sources, scalars, joins, aggregates and windows over stays and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import cohort as fc, text as ft
from ..operators import cohort as oc, ranking as rk
from ..plans.cohort import build_cohort
from ..session import scratch_path
from ..sources import tables as src
from .common import (
    notes, r6, raw_documents, sales, sql_r6, sql_words, stays, subjects, table, with_stays,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def _csv(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.options(
        header=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return path


def cohort_frame(spark, d) -> DataFrame:
    return build_cohort(notes(spark, d), stays(spark, d), subjects(spark, d))


# --- sources ------------------------------------------------------------------


@query(
    "s1_load_notes",
    with_stays(
        """SELECT note_id, subject_id, hadm_id, length(text) AS n_chars, md5(text) AS digest,
           charttime FROM notes WHERE note_type = 'Discharge summary'"""
    ),
)
def s1(spark, d):
    out = src.load_notes(spark, _csv(notes(spark, d), "notes"))
    return out.select(
        "note_id", "subject_id", "hadm_id",
        F.length("text").cast("long").alias("n_chars"),
        F.md5("text").alias("digest"),
        F.date_format("charttime", "yyyy-MM-dd HH:mm:ss").alias("charttime"),
    )


@query(
    "s2_load_admissions",
    with_stays(
        """SELECT subject_id, hadm_id, strftime(admittime, '%Y-%m-%d %H:%M:%S') AS admittime,
           CASE WHEN hadm_id % 5 <> 0 THEN strftime(dischtime, '%Y-%m-%d %H:%M:%S') END
             AS dischtime, admission_type, hospital_expire_flag FROM stays"""
    ),
)
def s2(spark, d):
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    raw = stays(spark, d).withColumns(
        {
            "admittime": shown("admittime"),
            "dischtime": F.when(F.col("hadm_id") % 5 == 0, "not a time").otherwise(
                shown("dischtime")
            ),
        }
    )
    out = src.load_admissions(spark, _csv(raw, "admissions"))
    return out.withColumns({c: shown(c) for c in ("admittime", "dischtime")})


@query("s3_load_patients", with_stays("SELECT * FROM subjects"))
def s3(spark, d):
    return src.load_patients(spark, _csv(subjects(spark, d), "patients"))


@query(
    "s4_cohort",
    with_stays(
        f"""SELECT note_id, subject_id, hadm_id, readmission_30day, {sql_r6('los_days')} AS los_days,
            anchor_age, age_group, gender, insurance FROM cohort"""
    ),
)
def s4(spark, d):
    return cohort_frame(spark, d).select(
        "note_id", "subject_id", "hadm_id", "readmission_30day",
        r6(F.col("los_days")).alias("los_days"), "anchor_age", "age_group", "gender", "insurance",
    )


# --- scalars ------------------------------------------------------------------


@query(
    "p1_required_columns",
    "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
)
def p1(spark, d):
    docs = table(spark, d, "documents")
    oc.require_columns(docs, ["doc_id", "text", "lang"], "documents")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p2_document_type",
    "SELECT doc_id, source FROM documents WHERE lang = 'en'",
)
def p2(spark, d):
    return oc.keep_document_type(table(spark, d, "documents"), "en", "lang").select(
        "doc_id", "source"
    )


@query(
    "p3_coerce_timestamp",
    with_stays(
        """SELECT note_id, charttime, charttime IS NULL AS unreadable FROM notes"""
    ),
)
def p3(spark, d):
    time = fc.coerce_timestamp(F.col("charttime"))
    return notes(spark, d).select(
        "note_id",
        F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("charttime"),
        time.isNull().alias("unreadable"),
    )


@query(
    "p4_eligible",
    with_stays("SELECT hadm_id, readmission_30day FROM labelled WHERE readmission_30day >= 0"),
)
def p4(spark, d):
    return oc.keep_eligible(oc.return_label(stays(spark, d))).select("hadm_id", "readmission_30day")


_ODD_STAY = "(o_orderkey * 7919) % 1000003 - 100000"


@query(
    "p5_length_of_stay",
    f"""SELECT o_orderkey AS hadm_id,
        {sql_r6(f"round_even(greatest(date_diff('microsecond', o_orderdate, o_orderdate + to_seconds({_ODD_STAY})) / 86400000000.0::DOUBLE, 0), 2)")}
        AS los_days FROM orders""",
)
def p5(spark, d):
    end = F.expr(
        f"o_orderdate + make_dt_interval(0, 0, 0, CAST({_ODD_STAY} AS DECIMAL(18,6)))"
    )
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("hadm_id"),
        r6(fc.length_of_stay(F.col("o_orderdate"), end)).alias("los_days"),
    )


@query(
    "p6_age_group",
    """SELECT c_custkey AS subject_id, CAST(c_custkey % 123 AS INTEGER) AS age,
       CASE WHEN c_custkey % 123 BETWEEN 1 AND 39 THEN '<40'
            WHEN c_custkey % 123 BETWEEN 40 AND 64 THEN '40-65'
            WHEN c_custkey % 123 BETWEEN 65 AND 120 THEN '65+' END AS age_group FROM customer""",
)
def p6(spark, d):
    age = (F.col("c_custkey") % 123).cast("int")
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("subject_id"), age.alias("age"),
        fc.age_group(age).alias("age_group"),
    )


@query(
    "p8_insurance_flags",
    with_stays(
        """SELECT subject_id, CAST(coalesce(insurance, 'Other') = 'Medicare' AS INTEGER) AS insurance_medicare,
           CAST(coalesce(insurance, 'Other') = 'Medicaid' AS INTEGER) AS insurance_medicaid,
           CAST(coalesce(insurance, 'Other') = 'Other' AS INTEGER) AS insurance_other FROM subjects"""
    ),
)
def p8(spark, d):
    flags = fc.insurance_flags(F.col("insurance"))
    return subjects(spark, d).select("subject_id", *[c.alias(k) for k, c in flags.items()])


@query(
    "p9_admission_type_flags",
    with_stays(
        """SELECT hadm_id, CAST(k = 'EMERGENCY' AS INTEGER) AS admtype_emergency,
           CAST(k = 'ELECTIVE' AS INTEGER) AS admtype_elective,
           CAST(k = 'URGENT' AS INTEGER) AS admtype_urgent
           FROM (SELECT hadm_id, replace(upper(coalesce(admission_type, 'EMERGENCY')),
             'EW EMER.', 'EMERGENCY') AS k FROM stays)"""
    ),
)
def p9(spark, d):
    flags = fc.admission_type_flags(F.col("admission_type"))
    return stays(spark, d).select("hadm_id", *[c.alias(k) for k, c in flags.items()])


@query(
    "p10_gender_flag",
    with_stays(
        "SELECT subject_id, coalesce(CAST(upper(gender) = 'M' AS INTEGER), 0) AS gender_male FROM subjects"
    ),
)
def p10(spark, d):
    return subjects(spark, d).select(
        "subject_id", fc.gender_flag(F.col("gender")).alias("gender_male")
    )


@query(
    "p11_log_stay",
    f"""SELECT o_orderkey AS hadm_id, {sql_r6(
        "ln(1 + greatest(coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1000 - 100 END, 0), 0))"
    )} AS log_los FROM orders""",
)
def p11(spark, d):
    odd = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 1000 - 100)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("hadm_id"), r6(fc.log_stay(odd)).alias("log_los")
    )


@query(
    "p12_word_count",
    f"SELECT doc_id, CAST(len({sql_words('text')}) AS BIGINT) AS n_words FROM documents",
)
def p12(spark, d):
    return raw_documents(spark, d).select(
        "doc_id", ft.word_count(F.col("text")).cast("long").alias("n_words")
    )


# --- joins --------------------------------------------------------------------


@query(
    "j1_notes_stays",
    with_stays(
        """SELECT n.note_id, n.subject_id, n.hadm_id, s.admission_type
           FROM notes n JOIN stays s ON n.subject_id = s.subject_id AND n.hadm_id = s.hadm_id"""
    ),
)
def j1(spark, d):
    return notes(spark, d).join(stays(spark, d), ["subject_id", "hadm_id"]).select(
        "note_id", "subject_id", "hadm_id", "admission_type"
    )


@query(
    "j2_stays_subjects",
    with_stays(
        """SELECT t.hadm_id, t.subject_id, s.gender, s.anchor_age FROM stays t
           LEFT JOIN (SELECT * FROM subjects WHERE subject_id % 10 <> 3) s
           ON t.subject_id = s.subject_id"""
    ),
)
def j2(spark, d):
    known = subjects(spark, d).where(F.col("subject_id") % 10 != 3)
    return stays(spark, d).join(known, "subject_id", "left").select(
        "hadm_id", "subject_id", "gender", "anchor_age"
    )


# --- aggregates -----------------------------------------------------------------


@query(
    "a1_cohort_summary",
    with_stays(
        f"""SELECT count(*) AS total_notes, count(DISTINCT subject_id) AS unique_patients,
           count(DISTINCT hadm_id) AS unique_admissions,
           {sql_r6("round_even(avg(CASE WHEN readmission_30day >= 0 THEN readmission_30day END)::DOUBLE * 100, 2)")}
             AS readmission_rate_pct,
           {sql_r6(f"round_even(avg(len({sql_words('text')}))::DOUBLE, 1)")} AS avg_note_length_words
           FROM cohort"""
    ),
)
def a1(spark, d):
    out = oc.cohort_summary(cohort_frame(spark, d))
    return out.select(
        "total_notes", "unique_patients", "unique_admissions",
        r6(F.col("readmission_rate_pct")).alias("readmission_rate_pct"),
        r6(F.col("avg_note_length_words")).alias("avg_note_length_words"),
    )


@query(
    "a2_value_counts",
    with_stays(
        """SELECT 'gender' AS attribute, gender AS value, count(*) AS n FROM cohort
           WHERE gender IS NOT NULL GROUP BY gender
           UNION ALL SELECT 'age_group', age_group, count(*) FROM cohort
           WHERE age_group IS NOT NULL GROUP BY age_group
           UNION ALL SELECT 'insurance', insurance, count(*) FROM cohort
           WHERE insurance IS NOT NULL GROUP BY insurance"""
    ),
)
def a2(spark, d):
    return oc.value_counts(cohort_frame(spark, d), ["gender", "age_group", "insurance"])


@query(
    "a3_age_summary",
    with_stays(
        f"""SELECT {sql_r6('avg(anchor_age)')} AS mean, {sql_r6('median(anchor_age)')} AS median,
            min(anchor_age) AS min, max(anchor_age) AS max FROM subjects"""
    ),
)
def a3(spark, d):
    out = oc.numeric_summary(subjects(spark, d), "anchor_age")
    return out.select(
        r6(F.col("mean")).alias("mean"), r6(F.col("median")).alias("median"), "min", "max"
    )


@query(
    "a4_rate_by_age_group",
    with_stays(
        f"""SELECT c.position, c.age_group, {sql_r6('r.rate')} AS rate, coalesce(r.n, 0) AS n
        FROM (VALUES (0, '<40'), (1, '40-65'), (2, '65+')) c(position, age_group)
        LEFT JOIN (SELECT age_group, avg(readmission_30day) AS rate, count(*) AS n FROM cohort
                   WHERE readmission_30day >= 0 GROUP BY age_group) r ON c.age_group = r.age_group"""
    ),
)
def a4(spark, d):
    out = oc.rate_by_age_group(cohort_frame(spark, d))
    return out.withColumn("rate", r6(F.col("rate")))


@query(
    "a5_histogram",
    f"""WITH v AS (SELECT lang, CAST(len({sql_words('text')}) AS DOUBLE) AS x FROM documents),
    lim AS (SELECT lang, min(x) AS lo, max(x) AS hi FROM v GROUP BY lang)
    SELECT lang, CAST(least(floor((x - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin,
           count(*) AS n FROM v JOIN lim USING (lang) GROUP BY 1, 2""",
)
def a5(spark, d):
    words = raw_documents(spark, d).select("lang", ft.word_count(F.col("text")).alias("n_words"))
    return oc.histogram(words, "n_words", 20, ["lang"]).select("lang", "bin", "n")


@query(
    "a5_medians",
    f"""SELECT lang, {sql_r6(f"median(len({sql_words('text')}))")} AS median
        FROM documents GROUP BY lang""",
)
def a5m(spark, d):
    words = raw_documents(spark, d).select("lang", ft.word_count(F.col("text")).alias("n_words"))
    return oc.medians(words, "n_words", ["lang"]).select("lang", r6(F.col("median")).alias("median"))


# --- windows --------------------------------------------------------------------


@query(
    "w1_return_label",
    with_stays("SELECT subject_id, hadm_id, readmission_30day FROM labelled"),
)
def w1(spark, d):
    return oc.return_label(stays(spark, d)).select("subject_id", "hadm_id", "readmission_30day")


@query(
    "w2_prior_stays",
    with_stays("SELECT hadm_id, num_prior_admissions FROM labelled"),
)
def w2(spark, d):
    return oc.utilization(stays(spark, d)).select("hadm_id", "num_prior_admissions")


@query(
    "w3_days_since_last",
    with_stays("SELECT hadm_id, CAST(days_since_last_admission AS BIGINT) AS days_since_last_admission FROM labelled"),
)
def w3(spark, d):
    return oc.utilization(stays(spark, d)).select("hadm_id", "days_since_last_admission")


@query(
    "w4_prior_terminal",
    with_stays("SELECT hadm_id, prior_expire_flag FROM labelled"),
)
def w4(spark, d):
    return oc.utilization(stays(spark, d)).select("hadm_id", "prior_expire_flag")


@query(
    "w7_average_rank",
    f"""SELECT l_returnflag AS grp, l_extendedprice AS value, count(*) AS rows,
        {sql_r6('min(rk) + (count(*) - 1) / 2.0')} AS avg_rank
        FROM (SELECT l_returnflag, l_extendedprice,
              rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rk FROM lineitem)
        GROUP BY 1, 2""",
)
def w7(spark, d):
    out = rk.average_ranks(sales(spark, d), ["grp"], "value")
    return out.withColumn("avg_rank", r6(F.col("avg_rank")))


@query(
    "w8_cumulative_counts",
    """SELECT grp, value, CAST(sum(sum(outcome)) OVER w AS BIGINT) AS tp,
       CAST(sum(sum(1 - outcome)) OVER w AS BIGINT) AS fp
       FROM (SELECT l_returnflag AS grp, l_extendedprice AS value,
             CAST(l_linestatus = 'F' AS INTEGER) AS outcome FROM lineitem)
       GROUP BY grp, value WINDOW w AS (PARTITION BY grp ORDER BY value DESC)""",
)
def w8(spark, d):
    t = rk.label_totals(sales(spark, d), ["grp"], "value", "outcome")
    return t.select(
        "grp",
        F.col("score").alias("value"),
        (F.col("total_pos") - F.col("cum_pos") + F.col("pos")).alias("tp"),
        (F.col("total_neg") - F.col("cum_neg") + F.col("neg")).alias("fp"),
    )


# --- sampling and splits --------------------------------------------------------


@query(
    "k1_exact_sample",
    """SELECT least(777, count(*)) AS n, least(777, count(*)) AS n_distinct, true AS stable
       FROM orders""",
)
def k1(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    picked = rk.sample_exact(orders, ["o_orderkey"], 777, 42)
    again = rk.sample_exact(orders, ["o_orderkey"], 777, 42).select(
        F.col("o_orderkey").alias("again")
    )
    both = picked.join(again, F.col("o_orderkey") == F.col("again"), "full")
    return both.agg(
        F.count("o_orderkey").alias("n"),
        F.count_distinct("o_orderkey").alias("n_distinct"),
        F.bool_and(F.col("o_orderkey").isNotNull() & F.col("again").isNotNull()).alias("stable"),
    )


@query(
    "k2_ordered_stays",
    with_stays("SELECT subject_id, hadm_id, seq FROM linked"),
)
def k2(spark, d):
    from ..operators.sequence import neighbours

    linked = neighbours(stays(spark, d), "subject_id", ["admittime", "hadm_id"], ["admittime"])
    return linked.select("subject_id", "hadm_id", "seq")


_SPLIT_SQL = with_stays(
    """, sizes AS (SELECT readmission_30day AS label, count(*) AS n FROM labelled
         WHERE readmission_30day >= 0 GROUP BY 1),
    q1 AS (SELECT *, ceil(0.2 * sum(n) OVER ())::BIGINT AS take, sum(n) OVER () AS total FROM sizes),
    f1 AS (SELECT *, floor(n * take / total::DOUBLE) AS base,
           n * take / total::DOUBLE - floor(n * take / total::DOUBLE) AS rest FROM q1),
    t1 AS (SELECT label, n, (base + CAST(row_number() OVER (ORDER BY rest DESC, label)
           <= take - sum(base) OVER () AS INTEGER))::BIGINT AS n_test FROM f1),
    q2 AS (SELECT *, n - n_test AS pool, ceil(0.125 * sum(n - n_test) OVER ())::BIGINT AS take,
           sum(n - n_test) OVER () AS total FROM t1),
    f2 AS (SELECT *, floor(pool * take / total::DOUBLE) AS base,
           pool * take / total::DOUBLE - floor(pool * take / total::DOUBLE) AS rest FROM q2),
    t2 AS (SELECT label, n, n_test, (base + CAST(row_number() OVER (ORDER BY rest DESC, label)
           <= take - sum(base) OVER () AS INTEGER))::BIGINT AS n_val FROM f2)
    SELECT label, 'test' AS split, n_test AS n FROM t2
    UNION ALL SELECT label, 'val', n_val FROM t2
    UNION ALL SELECT label, 'train', n - n_test - n_val FROM t2"""
)


def _labelled(spark, d):
    return oc.keep_eligible(oc.return_label(stays(spark, d))).select(
        "hadm_id", F.col("readmission_30day").alias("label")
    )


@query("k8_stratified_split", _SPLIT_SQL)
def k8(spark, d):
    out = rk.stratified_split(_labelled(spark, d), "label", ["hadm_id"])
    return out.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k9_stratified_folds",
    with_stays(
        """SELECT readmission_30day AS label, CAST(f AS INTEGER) AS fold,
           (count(*) + 4 - f) // 5 AS n FROM labelled, range(5) r(f)
           WHERE readmission_30day >= 0 GROUP BY readmission_30day, f"""
    ),
)
def k9(spark, d):
    out = rk.stratified_folds(_labelled(spark, d), "label", ["hadm_id"], 5)
    return out.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))
