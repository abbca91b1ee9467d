"""Labels, joins and summaries of the cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import cohort as fc, text as ft
from ..functions.numeric import round_even
from .ranking import exact_quantile, join_groups, sample_exact
from .sequence import HOT_GROUP_ROWS, neighbours


def require_columns(df: DataFrame, required: list[str], what: str = "table") -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")


def return_label(
    stays: DataFrame,
    window_days: int = 30,
    subject: str = "subject_id",
    stay: str = "hadm_id",
    start: str = "admittime",
    end: str = "dischtime",
    terminal: str = "hospital_expire_flag",
    out: str = "readmission_30day",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """1 when the subject's next stay starts within ``window_days`` whole days of
    this one's end (overlaps count), 0 when later or undatable, -1 when the stay
    is terminal or the subject's last.  A table that has the label is returned
    unchanged.  Equal start times are ordered by stay id."""
    if out in stays.columns:
        return stays
    linked = neighbours(stays, subject, [start, stay], [start], hot_rows)
    gap = fc.whole_days_between(F.col(end), F.col("next")[start])
    label = (
        F.when(F.coalesce(F.col(terminal) == 1, F.lit(False)) | F.col("is_last"), -1)
        .when(gap <= window_days, 1)
        .otherwise(0)
    )
    return linked.withColumn(out, label).drop("seq", "prev", "next", "is_last")


def utilization(
    stays: DataFrame,
    subject: str = "subject_id",
    stay: str = "hadm_id",
    start: str = "admittime",
    end: str = "dischtime",
    terminal: str | None = "hospital_expire_flag",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Prior stays, days since the previous end (-1 on the first stay, never
    negative after) and the previous stay's terminal flag."""
    carry = [end] + ([terminal] if terminal else [])
    linked = neighbours(stays, subject, [start, stay], carry, hot_rows)
    first = F.col("seq") == 1
    gap = fc.whole_days_between(F.col("prev")[end], F.col(start))
    flag = F.col("prev")[terminal] if terminal else F.lit(0)
    return linked.select(
        *stays.columns,
        (F.col("seq") - 1).alias("num_prior_admissions"),
        F.when(first, F.lit(-1).cast("long"))
        .otherwise(F.greatest(gap, F.lit(0).cast("long")))
        .alias("days_since_last_admission"),
        F.when(first, 0).otherwise(F.coalesce(flag.cast("int"), F.lit(0))).alias(
            "prior_expire_flag"
        ),
    )


def keep_document_type(notes: DataFrame, value: str, column: str = "note_type") -> DataFrame:
    return notes.where(F.col(column) == value)


def keep_eligible(df: DataFrame, label: str = "readmission_30day") -> DataFrame:
    return df.where(F.col(label) >= 0)


def sample_notes(notes: DataFrame, n: int | None, seed: int = 42, id_col: str = "note_id"):
    return notes if not n else sample_exact(notes, [id_col], n, seed)


def join_cohort(
    notes: DataFrame,
    stays: DataFrame,
    subjects: DataFrame,
    subject: str = "subject_id",
    stay: str = "hadm_id",
    start: str = "admittime",
    end: str = "dischtime",
    age: str | None = "anchor_age",
) -> DataFrame:
    """Notes with their stay (inner) and subject (left), length of stay and age
    group.  Null keys match nothing; a subject that repeats is an error, as it would
    multiply its notes.  Join strategy and the splitting of a hot subject are left
    to adaptive execution."""
    rows = F.count(F.lit(1)).over(Window.partitionBy(subject))
    repeated = F.raise_error(F.concat(F.lit("repeated subject "), F.col(subject).cast("string")))
    known = subjects.where(F.col(subject).isNotNull()).withColumn("_rows", rows)
    known = known.withColumn(subject, F.when(F.col("_rows") == 1, F.col(subject)).otherwise(repeated)).drop("_rows")
    out = notes.join(stays, [subject, stay]).join(known, subject, "left")
    out = out.withColumn("los_days", fc.length_of_stay(F.col(start), F.col(end)))
    if age and age in out.columns:
        out = out.withColumn("age_group", fc.age_group(F.col(age)))
    return out


# --- summaries --------------------------------------------------------------


def cohort_summary(
    df: DataFrame,
    label: str = "readmission_30day",
    subject: str = "subject_id",
    stay: str = "hadm_id",
    text: str = "text",
) -> DataFrame:
    eligible = F.when(F.col(label) >= 0, F.col(label))
    words = F.when(F.col(text).isNotNull(), ft.word_count(F.col(text)))
    # Combined per stay first: the distinct counts then run on narrow rows.
    per_stay = df.select(subject, stay, eligible.alias("_y"), words.alias("_w")).groupBy(
        subject, stay
    ).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_y").alias("_ys"),
        F.count("_y").alias("_yn"),
        F.sum("_w").alias("_ws"),
        F.count("_w").alias("_wn"),
    )
    return per_stay.agg(
        F.sum("_n").alias("total_notes"),
        F.count_distinct(subject).alias("unique_patients"),
        F.count_distinct(stay).alias("unique_admissions"),
        round_even(F.try_divide(F.sum("_ys"), F.sum("_yn")) * 100, 2).alias(
            "readmission_rate_pct"
        ),
        round_even(F.try_divide(F.sum("_ws"), F.sum("_wn")), 1).alias("avg_note_length_words"),
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value"))
          for c in columns]
    )
    return (
        df.select(F.explode(pairs).alias("p"))
        .where(F.col("p.value").isNotNull())
        .groupBy("p.attribute", "p.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    stats = df.agg(
        F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max")
    )
    middle = exact_quantile(df, [], column).select(F.col("quantile").alias("median"))
    return stats.join(F.broadcast(middle), F.lit(True), "left").select("mean", "median", "min", "max")


def age_categories(df: DataFrame) -> DataFrame:
    rows = [(i, label) for i, (_, _, label) in enumerate(fc.AGE_BINS)]
    return df.sparkSession.createDataFrame(rows, "position int, age_group string")


def rate_by_age_group(
    df: DataFrame, label: str = "readmission_30day", group: str = "age_group"
) -> DataFrame:
    """Outcome rate of eligible rows for every age group, absent ones as null."""
    rates = keep_eligible(df, label).groupBy(F.col(group).alias("age_group")).agg(
        F.avg(label).alias("rate"), F.count(F.lit(1)).alias("n")
    )
    return age_categories(df).join(rates, "age_group", "left").select(
        "position", "age_group", "rate", F.coalesce("n", F.lit(0)).alias("n")
    )


def histogram(df: DataFrame, column: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts in ``bins`` equal bins from the minimum to the maximum, per group
    of ``by``; the maximum falls in the last bin; one lone value spans +-0.5."""
    by = by or []
    value = F.col(column).cast("double")
    data = df.where(F.col(column).isNotNull()).select(*by, value.alias("_v"))
    limits = data.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    lone = F.col("_lo") == F.col("_hi")
    limits = limits.select(
        *by,
        F.when(lone, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(lone, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    joined = join_groups(data, F.broadcast(limits), by)  # one row per group
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_no = F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1))
    # Bins are counted before their borders are attached.
    counted = joined.groupBy(*by, bin_no.cast("int").alias("bin"), "_lo", "_hi").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.select(
        *by,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        "n",
    )


def medians(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return exact_quantile(df, by or [], column).withColumnRenamed("quantile", "median")
