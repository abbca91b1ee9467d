"""Feature sets keyed by row id."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cohort as fc, text as ft
from ..functions.numeric import round_even
from .ranking import exact_quantile

# The structured columns, in order.
STRUCTURED_COLUMNS = [
    "age", "gender_male",
    "insurance_medicare", "insurance_medicaid", "insurance_other",
    "admtype_emergency", "admtype_elective", "admtype_urgent",
    "log_los", "num_prior_admissions", "days_since_last_admission", "prior_expire_flag",
]
STRUCTURED_NUMERIC = ["age", "log_los", "num_prior_admissions", "days_since_last_admission"]
TEXT_STATISTICS = [
    "note_length_words", "num_negations", "num_section_headers",
    "avg_word_length", "type_token_ratio",
]


def fit_scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and sample deviation of each column."""
    return train.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"{c}__mean") for c in columns],
        *[F.stddev_samp(F.col(c).cast("double")).alias(f"{c}__sd") for c in columns],
    )


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores; a column without spread is left as it is."""
    joined = df.join(F.broadcast(scaler), F.lit(True))  # one row
    scaled = {
        c: F.when(
            F.col(f"{c}__sd") > 0,
            (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__sd"),
        ).otherwise(F.col(c).cast("double"))
        for c in columns
    }
    return joined.withColumns(scaled).drop(*scaler.columns)


def median_row(train: DataFrame, column: str) -> DataFrame:
    return exact_quantile(train, [], column).select(F.col("quantile").alias("_median"))


def impute_median(df: DataFrame, column: str, median: DataFrame) -> DataFrame:
    filled = F.coalesce(F.col(column).cast("double"), F.col("_median"))
    joined = df.join(F.broadcast(median), F.lit(True), "left")  # one row
    return joined.withColumn(column, filled).drop("_median")


def structured_columns(
    df: DataFrame,
    keep: list[str],
    age: str | None = "anchor_age",
    gender: str | None = "gender",
    insurance: str | None = "insurance",
    admission_type: str | None = "admission_type",
    los: str | None = "los_days",
    history: bool = True,
    median: DataFrame | None = None,
) -> DataFrame:
    """The 12 structured columns before scaling.  A column passed as None gives
    the reference level: age 65, flags 0, no history."""
    zero = F.lit(0)
    if age:
        median = median if median is not None else median_row(df, age)
        df = impute_median(df, age, median)
    ins = fc.insurance_flags(F.col(insurance)) if insurance else {}
    adm = fc.admission_type_flags(F.col(admission_type)) if admission_type else {}
    values: dict[str, Column] = {
        "age": F.col(age) if age else F.lit(65.0),
        "gender_male": fc.gender_flag(F.col(gender)) if gender else zero,
        **{f"insurance_{c.lower()}": zero for c in fc.INSURANCE_CATEGORIES},
        **{f"admtype_{c.lower()}": zero for c in fc.ADMISSION_TYPES},
        **ins,
        **adm,
        "log_los": fc.log_stay(F.col(los)) if los else F.lit(0.0),
        "num_prior_admissions": F.col("num_prior_admissions") if history else zero,
        "days_since_last_admission": F.col("days_since_last_admission") if history else F.lit(-1),
        "prior_expire_flag": F.col("prior_expire_flag") if history else zero,
    }
    return df.select(*keep, *[values[c].alias(c) for c in STRUCTURED_COLUMNS])


def structured_features(
    df: DataFrame, keep: list[str], train: DataFrame | None = None, **columns
) -> DataFrame:
    """Structured columns with the numeric ones scaled; median, mean and spread
    come from ``train`` (default: all rows)."""
    fit_on = df if train is None else train
    age = columns.get("age", "anchor_age")
    median = median_row(fit_on, age) if age else None
    scaler = fit_scaler(
        structured_columns(fit_on, [], median=median, **columns), STRUCTURED_NUMERIC
    )
    raw = structured_columns(df, keep, median=median, **columns)
    return apply_scaler(raw, scaler, STRUCTURED_NUMERIC)


def text_statistics(
    df: DataFrame,
    keep: list[str],
    text: str = "cleaned_text",
    original: str | None = "text",
) -> DataFrame:
    """The 5 text statistics before scaling."""
    words = F.col("_words")
    n = F.size(words)
    letters = F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + F.length(w))
    distinct = F.size(F.array_distinct(F.transform(words, F.lower)))
    some = n > 0
    base = df.withColumn("_words", ft.word_list(F.coalesce(F.col(text), F.lit(""))))
    return base.select(
        *keep,
        n.alias("note_length_words"),
        ft.negation_count(F.coalesce(F.col(text), F.lit(""))).alias("num_negations"),
        (ft.header_count(F.coalesce(F.col(original), F.lit(""))) if original else F.lit(0)).alias(
            "num_section_headers"
        ),
        F.when(some, round_even(letters / F.when(some, n), 3)).otherwise(0.0).alias(
            "avg_word_length"
        ),
        F.when(some, round_even(distinct / F.when(some, n), 4)).otherwise(0.0).alias(
            "type_token_ratio"
        ),
    )


def text_statistics_features(
    df: DataFrame, keep: list[str], train: DataFrame | None = None, **columns
) -> DataFrame:
    raw = text_statistics(df, keep, **columns)
    fit_on = raw if train is None else text_statistics(train, [], **columns)
    return apply_scaler(raw, fit_scaler(fit_on, TEXT_STATISTICS), TEXT_STATISTICS)


def request_row(
    df: DataFrame,
    keep: list[str],
    age: str | None = "age",
    gender: str | None = "gender",
    insurance: str | None = "insurance",
    los: str | None = "los_days",
) -> DataFrame:
    """Structured columns for a scoring request with partial inputs: age 65, stay
    5 days, emergency, no history; insurance by substring.  Unscaled: the model's
    own scaling stage does that."""
    null = F.lit(None)
    ins = F.lower(F.coalesce(F.col(insurance) if insurance else null.cast("string"), F.lit("")))
    medicare = ins.contains("medicare").cast("int")
    medicaid = ins.contains("medicaid").cast("int")
    days = F.coalesce((F.col(los) if los else null).cast("double"), F.lit(5.0))
    values = {
        "age": F.coalesce((F.col(age) if age else null).cast("double"), F.lit(65.0)),
        "gender_male": F.coalesce(
            F.upper(F.col(gender) if gender else null.cast("string")).startswith("M").cast("int"),
            F.lit(0),
        ),
        "insurance_medicare": medicare,
        "insurance_medicaid": medicaid,
        "insurance_other": ((medicare + medicaid) == 0).cast("int"),
        "admtype_emergency": F.lit(1),
        "admtype_elective": F.lit(0),
        "admtype_urgent": F.lit(0),
        "log_los": F.log1p(days),
        "num_prior_admissions": F.lit(0),
        "days_since_last_admission": F.lit(0),
        "prior_expire_flag": F.lit(0),
    }
    return df.select(*keep, *[values[c].alias(c) for c in STRUCTURED_COLUMNS])


# --- assembling -------------------------------------------------------------


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """One vector column; the names stay in its metadata."""
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="error").transform(df)


def vector_names(df: DataFrame, column: str = "features") -> list[str]:
    """Feature names from the vector's metadata, else f0, f1, ..."""
    attrs = df.schema[column].metadata.get("ml_attr", {})
    named = [a for group in attrs.get("attrs", {}).values() for a in group]
    if named:
        return [a.get("name", f"f{a['idx']}") for a in sorted(named, key=lambda a: a["idx"])]
    size = attrs.get("num_attrs")
    if size is None:
        size = len(df.select(column).first()[0])
    return [f"f{i}" for i in range(size)]


def name_vector(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Attach feature names to a vector column."""
    attrs = [{"idx": i, "name": n} for i, n in enumerate(names)]
    meta = {"ml_attr": {"attrs": {"numeric": attrs}, "num_attrs": len(names)}}
    return df.withMetadata(column, meta)


def combine_feature_sets(
    sets: dict[str, DataFrame | None],
    row_id: str = "doc_id",
    vector: str = "features",
    out: str = "features",
) -> DataFrame:
    """Side by side: each set is (row_id, vector); names become ``set__name``.
    A missing set is skipped, none at all is an error.  Alignment is a join on the
    row id; sets partitioned by it join without another shuffle."""
    present = {k: v for k, v in sets.items() if v is not None}
    if not present:
        raise ValueError("no feature sets to combine")
    joined, names = None, []
    for key, frame in present.items():
        if not isinstance(frame, DataFrame):
            raise TypeError(f"feature set {key!r} is not a DataFrame")
        names += [f"{key}__{n}" for n in vector_names(frame, vector)]
        part = frame.select(row_id, F.col(vector).alias(f"_{key}"))
        joined = part if joined is None else joined.join(part, row_id)
    merged = assemble(joined, [f"_{k}" for k in present], out).select(row_id, out)
    return name_vector(merged, out, names)


def align(left: DataFrame, right: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """Rows of ``right`` that belong to rows of ``left``, by id."""
    return left.join(right, row_id)
