"""Readers for the three cohort tables and for the processed text.

CSV with quoted line breaks cannot be split, so a CSV file is read by one task:
land it once with ``land_parquet`` and read that from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.cohort import coerce_timestamp
from ..operators.cohort import keep_document_type, require_columns, sample_notes


def _schema(spec: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}
    fields = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


# Times are read as text and coerced: an unreadable one becomes null.
NOTES_SCHEMA = _schema(
    "note_id long, subject_id long, hadm_id long, note_type string, note_seq int,"
    " charttime string, storetime string, text string"
)
ADMISSIONS_SCHEMA = _schema(
    "subject_id long, hadm_id long, admittime string, dischtime string, edregtime string,"
    " edouttime string, admission_type string, admission_location string,"
    " discharge_location string, insurance string, language string, marital_status string,"
    " race string, hospital_expire_flag int, readmission_30day int"
)
PATIENTS_SCHEMA = _schema(
    "subject_id long, gender string, anchor_age int, anchor_year int,"
    " anchor_year_group string, dod string"
)
NOTES_REQUIRED = ["note_id", "subject_id", "hadm_id", "note_type", "text"]
NOTE_TIMES = ["charttime", "storetime"]
ADMISSION_TIMES = ["admittime", "dischtime", "edregtime", "edouttime"]
DOCUMENT_TYPE = "Discharge summary"


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Columns found in the header, typed by ``schema``; unknown ones stay text."""
    reader = spark.read.options(header=True, multiLine=True, escape='"', quote='"')
    # The header alone fixes the columns; nothing is inferred from the rows.
    names = spark.read.options(header=True, quote='"', escape='"').csv(path).columns
    known = {f.name: f for f in schema.fields}
    fields = [known.get(n, T.StructField(n, T.StringType())) for n in names]
    return reader.schema(T.StructType(fields)).csv(path)


def _coerce(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns(
        {c: coerce_timestamp(F.col(c)) for c in columns if c in df.columns}
    )


def load_notes(
    spark: SparkSession,
    path: str,
    sample_size: int | None = None,
    seed: int = 42,
    document_type: str = DOCUMENT_TYPE,
) -> DataFrame:
    """Notes of one type, optionally a seeded sample of exact size."""
    notes = _read_csv(spark, path, NOTES_SCHEMA)
    require_columns(notes, NOTES_REQUIRED, "notes")
    kept = keep_document_type(notes, document_type)
    return _coerce(sample_notes(kept, sample_size, seed), NOTE_TIMES)


def load_admissions(spark: SparkSession, path: str) -> DataFrame:
    return _coerce(_read_csv(spark, path, ADMISSIONS_SCHEMA), ADMISSION_TIMES)


def load_patients(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, PATIENTS_SCHEMA)


def land_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write once as Parquet (replacing what is there)."""
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by)
    return path


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
