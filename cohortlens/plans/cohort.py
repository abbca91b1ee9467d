"""Files or tables to the analysis frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.cohort import join_cohort, return_label, sample_notes
from ..sources.tables import load_admissions, load_notes, load_patients


def build_cohort(
    notes: DataFrame,
    admissions: DataFrame,
    patients: DataFrame,
    sample_size: int | None = None,
    seed: int = 42,
    window_days: int = 30,
) -> DataFrame:
    """Label (unless present), sample, join, derive: one lazy plan."""
    labelled = return_label(admissions, window_days)
    return join_cohort(sample_notes(notes, sample_size, seed), labelled, patients)


def load_cohort(
    spark: SparkSession,
    notes_path: str,
    admissions_path: str,
    patients_path: str,
    sample_size: int | None = None,
    seed: int = 42,
) -> DataFrame:
    return build_cohort(
        load_notes(spark, notes_path),
        load_admissions(spark, admissions_path),
        load_patients(spark, patients_path),
        sample_size,
        seed,
    )
