"""Expressions over stays: times, age bins, encoded attributes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import round_even

MICROS_PER_DAY = 86_400_000_000

# Age bins (0,39], (39,64], (64,120] and their labels, in order.
AGE_BINS = [(0, 39, "<40"), (39, 64, "40-65"), (64, 120, "65+")]

# One-hot categories, in column order.
INSURANCE_CATEGORIES = ["Medicare", "Medicaid", "Other"]
ADMISSION_TYPES = ["EMERGENCY", "ELECTIVE", "URGENT"]


def coerce_timestamp(value: Column) -> Column:
    """Parse a timestamp; anything unreadable is null, also under ANSI mode."""
    return F.try_to_timestamp(value.cast("string"))


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def whole_days_between(start: Column, end: Column) -> Column:
    """Floor of the gap in days (an overlap of one hour is day -1)."""
    micros = micros_between(start, end)
    day = F.lit(MICROS_PER_DAY)
    # An exact multiple divides exactly, so no rounding near a day boundary.
    return ((micros - F.pmod(micros, day)) / day).cast("long")


def length_of_stay(start: Column, end: Column) -> Column:
    """Days with 2 decimals, never negative; null when a time is missing."""
    days = micros_between(start, end) / float(MICROS_PER_DAY)
    return F.when(days.isNotNull(), round_even(F.greatest(days, F.lit(0.0)), 2))


def age_group(age: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high, label in reversed(AGE_BINS):
        out = F.when((age > low) & (age <= high), F.lit(label)).otherwise(out)
    return out


def one_hot(value: Column, category: str) -> Column:
    return F.coalesce((value == category).cast("int"), F.lit(0))


def insurance_flags(insurance: Column) -> dict[str, Column]:
    known = F.coalesce(insurance, F.lit("Other"))
    return {f"insurance_{c.lower()}": one_hot(known, c) for c in INSURANCE_CATEGORIES}


def admission_type_flags(admission_type: Column) -> dict[str, Column]:
    kind = F.upper(F.coalesce(admission_type, F.lit("EMERGENCY")))
    kind = F.replace(kind, F.lit("EW EMER."), F.lit("EMERGENCY"))
    return {f"admtype_{c.lower()}": one_hot(kind, c) for c in ADMISSION_TYPES}


def gender_flag(gender: Column) -> Column:
    return one_hot(F.upper(gender), "M")


def log_stay(los_days: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(los_days, F.lit(0.0)), F.lit(0.0)))
