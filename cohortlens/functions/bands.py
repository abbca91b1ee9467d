"""Threshold rules that turn a number into a label."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DISPARITY_NAMES = [
    "demographic_parity_difference",
    "equalized_odds_difference",
    "fpr_difference",
    "fnr_difference",
]


def predicted_label(probability: Column, threshold: float = 0.5) -> Column:
    return (probability >= threshold).cast("int")


def risk_band(probability: Column) -> Column:
    return (
        F.when(probability < 0.3, "low").when(probability < 0.6, "moderate").otherwise("high")
    )


def direction(contribution: Column) -> Column:
    return F.when(contribution > 0, "increases risk").otherwise("decreases risk")


def disparity_level(value: Column) -> Column:
    size = F.abs(value)
    return F.when(size < 0.05, "low").when(size < 0.1, "moderate").otherwise("high")


def disparity_flag(value: Column) -> Column:
    return F.abs(value) > 0.1


def rate_band(rate: Column) -> Column:
    return F.when(rate > 0.3, "danger").when(rate > 0.2, "warning").otherwise("success")
