"""Per-group audit of scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.bands import DISPARITY_NAMES, disparity_flag, disparity_level
from ..functions.numeric import ratio, round_even
from .evaluate import confusion_counts, confusion_rates

GROUP_METRICS = ["accuracy", "precision", "recall", "f1", "fpr", "fnr", "selection_rate"]


def group_counts(
    scored: DataFrame, attributes: list[str], label: str = "y_true", predicted: str = "y_pred"
) -> DataFrame:
    """Confusion counts per (attribute, group), all attributes in one pass.

    Unknown attributes are skipped, rows without a group left out.  The sums are
    combined before the shuffle, so a dominant group costs nothing extra.
    """
    known = [a for a in attributes if a in scored.columns]
    if not known:
        raise ValueError(f"none of {attributes} is a column")
    pairs = F.array(
        *[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("group"))
          for a in known]
    )
    long = scored.select(label, predicted, F.explode(pairs).alias("p")).select(
        label, predicted, "p.attribute", "p.group"
    )
    return confusion_counts(
        long.where(F.col("group").isNotNull()), ["attribute", "group"], label, predicted
    )


def group_metrics(counts: DataFrame, digits: int | None = 4) -> DataFrame:
    value = lambda c: round_even(c, digits) if digits is not None else c
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    rates = confusion_rates(counts)
    return rates.select(
        "attribute",
        "group",
        n.alias("n_samples"),
        value(ratio(F.col("tp") + F.col("fn"), n)).alias("positive_rate"),
        *[value(F.col(m)).alias(m) for m in GROUP_METRICS],
    )


def disparities(counts: DataFrame, digits: int | None = 4) -> DataFrame:
    """Largest gaps between groups, from unrounded rates."""
    value = lambda c: round_even(c, digits) if digits is not None else c
    gap = lambda m: F.max(m) - F.min(m)
    return confusion_rates(counts).groupBy("attribute").agg(
        value(gap("selection_rate")).alias("demographic_parity_difference"),
        value(F.greatest(gap("recall"), gap("fpr"))).alias("equalized_odds_difference"),
        value(gap("fpr")).alias("fpr_difference"),
        value(gap("fnr")).alias("fnr_difference"),
    )


def disparity_rows(table: DataFrame) -> DataFrame:
    """Long form with level and flag."""
    cells = F.array(
        *[F.struct(F.lit(d).alias("metric"), F.col(d).alias("value")) for d in DISPARITY_NAMES]
    )
    return table.select("attribute", F.explode(cells).alias("c")).select(
        "attribute",
        "c.metric",
        "c.value",
        disparity_level(F.col("c.value")).alias("level"),
        disparity_flag(F.col("c.value")).alias("flagged"),
    )


def largest_disparity(table: DataFrame) -> DataFrame:
    values = [F.coalesce(F.col(d), F.lit(0.0)) for d in DISPARITY_NAMES]
    return table.select("attribute", F.greatest(*values).alias("largest"))


def fairness_audit(
    scored: DataFrame, attributes: list[str], label: str = "y_true", predicted: str = "y_pred"
) -> dict[str, DataFrame]:
    counts = group_counts(scored, attributes, label, predicted)
    gaps = disparities(counts)
    return {"groups": group_metrics(counts), "disparities": gaps, "summary": disparity_rows(gaps)}
