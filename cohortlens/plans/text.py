"""Raw text to tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as ft
from ..operators.text import add_clean_text, add_phrases, exploded, keep_length_between, lemmatize


def prepare_text(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    removed_sections: list[str] | None = None,
    min_length: int = 100,
    max_length: int = 50_000,
    extra_stopwords: list[str] | None = None,
    lemmas: DataFrame | None = None,
    use_phrases: bool = True,
    min_count: int = 10,
    threshold: float = 50.0,
    scoring: str = "default",
) -> DataFrame:
    """Remove sections, clean, drop documents outside the length bounds, tokenize,
    join phrases; adds cleaned_text, tokens and num_tokens."""
    cleaned = add_clean_text(df, text, removed_sections, "_cleaned")
    # Made a row of its own: the test of its length would clean each text once more.
    kept = [c for c in df.columns if c != "cleaned_text"]
    out = keep_length_between(exploded(cleaned, kept, F.array("_cleaned"), "cleaned_text"), min_length, max_length)
    out = out.withColumn("tokens", ft.tokenize(F.col("cleaned_text"), extra_stopwords))
    if lemmas is not None:
        out = lemmatize(out, lemmas, doc_id)
    if use_phrases:
        out = add_phrases(out, min_count, threshold, scoring, doc_id)
    return out.withColumn("num_tokens", F.size("tokens"))
