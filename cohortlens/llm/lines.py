"""Lines that many documents repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import let
from ..session import materialize
from .common import SPACE, sized_broadcast, two_hashes, without

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), _UPPER, _UPPER.lower())


def drop_repeated_lines(docs: DataFrame, min_docs: int = 3, min_length: int = 20) -> DataFrame:
    """Drop lines whose key is in at least ``min_docs`` documents, except in the
    document with the largest doc_id that holds it.

    Returns the columns of ``docs`` with the kept ``text`` and n_lines, n_dropped;
    columns with these two names are replaced, any other name may occur.
    Keys under ``min_length`` code points are always kept.  A null or empty text is
    one empty line and becomes an empty text.  Rows with the same doc_id are one
    document to the count, and all of them keep a line when theirs is the largest id.  A null doc_id is below every other.  Repeated lines of one document
    count once; all of them go or stay.

    Only (hash, doc_id, row) leave the scan; the hash is 128 bits.  The count per
    hash combines within each task first, so a line that every document has costs
    one row per task, and hashes below the threshold are gone before the join.
    Lines are put back by position in the row's own array.
    """
    docs = without(docs, ("n_lines", "n_dropped"))
    texts = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.struct("doc_id", F.xxhash64("text").alias("t")).alias("id"),
        texts.alias("lines"),
    )
    keys = F.transform(
        "lines",
        # A line below the length has no key above it; the key is made once.
        lambda x: F.when(
            F.length(x) >= min_length,
            let(
                line_key(x),
                lambda k: F.when(
                    F.length(k) >= min_length, F.struct(*(h.alias(n) for h, n in zip(two_hashes(k), "gh")))
                ),
            ),
        ),
    )
    # One row per document and key.
    held = (
        rows.select("id", F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))).alias("k"))
        .select("id", "k.g", "k.h")
    )
    # Rows of one doc_id count once: where ids repeat, keys are made distinct per id.
    again = not docs.groupBy("doc_id").count().where(F.col("count") > 1).isEmpty()
    per_id = held.select("g", "h", "id.doc_id").distinct() if again else held.select("g", "h", "id.doc_id")
    often = (
        per_id.groupBy("g", "h")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        .where(F.col("n") >= min_docs)
        .drop("n")
    )
    # Written first: the join then has two plain sides, of which hot keys can be split.
    often = sized_broadcast(materialize(often, "often"))
    drops = (
        held.join(often, ["g", "h"])
        .where(~F.col("id.doc_id").eqNullSafe(F.col("last")))
        .groupBy("id")
        .agg(F.collect_set(F.struct("g", "h")).alias("gone"))
        .withColumnRenamed("id", "of")
    )
    gone = F.col("gone")
    marked = rows.join(drops.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("of")), "left")
    kept = F.when(gone.isNull(), F.col("lines")).otherwise(
        F.transform(
            F.filter(
                F.arrays_zip(F.col("lines").alias("line"), keys.alias("key")),
                lambda z: z["key"].isNull() | ~F.array_contains(gone, z["key"]),
            ),
            lambda z: z["line"],
        )
    )
    done = marked.select("row", "lines", kept.alias("kept"))
    n_lines = F.size("lines").cast("long")
    text = F.array_join("kept", "\n").alias("text")
    return done.select(
        *(text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns),
        n_lines.alias("n_lines"),
        (n_lines - F.size("kept")).alias("n_dropped"),
    )
