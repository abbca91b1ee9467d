"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep
the columns of ``documents``.  Stages are written as Parquet and read again, so a
lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm import lines, packing, quality, suffixes, superminhash
from cohortlens.llm.catalog import BYTE_BPE, query
from cohortlens.session import materialize, ship_package

#: Words whose ids a worker remembers while it packs: executors have grown by then.
PACK_WORDS = 200_000


def _changed(docs: DataFrame, operator) -> DataFrame:
    """``docs`` with the texts that ``operator`` leaves and n_chars counted again.  Columns
    that are no concern of it go through under other names, whatever they are called."""
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    changed = operator(docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in own.items()]))
    back = [F.col(own.get(c, c)).alias(c) for c in docs.columns]
    if "n_chars" in own:
        count = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
        back[docs.columns.index("n_chars")] = count
    return changed.select(*back)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality trees score below one half."""
    ship_package(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    good = quality.score(rows, model, "good").where(F.col("good") >= 0.5)
    return good.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that at least three documents have, but for one."""
    ship_package(spark)
    return _changed(docs, lines.drop_repeated_lines)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five words, 0.8)."""
    ship_package(spark)
    return superminhash.drop_near_duplicates(docs)


def drop_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop strings of 400 bytes and more that occur twice."""
    ship_package(spark)
    return _changed(docs, suffixes.remove_repeated_strings)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens."""
    ship_package(spark)
    return packing.pack(docs, BYTE_BPE, words=PACK_WORDS)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("minhash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_strings),
    ("packing", pack),
]

#: Model scores and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
