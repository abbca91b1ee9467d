"""The operators as queries over the given tables, with SQL where it can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    bpe, conversations, lines, merkle, packing, permutation_index, quality, recompression, sharding, suffixes,
    superminhash, topk, wavelet,
)
from .positions import coded
from .structure_sql import MANIFEST_SQL, REPAIR_SQL, SHARD_SQL, SHARDS

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("op1_wavelet_shards")
def _wavelet(spark, d):
    found = wavelet.token_directory(_table(spark, d, "documents"), BYTE_BPE)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
often AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT l.doc_id, l.line, l.pos, o.k IS NOT NULL AND l.doc_id <> o.last AS gone
      FROM keyed l LEFT JOIN often o ON l.k = o.k)
GROUP BY doc_id
"""


@query("op2_line_dedup", LINE_SQL)
def _lines(spark, d):
    kept = lines.drop_repeated_lines(_table(spark, d, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op3_byte_bpe")
def _bpe(spark, d):
    coded = bpe.encode_texts(_table(spark, d, "documents"), MULTI_RANKS, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op4_cost_balanced_packing")
def _packing(spark, d):
    pieces = packing.pack(_table(spark, d, "documents"), BYTE_BPE)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op5_quality_trees")
def _quality(spark, d):
    docs = _table(spark, d, "documents")
    model = quality.train(docs, _table(spark, d, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op6_permutation_index")
def _permutations(spark, d):
    return permutation_index.search(_table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_superminhash")
def _near(spark, d):
    return superminhash.near_duplicates(_table(spark, d, "documents"), words=2)


INNER_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
  FROM whole q JOIN whole r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM scored
QUALIFY rank <= 10
"""


@query("op8_exact_topk", INNER_SQL)
def _topk(spark, d):
    return topk.search(_table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op9_recompression")
def _passages(spark, d):
    kept = recompression.remove_repeated_passages(_table(spark, d, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op10_suffix_names")
def _strings(spark, d):
    kept = suffixes.remove_repeated_strings(_table(spark, d, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_lr_repair", REPAIR_SQL)
def _conversations(spark, d):
    rows = _table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    found, turns = conversations.repair(conversations.damaged(rows))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = rows.select("conv_id", coded(F.col("conv_id")).alias("conv")).distinct()
    return (
        every.join(found.withColumn("conv", coded(F.col("conv_id"))).drop("conv_id"), "conv", "left")
        .join(conversations.digests(turns), "conv", "left")
        .select(
            "conv_id",
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )


@query("op12_rendezvous_shards", SHARD_SQL)
def _shards(spark, d):
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, d, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = sharding.assign_shards(rows, ["doc_id"], [1.0] * SHARDS, [1.0])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op13_merkle_manifest", MANIFEST_SQL)
def _manifest(spark, d):
    docs = _table(spark, d, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = merkle.leaf_hash(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields])
    proved = merkle.manifest(
        docs, merkle.leaf_hash(*[F.col(c) for c in fields]), "lang", "doc_id",
        {"doc_id": F.col("doc_id"), "changed": F.when(drawn, changed)},
    )
    folded = merkle.fold(F.coalesce("changed", "leaf"), F.col("proof"))
    return proved.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
