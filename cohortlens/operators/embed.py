"""Document vectors: chunks, a pluggable encoder, pooling, reduction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

# Window of the encoder and the step between windows.
MAX_LENGTH = 512
STRIDE = 256
#: Chunks whose token vectors are laid out together: some tens of MB.
CHUNKS_AT_ONCE = 256


def chunk_rows(
    df: DataFrame,
    tokens: str = "tokens",
    doc_id: str = "doc_id",
    max_length: int = MAX_LENGTH,
    stride: int = STRIDE,
) -> DataFrame:
    """(doc_id, chunk_no, chunk): windows of ``max_length - 2`` tokens, each
    starting ``stride`` after the one before, until one reaches the end."""
    usable = max_length - 2
    if not 0 < stride <= usable:
        raise ValueError("stride must be in 1..max_length-2, or tokens would be skipped")
    over = F.greatest(F.size(tokens) - usable, F.lit(0))
    last = (F.ceil(over / stride) * stride).cast("int")
    starts = F.sequence(F.lit(0), last, F.lit(stride))
    return df.select(
        doc_id, tokens, F.posexplode_outer(starts).alias("chunk_no", "chunk_start")
    ).select(
        doc_id,
        "chunk_no",
        "chunk_start",
        F.slice(tokens, F.col("chunk_start") + 1, usable).alias("chunk"),
    )


def hashed_encoder(dims: int = 64, seed: int = 42, pooling: str = "mean") -> Callable:
    """Deterministic stand-in encoder: every token is a fixed +-1 vector drawn from
    its hash; a chunk is the mean of its tokens' vectors, or its first token's."""
    from hashlib import blake2b

    def vector(token: str) -> np.ndarray:
        raw = b""
        while len(raw) * 8 < dims:
            raw += blake2b(f"{seed}:{len(raw)}:{token}".encode()).digest()
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8))[:dims]
        return bits.astype(np.float32) * 2 - 1

    def encode(chunks: pd.Series) -> list[np.ndarray]:
        used = [c[:1] if pooling == "cls" else c for c in chunks]
        sizes = np.array([len(c) for c in used], dtype=np.int64)
        out = np.zeros((len(used), dims), dtype=np.float32)
        if not sizes.sum():
            return list(out)
        places, tokens = pd.factorize(np.concatenate([np.asarray(c, dtype=object) for c in used]))
        vectors = np.stack([vector(t) for t in tokens])
        ends = np.cumsum(sizes)
        some = np.flatnonzero(sizes)
        for at in np.split(some, range(CHUNKS_AT_ONCE, len(some), CHUNKS_AT_ONCE)):
            low, high = ends[at[0]] - sizes[at[0]], ends[at[-1]]
            sums = np.add.reduceat(vectors[places[low:high]], ends[at] - sizes[at] - low, axis=0)
            out[at] = sums / sizes[at, None].astype(np.float32)
        return list(out)

    return encode


def encode_chunks(
    chunks: DataFrame, encode: Callable[[pd.Series], list], doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, chunk_no, embedding).  ``encode`` gets Arrow batches of token
    arrays; a caller's model loads inside it, once per worker."""
    kind = chunks.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(
                {
                    doc_id: pdf[doc_id],
                    "chunk_no": pdf["chunk_no"],
                    "embedding": [np.asarray(v, dtype=np.float32) for v in encode(pdf["chunk"])],
                }
            )

    return chunks.select(doc_id, "chunk_no", "chunk").mapInPandas(
        run, f"{doc_id} {kind}, chunk_no int, embedding array<float>"
    )


def pool_documents(
    chunk_vectors: DataFrame, doc_id: str = "doc_id", embedding: str = "embedding"
) -> DataFrame:
    """(doc_id, embedding, n_chunks): mean of a document's chunk vectors, combined
    partially before the shuffle."""
    vector = array_to_vector(F.col(embedding))
    pooled = chunk_vectors.select(doc_id, vector.alias("_v")).groupBy(doc_id).agg(
        Summarizer.mean(F.col("_v")).alias("_mean"), F.count(F.lit(1)).alias("n_chunks")
    )
    return pooled.select(
        doc_id, vector_to_array("_mean", "float32").alias("embedding"), "n_chunks"
    )


def embed_documents(
    df: DataFrame,
    encode: Callable | None = None,
    dims: int = 64,
    tokens: str = "tokens",
    doc_id: str = "doc_id",
    max_length: int = MAX_LENGTH,
    stride: int = STRIDE,
) -> DataFrame:
    """A vector per document; a blank document gets zeros."""
    encode = encode or hashed_encoder(dims)
    some = df.where(F.size(tokens) > 0)
    vectors = encode_chunks(chunk_rows(some, tokens, doc_id, max_length, stride), encode, doc_id)
    pooled = pool_documents(vectors, doc_id)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dims)
    return df.select(doc_id).join(pooled, doc_id, "left").select(
        doc_id,
        F.coalesce("embedding", zeros).alias("embedding"),
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
    )


def chunked_documents(embedded: DataFrame) -> DataFrame:
    return embedded.agg(F.count_if(F.col("n_chunks") > 1).alias("n_chunked_documents"))


def fit_reduction(
    train: DataFrame,
    n_components: int = 50,
    column: str = "embedding",
    out: str = "features",
) -> PipelineModel:
    """Centering and principal components, fitted on the training rows.  The
    number of components is limited by rows and dimensions.  Only the dims x dims
    covariance reaches the driver."""
    vectors = train.select(array_to_vector(F.col(column)).alias("_v"))
    first = vectors.first()
    if first is None:
        raise ValueError("no rows to fit on")
    k = min(n_components, len(first["_v"]), vectors.limit(n_components).count())
    center = StandardScaler(inputCol="_v", outputCol="_centered", withMean=True, withStd=False)
    return Pipeline(stages=[center, PCA(k=k, inputCol="_centered", outputCol=out)]).fit(vectors)


def apply_reduction(
    df: DataFrame, model: PipelineModel, column: str = "embedding"
) -> DataFrame:
    with_vector = df.withColumn("_v", array_to_vector(F.col(column)))
    return model.transform(with_vector).drop("_v", "_centered")
