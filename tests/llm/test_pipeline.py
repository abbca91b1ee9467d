"""The pipeline's stages on the smallest tables, each held against its own input."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from cohortlens.session import materialize
from test_operators import dropped_lines, linked, strings, whole_ids

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(materialize(stage(spark, found[-1], SF_DIR), name.replace(" ", "-")))
    return [[r.asDict() for r in df.collect()] for df in found]


def pairs(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def test_columns_stay(stages):
    for rows in stages[1:-1]:
        assert list(rows[0]) == list(stages[0][0])
        assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_quality_keeps_labelled_good_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1]}
    judged = [(doc in kept) == bool(quality) for doc, quality in labels.items()]
    assert np.mean(judged) > 0.95


def test_lines(stages):
    want = [(i, text) for i, _, _, text in dropped_lines(pairs(stages[1]))]
    assert sorted(pairs(stages[2])) == sorted(want)


def test_near_copies(stages):
    want = {i for i, _, least, _ in linked(pairs(stages[2]), 5) if i == least}
    assert {r["doc_id"] for r in stages[3]} == want


def test_strings(stages):
    sizes = {i: n - gone for i, n, gone, *_ in strings(pairs(stages[3]), 400)}
    for i, text in pairs(stages[4]):
        assert sizes[i] - len(text.encode()) in range(0, 12)


def test_packing(stages):
    tokens = {i: whole_ids(text) + [0] for i, text in pairs(stages[4])}
    found = {}
    for r in sorted(stages[5], key=lambda r: r["start"]):
        found.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert found == tokens


def test_packing_remembers_few_words(tmp_path):
    from cohortlens.llm import tokens
    from cohortlens.llm.common import Hashes

    hashes = Hashes()
    hashes.of([b"one", b"two"])
    tokens._ENCODERS.pop(corpus_pipeline.BYTE_BPE, None)
    encoder = tokens.encoder(corpus_pipeline.BYTE_BPE, 100)
    assert not hashes  # of an earlier stage
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}" for i in range(60)) for k in range(20)]
    found = []
    for text in texts:
        found += encoder.encode([text])
        assert len(encoder.words) <= 100 + 2 * 60
    assert tokens.encoder(corpus_pipeline.BYTE_BPE).limit == tokens.CachedEncoder.LIMIT
    assert found == encoder.encode(texts)
    assert corpus_pipeline.PACK_WORDS < tokens.CachedEncoder.LIMIT
