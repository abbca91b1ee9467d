"""Steps that were too slow on large tables: same results by less work."""

import random
from collections import Counter
from hashlib import blake2b

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import text as ft
from cohortlens.operators import embed as oe, text as ot
from cohortlens.plans import features as pf, text as pt


def _docs(spark, n=60):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, [words[min(int(rnd.expovariate(0.2)), 39)] for _ in range(rnd.randint(0, 30))]) for i in range(n)]
    return rows, spark.createDataFrame([*rows, (n, None)], "doc_id int, tokens array<string>")


@pytest.mark.parametrize("max_terms", [1, 7, 25, 5000])
@pytest.mark.parametrize("max_df", [0.5, 1.0])
def test_vocabulary_of_pairs_of_frequent_words(spark, monkeypatch, max_terms, max_df):
    rows, df = _docs(spark)
    cnt, docs = Counter(), Counter()
    for _, t in rows:
        grams = t + [f"{a} {b}" for a, b in zip(t, t[1:])]
        cnt.update(grams)
        docs.update(set(grams))
    kept = [t for t in cnt if 3 <= docs[t] <= max_df * 61]
    want = sorted(sorted(kept, key=lambda t: (-cnt[t], t))[:max_terms])
    for size in (ot.COUNTED_TERMS, 50):
        monkeypatch.setattr(ot, "COUNTED_TERMS", size)
        got = ot.fit_bigram_vocabulary(df, F.col("tokens"), 3, max_df, max_terms)
        assert (got.terms, got.doc_freq, got.n_docs) == (want, [docs[t] for t in want], 61)
        assert got == ot.fit_vocabulary(df, ft.ngrams(F.col("tokens")), 3, max_df, max_terms)
    monkeypatch.setattr(ot, "LOOKUP_PAIRS", 2)
    assert ot.fit_bigram_vocabulary(df, F.col("tokens"), 3, max_df, max_terms) == got


def test_terms_are_counted_without_exploding_them(spark):
    rows, df = _docs(spark)
    got = ot.term_statistics(df, F.col("tokens"))
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    cnt, docs = Counter(t for _, x in rows for t in x), Counter(t for _, x in rows for t in set(x))
    assert {(r["term"], r["cnt"], r["df"]) for r in got.collect()} == {(t, cnt[t], docs[t]) for t in cnt}


def test_no_words_at_all(spark):
    df = spark.createDataFrame([(1, []), (2, None)], "doc_id int, tokens array<string>")
    assert ot.fit_bigram_vocabulary(df, F.col("tokens")).terms == []
    vocab = ot.Vocabulary(["a"], [1], 2)
    assert [r["v"].numNonzeros() for r in ot.tfidf_vectors(df, F.col("tokens"), vocab, out="v").collect()] == [0, 0]


def test_patterns_run_only_where_they_can_match(spark):
    odd = [
        "", None, " ", "\n", "a\n", "\u0085a ", "a__b [x] [ X ]c", "on 12/3/2020 x", "2020-01-02", "(555) 123-4567 a",
        "5mg 10.5 ML", "١٢/٣/٤٥ x", "٥mg", "a\t\tb  c \t d", "a\n\n\n\nb", "a\n\n\n", "__ \n\n\n[ ]",
        "\x1ca\x1f", "a\r", "　a ", "plain words",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, text string")
    plain = F.coalesce("text", F.lit(""))
    for pattern in ft.CLEANING_PATTERNS:
        plain = F.regexp_replace(plain, pattern, " ")
    plain = F.regexp_replace(F.regexp_replace(F.lower(plain), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    plain = F.regexp_replace(plain, ft._EDGE_SPACE, "")
    out = df.select(ft.clean_text(F.col("text")).alias("a"), plain.alias("b"))
    assert all(r["a"] == r["b"] for r in out.collect())
    seen = df.select(ft.clean_text(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN RLIKE" in seen


def test_sections_in_any_case(spark):
    text = "a\nDIſcharge condition :\nx y\nNext One\nz\nDISCHARGE MEDICATIONS\nq"
    df = spark.createDataFrame([(text,), ("none",), (None,)], "text string")
    out = df.select(ft.remove_sections(F.col("text"), ft.DEFAULT_REMOVED_SECTIONS))
    assert [r[0] for r in out.collect()] == ["a\n\nNext One\nz", "none", None]


def test_sets_are_combined_from_written_parts(spark):
    rows = [(i, f"t{i % 7} x", ["aa", f"t{i % 7}", "bb"], 40 + i, "M", "Medicare", "Urgent", 2.0, i % 3, 5, 0) for i in range(30)]
    df = spark.createDataFrame(
        [(r[0], r[1], r[1], *r[2:]) for r in rows],
        "doc_id int, text string, cleaned_text string, tokens array<string>, anchor_age int, gender string, insurance string,"
        " admission_type string, los_days double, num_prior_admissions int, days_since_last_admission int, prior_expire_flag int",
    )
    sets = pf.build_feature_sets(df, label=None, train=df.where("doc_id < 20"), tfidf={"min_df": 1, "max_df": 1.0})
    assert "regexp" not in sets["combined"]._jdf.queryExecution().optimizedPlan().toString()
    got = sets["combined"].collect()
    assert len(got) == 30 and {len(r["features"]) for r in got} == {len(sets["tfidf"].first()["features"]) + 17}


@pytest.mark.parametrize("pooling", ["mean", "cls"])
def test_chunks_are_encoded_together(pooling, monkeypatch):
    def vector(token):
        bits = np.unpackbits(np.frombuffer(blake2b(f"42:0:{token}".encode()).digest(), dtype=np.uint8))[:24]
        return bits.astype(np.float32) * 2 - 1

    monkeypatch.setattr(oe, "CHUNKS_AT_ONCE", 3)
    rnd = random.Random(1)
    chunks = pd.Series([[f"t{rnd.randrange(9)}" for _ in range(n)] for n in (0, 3, 1, 0, 0, 7, 5, 2, 11, 0)])
    got = oe.hashed_encoder(24, pooling=pooling)(chunks)
    for chunk, v in zip(chunks, got, strict=True):
        used = [vector(t) for t in (chunk[:1] if pooling == "cls" else chunk)] or [np.zeros(24, dtype=np.float32)]
        assert v.dtype == np.float32 and (v == np.mean(used, axis=0)).all()
    assert [v.tolist() for v in oe.hashed_encoder(24)(pd.Series([[], []]))] == [[0.0] * 24] * 2


def test_texts_are_cleaned_once_before_the_length_test(spark):
    df = spark.createDataFrame([(1, "word " * 30)], "doc_id int, text string")
    plan = pt.prepare_text(df, use_phrases=False).select("tokens", "cleaned_text")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("_{2,}") == 1
