"""Literal cases for text, phrases, weights and chunks."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import text as ft
from cohortlens.operators import embed as oe, features as of, text as ot
from cohortlens.plans.text import prepare_text


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("r")).first()["r"]


def test_clean(spark):
    raw = "Patient ___ was admitted on 12/25/2022. WBC 12.3 mg, call (555) 123-4567. [x] 2020-01-02"
    assert one(spark, raw, ft.clean_text) == "patient was admitted on . wbc , call ."
    for blank in ("", "   ", None):
        assert one(spark, blank, ft.clean_text) == ""
    assert one(spark, "A\n\n\n\n\tB ", ft.clean_text) == "a\n\n b"


def test_sections(spark):
    note = (
        "Admit note\n\nChief Complaint:\nshortness of breath\n\nHISTORY OF PRESENT ILLNESS\nlong\n"
        "Brief Hospital Course:\nfine\nChief Complaint:\nagain"
    )
    got = one(spark, note, ft.section_map)
    assert got == {
        "preamble": "Admit note", "Chief Complaint": "again",
        "HISTORY OF PRESENT ILLNESS": "long", "Brief Hospital Course": "fine",
    }


def test_remove_sections(spark):
    note = "Some text.\n\nDischarge Medications:\nListof meds here.\n\nBrief Hospital Course:\nCourse here."
    got = one(spark, note, lambda c: ft.remove_sections(c, ["Discharge Medications"]))
    assert got == "Some text.\n\n\nBrief Hospital Course:\nCourse here."
    tail = one(spark, "a\nAllergies\nx\n1. y", lambda c: ft.remove_sections(c, ["Allergies"]))
    assert tail == "a"


def test_tokens(spark):
    text = "the patient was admitted for heart failure, (fluid) a-fib 10.5 don't and shortness"
    assert one(spark, text, ft.tokenize) == ["admitted", "heart", "failure", "fluid", "shortness"]
    assert one(spark, "one two three", lambda c: ft.tokenize(c, ["two"])) == ["one", "three"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    got = [r[0] for r in df.select(ft.ngrams(F.col("w"), 1, 3)).collect()]
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]
    assert [r[0] for r in df.select(ft.ngrams(F.col("w"), 2, 2)).collect()] == [["a b", "b c"], [], []]


def greedy(tokens, pairs):
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in pairs:
            out.append(f"{tokens[i]}_{tokens[i + 1]}")
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


@pytest.mark.parametrize("bound", [1_000_000, 2])
def test_phrases_match_greedy_scan(spark, monkeypatch, bound):
    monkeypatch.setattr(ot, "LOOKUP_PAIRS", bound)  # 2: joined by a shuffle
    rng = random.Random(3)
    docs = [(i, [rng.choice("abcd") for _ in range(rng.randint(0, 30))]) for i in range(60)]
    pairs = {("a", "b"), ("b", "a"), ("a", "a"), ("c", "d"), ("d", "c")}
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(3)
    got = ot.join_phrases(df, spark.createDataFrame(sorted(pairs), "a string, b string"))
    assert {r["doc_id"]: r["tokens"] for r in got.collect()} == {i: greedy(t, pairs) for i, t in docs}


def test_phrases_in_place(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, []), (4, ["b", "a"]), (5, ["a"])], "doc_id int, tokens array<string>")
    got = ot.join_phrases(df.coalesce(1), spark.createDataFrame([("a", "b")], "a string, b string"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["tokens"] for r in got.collect()} == {1: ["a_b"], 2: None, 3: [], 4: ["b", "a"], 5: ["a"]}


def test_phrases_found(spark):
    words = "cardiac arrest pulmonary edema septic shock".split() * 5
    df = spark.createDataFrame([(i, words) for i in range(80)], "doc_id long, tokens array<string>")
    got = ot.add_phrases(df, 3, 0.5, "npmi").first()["tokens"]
    assert any("_" in t for t in got)


def test_tfidf_weights(spark):
    docs = [["aa", "bb", "aa"], ["bb", "cc"], ["aa", "cc", "cc"]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, tokens array<string>")
    vocab = ot.fit_vocabulary(df, F.col("tokens"), 1, 1.0, 10)
    assert (vocab.terms, vocab.doc_freq) == (["aa", "bb", "cc"], [2, 2, 2])
    got = {(r["doc_id"], r["term"]): r["weight"] for r in ot.tfidf_rows(df, F.col("tokens"), vocab).collect()}
    idf = math.log(4 / 3) + 1
    for i, words in enumerate(docs):
        raw = {t: (1 + math.log(n)) * idf for t, n in Counter(words).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for t, v in raw.items():
            assert got[(i, t)] == pytest.approx(v / norm)
    vec = ot.tfidf_vectors(df, F.col("tokens"), vocab).orderBy("doc_id").first()["tfidf"]
    assert vec.size == 3 and vec[0] == pytest.approx(got[(0, "aa")])


def test_prepare_text_drops_by_length(spark):
    df = spark.createDataFrame([(1, "word " * 30), (2, "short")], "doc_id int, text string")
    got = prepare_text(df, min_length=100, use_phrases=False).collect()
    assert [(r["doc_id"], r["num_tokens"]) for r in got] == [(1, 30)]


def test_lemmas(spark):
    df = spark.createDataFrame([(1, ["mice", "run", "mice"]), (2, [])], "doc_id int, tokens array<string>")
    lemmas = spark.createDataFrame([("mice", "mouse")], "token string, lemma string")
    got = {r["doc_id"]: r["tokens"] for r in ot.lemmatize(df, lemmas).collect()}
    assert got == {1: ["mouse", "run", "mouse"], 2: []}


def test_text_statistics(spark):
    df = spark.createDataFrame(
        [("No pain. not Not denies", "Chief Complaint\nx allergies"), ("", None)],
        "cleaned_text string, text string",
    )
    first, blank = of.text_statistics(df, []).collect()
    assert tuple(first) == (5, 4, 1, 3.8, 0.8)
    assert tuple(blank) == (0, 0, 0, 0.0, 0.0)


@pytest.mark.parametrize("n,starts", [(510, [0]), (511, [0, 256]), (604, [0, 256]), (1022, [0, 256, 512])])
def test_chunks(spark, n, starts):
    df = spark.createDataFrame([(1, ["t"] * n)], "doc_id int, tokens array<string>")
    got = oe.chunk_rows(df).orderBy("chunk_no").collect()
    assert [r["chunk_start"] for r in got] == starts
    assert got[-1]["chunk_start"] + len(got[-1]["chunk"]) == n


def test_embedding_of_blank_text_is_zero(spark):
    words = "the subject presented with".split() + ["clinical", "finding"] * 300
    df = spark.createDataFrame([(1, words), (2, [])], "doc_id int, tokens array<string>")
    got = {r["doc_id"]: r for r in oe.embed_documents(df, dims=8).collect()}
    assert got[1]["n_chunks"] == 2 and any(v != 0 for v in got[1]["embedding"])
    assert got[2]["embedding"] == [0.0] * 8
    with pytest.raises(ValueError):
        oe.chunk_rows(df, max_length=10, stride=9)


def test_reduction(spark):
    rng = random.Random(0)
    df = spark.createDataFrame(
        [(i, [rng.gauss(5, 1) for _ in range(12)]) for i in range(20)], "doc_id int, embedding array<double>"
    )
    model = oe.fit_reduction(df, 50)
    got = oe.apply_reduction(df, model).collect()
    assert len(got[0]["features"]) == 12 and len(got) == 20
    assert abs(sum(r["features"][0] for r in got)) < 1e-6


def test_combined_sets(spark):
    a = of.assemble(spark.createDataFrame([(1, 2.0)], "doc_id int, x double"), ["x"])
    b = of.assemble(spark.createDataFrame([(1, 3.0, 4.0)], "doc_id int, y double, z double"), ["y", "z"])
    got = of.combine_feature_sets({"a": a, "none": None, "b": b})
    assert of.vector_names(got) == ["a__x", "b__y", "b__z"]
    assert list(got.first()["features"]) == [2.0, 3.0, 4.0]
    with pytest.raises(ValueError):
        of.combine_feature_sets({"a": None})
    with pytest.raises(TypeError):
        of.combine_feature_sets({"a": [1, 2]})


def test_structured_without_optional_columns(spark):
    df = spark.createDataFrame([(1,), (2,)], "doc_id int")
    got = of.structured_features(
        df, ["doc_id"], age=None, gender=None, insurance=None, admission_type=None, los=None, history=False
    ).first()
    assert got["age"] == 65.0 and got["days_since_last_admission"] == -1 and got["log_los"] == 0
