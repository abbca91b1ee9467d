"""Text preparation: phrases, vocabularies, document-term tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import text as ft
from ..functions.numeric import let
from ..session import materialize


def exploded(df: DataFrame, keep: list, items: Column, name: str) -> DataFrame:
    """One row per item.  A plain explode makes the optimizer test the array's size
    at the scan, which evaluates an expensive array (tokens from raw text) twice;
    the outer form with a null test after it does not, and it leaves equal
    sub-plans equal, so their shuffles are shared."""
    rows = df.select(*keep, F.explode_outer(items).alias(name))
    return rows.where(F.col(name).isNotNull())


def add_clean_text(
    df: DataFrame,
    text: str = "text",
    removed_sections: list[str] | None = None,
    out: str = "cleaned_text",
) -> DataFrame:
    source = F.col(text)
    if removed_sections:
        source = ft.remove_sections(F.coalesce(source, F.lit("")), removed_sections)
    return df.withColumn(out, ft.clean_text(source))


def keep_length_between(
    df: DataFrame, low: int = 100, high: int = 50_000, text: str = "cleaned_text"
) -> DataFrame:
    return df.where(F.length(text).between(low, high))


def section_rows(df: DataFrame, doc_id: str, text: str = "text") -> DataFrame:
    """One row per (document, section) in text order."""
    return df.select(doc_id, F.posexplode(ft.sections(F.col(text))).alias("position", "s")).select(
        doc_id, "position", "s.section", "s.body"
    )


def lemmatize(
    df: DataFrame, lemmas: DataFrame, doc_id: str = "doc_id", tokens: str = "tokens"
) -> DataFrame:
    """Replace tokens found in ``lemmas`` (token, lemma; one row per token)."""
    words = df.select(doc_id, F.posexplode(tokens).alias("_pos", "token"))
    mapped = words.join(lemmas, "token", "left").select(
        doc_id, "_pos", F.coalesce("lemma", "token").alias("_word")
    )
    rebuilt = mapped.groupBy(doc_id).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_word"))), lambda s: s["_word"])
        .alias("_lemmas")
    )
    return (
        df.join(rebuilt, doc_id, "left")
        .withColumn(tokens, F.coalesce("_lemmas", F.col(tokens)))
        .drop("_lemmas")
    )


def vocabulary_summary(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    distinct = exploded(df, [], F.col(tokens), "t").agg(
        F.count_distinct("t").alias("vocabulary_size")
    )
    mean = df.agg(F.avg(F.size(tokens)).alias("avg_tokens"))
    return distinct.join(F.broadcast(mean), F.lit(True))  # one row each


# --- phrases ----------------------------------------------------------------


def _pairs(tokens: Column) -> Column:
    """Neighbouring tokens as structs (a, b), in order."""
    count = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, 1, count),
        F.slice(tokens, 2, count),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )


def phrase_scores(
    df: DataFrame,
    min_count: int = 10,
    scoring: str = "default",
    tokens: str = "tokens",
) -> DataFrame:
    """(a, b, n_ab, n_a, n_b, score) for neighbouring pairs seen ``min_count``
    times.  ``default``: (n_ab - min)/(n_a n_b) x number of distinct words and
    pairs; ``npmi``: normalized pointwise mutual information."""
    if scoring not in ("default", "npmi"):
        raise ValueError(f"unknown scoring {scoring!r}")
    words = exploded(df, [], F.col(tokens), "w").groupBy("w").agg(
        F.count(F.lit(1)).alias("n")
    )
    pairs = exploded(df, [], _pairs(F.col(tokens)), "p").groupBy("p.a", "p.b").agg(
        F.count(F.lit(1)).alias("n_ab")
    )
    # Read several times below; the tokens are read once for each.
    words, pairs = materialize(words, "words"), materialize(pairs, "pairs")
    sizes = words.agg(F.count(F.lit(1)).alias("_words"), F.sum("n").alias("_total")).join(
        F.broadcast(pairs.agg(F.count(F.lit(1)).alias("_pairs"))), F.lit(True)
    )
    kept = pairs.where(F.col("n_ab") >= min_count)
    kept = kept.join(words.select(F.col("w").alias("a"), F.col("n").alias("n_a")), "a")
    kept = kept.join(words.select(F.col("w").alias("b"), F.col("n").alias("n_b")), "b")
    kept = kept.join(F.broadcast(sizes), F.lit(True))  # one row
    if scoring == "default":
        score = (
            (F.col("n_ab") - min_count)
            / F.col("n_a").cast("double")
            / F.col("n_b").cast("double")
            * (F.col("_words") + F.col("_pairs"))
        )
    else:
        p = lambda c: F.col(c) / F.col("_total")
        score = F.ln(p("n_ab") / (p("n_a") * p("n_b"))) / -F.ln(p("n_ab"))
    return kept.select("a", "b", "n_ab", "n_a", "n_b", score.alias("score"))


def join_phrases(
    df: DataFrame,
    phrases: DataFrame,
    doc_id: str = "doc_id",
    tokens: str = "tokens",
    delimiter: str = "_",
) -> DataFrame:
    """Join accepted pairs (a, b) greedily from the left.

    In a run of overlapping accepted pairs the greedy choice is every other one,
    starting with the first.  Up to ``LOOKUP_PAIRS`` accepted pairs go to every task,
    which looks neighbours up in its own rows: nothing is shuffled.  Beyond that the
    positions are joined to the pairs, and the rows to the positions.
    """
    found = phrases.select(F.concat_ws(_BETWEEN, "a", "b").alias("p")).limit(LOOKUP_PAIRS + 1)
    accepted = [r["p"] for r in found.collect()]
    if len(accepted) <= LOOKUP_PAIRS:
        join = F.arrow_udf(_joiner(accepted, delimiter), "array<string>")
        return df.withColumn(tokens, join(F.col(tokens)))
    return _join_shuffled(df, phrases, doc_id, tokens, delimiter)


#: Accepted pairs that are sent to every task: some tens of MB of text.
LOOKUP_PAIRS = 1_000_000
_BETWEEN = "\x00"


def _joiner(accepted: list[str], delimiter: str):
    """Token lists with accepted neighbours joined, a whole Arrow batch at a time."""

    def join(lists: pa.Array) -> pa.Array:
        lists = pa.array(lists) if not isinstance(lists, pa.Array) else lists
        flat = lists.flatten()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        n = len(flat)
        if n == 0:
            return lists
        after = pa.concat_arrays([flat.slice(1), pa.nulls(1, flat.type)])
        both = pc.binary_join_element_wise(flat, after, _BETWEEN)
        hit = pc.is_in(both, pa.array(accepted, flat.type)).to_numpy(zero_copy_only=False)
        hit[ends[sizes > 0] - 1] = False  # no pair goes on in the next row
        at = np.arange(n)
        last_miss = np.maximum.accumulate(np.where(hit, -1, at))
        chosen = hit & ((at - last_miss) % 2 == 1)
        stays = np.concatenate([[True], ~chosen[:-1]])
        joined = pc.if_else(pa.array(chosen), pc.binary_join_element_wise(flat, after, delimiter), flat)
        edges = np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], ends])]
        missing = lists.is_null() if lists.null_count else None
        return pa.ListArray.from_arrays(
            pa.array(edges, pa.int32()), joined.filter(pa.array(stays)), mask=missing
        )

    return join


def _join_shuffled(df: DataFrame, phrases: DataFrame, doc_id: str, tokens: str, delimiter: str) -> DataFrame:
    pairs = df.select(
        doc_id, F.posexplode_outer(_pairs(F.col(tokens))).alias("pos", "p")
    ).where(F.col("pos").isNotNull()).select(doc_id, "pos", "p.a", "p.b")
    hits = pairs.join(phrases.select("a", "b"), ["a", "b"], "left_semi")
    by_doc = Window.partitionBy(doc_id).orderBy("pos")  # positions of one document
    runs = hits.withColumn("_run", F.col("pos") - F.row_number().over(by_doc))
    offset = F.col("pos") - F.min("pos").over(Window.partitionBy(doc_id, "_run"))
    chosen = (
        runs.withColumn("_off", offset)
        .where(F.col("_off") % 2 == 0)
        .groupBy(doc_id)
        .agg(F.sort_array(F.collect_list("pos")).alias("_cut"))
    )
    out = df.join(chosen, doc_id, "left")
    toks, cut = F.col(tokens), F.coalesce("_cut", F.array().cast("array<int>"))
    # Before each joined pair: the tokens since the previous pair.  After the
    # last pair: the rest.
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(cut, i - 1) + 2)
    pieces = F.transform(
        cut,
        lambda p, i: F.concat(
            F.slice(toks, begin(i) + 1, p - begin(i)),
            F.array(F.concat(toks[p], F.lit(delimiter), toks[p + 1])),
        ),
    )
    last = F.when(F.size(cut) == 0, 0).otherwise(F.get(cut, F.size(cut) - 1) + 2)
    rebuilt = F.concat(F.flatten(pieces), F.slice(toks, last + 1, F.size(toks)))
    return out.withColumn(tokens, rebuilt).drop("_cut")


def add_phrases(
    df: DataFrame,
    min_count: int = 10,
    threshold: float = 50.0,
    scoring: str = "default",
    doc_id: str = "doc_id",
    tokens: str = "tokens",
    passes: int = 2,
) -> DataFrame:
    """Two-word phrases, then (second pass) three- and four-word ones.  Each pass
    reads its input several times, so it is written to the shared folder first."""
    for _ in range(passes):
        df = materialize(df, "tokens")
        scores = phrase_scores(df, min_count, scoring, tokens)
        # Written too: its real size then decides between broadcasting it to the
        # pairs and a shuffled join.
        accepted = materialize(scores.where(F.col("score") > threshold).select("a", "b"), "phrases")
        df = join_phrases(df, accepted, doc_id, tokens)
    return df


# --- vocabularies and document-term tables ------------------------------------


@dataclass
class Vocabulary:
    """At most ``max_terms`` terms in index order, with document frequencies."""

    terms: list[str]
    doc_freq: list[int]
    n_docs: int

    def frame(self, spark) -> DataFrame:
        rows = list(zip(range(len(self.terms)), self.terms, self.doc_freq))
        return spark.createDataFrame(rows, "term_id int, term string, df long")

    def idf(self) -> Column:
        """ln((1+n)/(1+df)) + 1 by term id: one constant array, folded into the
        plan, so no row carries it."""
        values = [math.log((1 + self.n_docs) / (1 + d)) + 1 for d in self.doc_freq]
        return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _name_terms(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Attach ``term`` to rows with a term_id; the vocabulary is capped by
    ``max_terms``, hence the broadcast."""
    names = vocab.frame(rows.sparkSession).select("term_id", "term")
    return rows.join(F.broadcast(names), "term_id")


#: Terms that a task counts at once: some 100 MB.
COUNTED_TERMS = 1 << 21


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The items of all lists and the size of each list, a null one's being 0."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0)
    return lists.flatten(), sizes.to_numpy(zero_copy_only=False).astype(np.int64)


def _sums(held: list[pa.Array]) -> pa.RecordBatch:
    """(term, cnt, df) over some lists of terms."""
    parts = [_flat(lists) for lists in held]
    sizes = np.concatenate([n for _, n in parts])
    coded = pa.concat_arrays([flat for flat, _ in parts]).dictionary_encode(null_encoding="encode")
    n, ids = len(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
    once = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(n, 1) + ids) % max(n, 1)
    sums = [pa.array(np.bincount(x, minlength=n).astype(np.int64)[:n]) for x in (ids, once)]
    return pa.RecordBatch.from_arrays([coded.dictionary, *sums], ["term", "cnt", "df"])


def _in_parts(batches: Iterator[pa.RecordBatch], sums) -> Iterator[pa.RecordBatch]:
    """``sums`` of the first column, ``COUNTED_TERMS`` list items at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0))
        n += int(_flat(held[-1])[1].sum())
        if n >= COUNTED_TERMS:
            yield sums(held)
            held, n = [], 0
    if held:
        yield sums(held)


def term_statistics(df: DataFrame, grams: Column | str) -> DataFrame:
    """(term, cnt, df): corpus count and document frequency in one scan.  A task sums
    ``COUNTED_TERMS`` terms at a time over Arrow batches, which leaves little to shuffle."""
    lists = F.col(grams) if isinstance(grams, str) else grams
    rows = df.select(lists.alias("_g")).mapInArrow(lambda b: _in_parts(b, _sums), "term string, cnt long, df long")
    return rows.groupBy("term").agg(F.sum("cnt").alias("cnt"), F.sum("df").alias("df"))


def fit_vocabulary(
    df: DataFrame,
    grams: Column | str,
    min_df: int = 5,
    max_df: float = 0.95,
    max_terms: int = 5000,
    rank_by: str = "cnt",
) -> Vocabulary:
    """Terms in ``min_df`` documents or more and in at most ``max_df`` of all,
    the ``max_terms`` most frequent, in alphabetical order."""
    n_docs = df.count()
    stats = term_statistics(df, grams).where(
        (F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)
    )
    top = stats.orderBy(F.desc(rank_by), "term").limit(max_terms)
    rows = sorted((r["term"], r["df"]) for r in top.collect())  # at most max_terms
    return Vocabulary([t for t, _ in rows], [d for _, d in rows], n_docs)


def _pair_sums(words: list[str]):
    """(pair, cnt, df) of neighbours that are both in ``words``; a pair is the place of
    its first word times their number, plus the place of its second."""

    def sums(held: list[pa.Array]) -> pa.RecordBatch:
        parts = [_flat(lists) for lists in held]
        sizes = np.concatenate([n for _, n in parts])
        flat = pa.concat_arrays([x for x, _ in parts])
        found = pc.fill_null(pc.index_in(flat, value_set=pa.array(words, flat.type)), -1)
        ids, doc = found.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
        both = (ids[:-1] >= 0) & (ids[1:] >= 0) & (doc[:-1] == doc[1:])
        pairs, place = np.unique(ids[:-1][both] * len(words) + ids[1:][both], return_inverse=True)
        n = len(pairs)
        once = np.unique(doc[:-1][both] * max(n, 1) + place) % max(n, 1)
        counts = [pa.array(np.bincount(x, minlength=n).astype(np.int64)[:n]) for x in (place, once)]
        return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), *counts], ["pair", "cnt", "df"])

    return lambda batches: _in_parts(batches, sums)


def fit_bigram_vocabulary(
    df: DataFrame,
    words: Column,
    min_df: int = 5,
    max_df: float = 0.95,
    max_terms: int = 5000,
) -> Vocabulary:
    """``fit_vocabulary`` of the words and of all neighbouring pairs.

    The words are counted first.  A pair is no more frequent than its words, so where
    ``max_terms`` words are allowed, only pairs of words at least as frequent as the
    last of them can get in: others are not counted.  ``df`` is read twice.
    """
    n_docs = df.count()
    allowed = (F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)
    order = [F.desc("cnt"), "term"]
    stats = materialize(term_statistics(df, words), "words")
    top = stats.where(allowed).orderBy(*order).limit(max_terms).collect()
    least = top[-1]["cnt"] if top and len(top) == max_terms else 1
    likely = stats.where((F.col("df") >= min_df) & (F.col("cnt") >= least))
    names = [r["term"] for r in likely.select("term").limit(LOOKUP_PAIRS + 1).collect()]
    if len(names) > LOOKUP_PAIRS:
        return fit_vocabulary(df, ft.ngrams(words), min_df, max_df, max_terms)
    pairs = df.select(words.alias("_w")).mapInArrow(_pair_sums(names), "pair long, cnt long, df long")
    pairs = pairs.groupBy("pair").agg(F.sum("cnt").alias("cnt"), F.sum("df").alias("df"))
    named = df.sparkSession.createDataFrame(list(enumerate(names)), "_id long, _name string")
    first, second = named.toDF("_a", "_first"), named.toDF("_b", "_second")
    pairs = (
        pairs.where(allowed & (F.col("cnt") >= least))
        .withColumn("_a", F.expr(f"pair div {max(len(names), 1)}"))
        .withColumn("_b", F.expr(f"pair % {max(len(names), 1)}"))
        .join(F.broadcast(first), "_a").join(F.broadcast(second), "_b")  # at most LOOKUP_PAIRS
        .select(F.concat("_first", F.lit(" "), "_second").alias("term"), "cnt", "df")
    )
    both = stats.where(allowed).select("term", "cnt", "df").unionByName(pairs)
    rows = sorted((r["term"], r["df"]) for r in both.orderBy(*order).limit(max_terms).collect())
    return Vocabulary([t for t, _ in rows], [d for _, d in rows], n_docs)


_SPARSE = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def _counter(terms: list[str]):
    """Sparse counts of the lists of an Arrow batch, looked up all at once."""

    def count(lists: pa.Array) -> pa.Array:
        flat, sizes = _flat(lists)
        found = pc.index_in(flat, value_set=pa.array(terms, flat.type))
        known = found.is_valid().to_numpy(zero_copy_only=False)
        ids = found.drop_null().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(sizes)), sizes)[known]
        cells, tf = np.unique(rows * max(len(terms), 1) + ids, return_counts=True)
        ends = np.cumsum(np.bincount(cells // max(len(terms), 1), minlength=len(sizes)))
        edges = pa.array(np.concatenate([[0], ends]), pa.int32())
        return pa.StructArray.from_arrays(
            [
                pa.array(np.zeros(len(sizes)), pa.int8()),
                pa.array(np.full(len(sizes), len(terms)), pa.int32()),
                pa.ListArray.from_arrays(edges, pa.array(cells % max(len(terms), 1), pa.int32())),
                pa.ListArray.from_arrays(edges, pa.array(tf, pa.float64())),
            ],
            ["type", "size", "indices", "values"],
        )

    return count


def _term_counts(df: DataFrame, grams: Column, vocab: Vocabulary, out: str) -> DataFrame:
    """Per row the sparse counts struct<size, indices, values>; no shuffle."""
    return df.withColumn(out, F.arrow_udf(_counter(vocab.terms), _SPARSE)(grams))


def document_term_counts(
    df: DataFrame, grams: Column, vocab: Vocabulary, doc_id: str = "doc_id"
) -> DataFrame:
    """Long table (doc_id, term_id, term, tf).  Counted inside each document, so the
    rows are not shuffled; the vocabulary is capped by ``max_terms``."""
    rows = exploded(df, [doc_id], ft.counted(grams), "e").select(doc_id, "e.term", "e.tf")
    names = vocab.frame(df.sparkSession).select("term_id", "term")
    return rows.join(F.broadcast(names), "term").select(
        doc_id, "term_id", "term", F.col("tf").cast("long").alias("tf")
    )


def as_vector(df: DataFrame, column: str) -> DataFrame:
    """Turn struct<type, size, indices, values> into a vector column.  The struct
    already has the vector's layout: the Arrow batches pass through unchanged and
    only get the type."""
    fields = [
        T.StructField(f.name, VectorUDT() if f.name == column else f.dataType)
        for f in df.schema.fields
    ]
    return df.mapInArrow(lambda batches: batches, T.StructType(fields))


def count_vectors(
    df: DataFrame, tokens: str, vocab: Vocabulary, out: str = "counts"
) -> DataFrame:
    return CountVectorizerModel.from_vocabulary(
        vocab.terms, inputCol=tokens, outputCol=out
    ).transform(df)


def tfidf_vectors(
    df: DataFrame,
    grams: Column,
    vocab: Vocabulary,
    sublinear: bool = True,
    out: str = "tfidf",
    vector: bool = True,
) -> DataFrame:
    """Add the weighted, L2-normalized term vector of each row.

    tf is 1 + ln(tf) (or raw), idf is ln((1+n)/(1+df)) + 1.  Counting looks terms
    up in the broadcast vocabulary (at most ``max_terms`` entries); weights are
    array expressions, so nothing is shuffled.
    """
    counted = _term_counts(df, grams, vocab, "_tf")
    idf = vocab.idf()
    tf = lambda v: (1 + F.ln(v)) if sublinear else v
    raw = F.zip_with("_tf.values", "_tf.indices", lambda v, i: tf(v) * F.get(idf, i))
    square = lambda ws: F.aggregate(ws, F.lit(0.0), lambda acc, x: acc + x * x)
    unit = let(
        raw,
        lambda ws: let(F.sqrt(square(ws)), lambda norm: F.transform(ws, lambda x: x / norm)),
    )
    parts = F.struct(
        F.col("_tf.type").alias("type"),
        F.col("_tf.size").alias("size"),
        F.col("_tf.indices").alias("indices"),
        unit.alias("values"),
    )
    done = counted.withColumn(out, parts).drop("_tf")
    return as_vector(done, out) if vector else done


def tfidf_rows(
    df: DataFrame,
    grams: Column,
    vocab: Vocabulary,
    doc_id: str = "doc_id",
    sublinear: bool = True,
) -> DataFrame:
    """Long table (doc_id, term, weight)."""
    slim = df.select(doc_id, grams.alias("_g"))
    parts = tfidf_vectors(slim, F.col("_g"), vocab, sublinear, "_w", vector=False)
    rows = exploded(parts, [doc_id], F.arrays_zip("_w.indices", "_w.values"), "e").select(doc_id, F.col("e.indices").alias("term_id"), F.col("e.values").alias("weight"))
    return _name_terms(rows, vocab).select(doc_id, "term", "weight")
