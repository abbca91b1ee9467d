"""The operators on small tables with nulls, empty and long texts, ties and repeats,
each against a plain version of its rule."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import (
    bpe, common, lines, packing, permutation_index, quality, recompression, repeats, suffixes, superminhash,
    tokens, topk, wavelet,
)
from cohortlens.llm.catalog import BYTE_BPE, MULTI_RANKS
from cohortlens.session import ship_package

SCHEMA = "doc_id bigint, text string, t string, gone int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("aeioubcdlmnrst", k=r.randint(2, 7))) for _ in range(n))


PASSAGE = prose(1, 90)
LONG = "\n".join(prose(100 + i, 200) for i in range(30))
TEXTS = [
    None, "", " ", "\n", "a", "one two", "one two", "One  TWO\t three\n\n\nfour ",
    PASSAGE, prose(2, 40) + " " + PASSAGE, PASSAGE + "\n" + prose(3, 70), PASSAGE,
    LONG, LONG + " and more", "é" * 900, "x" * 1500, "ab " * 400, "ab " * 401,
    "the same long line is here again\n" + prose(4, 30), "The same long line is here again  \nz",
    "q\nthe same long line is here again\nthe same long line is here again",
    "１２ don't we'll 3d x y\x1cz <|endoftext|>", prose(5, 400), prose(5, 380) + " " + prose(6, 20),
]


def rows() -> list[tuple]:
    out = [(i, text, "x", None) for i, text in enumerate(TEXTS)]
    # A null id, and rows that repeat an id or a whole row.
    return out + [(None, PASSAGE + " end", None, 1), (9, TEXTS[9], "x", None), (9, "another text with this id", "x", None)]


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def unique_rows() -> list[tuple]:
    return [(i, text) for i, text in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def plain(spark):
    ship_package(spark)
    return spark.createDataFrame(unique_rows(), "doc_id bigint, text string").repartition(3)


def whole_ids(text: str | None) -> list[int]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_cached_encoder_is_the_library(docs):
    encoder = tokens.CachedEncoder(BYTE_BPE)
    encoder.LIMIT = 20
    texts = [t or "" for t in TEXTS] + ["a \n b", "\n a", "a\n", " a", "x.y, z., (w)", "ﬀ ſt Ωmega", "\t\ta"]
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert got == [whole_ids(t) for t in texts]


def test_wavelet_matrix_answers():
    r = np.random.default_rng(3)
    for n, top in ((1, 1), (700, 3), (5000, 40000)):
        ids = r.integers(0, top, n).astype(np.uint32)
        m = wavelet.WaveletMatrix.build(ids)
        assert (m.decode() == ids).all()
        for i in r.integers(0, n, 30):
            token = int(ids[i])
            assert m.access(int(i)) == token
            assert m.rank(token, int(i)) == int((ids[:i] == token).sum())
            places = np.flatnonzero(ids == token)
            k = int(r.integers(0, len(places)))
            assert m.select(token, k) == places[k]
            assert m.count(token, n // 3, n) == int((ids[n // 3 :] == token).sum())
        assert m.count(top + 70000) == 0
        with pytest.raises(IndexError):
            m.access(n)
        with pytest.raises(IndexError):
            m.select(int(ids[0]), n)
    assert len(wavelet.WaveletMatrix.build(np.zeros(0, np.uint32)).decode()) == 0


@pytest.mark.parametrize("shard_tokens", [50, 1 << 19])
def test_wavelet_directory(docs, empty, monkeypatch, shard_tokens):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", shard_tokens)
    got = sorted(wavelet.token_directory(docs, BYTE_BPE).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] + sorted(r[0] for r in rows() if r[0] is not None)
    start, by_id = 0, defaultdict(list)
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) // 4
        start += r.n_tokens
        by_id[r.doc_id].append(np.frombuffer(r.ids, "<u4").tolist())
    for doc_id, found in by_id.items():
        assert sorted(found) == sorted(whole_ids(r[1]) + [0] for r in rows() if r[0] == doc_id)
    assert wavelet.token_directory(empty, BYTE_BPE).count() == 0


def test_a_written_shard_answers(spark, docs, tmp_path):
    """One file opened alone gives access, counts and occurrences of its tokens."""
    wavelet.write_shards(docs, BYTE_BPE, f"{tmp_path}/shards")
    shards = spark.read.schema(wavelet.SHARD).parquet(f"{tmp_path}/shards").collect()
    shard = max(shards, key=lambda r: r.n_tokens)
    matrix = wavelet.WaveletMatrix(shard.n_tokens, shard.zeros, shard.planes, shard.ranks)
    texts = defaultdict(list)
    for r in rows():
        texts[r[0]].append(whole_ids(r[1]) + [0])
    found, at = [], 0
    for doc_id, length in zip(shard.doc_ids, shard.lengths):
        mine = [matrix.access(i) for i in range(at, at + length)]
        assert mine in texts[doc_id]
        found, at = found + mine, at + length
    assert at == shard.n_tokens
    for token in {*found[:5], 0, max(found)}:
        places = [i for i, x in enumerate(found) if x == token]
        assert matrix.count(token) == len(places)
        assert matrix.count(token, 3, at - 2) == sum(3 <= i < at - 2 for i in places)
        assert [matrix.select(token, k) for k in range(len(places))] == places


def dropped_lines(table: list[tuple], min_docs: int = 3, size: int = 20) -> list[tuple]:
    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(common.SPACE))

    held = defaultdict(set)
    for doc_id, text in table:
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k].add(-1 if doc_id is None else doc_id)
    out = []
    for doc_id, text in table:
        cut = (text or "").split("\n")
        kept = [
            x for x in cut
            if len(key(x)) < size or len(held[key(x)]) < min_docs or max(held[key(x)]) == (-1 if doc_id is None else doc_id)
        ]
        out.append((doc_id, len(cut), len(cut) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines(docs, empty):
    got = lines.drop_repeated_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    found = sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()], key=str)
    assert found == dropped_lines([r[:2] for r in rows()])
    assert any(r[2] for r in found)
    assert lines.drop_repeated_lines(empty).count() == 0


def test_rows_of_one_document_count_once(spark):
    line = "a line of more than twenty characters"
    table = [(5, line), (5, line), (9, line), (1, "x")]
    got = lines.drop_repeated_lines(spark.createDataFrame(table, "doc_id bigint, text string"))
    found = sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()], key=str)
    assert found == dropped_lines(table) and not any(r[2] for r in found)


CLASHING = ["n_lines", "N_dropped", "n_words", "n_removed", "n_bytes", "n_spans", "kept", "score", "row", "id", "t", "u",
            "rank", "starts", "ends", "least", "lines", "g", "h", "last", "of", "gone", "batch", "bucket", "key"]


def test_clashing_names(spark):
    table = [(i, PASSAGE + "\n" + LONG[:900]) + ("mine",) * len(CLASHING) for i in range(4)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in CLASHING))
    made = {
        "n_lines": lines.drop_repeated_lines(docs), "n_words": recompression.remove_repeated_passages(docs),
        "n_bytes": suffixes.remove_repeated_strings(docs), "score": quality.score(docs, quality.HistogramTrees(rounds=1).fit(
            np.zeros((2, len(quality.FEATURES))), np.array([0.0, 1.0]))),
    }
    for name, got in made.items():
        rows = got.collect()
        assert len(rows) == 4 and len({c.lower() for c in got.columns}) == len(got.columns)
        assert all(not isinstance(r[name], str) and r["rank"] == "mine" for r in rows)


@pytest.mark.parametrize("space", [" ", "\n", "\t", "\u3000", " \r\n"])
def test_long_white_space(space):
    codec = bpe.RankFile(MULTI_RANKS, public_tokenizers.PATTERN)
    tail, lone = ["end", "", "'s", "9", "\u00e9!"], codec.encoding
    for after in tail:
        text = "word" + space * 30_000 + after  # short enough for the library
        assert codec.encode("x " * 20_000 + text) == lone.encode_ordinary("x " * 20_000 + text)
    whole = "word" + space * 1_000_000 + "end"
    assert codec.decode(codec.encode(whole)) == whole.encode()


def test_bpe(docs, empty):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI_RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.encode_texts(docs, MULTI_RANKS, public_tokenizers.PATTERN)
    got = sorted([(r.doc_id, r.ids, bytes(r.decoded)) for r in coded.collect()], key=str)
    assert got == sorted([(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows()], key=str)
    back = bpe.decode_ids(coded, MULTI_RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((t or "").encode() for _, t, *_ in rows())
    assert bpe.encode_texts(empty, MULTI_RANKS, public_tokenizers.PATTERN).count() == 0
    codec = bpe.RankFile(MULTI_RANKS, public_tokenizers.PATTERN)
    for text in (LONG, "ab1 " * 500, "a\n\n  b" * 300, "x" * 3000, "don't  " * 200):
        parts = bpe.safe_parts(text, 64)
        assert "".join(parts) == text
        assert [i for p in parts for i in library.encode_ordinary(p)] == library.encode_ordinary(text)
        assert codec.decode(codec.encode(text)[3:5]) in text.encode()


def test_packing(docs, empty, monkeypatch):
    monkeypatch.setattr(packing, "BUFFER_TOKENS", 5000)
    got = packing.pack(docs, BYTE_BPE, 128).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for placed in sequences.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 128
    assert sum(r.length for r in got) == sum(len(whole_ids(t)) + 1 for _, t, *_ in rows())
    for (doc_id, n), found in pieces.items():
        if sum(r[0] == doc_id for r in rows()) == 1:
            text = next(r[1] for r in rows() if r[0] == doc_id)
            assert [i for _, ids in sorted(found) for i in ids] == whole_ids(text) + [0] and n == len(whole_ids(text)) + 1
    assert packing.pack(empty, BYTE_BPE).count() == 0


def test_balanced_packing_fills_and_balances():
    r = random.Random(5)
    sizes = [r.choice([1, 5, 30, 100, 333, 700, 1023, 1024, 1025, 5000]) for _ in range(900)]
    placed = packing.balanced(sizes, 1024)
    used, cost = defaultdict(int), defaultdict(float)
    for _, _, length, sequence, _ in placed:
        used[sequence] += length
        cost[sequence] += packing.LINEAR * length + packing.QUADRATIC * length**2
    assert max(used.values()) <= 1024 and len(used) == -(-sum(sizes) // 1024)
    for doc, size in enumerate(sizes):
        own = sorted((s, n) for d, s, n, *_ in placed if d == doc)
        assert sum(n for _, n in own) == size and own[0][0] == 0
    assert packing.balanced([], 8) == []


def test_quality_learns_and_scores_all(spark, docs, empty):
    good = [(i, prose(i, 60), 1) for i in range(0, 400, 2)]
    bad = [(i, " ".join(w + "!!" for w in prose(i, 40).upper().split()), 0) for i in range(1, 400, 2)]
    table = spark.createDataFrame(good + bad, "doc_id bigint, text string, quality int")
    labels = table.select("doc_id", "quality").unionAll(
        spark.createDataFrame([(None, 1), (5, None), (7, 9), (99999, 1)], "doc_id bigint, quality int")
    )
    model = quality.train(table.select("doc_id", "text"), labels)
    found = {r.doc_id: r for r in quality.score(table, model).withColumn("out", quality.held_out(F.col("doc_id"))).collect()}
    assert len(found) == 400
    for i, r in found.items():
        assert r.out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
    judged = [(r.score >= 0.5) == bool(r.quality) for r in found.values() if r.out]
    assert np.mean(judged) > 0.95
    scored = quality.score(docs, model)
    assert scored.columns == [*docs.columns, "score"] and scored.where("score IS NULL").count() == 0
    assert scored.count() == len(rows())
    none = quality.train(empty, labels)
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def vectors(spark):
    r = np.random.default_rng(11)
    data = [(i, r.normal(size=8).astype(float).tolist()) for i in range(400)]
    same = r.normal(size=8).tolist()
    data += [(1000 + i, same) for i in range(60)]
    data += [
        (2000, None), (2001, [0.0] * 8), (2002, [1.0, None] + [0.0] * 6), (2003, [float("nan")] * 8),
        (2004, [float("inf")] + [0.0] * 7), (2005, [2.0, 1.0]), (None, [1.0] * 8), (20, data[20][1]), (2006, []),
    ]
    return spark.createDataFrame(data, "vec_id bigint, embedding array<double>"), data


def nearest(data, asks, k, keep, change):
    kept = [(i, np.array(change([*v, *[0.0] * (8 - len(v))]))) for i, v in data if i is not None and keep(v)]
    out = set()
    for q, v in kept:
        if asks(q):
            found = sorted(((i, (w * v).sum()) for i, w in kept if i != q), key=lambda x: (-x[1], x[0]))[:k]
            out |= {(q, rank + 1, i, s) for rank, (i, s) in enumerate(found)}
    return out


def finite(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_quality_trees_walk_as_scored():
    """The gathers over flat arrays against a walk of each tree, node by node."""
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(400, len(quality.FEATURES))), 1)
    model = quality.HistogramTrees(rounds=12, depth=3).fit(x, (x[:, 2] * x[:, 5] > x[:, 0]).astype(float))

    def walk(row) -> float:
        margin = model.base
        for feature, value, leaf in zip(model.feature, model.value, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > value[node])
            margin += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-margin))

    assert len(model.feature) == 12 and len(np.unique(model.feature)) > 3
    np.testing.assert_allclose(model.score(x), [walk(row) for row in x], rtol=0, atol=1e-12)


def test_quality_statistics_by_plain_counts():
    text = "One two TWO two\n\nsix 42!\n" + "é" * 3
    got = dict(zip(quality.FEATURES, quality.statistics(text)))
    n = len(text.encode())
    words = text.encode().split()
    want = {
        "bytes": n, "words": 7, "lines": 4, "word_max": 6, "word_mean": sum(map(len, words)) / 7,
        "distinct_words": 6 / 7, "top_word": 2 / 7, "distinct_pairs": 6 / 7, "distinct_lines": 1, "line_max": 15,
        "upper": 4 / n, "digit": 2 / n, "space": 4 / n, "newline": 3 / n, "beyond_ascii": 6 / n, "sign": 1 / n,
        "sign_33": 1 / n,
    }
    assert {k: round(got[k], 12) for k in want} == {k: round(v, 12) for k, v in want.items()}
    assert quality.statistics("") == [0.0] * len(quality.FEATURES)


def test_permutation_index(spark):
    df, data = vectors(spark)
    got = permutation_index.search(df, F.col("vec_id") % 20 == 0, k=5, share=1.0)
    want = nearest(data, lambda i: i % 20 == 0, 5, lambda v: finite(v) and any(v), lambda v: v)
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got.collect()} == {
        (*x[:3], round(x[3], 9)) for x in want
    }
    assert permutation_index.search(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("kind", ["plain", "unequal", "third", "half"])
def test_permutation_index_recall(spark, monkeypatch, kind):
    """With the candidates cut to 12 % at any size: 2,000 vectors as they are, of
    unequal lengths, and with a third and a half of the rows copies of one."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    matrix = np.array(given.embedding.tolist(), dtype=float)
    if kind == "unequal":
        matrix *= np.random.default_rng(1).uniform(0.5, 2, len(matrix))[:, None]
    if kind in ("third", "half"):
        step = {"third": 3, "half": 2}[kind]
        matrix[1::step] = matrix[1]
    df = spark.createDataFrame(list(zip(given.vec_id.tolist(), matrix.tolist())), "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(permutation_index, "LEAST", 20)
    got = defaultdict(list)
    for r in permutation_index.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    ids = given.vec_id.to_numpy()
    caught = []
    for at in np.flatnonzero(ids % 20 == 0):
        score = (matrix * matrix[at]).sum(1)
        best = [i for i in ids[np.lexsort((ids, -score))] if i != ids[at]][:20]
        caught.append(len(set(best) & set(got[ids[at]])) / 20)
    assert len(got) == len(caught)
    assert np.mean(caught) >= 0.9 and min(caught) >= 0.5, (np.mean(caught), min(caught))


def test_permutation_index_keeps_ids_of_equal_vectors(spark):
    """Own ids that repeat, in one vector and in several, take no place of others."""
    one, other = [1.0, 0.0], [0.9, 0.1]
    rows = [(20, one)] * 9 + [(20, other)] * 9 + [(i, one) for i in range(101, 109)] + [(7, other), (7, other), (8, other)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = permutation_index.search(df, F.col("vec_id") == 20, k=10).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [*range(101, 109), 7, 7]


@pytest.mark.parametrize("few", [True, False])
def test_exact_topk(spark, monkeypatch, few):
    from cohortlens.llm import vectors as blocks

    if not few:
        monkeypatch.setattr(blocks, "BROADCAST_BLOCKS", 0)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "ROTATION_ROWS", 32)
    df, data = vectors(spark)
    got = topk.search(df, F.col("vec_id") % 5 == 0, k=7, scale=64)
    floor = lambda v: [float(np.floor(64 * x)) for x in v]
    want = nearest(data, lambda i: i % 5 == 0, 7, finite, floor)
    assert {tuple(r) for r in got.collect()} == {(*x[:3], int(x[3])) for x in want}
    assert topk.search(df.limit(0), F.lit(True)).count() == 0


def test_signatures_estimate_similarity():
    r = np.random.default_rng(2)
    pool = common.mix(r.integers(1, 1 << 60, 900).astype(np.uint64))
    sets = [np.sort(pool[:600]), np.sort(pool[150:750]), np.sort(pool[:3]), np.sort(pool[600:602]), np.sort(pool[:600])]
    found = superminhash.signatures(sets, 160)
    assert (found != superminhash._EMPTY).all()
    assert (found[0] == found[4]).all()
    assert abs((found[0] == found[1]).mean() - 450 / 750) < 0.12
    assert (found[0] == found[3]).mean() == 0
    assert superminhash.signatures([], 10).shape == (0, 10)
    # The early stop changes nothing: each set alone gives the same registers.
    for s, row in zip(sets, found):
        assert (superminhash.signatures([s], 160)[0] == row).all()


def linked(table, words, threshold=80):
    sets = []
    for _, text in table:
        w = (text or "").encode().lower().split()
        size = min(words, len(w))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set())
    parent = list(range(len(table)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    key = lambda i: (table[i][0] is None, table[i][0] or 0, i)
    for a in range(len(table)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both and 100 * both >= threshold * either:
                x, y = sorted((root(a), root(b)), key=key)
                parent[y] = x
    out = []
    for i, (doc_id, _) in enumerate(table):
        least = table[root(i)][0]
        out.append((doc_id, len(sets[i]), least, doc_id is None and least is None or doc_id == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(docs, empty, words):
    got = superminhash.near_duplicates(docs, words)
    found = sorted([tuple(r) for r in got.collect()], key=str)
    assert found == linked([r[:2] for r in rows()], words)
    assert superminhash.near_duplicates(empty, words).count() == 0
    kept = superminhash.drop_near_duplicates(docs, words)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in found if r[3]}


def test_near_duplicate_chain(spark):
    """Links of a chain are found although its ends are unlike."""
    words = prose(50, 300).split()
    table = [(100 - i, " ".join(words[i * 12 : i * 12 + 150])) for i in range(10)]
    table += [(200 + i, " ".join([*words[:140], *prose(60 + i, 6).split()])) for i in range(8)]
    df = spark.createDataFrame(table, "doc_id bigint, text string")
    assert sorted([tuple(r) for r in superminhash.near_duplicates(df, 2).collect()], key=str) == linked(table, 2)


def test_rows_of_one_id_are_told_apart(spark):
    """Links follow each row's own text, although ids repeat."""
    one, two = prose(70, 60), prose(71, 60)
    table = [(1, one), (1, two), (2, one + " more"), (3, two + " more"), (4, prose(72, 60))]
    df = spark.createDataFrame(table, "doc_id bigint, text string")
    assert sorted([tuple(r) for r in superminhash.near_duplicates(df, 2).collect()], key=str) == linked(table, 2)


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)]
    edges += [(500, 500 + i) for i in range(1, 300)]
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = common.components(spark.createDataFrame(edges, "a bigint, b bigint"), "test")
    assert sorted(tuple(x) for x in got.collect()) == sorted((v, root(v)) for v in list(parent))


def passages(table, size):
    seen = {}
    cut = [(d if d is not None else -1, (t or "").encode().split()) for d, t in table]
    for d, w in cut:
        for k in range(len(w) - size + 1):
            key = b" ".join(w[k : k + size])
            seen[key] = min(d, seen.get(key, d))
    out = []
    for (doc_id, _), (d, w) in zip(table, cut):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - size + 1):
            if seen[b" ".join(w[k : k + size])] < d:
                gone[k : k + size] = True
        out.append((doc_id, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def strings(table, size):
    count = defaultdict(int)
    raw = [(t or "").encode() for _, t in table]
    for b in raw:
        for k in range(len(b) - size + 1):
            count[b[k : k + size]] += 1
    out = []
    for (doc_id, _), b in zip(table, raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if count[b[k : k + size]] > 1:
                gone[k : k + size] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [3, 50])
def test_passages(docs, empty, monkeypatch, size):
    monkeypatch.setattr(repeats, "BATCH_BYTES", 3000)
    monkeypatch.setattr(repeats, "BUCKET_WINDOWS", 3000)
    got = recompression.remove_repeated_passages(docs, size)
    assert got.columns == [*docs.columns, "n_words", "n_removed"]
    found = sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()], key=str)
    assert found == passages([r[:2] for r in rows()], size)
    assert recompression.remove_repeated_passages(empty, size).count() == 0


@pytest.mark.parametrize("size", [100, 400])
def test_strings(docs, empty, monkeypatch, size):
    monkeypatch.setattr(repeats, "BATCH_BYTES", 3000)
    monkeypatch.setattr(repeats, "BUCKET_WINDOWS", 3000)
    got = suffixes.remove_repeated_strings(docs, size)
    found = sorted(
        [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.collect()], key=str
    )
    assert found == strings([r[:2] for r in rows()], size)
    assert suffixes.remove_repeated_strings(empty, size).count() == 0


def short_rows() -> list[tuple]:
    texts = [None, "", " ", "one", *(prose(700 + i, 20) for i in range(12)), prose(700, 20)]
    return [(i, text, "x", None) for i, text in enumerate(texts)]


@pytest.mark.parametrize("apart", [True, False])
@pytest.mark.parametrize(
    "operator, whole",
    [(recompression.remove_repeated_passages, lambda t: " ".join(t.split())), (suffixes.remove_repeated_strings, str)],
)
def test_texts_without_a_window(spark, operator, whole, apart):
    """Short, empty and null texts only, one row per partition or all in one: nothing goes."""
    ship_package(spark)
    table = short_rows()
    assert max(len(r[1] or "") for r in table) < 400 < sum(len(r[1] or "") for r in table)
    found = operator(spark.createDataFrame(spark.sparkContext.parallelize(table, len(table) if apart else 1), SCHEMA))
    got = {r.doc_id: (r.text, r.n_removed) for r in found.collect()}
    assert got == {i: (whole(t or ""), 0) for i, t, *_ in table}


def test_equal_windows_have_equal_anchors():
    """Anchors follow from a window's words, whatever stands around it."""
    r = random.Random(4)
    for trial in range(30):
        vocabulary = [f"w{i}" for i in range(r.choice([1, 2, 5, 300]))]
        core = r.choices(vocabulary, k=50)
        texts = [" ".join([*r.choices(vocabulary, k=r.randint(0, 40)), *core, *r.choices(vocabulary, k=r.randint(0, 40))]) for _ in range(6)]
        key, owner, low, high = recompression.anchors(texts, 50)
        prints = recompression.windows(texts, 50)
        seen = {}
        for k, o, a, b in zip(key, owner, low, high):
            for s in range(a, b + 1):
                assert seen.setdefault(prints[o][s], k) == k


def test_windows_that_overlap_share_their_anchor():
    r = random.Random(5)
    texts = [" ".join(f"w{r.randint(0, 3000)}" for _ in range(2000)) for _ in range(5)]
    key, *_ = recompression.anchors(texts, 50)
    assert len(key) < 10_000 / 11


def test_parities_rule_out_no_link(spark):
    r = np.random.default_rng(8)
    base = r.integers(0, 2**63, 150, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k:], r.integers(0, 2**63, k, dtype=np.uint64)])) for k in (0, 5, 16, 17, 28, 60)]
    sets.append(np.unique(r.integers(0, 2**63, 40, dtype=np.uint64)))
    rows = [(i, len(s), odd.tolist()) for i, (s, odd) in enumerate(zip(sets, superminhash.parities(sets)))]
    one = spark.createDataFrame(rows, "a int, n bigint, odd array<bigint>")
    two = spark.createDataFrame(rows, "b int, m bigint, odd_b array<bigint>")
    kept = {(x.a, x.b) for x in one.crossJoin(two).where(superminhash._may_be_linked(80)).collect()}
    alike = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    near = {(i, j): alike(a, b) for i, a in enumerate(sets) for j, b in enumerate(sets)}
    assert {p for p, share in near.items() if share >= 0.8} <= kept
    assert not {p for p, share in near.items() if share < 0.7} & kept
