"""Conversation repair, shards and manifests on small tables with nulls, repeats, long
texts and clashing names, against SQL and plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import conversations, merkle, sharding
from cohortlens.llm.catalog import all_queries, all_sql
from compare import compare

TURNS = "conv_id bigint, turn bigint, role string, text string"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def conversation_rows() -> list[tuple]:
    r = random.Random(3)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]
    texts = ["Yes.", "No!", "open end", "", " \t\n", None, "Well? ", "é.", "a\nb.", "..."]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(r.randint(1, 9)):
            rows.append((conv, r.choice([turn, turn, turn, None]), r.choice(roles), r.choice(texts)))
    rows += [(100, t, r.choice(roles), f"turn {t % 7}." if t % 5 else "cut") for t in range(130)]
    rows += [(101, 0, "user", "Same.")] * 5 + [(102, None, None, None), (103, 2**40, "user", "x" * 300_000)]
    return rows


def document_rows() -> list[tuple]:
    r = random.Random(4)
    langs = ["en", "en", "en", "de", None, "é", "", "zz"]
    rows = [(i, f"text {i} " * r.randint(0, 9), r.choice(langs), r.choice(["a", None]), r.choice([i, None])) for i in range(150)]
    rows += [(None, "no id", "en", "b", 5), (None, "no id", "en", "b", 5), (200, None, "en", None, None)]
    rows += [(201, "same", "de", "b", 4)] * 7 + [(202, "y" * 300_000, "en", "b", 1), (-5, "", "one only", "", 0)]
    return rows


def tables(spark, path, **found) -> object:
    con = duckdb.connect()
    for name, (rows, schema) in found.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("segment", [1024, 4])
def test_repair_equals_sql(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    con = tables(spark, tmp_path, conversations=(conversation_rows(), TURNS))
    name = "op11_lr_repair"
    assert compare(spark, con, all_queries()[name], all_sql()[name], str(tmp_path)) is None


def plain_repair(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """All edits of a few rows with at most four insertions."""
    best = None
    ways = []
    for initial, kind in rows:
        dear = 5 if kind == conversations.DEAR else 0
        ways.append([("D", 2, "")] + ([] if kind == conversations.DOOMED else
                    [("K", dear, initial), ("R", 1 + dear, "u"), ("R", 1 + dear, "a")]))
    for path in itertools.product(*ways):
        for spots in itertools.product(range(3), repeat=len(rows) + 1):
            if sum(spots) > 4:
                continue
            for letters in itertools.product("ua", repeat=sum(spots)):
                left, audit, said, cost = list(letters), "", "", 5 * sum(spots)
                for gap, step in zip(spots, [*path, None]):
                    for _ in range(gap):
                        audit, said = audit + "I", said + left.pop(0)
                    if step:
                        audit, cost, said = audit + step[0], cost + step[1], said + step[2]
                if re.fullmatch("(s?(ua)+)?", said) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def test_parse_equals_all_edits():
    made = conversations.Repairer()
    assert made.tops <= 12
    r = random.Random(5)
    for _ in range(60):
        rows = [(r.choice("suaxu"), r.choice([0, 0, 0, 1, 2])) for _ in range(r.randint(0, 3))]
        assert made.finish(made.parse(0, rows)) == plain_repair(rows), rows


def test_segments_chain_to_the_whole():
    made = conversations.Repairer()
    r = random.Random(6)
    for _ in range(50):
        rows = [(r.choice("suax"), r.choice([0, 0, 1, 2])) for _ in range(r.randint(3, 40))]
        cut = sorted(r.sample(range(len(rows)), 2))
        whole = made.parse(0, rows)
        parts = [rows[: cut[0]], rows[cut[0] : cut[1]], rows[cut[1] :]]
        first, *rest = [{e: made.parse(e, p) for e in range(made.tops)} for p in parts]
        for part in rest:
            first = made.chain(first, part)
        assert made.finish(first[0]) == made.finish(whole)


def test_endless_stacks_are_refused():
    with pytest.raises(ValueError, match="left-recursively"):
        conversations.Repairer([("C", "B"), ("B", "P"), ("B", "PB"), ("P", "ua")])


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "S.", 7), (1, 1, "tool", "Q?", 7), (1, 2, "assistant", "A.", 7), (2, 0, "user", "", 7)]
    docs = spark.createDataFrame(rows, TURNS + ", place int")
    per, turns = conversations.repair(docs)
    assert [(r.place, r.action, r.role, r.text) for r in turns.orderBy("place").collect()] == [
        (0, "K", "system", "S."), (1, "R", "user", "Q?"), (2, "K", "assistant", "A.")
    ]
    assert {r.conv_id: (r.cost, r.audit, r.blank) for r in per.collect()} == {1: (1, "KRK", 0), 2: (2, "D", 1)}


def test_shards_equal_sql(spark, tmp_path):
    con = tables(spark, tmp_path, documents=(document_rows(), DOCS))
    name = "op12_rendezvous_shards"
    assert compare(spark, con, all_queries()[name], all_sql()[name], str(tmp_path)) is None


def test_a_new_shard_only_takes(spark):
    rows = spark.range(20_000).withColumn("slot", F.lit("mine")).withColumn("_at", F.lit(1)).withColumn("_shard", F.lit(2))
    weights = [1.0] * 9 + [3.0]
    found = sharding.assign_shards(rows, ["id"], weights, [1.0]).collect()
    assert len(found) == 20_000 and found[0].asDict().keys() == {"id", "_at", "_shard", "shard", "grown_shard", "slot"}
    assert all(r.grown_shard in (r.shard, 10) for r in found)
    moved = sum(r.grown_shard == 10 for r in found)
    assert abs(moved - 20_000 / 13) < 150
    assert abs(sum(r.shard == 9 for r in found) - 20_000 * 3 / 12) < 300
    for shard in range(10):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    # The old shards follow from the key and the weights alone.
    again = sharding.assign_shards(spark.range(100), ["id"], [*weights, 1.0]).collect()
    grown = {r.id: r.grown_shard for r in found}
    assert all(grown[r.id] == r.shard for r in again)


def test_written_shards(spark, tmp_path):
    rows = spark.range(300).withColumn("shard", F.lit("old"))
    sharding.write_shards(rows, f"{tmp_path}/out", ["id"], [1.0, 2.0], file_rows=50)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 300 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1}
    with pytest.raises(ValueError):
        sharding.assign_shards(rows, ["id"], [1.0, 0.0])


def test_manifest_equals_sql(spark, tmp_path):
    con = tables(spark, tmp_path, documents=(document_rows(), DOCS))
    name = "op13_merkle_manifest"
    assert compare(spark, con, all_queries()[name], all_sql()[name], str(tmp_path)) is None


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes: list[str], fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    steps = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + fanout, len(nodes))) for i in range(0, len(nodes), fanout)]
        for run in runs:
            for own in run:
                step = ("".join(nodes[i] for i in run if i < own), "".join(nodes[i] for i in run if i > own))
                for leaf in under[own]:
                    steps[leaf].append(step)
        under = [[leaf for i in run for leaf in under[i]] for run in runs]
        nodes = [sha("".join(nodes[i] for i in run)) for run in runs]
    return nodes[0], steps


@pytest.mark.parametrize("fanout", [2, 3, 7])
def test_manifest_of_any_fanout(spark, fanout):
    rows = [("b" if i % 3 else "a", i, f"t{i}") for i in range(333)] + [("c", 1, "lone")]
    docs = spark.createDataFrame(rows, "g string, i int, leaf string")
    made = merkle.manifest(docs, merkle.leaf_hash(F.col("leaf")), "g", "i", {"g": F.col("g"), "i": F.col("i"), "leaf": F.col("leaf")}, fanout)
    found = {(r.g, r.i): r for r in made.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()}
    assert len(found) == len(rows)
    tops, steps = {}, {}
    for g in "abc":
        own = [r for r in rows if r[0] == g]
        tops[g], proofs = plain_tree([sha(f"{len(t)}:{t}") for _, _, t in own], fanout)
        steps |= {(g, r[1]): p for r, p in zip(own, proofs)}
    root, above = plain_tree([tops[g] for g in "abc"], fanout)
    for (g, i), row in found.items():
        assert (row.subroot, row.root, row.folded) == (tops[g], root, root)
        assert [tuple(s) for s in row.proof] == steps[(g, i)] + above["abc".index(g)]


@pytest.mark.parametrize("name", ["op11_lr_repair", "op12_rendezvous_shards", "op13_merkle_manifest"])
def test_empty_tables(spark, tmp_path, name):
    tables(spark, tmp_path, documents=([], DOCS), conversations=([], TURNS))
    assert all_queries()[name](spark, str(tmp_path)).collect() == []
