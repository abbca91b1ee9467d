"""Near-duplicate groups by SuperMinHash (Ertl 2017), banding and exact checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import Hashes, components, mix, sized_broadcast, small_batches, texts_of

#: Bands and registers of a band.  A pair at similarity 0.8 misses every band with
#: probability (1 - 0.8^5)^32, about 3 in a million.
BANDS, WIDTH = 32, 5

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_HASHES = Hashes()

#: Words of 64 parities that a set is summed up in.
PARITIES = 16

SETS = (
    "doc_id bigint, n_shingles bigint, g bigint, h bigint, bands array<bigint>, low array<tinyint>,"
    " odd array<bigint>"
)

#: Share of equal registers below which a pair that shares a bucket is not checked.
#: At similarity 0.8 the share of 160 registers is 6 standard deviations above it.
AGREEING = 0.6


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words, A-Z lower case.

    Fewer words than that are one shingle; a text without words has none.
    """
    found = _HASHES.of(text.encode("utf-8", "surrogatepass").lower().split())
    if not len(found):
        return found
    size = min(words, len(found))
    out = np.full(len(found) - size + 1, size, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + found[i : i + len(out)])
    return np.unique(out)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash of each set: m registers (step << 32 | draw), one row per set.

    Step j of an element draws a value and swaps two places of its permutation, so
    the element offers j + value to one more register.  A register keeps the least
    offer, and later steps offer more, so a set is done at the first step after
    which all its registers are filled.
    """
    n = len(sets)
    registers = np.full(n * m, _EMPTY)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    element = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    place = np.zeros((0, m), np.uint8)
    for j in range(m):
        if not len(element):
            break
        draw = mix(element + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        k = (j + ((draw >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32))).astype(np.int64)
        offer = np.uint64(j << 32) | (draw & np.uint64(0xFFFFFFFF))
        if j == 0:
            slot = k
        else:
            rows = np.arange(len(element))
            slot = place[rows, k].astype(np.int64)
            place[rows, k] = place[:, j]
        np.minimum.at(registers, owner * m + slot, offer)
        open_sets = (registers.reshape(n, m) == _EMPTY).any(1)
        active = open_sets[owner]
        if j == 0:
            element, owner = element[active], owner[active]
            place = np.tile(np.arange(m, dtype=np.uint8), (len(element), 1))
            place[np.arange(len(element)), k[active]] = 0
        else:
            element, owner, place = element[active], owner[active], place[active]
    return registers.reshape(n, m)


def bands_of(registers: np.ndarray, bands: int, width: int) -> np.ndarray:
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(registers), 1))
    for i in range(width):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + registers[:, i : bands * width : width])
    return out.view(np.int64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """PARITIES longs for each set: a bit says whether an odd number of shingles fell on
    it.  Two sets differ in at least as many shingles as bits."""
    n, bits = len(sets), 64 * PARITIES
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    element = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    spot = owner * bits + (element % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(spot, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").reshape(n, PARITIES)


def _may_be_linked(threshold: int) -> Column:
    """Whether the parities of a pair (n, odd; m, odd_b) leave the threshold in reach.  At
    or above it at most (n + m) * (100 - threshold) / (100 + threshold) shingles differ,
    so no link is lost."""
    differing = sum(
        F.bit_count(F.col("odd")[i].bitwiseXOR(F.col("odd_b")[i])).cast("bigint") for i in range(PARITIES)
    )
    return differing * (100 + threshold) <= (F.col("n") + F.col("m")) * (100 - threshold)


def least_size(threshold: int) -> int:
    """Sets below this size are similar only to equal sets."""
    size = 1
    while 100 * size < threshold * (size + 1):
        size += 1
    return size


def _sketch(words: int, bands: int, width: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, words) for text in texts_of(batch)]
            large = [i for i, s in enumerate(sets) if len(s) >= least]
            registers = signatures([sets[i] for i in large], bands * width)
            lists: list = [[]] * len(sets)
            lows: list = [[]] * len(sets)
            odds: list = [[]] * len(sets)
            odd = parities([sets[i] for i in large])
            for i, row, low, bits in zip(large, bands_of(registers, bands, width), registers.astype(np.int8), odd):
                lists[i], lows[i], odds[i] = row, low, bits
            prints = _prints(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(prints[:, 0]),
                    pa.array(prints[:, 1]),
                    pa.array(lists, pa.list_(pa.int64())),
                    pa.array(lows, pa.list_(pa.int8())),
                    pa.array(odds, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "g", "h", "bands", "low", "odd"],
            )

    return run


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit fingerprints of whole sets, as two longs each."""
    import xxhash

    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]), "<i8").reshape(-1, 2)


def _elements(words: int):
    """The set of each row's text, where it is the one that the row's id names: rows
    of one doc_id may differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, words) for text in texts_of(batch)]
            named = np.array([i["g"] for i in batch.column("id").to_pylist()], np.int64) == _prints(sets)[:, 0]
            found = pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "elements"]
            )
            yield found.filter(pa.array(named))

    return run


def _verified(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= threshold * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80, bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Documents are linked when 100 * intersection >= threshold * union of their
    shingle sets; a component is all that links reach, and its id the smallest
    doc_id in it.  A text without words (null, empty, white space) has no shingles
    and is linked with nothing.  Rows with equal sets are linked; rows of one id
    count apart.  A null doc_id is above all others, and is null in the result.
    Extra columns are ignored.

    Equal sets become one class first, so copies meet only in an aggregate.  In each
    band bucket every class is checked against one of the bucket's, chosen by a hash
    of class and bucket, so a class meets different ones in its buckets; checked
    links are merged.  A bucket that still holds several components then has pairs
    across components checked, and no others: those whose registers agree often
    enough and whose parities do not rule out a link.  Sizes that cannot reach the threshold are never paired.  All checks
    compare full sets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    least = least_size(threshold)
    sketched = materialize(
        docs.select("doc_id", "text").mapInArrow(_sketch(words, bands, width, least), SETS), "sketches"
    ).withColumn("did", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    classes = materialize(
        sketched.where("n_shingles > 0").groupBy("g", "h").agg(
            F.min("did").alias("did"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
            F.first("low").alias("low"), F.first("odd").alias("odd"),
        ).select("g", "h", F.struct("did", "g").alias("id"), "n", "bands", "low", "odd"),
        "classes",
    )
    posted = classes.where(F.col("n") >= least).select("id", "n", F.explode("bands").alias("key"))
    # Nearly all buckets hold one class: they leave with their key alone.  Tables are written
    # first, so that a join has two plain sides, of which hot keys can be split.
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    posted = materialize(posted.join(sized_broadcast(materialize(shared, "shared")), "key"), "buckets")
    drawn = F.struct(F.xxhash64("key", "id"), "id", "n")
    first = sized_broadcast(materialize(posted.groupBy("key").agg(F.min(drawn).alias("p")), "pivots"))
    similar_size = (F.least("n", "m") * 100 >= F.greatest("n", "m") * threshold)
    star = materialize(
        posted.join(first, "key")
        .select(F.col("p.id").alias("a"), F.col("id").alias("b"), "n", F.col("p.n").alias("m"))
        .where((F.col("a") != F.col("b")) & similar_size)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "stars",
    )

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that are linked, written."""
        ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
        ids = materialize(ids, "ids")
        hashed = docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("did"), "text")
        sets = hashed.join(sized_broadcast(ids.select("id.did", "id")), "did")
        kind = "struct<did:bigint,g:bigint>"
        sets = materialize(
            sets.select("id", "text").mapInArrow(_elements(words), f"id {kind}, elements binary"), "sets"
        )
        joined = (
            pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")
            .select("a", "b", "x", "y")
        )
        return materialize(joined.mapInArrow(_verified(threshold), f"a {kind}, b {kind}"), name)

    links = checked(star, "links")
    grouped = components(links, "components")
    labelled = posted.join(grouped, "id", "left").withColumn("label", F.coalesce("component", "id"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("u")).where("l <> u").select("key")
    mixed = sized_broadcast(materialize(mixed, "mixed"))
    open_rows = materialize(labelled.join(mixed, "key").select("key", "id", "n", "label").distinct(), "open")
    registers = classes.join(sized_broadcast(materialize(open_rows.select("id").distinct(), "ids")), "id").select("id", "low", "odd")
    open_rows = materialize(open_rows.join(registers, "id"), "open")
    other = open_rows.select(
        "key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("label").alias("label_b"), F.col("low").alias("low_b"),
        F.col("odd").alias("odd_b"),
    )
    equal = F.aggregate(
        F.zip_with("low", "low_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x
    )
    across = (
        open_rows.withColumnRenamed("id", "a")
        .join(other, "key")
        .where((F.col("label") < F.col("label_b")) & similar_size & _may_be_linked(threshold))
        .where(equal >= int(AGREEING * bands * width))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    across = materialize(across.join(star, ["a", "b"], "left_anti"), "across")
    if not across.isEmpty():
        more = checked(across, "links")
        if not more.isEmpty():
            grouped = components(links.unionAll(more), "components")
    reached = classes.select("id", "g", "h").join(grouped, "id", "left").select(
        "g", "h", F.coalesce(F.col("component.did"), F.col("id.did")).alias("reach")
    )
    answer = sketched.join(reached, ["g", "h"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("reach")).otherwise(F.col("did"))
    return answer.select(
        "doc_id", "n_shingles",
        F.when(component < (1 << 63) - 1, component).alias("component_id"),
        (F.col("did") == component).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that of smallest
    doc_id.  Rows of one doc_id stay or go together, and stay if any of them is kept."""
    gone = materialize(
        near_duplicates(docs, words, threshold).groupBy("doc_id").agg(F.max("kept").alias("kept"))
        .where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.lit(1).alias("_one")),
        "dropped",
    )
    small = sized_broadcast(gone)
    joined = docs.join(small, docs["doc_id"].eqNullSafe(small["_gone"]), "left")
    return joined.where(small["_one"].isNull()).select(*(docs[c] for c in docs.columns))
