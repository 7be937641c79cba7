"""One document of each group of near copies: Jaccard similarity of five-word shingle sets of 0.8 or more.

A SimHash distance that finds copies at 0.8 is some 15 of 64 bits, which no index of masked patterns prunes; so this stage takes
its candidates from MinHash bands. Two sets of similarity s share one of `BANDS` bands of `ROWS` values with the chance
1 - (1 - s^ROWS)^BANDS, 0.9999 at 0.8. Each candidate pair's similarity is then worked out from both whole sets, so that nothing
goes by a chance meeting.

Texts with equal sets are one node. First every node is checked against one other that shares a bucket with it: that with the most
neighbours, which lies in the middle of a group of near copies, so a large group grows together with one pair for each node. For
nodes that still share a bucket with another component, pairs are found by exact prefix filtering: with shingles in order of rarity,
two similar sets share one so early in both that enough can follow. A copy with many shingles of its own, as most that the first
step leaves over, has nothing but those there and meets nobody, so no group gives a square of pairs.

Defined results: a text of fewer words than a shingle has one shingle, its words; texts without words are copies of each other. Of
a component stays the row with the smallest doc_id, null last, among several the smallest by text; ids may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize
from .simhash import _LOWER, SEED, components, first_of_each, text_key

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 7
_RNG = np.random.default_rng(SEED)
_MULTIPLIERS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes (uint64) of a text's word shingles."""
    from xxhash import xxh64_digest

    w = text.encode().translate(_LOWER).split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(shingle, len(w))
    pairs = zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.unique(np.frombuffer(b"".join([xxh64_digest(joined[s:e], SEED) for s, e in pairs]), ">u8").astype(np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band; none for an empty set."""
    from xxhash import xxh64_intdigest

    if not len(found):
        return np.zeros(0, np.uint64)
    # The upper half is mixed in first, as the low bits of a product depend on the low bits of its factors only.
    mixed = found ^ (found >> np.uint64(32))
    least = np.array([(mixed * m + a).min() for m, a in zip(_MULTIPLIERS, _ADDENDS)], np.uint64)
    return np.array([xxh64_intdigest(least[i * ROWS : i * ROWS + ROWS].tobytes(), i) for i in range(BANDS)], np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _marks(documents: DataFrame) -> DataFrame:
    """(doc_id, key, node, bands) of every row: the hash of its text, of its set, and the set's bands."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t.as_py()) for t in part.column(2)]
                node = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                marks = pa.array([bands(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node), marks], ["doc_id", "key", "node", "bands"])

    return documents.select(F.col("doc_id").cast("bigint"), text_key().alias("key"), "text").mapInArrow(run, "doc_id bigint, key bigint, node bigint, bands array<bigint>")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, found): the sets of rows (node, text), as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], ["node", "found"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, found binary")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda c, i: np.frombuffer(batch.column(c)[i].as_py(), np.uint64)
            ok = [similarity(of(2, i), of(3, i)) >= least for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in (0, 1)], ["a", "b"])

    left, right = sets.select(F.col("node").alias("a"), F.col("found").alias("x")), sets.select(F.col("node").alias("b"), F.col("found").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _to_the_middle(buckets: DataFrame) -> DataFrame:
    """(a, b), a < b: each node with the other node of its buckets that has most neighbours. Only minima by bucket and by node are taken."""
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.struct("order", "node")
    now = materialize(buckets.join(buckets.join(sizes, "bucket").groupBy("node").agg((-F.sum("n")).alias("order")), "node"), "ranked")
    first = now.groupBy("bucket").agg(F.min(ranked).alias("x"))
    second = now.join(first, "bucket").filter(F.col("node") != F.col("x.node")).groupBy("bucket").agg(F.min(ranked).alias("y"), F.min("x").alias("x"))
    met = now.join(second, "bucket").select("node", F.when(F.col("x.node") != F.col("node"), F.col("x")).otherwise(F.col("y")).alias("z"))
    best = met.groupBy("node").agg(F.min("z").alias("z")).select("node", F.col("z.node").alias("other"))
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _left_over(buckets: DataFrame, near: DataFrame) -> DataFrame:
    """(node, c): the nodes of buckets that hold several components, with their components."""
    now = buckets.join(components(near), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c"))
    split = now.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("bucket")
    return now.join(split, "bucket").select("node", "c").distinct()


def _by_prefix(now: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: all pairs of nodes of now, of different components, that may have at least that similarity."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, c, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = np.frombuffer(raw, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), node)), pa.array(np.full(len(found), c)), pa.array(np.full(len(found), len(found))), pa.array(found)], ["node", "c", "n", "s"])

    own = now.join(sets, "node").select("node", "c", "found").mapInArrow(explode, "node bigint, c bigint, n bigint, s bigint")
    own = materialize(own, "shingles")
    common = own.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "s"))
    early = own.join(common, "s").withColumn("at", place).filter((F.col("at") <= F.floor(F.col("n") * (1 - least) + 1e-9) + 1) & (F.col("df") > 1)).select("s", "node", "c", "n", "at")
    early = materialize(early, "early")
    x, y = (early.select("s", *[F.col(k).alias(k + side) for k in ("node", "c", "n", "at")]) for side in "xy")
    # What both can still share from here on, and what two sets of these sizes share at that similarity.
    left = F.least(F.col("nx") - F.col("atx"), F.col("ny") - F.col("aty")) + 1
    met = x.join(y, "s").filter((F.col("nodex") < F.col("nodey")) & (F.col("cx") != F.col("cy")) & (left >= (F.col("nx") + F.col("ny")) * (least / (1 + least)) - 1e-6))
    return met.select(F.col("nodex").alias("a"), F.col("nodey").alias("b")).distinct()


def roots(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, node, root) of every row; rows of one component have the same root."""
    marks = materialize(_marks(documents), "minhash")
    keys = marks.groupBy("node").agg(F.min("key").alias("key"))
    # Copies meet before their bands do; equal sets have equal bands.
    placed = marks.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    buckets = materialize(placed.join(shared, "bucket"), "buckets")
    wanted = keys.join(buckets.select("node").distinct(), "node", "left_semi")
    # Two rows of one text have one set; the first will do.
    texts = documents.select(text_key().alias("key"), "text").join(wanted, "key").groupBy("node").agg(F.first("text").alias("text"))
    sets = materialize(_sets(texts), "sets")
    near = materialize(_similar(materialize(_to_the_middle(buckets), "partners"), sets, least), "near")
    rest = materialize(_by_prefix(_left_over(buckets, near), sets, least), "rest")
    label = components(near.unionAll(materialize(_similar(rest, sets, least), "near")))
    return marks.join(label, "node", "left").select("doc_id", "key", marks["node"], F.coalesce("component", marks["node"]).alias("root"))


def one_of_each(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each component, with all its columns."""
    return first_of_each(documents, roots(documents, least))
