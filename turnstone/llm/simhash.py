"""SimHash near-duplicate detection with a Gray-order hierarchical index.

Fingerprints that differ in at most d bits agree on some upper node of the index: with the 64 bits cut into k segments, at
least k - d segments are equal, so each choice of k - d segments is a masked bit pattern, and pairs meet under a common one.
k is the least number for which an upper node holds few fingerprints at the size of the corpus. Under an upper node,
fingerprints are sorted by Gray rank, which puts similar patterns side by side, and blocks of consecutive ones share masked
patterns on each level. A search goes down from the upper node and adds up the differences to the patterns it passes (each
level counts only the bits that the level above left open); a block whose sum exceeds d is pruned as a whole, and so is one
whose members already are in the searcher's own group. What an upper node yields is a forest: at most one link for each of
its fingerprints, never all pairs.

Upper nodes with more than `node_rows` fingerprints are dealt to several tasks by salts, two salts to a task, so that all
pairs still meet. Components come from alternating large and small stars over the links, until nothing changes.

Defined results: a null or empty text has the fingerprint zero, which links like any other; a null doc_id takes part, and is
never the smallest of a component that has others; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import column, materialize

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Fingerprints that an upper node may hold on average, and in one task.
NODE_MEAN = 2_000
NODE_ROWS = 20_000
FANOUT = 16
#: Searches that start together, and pairs of searches and blocks held at once.
SEARCHES = 2_048
FRONTIER = 500_000
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    from xxhash import xxh64_digest

    w = text.encode().translate(_LOWER).split() if text else []
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(shingle, len(w))
    total, n = np.zeros(64, np.int64), len(w) - k + 1
    for at in range(0, n, 65_280):
        pairs = zip(starts[at : min(n, at + 65_280)].tolist(), ends[at + k - 1 : min(n, at + 65_280) + k - 1].tolist())
        raw = b"".join([xxh64_digest(joined[s:e], SEED) for s, e in pairs])
        rows = len(raw) // 8
        bits = np.zeros((-(-rows // 255) * 255, 64), np.uint8)
        bits[:rows] = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, 8), axis=1)
        total += bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = np.array([fingerprint(t.as_py(), shingle) for t in part.column(1)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the reflected Gray order."""
    g = fp.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        g = g ^ (g >> np.uint64(s))
    return g


def upper_masks(n: int, distance: int = DISTANCE, node_mean: int = NODE_MEAN) -> list[int]:
    """Masks such that codes within the distance agree under one of them, for n codes."""
    for k in range(distance + 1, 33):
        cuts = [64 * i // k for i in range(k + 1)]
        parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
        same = k - distance
        if n / 2 ** sum(sorted(bin(p).count("1") for p in parts)[:same]) <= node_mean or k == 16:
            return [sum(c) for c in combinations(parts, same)]
    raise AssertionError


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest member of each group) after joining the groups of a[i] and b[i]."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def link_forest(fp: np.ndarray, node: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each node, all codes reachable over steps of at most the distance.

    fp and node: codes (uint64) and their upper nodes, sorted by node and Gray rank. Returns places; at most one link a place.
    """
    n = len(fp)
    label = np.arange(n)
    if n < 2:
        return label[:0], label[:0]
    near = np.flatnonzero((node[1:] == node[:-1]) & (np.bitwise_count(fp[1:] ^ fp[:-1]) <= distance))
    label = _merge(label, near, near + 1)
    first = np.searchsorted(node, node)
    # Levels of blocks: the bits that all members share, and their pattern.
    levels = []
    ones, zeros = fp.copy(), ~fp
    while True:
        levels.append((ones, ones | zeros))
        if len(ones) <= FANOUT:
            break
        cut = np.arange(0, len(ones), FANOUT)
        ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
    starts = [np.arange(0, n, FANOUT**d) for d in range(len(levels))]
    top = len(levels) - 1
    for begin in range(0, n, SEARCHES):
        q = np.arange(begin, min(n, begin + SEARCHES))
        q = q[first[q] < q]
        if not len(q):
            continue
        # A search looks only at places before its own, from the start of its node on, in at most some FANOUT blocks at first.
        depth = min(top, max(0, int(np.ceil(np.log(max(2, (q - first[q]).max())) / np.log(FANOUT))) - 1))
        lo, hi = first[q] // FANOUT**depth, (q - 1) // FANOUT**depth
        who = np.repeat(q, hi - lo + 1)
        block = np.arange(len(who)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1) + np.repeat(lo, hi - lo + 1)
        stack = [(depth, who, block, np.zeros(len(who), np.uint8), np.zeros(len(who), np.uint64))]
        while stack:
            depth, who, block, acc, seen = stack.pop()
            if len(who) > FRONTIER:
                for at in range(0, len(who), FRONTIER):
                    stack.append((depth, *(x[at : at + FRONTIER] for x in (who, block, acc, seen))))
                continue
            pattern, shared = levels[depth]
            acc = acc + np.bitwise_count((fp[who] ^ pattern[block]) & shared[block] & ~seen)
            ok = acc <= distance
            if not depth:
                ok &= (block < who) & (block >= first[who]) & (label[who] != label[block])
                label = _merge(label, who[ok], block[ok])
                continue
            low, high = np.minimum.reduceat(label, starts[depth])[block], np.maximum.reduceat(label, starts[depth])[block]
            ok &= ~((low == high) & (low == label[who]))
            who, block, acc, seen = who[ok], block[ok], acc[ok], (seen | shared[block])[ok]
            depth -= 1
            below = (block[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            who, acc, seen = np.repeat(who, FANOUT), np.repeat(acc, FANOUT), np.repeat(seen, FANOUT)
            ok = (below * FANOUT**depth < who) & ((below + 1) * FANOUT**depth > first[who])
            if ok.any():
                stack.append((depth, who[ok], below[ok], acc[ok], seen[ok]))
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _salted(nodes: DataFrame, masks: list[int], node_rows: int) -> DataFrame:
    """(mask, pattern, salt, fp): each code under each of its upper nodes; large nodes are dealt out so that each pair of salts meets."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    under = nodes.select("fp", F.posexplode(F.array(*[F.lit(m).cast("bigint") for m in signed])).alias("mask", "bits")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("bits")).alias("pattern"))
    large = under.groupBy("mask", "pattern").count().filter(F.col("count") > node_rows).select("mask", "pattern", F.ceil(2 * F.col("count") / F.lit(node_rows)).cast("int").alias("parts"))
    salted = under.join(large, ["mask", "pattern"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # Salt s meets every other t in the task (min, max).
    tasks = F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: F.least(t, own).cast("bigint") * F.col("parts") + F.greatest(t, own)))
    return salted.select("mask", "pattern", F.explode(tasks).alias("salt"), "fp")


def links(nodes: DataFrame, distance: int = DISTANCE, node_mean: int = NODE_MEAN, node_rows: int = NODE_ROWS) -> DataFrame:
    """(a, b): links between the distinct codes in nodes (column fp) that keep all of them connected that steps of at most the distance connect."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(fp: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            a, b = link_forest(fp.view(np.uint64), key, distance)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

        held: list[np.ndarray] = []
        size, number, last = 0, 0, None
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            head = np.vstack([rows[:1] if last is None else last[None], rows])
            key = number + np.cumsum((head[1:, :3] != head[:-1, :3]).any(axis=1))
            last, number = rows[-1], int(key[-1])
            held.append(np.column_stack([rows[:, 3], key]))
            size += len(rows)
            if size >= 4 * node_rows and held[0][0, 1] != number:
                every = np.vstack(held)
                cut = np.searchsorted(every[:, 1], number)
                yield run(np.ascontiguousarray(every[:cut, 0]), every[:cut, 1])
                held, size = [every[cut:]], len(every) - cut
        if held:
            every = np.vstack(held)
            yield run(np.ascontiguousarray(every[:, 0]), every[:, 1])

    masks = upper_masks(nodes.count(), distance, node_mean)
    # Gray rank in SQL: fp ^ fp>>1 ^ ... by doubling shifts; flipping the sign bit makes the signed order the unsigned one.
    dealt = _salted(nodes, masks, node_rows).repartition("mask", "pattern", "salt")
    rank = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        dealt = dealt.withColumn("rank", rank).withColumn("rank", F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", s)))
        rank = F.col("rank")
    dealt = dealt.withColumn("rank", F.col("rank").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")))
    return dealt.sortWithinPartitions("mask", "pattern", "salt", "rank").select("mask", "pattern", "salt", "fp").mapInArrow(search, "a bigint, b bigint")


def components(edges: DataFrame, label: str = "stars") -> DataFrame:
    """(node, component): the smallest node reachable from each end of the edges, by alternating large and small stars."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        now = materialize(large, label)
        least = now.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = now.join(least, now["a"] == least["u"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        now = materialize(small, label)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = state


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links, itself included) of every row."""
    docs = materialize(fingerprints(documents, shingle), "fingerprints")
    nodes = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    joined = nodes.join(components(links(nodes.select("fp"), distance)), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = joined.join(roots, "root").select("fp", "component_id")
    return docs.join(of, "fp").select("doc_id", "fp", "component_id")


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_key() -> Column:
    """What a row is known by beside its doc_id, which may be null or repeat."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def first_of_each(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """One row for each root of roots (doc_id, key, root), with all columns of documents: the smallest doc_id, null last, then the smallest key."""
    first = roots.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m"), F.count(F.lit(1)).alias("rows"))
    # The row's own columns stay together, so none of any name can meet those here.
    given = documents.select(F.struct(*[column(c) for c in documents.columns]).alias("given"), text_key().alias("own"), F.col("doc_id").cast("bigint").alias("its"))
    kept = given.join(first.select(F.col("m.doc_id").alias("id"), F.col("m.key").alias("key"), "rows"), (F.col("own") == F.col("key")) & F.col("its").eqNullSafe(F.col("id")))
    # Only a row that isn't alone in its component may stand several times.
    again = kept.filter("rows > 1").groupBy("id", "key").agg(F.min_by("given", F.xxhash64(F.to_json("given"))).alias("given"))
    return kept.filter("rows = 1").select("given").unionAll(again.select("given")).select("given.*")


def roots(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(key, root) of every text; texts of one component have the same root."""
    found = near_duplicates(documents.select(text_key().alias("doc_id"), "text"), shingle, distance)
    return found.groupBy(F.col("doc_id").alias("key")).agg(F.first("component_id").alias("root"))


def united(rows: DataFrame, other: DataFrame) -> DataFrame:
    """(doc_id, key, root) of rows (doc_id, key, root), the components joined that share one of other (key, root)."""
    rows = materialize(rows.select("doc_id", "key", "root"), "roots")
    met = rows.join(other.withColumnRenamed("root", "of"), "key").groupBy("of", "root").agg(F.count(F.lit(1)).alias("n"))
    met = materialize(met, "met")
    low = met.groupBy("of").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    edges = met.join(low, "of").filter("root <> low").select(F.col("root").alias("a"), F.col("low").alias("b"))
    return rows.join(components(edges), F.col("root") == F.col("node"), "left").select("doc_id", "key", F.coalesce("component", "root").alias("root"))


def one_of_each(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each component, with all its columns."""
    of = roots(documents, shingle, distance)
    return first_of_each(documents, documents.select(F.col("doc_id").cast("bigint"), text_key().alias("key")).join(of, "key"))
