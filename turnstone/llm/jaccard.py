"""Set similarity join on word shingles: all pairs of texts at a Jaccard similarity of 0.85 or more, by a partition of the universe.

Sets of a size band share a scheme: the tokens are hashed to m segments. Two sets of which the smaller has x tokens are similar
only if they differ in at most H(x) tokens, so of any segments with thresholds t_i (-1: not looked at, 0: equal, 1: one token
more or less) for which the sum of t_i + 1 is over H(x), one segment at least differs by no more than its threshold. Each set
indexes its segments under the scheme of its own band, and under that of the band below if a partner may be there; the smaller
set of a pair is the one that searches.

1. Every set's segments are keys; a key that one set alone has links nothing. Of m equal-or-not segments m - H at least must be
   equal, so sets with fewer keys in common with any others are left out, which leaves little but near copies.
2. In each bucket, sets are checked against the one in its middle. A large group of near copies becomes one component that way,
   with one pair for each set.
3. Sets whose segments still meet those of other components look for the rest. Copies that are too far from their group have tokens
   that few others have; they search by those, as segments of one token each, and nobody looks for them any more. In what is left,
   tokens that no other component has count as differences beforehand, and each segment's cost is counted: for equality, the sets of
   its bucket; for a threshold of one, those that its one-deletion neighbourhood meets. The H + 1 cheapest units are
   allocated, so segments that are common, as those of templates and shared passages, are passed over wherever others suffice.
4. All candidates are verified from both whole sets; components come from alternating stars.

Tokens are 64-bit hashes of shingles. Equal sets are one node, which is taken once from each task. Keys that stand out in a
bounded sample of texts are dealt over salts; in any other way they are treated alike.

Defined results: a text of fewer words than a shingle has one, its words; null texts and texts without words have no shingle and
are linked with nothing, so their component is their own doc_id; a null doc_id takes part and is never the smallest of a component
that has others; repeated rows give repeated rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize
from .simhash import _LOWER, components, text_key

SHINGLE = 4
PERCENT = 85
#: Largest size of a band by its smallest, segments by units needed, and the least number of segments.
SPREAD, SLACK, LEAST_SEGMENTS = 1.4, 1.2, 8
#: Texts sampled for keys that stand out, how often those occur among them at least, and the salts that they are dealt over.
SAMPLE, HOT, SALTS = 20_000, 20, 64
#: Candidates for each of its tokens that a set's search by tokens may meet, first and then; a dearer set searches by segments.
SEARCHES = (1, 16)
_ROWS, _WORDS = 256, 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TOP = np.uint64(1 << 63)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Hashes of the words met so far, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= _WORDS:
            self.clear()
        self[word] = found = xxh64_intdigest(word)
        return found


_hashes = _WordHashes()


def shingles(text: str | bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes (uint64) of a text's word shingles."""
    raw = text.encode() if isinstance(text, str) else text or b""
    w = raw.translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))
    k = min(shingle, len(w))
    found = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        found = mix(found + h[i : len(w) - k + 1 + i])
    return np.unique(found)


def most_apart(size: int, percent: int = PERCENT) -> int:
    """H: in how many tokens a set of that size differs at most from a similar one that isn't smaller."""
    return (100 - percent) * (100 * size // percent) // 100


@cache
def bands(percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The largest size and the number of segments of every band. Smaller sets are similar to none but their equals."""
    low = next(x for x in range(1, 10**6) if most_apart(x, percent))
    most, segments = [], []
    while low < 1 << 40:
        high = max(low, int(low * SPREAD), int(100 * low // percent) + 1)
        most.append(high)
        segments.append(max(LEAST_SEGMENTS, int(np.ceil(SLACK * (most_apart(high, percent) + 1)))))
        low = high + 1
    return np.array(most), np.array(segments)


def schemes(size: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(band, segments, equal segments that a pair needs) of the set's own band, and of the band below if a partner may be there."""
    most, segments = bands(percent)
    if not most_apart(size, percent):
        return []
    own = int(np.searchsorted(most, size))
    # Bands are wide enough for one below to do.
    below = [own - 1] if own and 100 * int(most[own - 1]) >= percent * size else []
    return [(k, int(segments[k]), int(segments[k]) - most_apart(min(size, int(most[k])), percent)) for k in (own, *below)]


def segment_keys(found: np.ndarray, band: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A key for each segment with its tokens, and by token its segment and the sum and base that the key is made of."""
    x = mix(found + np.uint64(0x51ED270B * (band + 1)))
    place = ((x >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    tokens = mix(x + np.uint64(1))
    total = np.zeros(segments, np.uint64)
    np.add.at(total, place, tokens)
    base = mix(np.uint64((band + 1) << 40) + np.arange(segments, dtype=np.uint64))
    return mix(total ^ base), place, total[place] - tokens, base


def _node(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(found.tobytes(), SHINGLE) >> 1


def _marks(documents: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of every row: doc_id, the hash of its text, its set as a node, the set's size, the units that a search needs, and by scheme the equal segments that a pair needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(2):
                s = shingles(t.as_py(), shingle)
                own, below = ([x[2] for x in schemes(len(s), percent)] + [0, 0])[:2]
                rows.append((_node(s), len(s), most_apart(len(s), percent) + 1, own, below))
            more = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], ["doc_id", "key", "node", "n", "units", "own", "below"])

    given = documents.select(F.col("doc_id").cast("bigint"), text_key().alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return given.mapInArrow(run, "doc_id bigint, key bigint, node bigint, n bigint, units bigint, own bigint, below bigint")


def _keys(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(key, node) of all segments of texts; a node below zero has the key under its own band. A task takes each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                keys, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
                for t in batch.column(0).slice(at, _ROWS):
                    s = shingles(t.as_py(), shingle)
                    node = _node(s)
                    if node in seen:
                        continue
                    seen.add(node)
                    for i, (band, segments, _) in enumerate(schemes(len(s), percent)):
                        keys.append(segment_keys(s, band, segments)[0])
                        nodes.append(np.full(segments, np.uint64(node) | (np.uint64(0) if i else _TOP), np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in (keys, nodes)], ["key", "node"])

    return texts.select(F.coalesce("text", F.lit("")).cast("binary")).mapInArrow(run, "key bigint, node bigint")


def _shared(keys: DataFrame, hot: list[int]) -> DataFrame:
    """(key, node, own): the keys that several nodes have, one of them under its own band. Hot keys, which are dealt out, count as such."""
    always = np.array(sorted(hot), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the last key: its last row, whether its nodes differ, whether the first is under its own band, whether the row still waits.
        held: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if held:
                key, node = np.append(held[0], key), np.append(held[1], node)
            first = np.append(True, key[1:] != key[:-1])
            new = first | np.append(True, node[1:] != node[:-1])
            start, group = np.flatnonzero(first), np.cumsum(first) - 1
            # Rows of a key are sorted, those under their own band first.
            differ, own = np.maximum.reduceat(node, start) != node[start], node[start] < 0
            if held:
                differ[0] |= held[2]
                own[0] = held[3]
            shared = differ & own
            if len(always):
                shared |= always[np.minimum(np.searchsorted(always, key[start]), len(always) - 1)] == key[start]
            give = shared[group] & new
            if held:
                give[0] &= held[4]
            held = (key[-1], node[-1], differ[-1], own[-1], not shared[-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[give]), pa.array(node[give] & np.int64((1 << 63) - 1)), pa.array(node[give] < 0)], ["key", "node", "own"])

    salt = F.when(F.col("key").isin(hot), F.pmod("node", F.lit(SALTS))).otherwise(0) if hot else F.lit(0)
    return keys.repartition("key", salt).sortWithinPartitions("key", "node").mapInArrow(run, "key bigint, node bigint, own boolean")


def _apart(x: Column, y: Column, percent: int) -> Column:
    """In how many tokens two similar sets of these sizes differ at most."""
    return F.floor((100 - percent) * (x + y) / (100 + percent) + 1e-9)


def _live(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (key, node, own, need, c, n, u, asks) of shared keys that may be of a pair of different components c.

    u of a set's tokens are in no other component, so a pair differs in 2 u + ny - nx tokens at least by the u of the smaller set x,
    and in 2 u - (ny - nx) by that of the larger one y. A row that doesn't ask goes if that is too many even for the smallest set that
    asks under its key, and a set goes if it has too few keys left for a pair.
    """
    mixed = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min(F.when(F.col("asks"), F.col("n"))).alias("least")).filter("low < high and least is not null").select("key", "least")
    least = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    partner = (F.col("least") <= F.col("n")) & (2 * F.col("u") <= _apart(least, F.col("n"), percent) + F.col("n") - least)
    met = materialize(rows.join(mixed, "key").filter(F.col("asks") | partner).drop("least"), "met")
    enough = met.groupBy("node", "own").agg(F.count(F.lit(1)).alias("has"), F.max("need").alias("least")).filter("has >= least").select("node", "own")
    return materialize(met.join(enough, ["node", "own"], "left_semi"), "live")


def _tokens(left: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, c, token) of the sets of left (node, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                token = np.frombuffer(raw.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), node)), pa.array(np.full(len(token), c)), pa.array(token)], ["node", "c", "token"])

    return left.select("node", "c").distinct().join(sets, "node").select("node", "c", "found").mapInArrow(run, "node bigint, c bigint, token bigint")


def _by_tokens(left: DataFrame, sets: DataFrame, percent: int, dear: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, u), and the sets (node) that few others can be similar to, with their candidates (a, b), a < b.

    The finest partition of the universe has a segment for each token. By both sizes, a set misses so many of its tokens in a similar
    one at most, so of any number over that a similar one has one. u counts those that no other component has; where the cheapest tokens, those and the
    next rarest, are had by no more other sets than `dear` for each token of the set, its whole search goes by them.
    """
    sizes = left.groupBy("node").agg(F.max("n").alias("n"))
    tokens = materialize(_tokens(left, sets).join(sizes, "node"), "tokens")
    by_size = tokens.groupBy("token", "n").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("low"), F.max("c").alias("high"))
    held = by_size.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("k").alias("holders"))
    # A token's holders by size are few rows, however many holders it has.
    smaller = by_size.select("token", "n", (F.sum("k").over(Window.partitionBy("token").orderBy("n")) - F.col("k")).alias("smaller"))
    alone = F.col("low") == F.col("high")
    priced = tokens.join(held, "token").join(smaller, ["token", "n"]).select("node", "c", "n", "token", F.when(alone, 0).otherwise(F.col("holders")).alias("cost"), F.when(alone, 0).otherwise(F.col("smaller")).alias("smaller"))
    priced = materialize(priced, "priced")
    place = F.row_number().over(Window.partitionBy("node").orderBy("cost", "token"))
    # Tokens after those that a search for sets of no smaller size needs are for smaller sets alone.
    misses = lambda x, y: F.floor(x - percent * (x + y) / (100 + percent) + 1e-9)
    n, least = F.col("n"), F.ceil(F.col("n") * percent / 100)
    chosen = materialize(priced.withColumn("place", place).filter(F.col("place") <= misses(n, least) + 1), "chosen")
    cheap = materialize(chosen.groupBy("node").agg(F.sum(F.when(F.col("place") <= misses(n, n) + 1, F.col("cost")).otherwise(F.col("smaller"))).alias("cost"), F.max("n").alias("n")).filter(F.col("cost") <= dear * F.col("n")).select("node"), "cheap")
    asked = chosen.filter("cost > 0").join(cheap, "node", "left_semi").select("token", "place", F.col("node").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"))
    met = asked.join(tokens, "token").filter((F.col("c") != F.col("cx")) & (F.col("place") <= misses(F.col("nx"), F.col("n")) + 1))
    met = met.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct()
    return priced.filter("cost = 0").groupBy("node").agg(F.count(F.lit(1)).alias("u")), cheap, met


def _to_the_middle(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: each node with that middle of its buckets with which it shares most keys; a middle is the node that meets most others."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    order = rows.join(sizes, "key").groupBy("node").agg((-F.sum("size")).alias("order"))
    ranked = rows.join(order, "node")
    middle = ranked.groupBy("key").agg(F.min(F.struct("order", "node")).alias("z"))
    met = ranked.join(middle, "key").filter(F.col("node") != F.col("z.node")).groupBy("node", F.col("z").alias("z")).agg(F.count(F.lit(1)).alias("has"), F.max("need").alias("least"))
    best = met.groupBy("node").agg(F.max(F.struct("has", -F.col("z.order"), F.col("z.node").alias("other"))).alias("m"), F.max("least").alias("least"))
    return best.filter(2 * F.col("m.has") >= F.col("least")).select(F.least("node", "m.other").alias("a"), F.greatest("node", "m.other").alias("b")).distinct()


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, found): the sets of rows (node, text), as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py(), shingle).tobytes() for t in part.column(1)], pa.binary())], ["node", "found"])

    return texts.select("node", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, "node bigint, found binary")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have at least that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in (0, 1)], ["a", "b"])

    left, right = sets.select(F.col("node").alias("a"), F.col("found").alias("x")), sets.select(F.col("node").alias("b"), F.col("found").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _segments(sets: DataFrame, percent: int) -> DataFrame:
    """(node, own, key, without): each segment's key with null, and with the key that it has without each of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.frombuffer(raw.as_py(), np.uint64)
                for i, (band, segments, _) in enumerate(schemes(len(found), percent)):
                    keys, place, less, base = segment_keys(found, band, segments)
                    key = np.append(keys, keys[place]).view(np.int64)
                    without = pa.concat_arrays([pa.nulls(segments, pa.int64()), pa.array(mix(less ^ base[place]).view(np.int64))])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), node)), pa.array(np.full(len(key), i == 0)), pa.array(key), without], ["node", "own", "key", "without"])

    return sets.select("node", "found").mapInArrow(run, "node bigint, own boolean, key bigint, without bigint")


def _searched(live: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: the candidates, of different components c, that the cheapest allocation of every set leaves."""
    of = live.select("node", "own", "c", "u", "asks").distinct()
    every = materialize(_segments(sets.join(of.select("node").distinct(), "node", "left_semi"), percent).join(of, ["node", "own"]), "segments")
    whole, less = every.filter("without is null").drop("without"), every.filter("without is not null")
    # What a key meets: nothing, if all that have it are of one component, the searcher's own.
    held = lambda rows, key, n: rows.groupBy(F.col(key).alias("met")).agg(F.count(F.lit(1)).alias(n), F.min("c").alias(f"{n}_low"), F.max("c").alias(f"{n}_high"))
    cost = lambda n: F.when((F.col(f"{n}_low") != F.col("c")) | (F.col(f"{n}_high") != F.col("c")), F.col(n)).otherwise(0)
    equal, lacking = held(whole, "key", "e"), held(less, "without", "d")
    mine = whole.filter("asks").join(equal, F.col("key") == F.col("met"), "left").drop("met").join(lacking, F.col("key") == F.col("met"), "left").drop("met")
    mine = mine.select("node", "c", "u", "key", F.coalesce(cost("e"), F.lit(0)).alias("zero"), F.coalesce(cost("d"), F.lit(0)).alias("more"))
    taken = less.filter("asks").join(equal, F.col("without") == F.col("met")).groupBy("node", "key").agg(F.sum(cost("e")).alias("taken"))
    mine = mine.join(taken, ["node", "key"], "left").withColumn("one", F.greatest("zero", F.col("more") + F.coalesce("taken", F.lit(0))))
    # A segment's first unit is equality, its second one token more or less, which never is the cheaper one.
    units = mine.select("node", "c", "u", "key", F.explode(F.array(F.struct(F.lit(0).alias("unit"), F.col("zero").alias("cost")), F.struct(F.lit(1).alias("unit"), F.col("one").alias("cost")))).alias("at")).select("node", "c", "u", "key", "at.*")
    place = F.row_number().over(Window.partitionBy("node").orderBy("cost", "unit", "key"))
    chosen = units.withColumn("place", place).join(nodes.select("node", F.col("units").alias("wanted"), "n"), "node").filter("place <= wanted and cost > 0")
    chosen = materialize(chosen.select("node", "c", "u", "n", "key", "unit"), "allocated")
    other = lambda rows, key: rows.join(nodes.select("node", "n"), "node").select(F.col(key).alias("met"), F.col("node").alias("y"), F.col("c").alias("cy"), F.col("u").alias("uy"), F.col("n").alias("ny"))
    near = chosen.filter("unit = 1")
    shorter = near.join(less.filter("asks").select("node", "key", "without"), ["node", "key"]).withColumn("key", F.col("without"))
    more = F.col("ny") - F.col("n")
    fits = (F.col("c") != F.col("cy")) & (more >= 0) & (F.greatest(2 * F.col("u") + more, 2 * F.col("uy") - more) <= _apart(F.col("n"), F.col("ny"), percent))
    found = None
    for asked, rows in ((chosen.filter("unit = 0"), other(whole, "key")), (near, other(less, "without")), (shorter, other(whole, "key"))):
        met = asked.select("node", "c", "u", "n", F.col("key").alias("met")).join(rows, "met").filter(fits).select(F.least("node", "y").alias("a"), F.greatest("node", "y").alias("b"))
        found = met if found is None else found.unionAll(met)
    return found.distinct()


def _rows(documents: DataFrame, nodes: DataFrame, count: int, shingle: int, percent: int) -> DataFrame:
    """(key, node, own, need, c, n, u, asks) of all shared keys; each node is a component of its own, and asks under its own band."""
    some = -(-max(1, count) // SAMPLE)
    sample = _keys(documents.filter(F.pmod(F.xxhash64("text"), F.lit(some)) == 0), shingle, percent)
    # A set of n tokens has some n / 3 keys, so at most SAMPLE / HOT times that are collected.
    hot = [r[0] for r in sample.groupBy("key").count().filter(F.col("count") >= HOT).select("key").collect()] if some > 1 else []
    shared = _shared(_keys(documents, shingle, percent), hot)
    need = nodes.select("node", "n", F.col("own").alias("o"), "below")
    return shared.join(need, "node").select("key", "node", "own", F.when(F.col("own"), F.col("o")).otherwise(F.col("below")).alias("need"), F.col("node").alias("c"), "n", F.lit(0).cast("bigint").alias("u"), F.col("own").alias("asks"))


def groups(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, key, node, n, root) of every row: the hash of its text, its set and the set's size; linked rows have the same root."""
    marks = materialize(_marks(documents, shingle, percent), "sizes")
    nodes = materialize(marks.groupBy("node").agg(F.min("key").alias("key"), *[F.max(c).alias(c) for c in ("n", "units", "own", "below")]), "nodes")
    rows = materialize(_rows(documents, nodes, marks.count(), shingle, percent), "shared")
    live = _live(_live(rows, percent), percent)
    wanted = nodes.join(live.select("node").distinct(), "node", "left_semi").select("node", "key")
    texts = documents.select(text_key().alias("key"), "text").join(wanted, "key").groupBy("node").agg(F.first("text").alias("text"))
    sets = materialize(_sets(texts, shingle), "sets")
    near = materialize(_similar(materialize(_to_the_middle(live), "partners"), sets, percent), "near")
    left = live.drop("c").join(components(near), "node", "left").withColumn("c", F.coalesce("component", "node"))
    left = _live(materialize(left.drop("component"), "left"), percent)
    few = []
    for dear in SEARCHES:
        # What is left after the cheap searches often has nobody to look for.
        alone, cheap, met = _by_tokens(left, sets, percent, dear)
        few.append(met)
        left = left.drop("u", "asks").join(cheap, "node", "left_anti").join(alone, "node", "left").withColumn("u", F.coalesce("u", F.lit(0)))
        left = materialize(left.withColumn("asks", F.col("own") & (2 * F.col("u") <= _apart(F.col("n"), F.col("n"), percent))), "left")
        left = _live(_live(left, percent), percent)
    rest = materialize(reduce(DataFrame.unionAll, few, _searched(left, nodes, sets, percent)).distinct(), "candidates")
    label = components(near.unionAll(_similar(rest, sets, percent)))
    return marks.join(label, "node", "left").select("doc_id", "key", marks["node"], "n", F.coalesce("component", marks["node"]).alias("root"))


def join(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable over links, itself included) of every row."""
    found = materialize(groups(documents, shingle, percent), "groups")
    least = found.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return found.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
  FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM t WHERE len(w) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), e AS (
  SELECT x.r AS a, y.r AS b FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r JOIN n nx ON nx.r = x.r JOIN n ny ON ny.r = y.r
  GROUP BY x.r, y.r, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))
), reach AS (
  SELECT r AS a, r AS b FROM t UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(u.doc_id) FROM reach JOIN t u ON u.r = reach.b WHERE reach.a = t.r) AS component_id
FROM t LEFT JOIN n ON n.r = t.r
"""
