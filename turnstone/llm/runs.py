"""Periodic run detection: the maximal stretches of a text's words that repeat with a period, and the text without the repeats.

The longest common prefixes (LCP) of neighbours in the suffix array are taken as edges in descending order, as Kruskal's
algorithm takes its own. The classes of suffixes that they unite are ordered sets of positions; the smaller set goes into the
larger one. When i and j = i + d become neighbours in a set that was united at an LCP of l, exactly l words agree, so words
from i to i + d + l have the period d. For l >= 2d that stretch is three periods long, and d is its smallest period: under a
smaller one, i + that period would stand between the two, having joined i at a larger LCP. A run's first position meets the
one a period later so, at the LCP that reaches the run's end; of the seeds with one period and end, the smallest start is the
run's. Nothing has to be extended.

A run of at least `min_words` words and three periods has an LCP of 2/3 of min_words at least. Texts in which no window of
as many words is met twice hold none, which hashes of all windows show first.

Defined results: a null or empty text has no words, no runs and an empty text; equal rows give equal rows; columns of any
names are carried along in a struct of their own, so none can clash.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from .common import column

MIN_WORDS, MIN_PERIODS = 24, 3
#: Texts whose windows are hashed together: so many rows, or the words of so many octets.
_ROWS, _OCTETS = 256, 8 << 20
_RUN = "struct<start: bigint, length: bigint, period: bigint>"
_FOUND = f"struct<runs: array<{_RUN}>, best: {_RUN}, text: string>"
_RUN_KIND = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_KIND = pa.struct([("runs", pa.list_(_RUN_KIND)), ("best", _RUN_KIND), ("text", pa.string())])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def least_lcp(min_words: int = MIN_WORDS) -> int:
    """What a run's first position has in common with the one a period later: the run but for one period, of three at least."""
    return min_words - min_words // MIN_PERIODS


def with_repeats(texts: list[list[bytes]], window: int) -> np.ndarray:
    """Whether each text may hold some window of so many words twice; never false where it does."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(size.sum())
    h = np.fromiter(map(hash, chain.from_iterable(texts)), np.int64, total).view(np.uint64)
    # Windows of any length are put together of those of powers of two, as binary digits say; the text's number tells texts apart.
    at, whole, power = 0, np.repeat(np.arange(len(texts), dtype=np.uint64), size) * _ODD, 1
    while True:
        if window & power:
            own = whole[: max(0, total - at)]
            own[:] = (own ^ h[at:]) * _ODD
            own ^= own >> np.uint64(29)
            at += power
        power *= 2
        if power > window:
            break
        h[: -power // 2 or None] = (h[: -power // 2 or None] * _ODD) ^ (h[power // 2 :] + (h[: -power // 2 or None] >> np.uint64(31)))
    left = np.repeat(np.cumsum(size), size) - np.arange(total)
    of, seen = np.repeat(np.arange(len(texts)), size)[left >= window], whole[left >= window]
    ordered = np.sort(seen)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    found = np.zeros(len(texts), bool)
    if len(twice):
        place = np.minimum(np.searchsorted(twice, seen), len(twice) - 1)
        found[of[twice[place] == seen]] = True
    return found


def common_prefixes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the words, and the LCP of each neighbouring pair, by doubled prefixes."""
    known: dict[bytes, int] = {}
    rank = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    n, ranks, size = len(rank), [rank], 1
    while int(rank.max()) < n - 1:
        after = np.zeros(n, np.int64)
        after[: max(0, n - size)] = rank[size:] + 1
        _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        ranks.append(rank)
        size *= 2
    order = np.argsort(rank)
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    # Prefixes that run over the text's end differ from all others, so equal ones lie within it.
    for rank, step in zip(ranks[::-1], (1 << k for k in range(len(ranks) - 1, -1, -1))):
        inside = np.flatnonzero(np.maximum(a, b) < n)
        same = inside[rank[a[inside]] == rank[b[inside]]]
        lcp[same] += step
        a[same] += step
        b[same] += step
    return order, lcp


def runs_of(words: list[bytes], min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    if len(words) < min_words:
        return []
    order, lcp = common_prefixes(words)
    edges = np.flatnonzero(lcp >= least_lcp(min_words))
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    members: dict[int, list[int]] = {}
    owner: dict[int, int] = {}
    starts: dict[tuple[int, int], int] = {}
    for x, y, level in zip(order[edges].tolist(), order[edges + 1].tolist(), lcp[edges].tolist()):
        into, small = owner.setdefault(x, x), owner.setdefault(y, y)
        if len(members.setdefault(into, [into])) < len(members.setdefault(small, [small])):
            into, small = small, into
        large, coming = members[into], members.pop(small)
        at = 0
        for k, p in enumerate(coming):
            owner[p] = into
            at = bisect_left(large, p, at)
            # Neighbours that both come from the smaller set have met before, at a larger LCP.
            pairs = [(large[at - 1], p)] if at and (not k or large[at - 1] != coming[k - 1]) else []
            if at < len(large) and (k + 1 == len(coming) or coming[k + 1] > large[at]):
                pairs.append((p, large[at]))
            large.insert(at, p)
            for i, j in pairs:
                if (MIN_PERIODS - 1) * (j - i) <= level and j - i + level >= min_words:
                    key = (j - i, j + level)
                    if starts.get(key, i) >= i:
                        starts[key] = i
    return sorted((start, end - start, period) for (period, end), start in starts.items())


def best_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length in periods, as an exact fraction; of equal ones the first by start and period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def collapse(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(document, found) of every row: all columns but the text, and its runs, the best of them and the text without repeats."""
    rest = F.struct(*[column(c) for c in documents.columns if c.lower() != "text"])
    given = documents.select(rest.alias("document"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    shape = given.select("document", F.lit(None).cast(_FOUND).alias("found")).schema
    schema = StructType([StructField(f.name, f.dataType) for f in shape])
    named = lambda run: None if run is None else dict(zip(("start", "length", "period"), run))

    def made(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.as_py().split() for t in part.column(1)]
        rows = []
        for words, maybe in zip(texts, with_repeats(texts, least_lcp(min_words))):
            runs = runs_of(words, min_words) if maybe else []
            rows.append({"runs": [named(r) for r in runs], "best": named(best_of(runs)), "text": b" ".join(without_repeats(words, runs)).decode()})
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _KIND)], ["document", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum([len(t.as_buffer()) for t in batch.column(1)])
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = min(at + _ROWS, max(at + 1, int(np.searchsorted(ends, before + _OCTETS))))
                yield made(batch.slice(at, to - at))
                at = to

    return given.mapInArrow(run, schema)


def periodic(documents: DataFrame) -> DataFrame:
    """doc_id and text; of every document whose hash is divisible by ten, the words from some place on go round with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.expr(r"array_remove(split(text, '[\\x20\\x09-\\x0D]+'), '')")
    placed = documents.select("doc_id", "text", (h / 10).cast("bigint").alias("g"), F.when(h % 10 == 0, words).alias("w"))
    placed = placed.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    placed = placed.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr("concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a))")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def report(found: DataFrame) -> DataFrame:
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("found.runs", line), "\n"), F.when(F.size("found.runs") > 0, "\n").otherwise(""))
    return found.select(
        "document.doc_id",
        F.size("found.runs").cast("bigint").alias("n_runs"),
        *[F.col(f"found.best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * found.best.length div found.best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("found.text", 256).alias("collapsed_sha256"),
    )
