"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document. Each segment (one row of the stored table) holds, for the documents it covers, the
postings of all terms that the benchmark uses: positions sorted by term, then place. Phrases start from their rarest term,
whose list is shifted by the term's offset and then intersected by binary search with the lists of the other terms, rarer
ones first. Besides exact phrases, documents get the items of which a phrase stands nearly there: from some start on, every one of
its terms is at most `near` places off its own (proximity; exact phrases are among them).

Defined results: a null or empty text has no words and no hits; benchmark rows without words have no window; a null item_id
counts as the id "null"; repeated item_ids are one item; an empty benchmark hits nothing; every row of documents gives a row.
What goes to the executors at once is bounded: the benchmark is searched in groups of at most `max_terms` distinct terms (plus
those of one item) and about `group_words` words, each with an index of its own terms, and a group's windows in blocks of about
`block_words` words. What several groups find in a document is put together from the places that they hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

WINDOW = 10
NEAR = 2
SEGMENT_WORDS = 1_500_000
BLOCK_WORDS = 300_000
#: Free places between two documents of a segment; no phrase reaches over them.
GAP = 64
CHUNK = 2_000_000
MAX_TERMS = 1_000_000
GROUP_WORDS = 3_000_000

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))

INDEX_SCHEMA = "doc_ids array<bigint>, hashes array<bigint>, n_words array<bigint>, terms binary, ends binary, places binary"
MATCH_SCHEMA = "doc_id bigint, h bigint, n_words bigint, n_hit bigint, item_ids array<string>, spans array<struct<start:int,end:int>>, near_ids array<string>"


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII punctuation, spaces and controls, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_TABLE).split() if text else []


def windows(items: list[tuple[object, str | None]], size: int) -> dict[tuple[bytes, ...], set[str]]:
    """The distinct windows of the items, with the ids of the items that have them."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            found.setdefault(tuple(w[i : i + size]), set()).add("null" if item is None else str(item))
    return found


def _segment(docs: list, hashes: list[int], counts: list[int], places: list[np.ndarray], terms: list[np.ndarray]) -> dict:
    t = np.concatenate(terms) if terms else np.zeros(0, np.int32)
    p = np.concatenate(places) if places else np.zeros(0, np.int32)
    order = np.argsort(t, kind="stable")
    known, first = np.unique(t[order], return_index=True)
    ends = np.append(first[1:], len(t)).astype(np.int32) if len(known) else np.zeros(0, np.int32)
    return {"doc_ids": docs, "hashes": hashes, "n_words": counts, "terms": known.astype(np.int32).tobytes(), "ends": ends.tobytes(), "places": p[order].astype(np.int32).tobytes()}


def build_index(documents: DataFrame, vocabulary: list[bytes], segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The positional postings of the vocabulary's terms in all documents, one row for each segment of about segment_words words."""
    sc = documents.sparkSession.sparkContext
    shared = sc.broadcast(vocabulary)
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.binary()), ("ends", pa.binary()), ("places", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import repeat

        number = {w: i for i, w in enumerate(shared.value)}.get
        docs, hashes, counts, places, terms, base = [], [], [], [], [], 0
        for batch in batches:
            for doc, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                w = words(text.as_py())
                if docs and base + len(w) > segment_words:
                    yield pa.RecordBatch.from_pylist([_segment(docs, hashes, counts, places, terms)], schema)
                    docs, hashes, counts, places, terms, base = [], [], [], [], [], 0
                ids = np.fromiter(map(number, w, repeat(-1)), np.int32, len(w))
                at = np.flatnonzero(ids >= 0)
                docs.append(doc)
                hashes.append(h)
                counts.append(len(w))
                terms.append(ids[at])
                places.append((at + base).astype(np.int32))
                base += len(w) + GAP
        if docs:
            yield pa.RecordBatch.from_pylist([_segment(docs, hashes, counts, places, terms)], schema)

    return documents.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("h"), "text").mapInArrow(build, INDEX_SCHEMA)


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n): how often each term stands in the corpus, summed over the lists of the stored index."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t, e = np.frombuffer(terms, np.int32), np.frombuffer(ends, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.diff(e, prepend=0).astype(np.int64))], ["term", "n"])

    return index.select("terms", "ends").mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _intersect(keys: np.ndarray, span: int, plan: dict[str, np.ndarray], slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of all matches in a segment, or (window, place of its rarest term) of the near ones. keys: term * span + place, sorted; plan: terms and offsets of each window, rarest first."""
    terms, offsets, sizes = plan["terms"], plan["offsets"], plan["sizes"]
    lo = np.searchsorted(keys, terms[:, 0].astype(np.int64) * span)
    n = np.searchsorted(keys, (terms[:, 0].astype(np.int64) + 1) * span) - lo
    live = np.flatnonzero(n)
    found_w, found_s = [], []
    cuts = np.searchsorted(np.cumsum(n[live]), np.arange(CHUNK, n[live].sum() + CHUNK, CHUNK)) + 1 if len(live) else []
    begin = 0
    for end in cuts:
        part = live[begin : min(end, len(live))]
        begin = end
        if not len(part):
            continue
        w = np.repeat(part, n[part])
        inner = np.arange(len(w)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
        place = keys[lo[w] + inner] - terms[w, 0].astype(np.int64) * span
        start = place - offsets[w, 0]
        if slop:
            # The rarest term may be off its place too, so each of its places gives several starts.
            w, place, start = (np.repeat(x, 2 * slop + 1) for x in (w, place, start))
            start = start + np.tile(np.arange(-slop, slop + 1), len(start) // (2 * slop + 1))
        for k in range(1, terms.shape[1]):
            has = sizes[w] > k
            want = terms[w, k].astype(np.int64) * span + start + offsets[w, k]
            at = np.searchsorted(keys, want - slop)
            ok = ~has | ((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= want + slop))
            w, start, place = w[ok], start[ok], place[ok]
        found_w.append(w)
        found_s.append(place if slop else start)
    return (np.concatenate(found_w), np.concatenate(found_s)) if found_w else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def plan_of(phrases: list[tuple[tuple[bytes, ...], list[str]]], number: dict[bytes, int], counts: dict[int, int]) -> dict:
    """Terms and offsets of each phrase, rarest in the corpus first, as arrays; and the ids that each phrase belongs to."""
    most = max([1, *(len(p) for p, _ in phrases)])
    terms, offsets, sizes = np.zeros((len(phrases), most), np.int32), np.zeros((len(phrases), most), np.int64), np.zeros(len(phrases), np.int64)
    for i, (phrase, _) in enumerate(phrases):
        order = sorted(range(len(phrase)), key=lambda k: (counts.get(number[phrase[k]], 0), k))
        terms[i, : len(order)], offsets[i, : len(order)], sizes[i] = [number[phrase[k]] for k in order], order, len(order)
    return {"terms": terms, "offsets": offsets, "sizes": sizes, "ids": [ids for _, ids in phrases]}


def search(index: DataFrame, plans: list[Broadcast], near: int = 0) -> DataFrame:
    """One row for each document: its words, the words inside any match, the ids whose phrases match, the places that are hit, and
    the ids whose phrases stand nearly there (none if near is 0). Each plan is one block of phrases."""
    if not 0 <= near < GAP // 4:
        raise ValueError("near must be shorter than a quarter of the gap between documents")
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("near_ids", pa.list_(pa.string()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size = np.array(row["n_words"], np.int64)
                base = np.cumsum(size + GAP) - size - GAP
                span = int(size.sum() + GAP * (len(size) + 2)) * 2
                known, ends = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["ends"], np.int32)
                keys = np.repeat(known.astype(np.int64) * span, np.diff(ends, prepend=0)) + np.frombuffer(row["places"], np.int32)
                edge = np.zeros(span, np.int32)
                items: list[set[str]] = [set() for _ in size]
                close: list[set[str]] = [set() for _ in size]
                for shared in plans:
                    plan = shared.value
                    w, start = _intersect(keys, span, plan)
                    doc = np.searchsorted(base, start, "right") - 1
                    np.add.at(edge, start, 1)
                    np.add.at(edge, np.minimum(start + plan["sizes"][w], base[doc] + size[doc]), -1)
                    for d, k in np.unique(np.stack([doc, w]), axis=1).T.tolist():
                        items[d].update(plan["ids"][k])
                    if near:
                        w, place = _intersect(keys, span, plan, near)
                        for d, k in np.unique(np.stack([np.searchsorted(base, place, "right") - 1, w]), axis=1).T.tolist():
                            close[d].update(plan["ids"][k])
                covered = np.cumsum(edge) > 0
                inside = np.append(0, np.cumsum(covered))
                hit = inside[base + size] - inside[base]
                turns = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                spans: list[list] = [[] for _ in size]
                for d, (a, b) in zip((np.searchsorted(base, turns[:, 0], "right") - 1).tolist(), turns.tolist()):
                    spans[d].append({"start": a - int(base[d]), "end": b - int(base[d])})
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["hashes"], pa.int64()), pa.array(size), pa.array(hit.astype(np.int64)), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, schema.field("spans").type), pa.array([sorted(x) for x in close], pa.list_(pa.string()))], schema=schema)

    return index.mapInArrow(find, MATCH_SCHEMA)


def _groups(benchmark: DataFrame, block_words: int, max_terms: int, group_words: int) -> Iterator[list[list[tuple[object, str | None]]]]:
    """The benchmark's rows in groups of blocks; one group at a time is held."""
    group, block, size, words_of, terms = [], [], 0, 0, set()
    for row in benchmark.select("item_id", "text").toLocalIterator():
        w = words(row[1])
        if (group or block) and (words_of + len(w) > group_words or len(terms) + sum(x not in terms for x in set(w)) > max_terms):
            yield [*group, block]
            group, block, size, words_of, terms = [], [], 0, 0, set()
        if block and size + len(w) > block_words:
            group.append(block)
            block, size = [], 0
        block.append((row[0], row[1]))
        size, words_of = size + len(w), words_of + len(w)
        terms.update(w)
    yield [*group, block]


def _union(spans: Column) -> Column:
    """How many places the spans cover together."""
    start = F.struct(F.lit(0).cast("bigint").alias("to"), F.lit(0).cast("bigint").alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["to"], s["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["n"])


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int = NEAR, block_words: int = BLOCK_WORDS, max_terms: int = MAX_TERMS, group_words: int = GROUP_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, the sorted item_ids and near_ids of every row of documents."""
    if not 0 < window <= GAP // 2:
        raise ValueError("the window must be shorter than half the gap between documents")
    sc = documents.sparkSession.sparkContext
    found: list[DataFrame] = []
    for group in _groups(benchmark, block_words, max_terms, group_words):
        listed = sorted({w for block in group for _, text in block for w in words(text)})
        number = {w: i for i, w in enumerate(listed)}
        index = materialize(build_index(documents, listed), "postings")
        counts = {r[0]: r[1] for r in term_counts(index).toLocalIterator()}
        plans = [sc.broadcast(plan_of([(p, sorted(ids)) for p, ids in windows(block, window).items()], number, counts)) for block in group]
        found.append(search(index, plans, near))
    if len(found) == 1:
        return found[0].select("doc_id", "n_words", "n_hit", "item_ids", "near_ids")
    some = (F.col("n_hit") > 0) | (F.size("near_ids") > 0)
    found = [materialize(f if i == 0 else f.filter(some), "matches") for i, f in enumerate(found)]
    # The first group has a row for each document. Rows of one document id and text are alike, so one of them tells for all.
    hit = found[0].filter(some)
    for f in found[1:]:
        hit = hit.unionAll(f)
    hit = hit.select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), "item_ids", "spans", "near_ids").distinct().groupBy("_doc", "_h")
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    every = hit.agg(together("item_ids").alias("_ids"), together("near_ids").alias("_near"), _union(F.flatten(F.collect_list("spans"))).alias("_hit"))
    joined = found[0].join(every, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("_hit", F.lit(0)).cast("bigint").alias("n_hit"), *[F.coalesce(c, F.array().cast("array<string>")).alias(name) for c, name in (("_ids", "item_ids"), ("_near", "near_ids"))])


def report(matches: DataFrame) -> DataFrame:
    """The digest columns: n_items, items_sha256, contaminated and n_near."""
    return matches.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_ids").cast("bigint").alias("n_near"))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark passage, with all their columns. Each row is judged by its own text, whatever its doc_id."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    bad = decontaminate(documents.select(key.alias("doc_id"), "text"), benchmark, near=0).filter("n_hit > 0").select(F.col("doc_id").alias("_bad")).distinct()
    return documents.join(bad, key == bad["_bad"], "left_anti")


__all__ = ["build_index", "clean", "decontaminate", "report", "search", "term_counts", "windows", "words"]


_SQL_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_SQL_WORDS} AS bw FROM benchmark),
g AS (SELECT DISTINCT item, least(len(bw), 10) AS n, array_to_string(bw[i : i + 9], ' ') AS gram FROM (SELECT item, bw, unnest(range(1, greatest(len(bw) - 9, 1) + 1)) AS i FROM b WHERE len(bw) > 0)),
p AS (SELECT r, i, n, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM g))),
m AS (SELECT p.r, p.i, p.n, g.item FROM p JOIN g ON p.gram = g.gram AND p.n = g.n),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r),
gw AS (SELECT gram, n, unnest(string_split(gram, ' ')) AS term, generate_subscripts(string_split(gram, ' '), 1) - 1 AS k FROM (SELECT DISTINCT gram, n FROM g)),
tk AS (SELECT * FROM (SELECT r, unnest(ws) AS term, generate_subscripts(ws, 1) AS i FROM w) WHERE term IN (SELECT term FROM gw)),
tc AS (SELECT term, count(*) AS c FROM tk GROUP BY term),
an AS (SELECT gram, gw.n, arg_min(struct_pack(k := k, term := gw.term), struct_pack(c := coalesce(c, 0), k := k)) AS a FROM gw LEFT JOIN tc ON gw.term = tc.term GROUP BY gram, gw.n),
cand AS (SELECT DISTINCT an.gram, an.n, tk.r, tk.i - a.k + d AS s FROM an JOIN tk ON tk.term = a.term CROSS JOIN range(-{NEAR}, {NEAR} + 1) AS e(d)),
nr AS (SELECT cand.gram, cand.r, cand.s FROM cand JOIN gw ON gw.gram = cand.gram JOIN tk ON tk.r = cand.r AND tk.term = gw.term AND tk.i BETWEEN cand.s + gw.k - {NEAR} AND cand.s + gw.k + {NEAR} GROUP BY cand.gram, cand.n, cand.r, cand.s HAVING count(DISTINCT gw.k) = cand.n),
nn AS (SELECT r, count(DISTINCT item) AS n_near FROM (SELECT DISTINCT gram, r FROM nr) x JOIN g ON g.gram = x.gram GROUP BY r)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM w LEFT JOIN h ON w.r = h.r LEFT JOIN t ON w.r = t.r LEFT JOIN nn ON w.r = nn.r
"""
