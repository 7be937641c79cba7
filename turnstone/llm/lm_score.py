"""Stupid-backoff scores, computed relationally.

The n-grams are pairs of words. Every document is exploded into its distinct pairs; these rows are partitioned by a hash of the pair,
where they are counted, the counts are joined to them, and scores are summed per document. A pair with at least `min_count`
occurrences scores log(c(p w) / c(p)); any other backs off to log(backoff * c(w) / N).

Pairs are named by numbers. A word with a share of at least 1 / FREQUENT of all words, of which there are FREQUENT at most, has a
number that every task knows; any other word is its 63-bit hash, negative. So no word is left out, however many there are, and
only words of the first kind, whose counts are at hand, are met too often for one partition: a pair is dealt over as many salts as
the rarer of its words asks for, and its counts are added up over them. A pair whose score needs the count of a rare word gets it by
a join on that word, which has a share below 1 / FREQUENT.

Defined results: a null or empty text has no words, a sum of zero and a null mean; the first word of a text follows a start mark;
words are runs of letters and digits (and of anything outside ASCII), A-Z lower-cased; repeated rows each count and each give a
row; a null doc_id is kept. documents must give the same rows in the same order when a task is run again, as files do.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize
from .decontam import words

MIN_COUNT = 2
BACKOFF = 0.4
#: A frequent word's number takes BITS bits; the start mark is one of them.
BITS = 21
FREQUENT = (1 << BITS) - 1
PART_PAIRS = 2_000_000
#: Words that are turned into pairs at once, and distinct words that a task counts before it passes them on.
BATCH_WORDS = 400_000
COUNTER_WORDS = 400_000
#: The start mark: its number as a word before the first, and what it is in the table of words, where its count is that of texts.
START, MARK = 0, b""
START_ARRAY = np.zeros(1, np.int64)
SEED = 42
#: Bits of a pair's count within a document; larger counts take several rows. The largest value marks a document without an id.
TF_BITS = 16
NO_ID = (1 << TF_BITS) - 1


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) over all documents; the word is UTF-8. The empty word counts the texts that have words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                w = words(text.as_py())
                held.update(w)
                held[MARK] += bool(w)
                if len(held) >= COUNTER_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return documents.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def rare_id(word: Column) -> Column:
    """The negative number of a word without one of its own."""
    return F.xxhash64(word).bitwiseOR(F.lit(-(1 << 63)).cast("bigint"))


class Numbers:
    """The numbers of frequent words, by falling count, and their counts; the start mark is the first."""

    def __init__(self, frequent: list[tuple[bytes, int]], texts: int):
        self.number = {w: i + 1 for i, (w, _) in enumerate(frequent)}
        self.counts = np.array([texts, *(n for _, n in frequent)], np.int64)

    def of(self, found: list[bytes]) -> np.ndarray:
        from itertools import repeat

        from xxhash import xxh64_intdigest

        ids = np.fromiter(map(self.number.get, found, repeat(-1)), np.int64, len(found))
        rare = np.flatnonzero(ids < 0)
        if len(rare):
            hashed = np.fromiter((xxh64_intdigest(found[i], SEED) for i in rare.tolist()), np.uint64, len(rare))
            ids[rare] = (hashed | np.uint64(1 << 63)).view(np.int64)
        return ids


def exploded(documents: DataFrame, shared, part_pairs: int) -> DataFrame:
    """(gram, other, of): the distinct pairs of every document, and one row for the document itself.

    gram is salt, p and w in one number if both words are frequent, and other is zero; else gram is p and other is w. of is the
    document's number and the count in the document, which together are one column, so that all who read the shuffled rows read
    the same ones and Spark shuffles them once. A document's own row has no count and its doc_id in other. A very long text is
    worked off in stretches, so that a pair may have one row for each.
    """
    schema = pa.schema([pa.field(c, pa.int64(), nullable=False) for c in ("gram", "other", "of")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = shared.value
        salts_of = -(-known.counts // part_pairs)
        number = TaskContext.get().partitionId() << 27

        def out(ids: list[tuple[int, int | None]], rows: list[int], before: list[np.ndarray], after: list[np.ndarray]) -> pa.RecordBatch:
            at = np.repeat(np.array(rows, np.int64), [len(x) for x in after])
            p, w = np.concatenate([START_ARRAY, *before])[1:], np.concatenate([START_ARRAY, *after])[1:]
            order = np.lexsort((w, p, at))
            at, p, w = at[order], p[order], w[order]
            # A pair starts anew where its count would not fit.
            first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(p, prepend=0) != 0) | (np.diff(w, prepend=0) != 0) | (np.arange(len(at)) % (NO_ID - 1) == 0))
            tf = np.diff(np.append(first, len(at)))
            at, p, w = at[first], p[first], w[first]
            both = (p >= 0) & (w >= 0)
            gram, other = p.copy(), np.where(both, 0, w)
            # Documents take the salts in turn, so that copies of one text don't share them.
            salt = at[both] % np.maximum(1, np.minimum(salts_of[p[both]], salts_of[w[both]]))
            gram[both] = salt << 2 * BITS | p[both] << BITS | w[both]
            own = np.array([(~n, d or 0, n << TF_BITS | (NO_ID if d is None else 0)) for n, d in ids], np.int64).reshape(-1, 3)
            columns = (np.append(gram, own[:, 0]), np.append(other, own[:, 1]), np.append(at << TF_BITS | tf, own[:, 2]))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

        ids, rows, before, after, held = [], [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, last = words(text.as_py()), START
                ids.append((number, doc))
                for begin in range(0, len(found), BATCH_WORDS):
                    now = known.of(found[begin : begin + BATCH_WORDS])
                    rows.append(number)
                    before.append(np.append(last, now[:-1]))
                    after.append(now)
                    last = now[-1]
                    held += len(now)
                    if held >= BATCH_WORDS:
                        yield out(ids, rows, before, after)
                        ids, rows, before, after, held = [], [], [], [], 0
                number += 1
                if number >> 27 != TaskContext.get().partitionId():
                    raise ValueError("a partition has more rows than numbers (2 ** 27): deal documents to more partitions")
        if ids:
            yield out(ids, rows, before, after)

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "gram bigint not null, other bigint not null, of bigint not null")


def score(documents: DataFrame, min_count: int = MIN_COUNT, backoff: float = BACKOFF, frequent: int = FREQUENT, part_pairs: int = PART_PAIRS) -> DataFrame:
    """doc_id, n_words, sum_log and mean_log of every row. Words with a share of 1 / frequent are sent to all executors."""
    spark = documents.sparkSession
    counted = materialize(word_counts(documents), "words")
    found = counted.agg(F.sum(F.when(F.col("word") != MARK, F.col("n"))), F.sum(F.when(F.col("word") == MARK, F.col("n")))).first()
    total, texts = found[0] or 0, found[1] or 0
    known = (F.col("word") != MARK) & (F.col("n") * frequent >= total)
    top = sorted(((bytes(r[0]), r[1]) for r in counted.filter(known).toLocalIterator()), key=lambda r: (-r[1], r[0]))
    numbers = Numbers(top, texts)
    shared = spark.sparkContext.broadcast(numbers)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_pairs))
    pairs = exploded(documents, shared, part_pairs).repartition(parts, "gram", "other")

    # The count table lies where its pairs lie. What a pair's score needs beside its own count is one count of a word: of its
    # first one, or, backing off, of its second.
    gram, other, of = F.col("gram"), F.col("other"), F.col("of")
    mask = lambda bits: F.lit((1 << bits) - 1).cast("bigint")
    count = of.bitwiseAND(mask(TF_BITS))
    tf = F.when(count < NO_ID, count).otherwise(0)
    p = F.when(other == 0, F.shiftright("gram", BITS).bitwiseAND(mask(BITS))).otherwise(gram)
    w = F.when(other == 0, gram.bitwiseAND(mask(BITS))).otherwise(other)
    hit = F.col("n") >= min_count
    needed = F.when(hit, p).otherwise(w)
    log = F.when(hit, F.log("n") - F.col("log_c")).otherwise(F.col("log_c") + math.log(backoff / max(1, total)))
    common = spark.createDataFrame(pa.table({"key": pa.array(np.arange(len(numbers.counts))), "c": pa.array(numbers.counts)}))
    # At most `frequent` rows and the start mark.
    common = F.broadcast(common.select("key", F.log("c").alias("log_c"), F.ceil(F.col("c") / part_pairs).cast("int").alias("salts")))
    rare = counted.filter(~known & (F.col("word") != MARK)).select(rare_id(F.col("word")).alias("key"), F.log("n").alias("log_c"))
    # Numbers go by falling counts, so the words that may need salts are those up to `heavy`.
    heavy = int((numbers.counts[1:] > part_pairs).sum())
    salted = (other == 0) & (p <= heavy) & (w <= heavy)
    table = pairs.groupBy("gram", "other").agg(F.sum(tf).alias("n"))
    own = table.withColumn("key", F.when(salted, F.lit(None)).when(F.col("n") > 0, needed))
    near = own.filter("key >= 0").join(common.drop("salts"), "key").select("gram", "other", log.alias("near"))
    far = own.filter("key < 0").join(rare, "key").select("gram", "other", log.alias("far"))
    if heavy:
        # The product, unlike a condition on the pair alone, isn't moved in front of the shuffle, which then would be another one.
        whole = table.filter(F.col("n") * salted.cast("int") > 0).groupBy(gram.bitwiseAND(mask(2 * BITS)).alias("gram"), "other").agg(F.sum("n").alias("n"))
        of_word = lambda c: common.select(F.col("key").alias(c), F.col("salts").alias(f"{c}_salts"))
        whole = whole.withColumn("key", needed).withColumn("p", p).withColumn("w", w).join(common.drop("salts"), "key").join(of_word("p"), "p").join(of_word("w"), "w")
        every = whole.select("gram", "other", log.alias("far"), F.explode(F.sequence(F.lit(0), F.least("p_salts", "w_salts") - 1)).alias("salt"))
        far = far.unionAll(every.select(F.shiftleft(F.col("salt").cast("bigint"), 2 * BITS).bitwiseOR(gram).alias("gram"), "other", "far"))
    # A part of the table is as small as its part of the pairs, so it may be held while those stream by.
    priced = pairs.join(near.hint("shuffle_hash"), ["gram", "other"], "left").join(far.hint("shuffle_hash"), ["gram", "other"], "left")
    sums = priced.groupBy(F.shiftright("of", TF_BITS).alias("row")).agg(F.max(F.when(count == 0, other)).alias("doc_id"), F.sum(tf).alias("n_words"), F.sum(tf * F.coalesce("near", "far")).alias("sum_log"))
    return sums.select("doc_id", "n_words", F.coalesce("sum_log", F.lit(0.0)).alias("sum_log"), F.when(F.col("n_words") > 0, F.col("sum_log") / F.col("n_words")).alias("mean_log"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), t AS (
  SELECT r, i, CASE WHEN i = 1 THEN '' ELSE ws[i - 1] END AS p, ws[i] AS w FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)
), u AS (SELECT w, count(*) AS n FROM t GROUP BY w), c AS (SELECT p, count(*) AS n FROM t GROUP BY p), n AS (SELECT greatest(count(*), 1) AS n FROM t),
f AS (SELECT w AS p, n FROM u UNION ALL SELECT p, n FROM c WHERE p = ''),
b AS (SELECT t.p, t.w, count(*) AS n FROM t GROUP BY t.p, t.w HAVING count(*) >= 2),
s AS (
  SELECT t.r, count(*) AS k, sum(coalesce(ln(b.n) - ln(f.n), ln(u.n) + ln(0.4 / n.n))) AS l
  FROM t JOIN u ON t.w = u.w CROSS JOIN n LEFT JOIN b ON t.p = b.p AND t.w = b.w LEFT JOIN f ON t.p = f.p GROUP BY t.r
)
SELECT d.doc_id, coalesce(k, 0) AS n_words, round(coalesce(l, 0.0), 6) AS sum_log, round(l / k, 6) AS mean_log FROM d LEFT JOIN s ON d.r = s.r
"""
