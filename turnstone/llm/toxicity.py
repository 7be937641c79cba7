"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (hashed into a table, as is the word itself), a text the mean of its
words, and a softmax over two classes reads that mean. Vectors and softmax are trained together, by full-batch Adam, on at most
`SAMPLE_PER_CLASS` labelled rows of each class; n-grams that are about as frequent in both classes, as a test of their shares
tells, take no part, so that few labelled rows of a language will do. Misspelt words that were never seen share most n-grams with
those that were.

What a trained model says of a text is linear in its words, so scoring keeps one number for each bucket of the table and one for
each distinct word met; whole texts of any length are read. Besides the whole text's mean, the mean of each stretch of
`stretch` words counts, so that a toxic passage isn't diluted by a long clean text: both logits are combined by a logistic
calibration, fitted on the part of the sample that the training doesn't see.

Defined results: a null or empty text has no words and gets the score of the median clean text; rows of documents that repeat
are scored alike; labels other than 0 and 1, and labels without a document, are not learnt from; where one class has no
labelled row (or nearly none), every score is the smoothed share of toxic rows, one in ten without any labels.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import column

HELD_OUT = 2
SAMPLE_PER_CLASS = 4_000
SAMPLE_CHARS = 20_000
BUCKETS = 1 << 17
DIMENSION = 8
NGRAMS = (3, 4, 5)
STEPS = 160
LEAST = 4.0
#: Step size and decay of the vectors, the softmax and its bias.
RATES = ((2.0, 0.05), (0.02, 0.0), (0.02, 0.0))
STRETCH = 64
#: Neutral words added to each mean, so that a few words alone are weak evidence.
PAD = 24
THRESHOLD = 0.3
CACHE_WORDS = 400_000
#: Octets of a word that isn't cut, and the characters and steps of the pieces of longer ones.
LONG, PIECE, STEP = 96, 32, 24
_KEEP = {*range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(c if c in _KEEP else 0x20 for c in range(256))
#: UTF-8 of Latin-1 marks, of general and CJK punctuation with all their spaces, and of full-width marks.
_MARKS = re.compile(rb"\xc2[\x80-\xbf]|\xe2[\x80\x81][\x80-\xbf]|\xe3\x80[\x80-\xbf]|\xef\xbc[\x80-\x8f]")


def words(text: str | None) -> list[bytes]:
    """Runs of letters (ASCII letters and anything outside ASCII but marks and spaces), lower-cased, as UTF-8.

    A longer run, as in a script without spaces, is cut into overlapping pieces, which share all their n-grams with it.
    """
    if not text:
        return []
    raw = text.lower().encode(errors="replace")
    found = (raw if raw.isascii() else _MARKS.sub(b" ", raw)).translate(_TABLE).split()
    if found and max(map(len, found)) > LONG:
        found = [x for w in found for x in ([w] if len(w) <= LONG else _pieces(w.decode(errors="ignore")))]
    return found


def _pieces(word: str) -> list[bytes]:
    return [word[i : i + PIECE].encode() for i in range(0, max(1, len(word) - (PIECE - STEP)), STEP)]


def buckets(word: bytes, size: int = BUCKETS) -> list[int]:
    """Buckets of the word and of its character n-grams, with marks at both ends."""
    w = f"<{word.decode(errors='ignore')}>"
    return [zlib.crc32(b"=" + word) % size, *(zlib.crc32(w[i : i + n].encode()) % size for n in NGRAMS for i in range(len(w) - n + 1))]


def _means(texts: Iterable[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, and the text, word and weight of each entry of the matrix that averages words to texts."""
    number: dict[bytes, int] = {}
    rows, cols, vals = [], [], []
    for i, t in enumerate(texts):
        ids, n = np.unique(np.fromiter((number.setdefault(w, len(number)) for w in t), np.int64, len(t)), return_counts=True)
        rows.append(np.full(len(ids), i))
        cols.append(ids)
        weight = np.log2(1 + n)
        vals.append(weight / (weight.sum() + PAD))
    cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return list(number), cat(rows, np.int64), cat(cols, np.int64), cat(vals, np.float32)


class _Sparse:
    """A fixed sparse matrix that multiplies dense ones, both ways."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        self.way = []
        for a, b, n in ((rows, cols, shape[0]), (cols, rows, shape[1])):
            order = np.argsort(a, kind="stable")
            at, first = np.unique(a[order], return_index=True)
            self.way.append((at, first, b[order].astype(np.int32), vals[order][:, None], n))

    def dot(self, x: np.ndarray, turned: bool = False) -> np.ndarray:
        at, first, other, vals, n = self.way[turned]
        out = np.zeros((n, x.shape[1]), np.float32)
        if len(at):
            out[at] = np.add.reduceat(x[other] * vals, first, axis=0)
        return out


def telling(rows: np.ndarray, cols: np.ndarray, of: np.ndarray, into: np.ndarray, toxic: np.ndarray, least: float) -> np.ndarray:
    """Which buckets stand in so different shares of toxic and of clean texts that chance rarely explains it (least: standard errors).

    rows and cols: the words of each text; of and into: the buckets of each word.
    """
    first = np.searchsorted(of, np.arange(of.max() + 2 if len(of) else 1))
    n = np.zeros((2, BUCKETS))
    for text in range(len(toxic)):
        own = cols[np.searchsorted(rows, text) : np.searchsorted(rows, text + 1)]
        if len(own):
            n[toxic[text]][np.unique(np.concatenate([into[first[w] : first[w + 1]] for w in own]))] += 1
    size = np.maximum(1, np.bincount(toxic, minlength=2))
    share, both = n / size[:, None], n.sum(axis=0) / size.sum()
    return np.abs(share[1] - share[0]) >= least * np.sqrt(np.maximum(both * (1 - both), 1 / size.sum()) * (1 / size[0] + 1 / size[1]))


def train(texts: Iterable[list[bytes]], toxic: np.ndarray, steps: int = STEPS, least: float = LEAST, seed: int = 1) -> tuple[np.ndarray, float]:
    """One number for each bucket, whose mean over a text's n-grams and words, plus the second result, is the text's logit."""
    known, rows, cols, vals = _means(texts)
    flat, size = array("i"), np.zeros(len(known), np.int64)
    for i, w in enumerate(known):
        before = len(flat)
        flat.extend(buckets(w))
        size[i] = len(flat) - before
    of, into_bucket = np.repeat(np.arange(len(known), dtype=np.int32), size), np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)
    # Other buckets say nothing of other texts; they stay zero, as do those never met.
    used = telling(rows, cols, of, into_bucket, toxic, least)[into_bucket]
    to_text = _Sparse(rows, cols, vals, (len(toxic), len(known)))
    to_word = _Sparse(of[used], into_bucket[used], (1 / size[of[used]]).astype(np.float32), (len(known), BUCKETS))
    rng = np.random.default_rng(seed)
    table = np.zeros((BUCKETS, DIMENSION), np.float32)
    soft, bias = rng.normal(0, 1, (DIMENSION, 2)).astype(np.float32), np.zeros(2, np.float32)
    weight = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum())).astype(np.float32)
    target = np.eye(2, dtype=np.float32)[toxic]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, soft, bias)]
    for step in range(1, steps + 1):
        mean = to_text.dot(to_word.dot(table))
        logit = mean @ soft + bias
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        miss = (p - target) * weight[:, None]
        into = to_word.dot(to_text.dot(miss @ soft.T, True), True)
        for (m, v), q, g, (rate, decay) in zip(moments, (table, soft, bias), (into, mean.T @ miss, miss.sum(axis=0)), RATES):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            q *= 1 - decay
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    """Evidence of texts under a trained table: the mean over all words, and the largest mean of any stretch of them."""

    def __init__(self, table: np.ndarray, stretch: int = STRETCH, empty: tuple[float, float] = (0.0, 0.0)):
        self.table, self.stretch, self.empty = table, stretch, empty
        self.known: dict[bytes, float] = {}

    def evidence(self, text: str | None) -> tuple[float, float]:
        w = words(text)
        if not w:
            return self.empty
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        if new := set(w).difference(known):
            new = list(new)
            grams = [buckets(x) for x in new]
            size = np.fromiter(map(len, grams), np.int64, len(grams))
            flat = self.table[np.fromiter((b for g in grams for b in g), np.int64, size.sum())]
            known.update(zip(new, (np.add.reduceat(flat, np.cumsum(size) - size, dtype=np.float64) / size).tolist()))
        count = Counter(w)
        weight = np.log2(1 + np.fromiter(count.values(), np.float64, len(count)))
        mean = float((weight * np.fromiter(map(known.__getitem__, count), np.float64, len(count))).sum() / (weight.sum() + PAD))
        most = -np.inf
        for end in range(min(len(w), self.stretch), len(w) + self.stretch // 2, self.stretch // 2):
            own = set(w[max(0, min(end, len(w)) - self.stretch) : end])
            most = max(most, sum(map(known.__getitem__, own)) / (len(own) + PAD))
        return mean, most


def calibrate(evidence: np.ndarray, toxic: np.ndarray, share: float, threshold: float = THRESHOLD) -> np.ndarray:
    """Weights of (mean, largest stretch, 1) for a logistic score, with classes weighted as in the corpus; shifted so that the threshold separates best."""
    scale = np.abs(evidence).mean(axis=0) + 1e-9
    x = np.column_stack([evidence / scale, np.ones(len(evidence))])
    weight = np.where(toxic == 1, share / max(1, (toxic == 1).sum()), (1 - share) / max(1, (toxic == 0).sum()))
    used = np.array([True, True, True])
    for _ in range(2):
        b = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-4, 1e-4, 1e-9])
            g = x.T @ (weight * (p - toxic)) + 1e-4 * b * [1, 1, 0]
            b[used] -= np.clip(np.linalg.solve(h[np.ix_(used, used)], g[used]), -5, 5)
        if (b[:2] >= 0).all():
            break
        # More evidence never lowers a score: a negative weight, which only offsets the other, is left out.
        used[int(np.argmin(b[:2]))] = False
    z = np.sort(x @ b)
    cuts = (z[1:] + z[:-1]) / 2
    own = x @ b
    hit = np.array([(weight * toxic * (own >= c)).sum() for c in cuts])
    all_ = np.array([(weight * (own >= c)).sum() for c in cuts])
    f1 = 2 * hit / (all_ + share)
    best = cuts[f1 >= f1.max() - 1e-12]
    b[2] += np.log(threshold / (1 - threshold)) - best.mean()
    return b / np.append(scale, 1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT


def fit(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_CHARS) -> dict:
    """The model, from at most per_class rows of each class (those first by a hash of doc_id) with texts of at most max_chars.

    A label without such a text takes no other's place. With fewer than five rows of a class, all texts get the share of toxic labels as their score.
    """
    known = labels.filter("toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), "toxic")
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    share = (n1 + 1) / (n0 + n1 + 10)
    order = F.xxhash64("_id")
    short = documents.filter(F.length("text") <= max_chars).select("doc_id", F.xxhash64("text").alias("_hash"), "text")
    there = short.select(F.col("doc_id").alias("_id"), "_hash").join(known, "_id").distinct()
    picked = reduce(DataFrame.unionAll, [there.filter(F.col("toxic") == c).orderBy(order, "_id", "_hash").limit(per_class) for c in (0, 1)])
    # The picked texts are at most 2 * per_class, so they may be broadcast.
    texts = short.join(F.broadcast(picked.withColumnRenamed("_hash", "_own")), (F.col("doc_id") == F.col("_id")) & (F.col("_hash") == F.col("_own")))
    rows = texts.groupBy("_id", "_hash", "toxic").agg(F.first("text").alias("text")).select("_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (zlib.crc32(f"{r[0]}".encode()), r[1], r[2]))
    toxic = np.array([r[2] for r in rows], np.int64)
    if min((toxic == 0).sum(), (toxic == 1).sum()) < 5:
        return {"table": np.zeros(BUCKETS, np.float32), "calibration": np.array([0, 0, np.log(share / (1 - share))]), "empty": (0.0, 0.0)}
    quarter = np.arange(len(rows)) % 4 == 0
    table, _ = train((words(r[1]) for r, x in zip(rows, quarter) if not x), toxic[~quarter])
    scorer = Scorer(table)
    evidence = np.array([scorer.evidence(r[1]) for r, x in zip(rows, quarter) if x])
    clean = evidence[toxic[quarter] == 0]
    empty = tuple(np.median(clean, axis=0).tolist()) if len(clean) else (0.0, 0.0)
    return {"table": table, "calibration": calibrate(evidence, toxic[quarter], share), "empty": empty}


def scored(documents: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """(given, score, predicted) of every row; all columns of documents are in the struct given, so none can clash."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    given = documents.select(F.struct(*[column(c) for c in documents.columns]).alias("given"), "text")
    schema = StructType([given.schema["given"], StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, weights = Scorer(shared.value["table"], empty=shared.value["empty"]), shared.value["calibration"]
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                e = np.array([(*scorer.evidence(t.as_py()), 1.0) for t in part.column(1)]).reshape(-1, 3)
                p = 1 / (1 + np.exp(-np.clip(e @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], schema.names)

    return given.mapInArrow(run, schema)


def score(documents: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of documents with score and predicted in place of any of these names; scored() keeps those too."""
    keep = [F.col("given").getField(c).alias(c) for c in documents.columns if c.lower() not in ("score", "predicted")]
    return scored(documents, model, threshold).select(*keep, "score", "predicted")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score(documents.select("doc_id", "text"), fit(documents, labels))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
