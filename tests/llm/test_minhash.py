import collections
import itertools
import os

import numpy as np
import pytest

import corpus_pipeline
from turnstone.llm import minhash

SCHEMA = "doc_id bigint, text string, source string"


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def test_copies_at_the_wanted_similarity_go(spark):
    rng = np.random.default_rng(4)
    rows, gone, bands = [], set(), []
    for i in range(60):
        w = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        base = " ".join(w)
        for at in rng.choice(400, 1 + i // 5, replace=False):
            w[at] = "other"
        s = jaccard(base, " ".join(w))
        bands.append(s)
        rows += [(2 * i, base, "s"), (2 * i + 1, " ".join(w), "s")]
        if s >= 0.8:
            gone.add(2 * i + 1)
    assert sum(0.8 <= s < 0.95 for s in bands) >= 20 and sum(s < 0.8 for s in bands) >= 3
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == {r[0] for r in rows} - gone


def test_empty(spark):
    assert minhash.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall_against_all_pairs(spark):
    """Every pair of the table at 0.8 or more, found by counting common shingles, is in one component, and nothing else is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    root = {r.doc_id: r.root for r in minhash.roots(docs).collect()}
    sets = {r.doc_id: grams(r.text or "") for r in docs.collect()}
    holders, common = {}, collections.Counter()
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    for ids in holders.values():
        common.update(itertools.combinations(ids, 2))
    pairs = [(a, b) for (a, b), n in common.items() if 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n)]
    assert len(pairs) > 50 and all(root[a] == root[b] for a, b in pairs)
    least = {i: i for i in sets}
    for _ in range(len(sets)):
        moved = [(a, b) for a, b in pairs if least[a] != least[b]]
        if not moved:
            break
        for a, b in moved:
            least[a] = least[b] = min(least[a], least[b])
    assert len(set(least.values())) == len(set(root.values()))
