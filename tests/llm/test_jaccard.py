import re

import numpy as np
import pytest

from turnstone.llm import jaccard, queries
from turnstone.llm.common import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, k=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def linked(x, y, percent=85):
    both = len(x & y)
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def brute(rows):
    sets = [grams(t) for _, t in rows]
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                at[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def families(rng, groups, words=140):
    """Copies of some texts with ever more words changed, at places of their own, and texts that share long passages."""
    texts = []
    for _ in range(groups):
        base = [f"v{x}" for x in rng.integers(0, 4000, int(rng.integers(6, words)))]
        for k in range(int(rng.integers(2, 14))):
            w = list(base)
            for at in rng.integers(0, len(w), k // 4):
                w[at] = f"own{rng.integers(0, 10**9)}"
            for _ in range(k % 3):
                w.insert(int(rng.integers(0, len(w) + 1)), f"new{rng.integers(0, 10**9)}")
            texts.append(" ".join(w if k % 4 else w[: len(w) - k // 4]))
        texts += [" ".join([*base[: len(base) * 2 // 3], *(f"o{x}" for x in rng.integers(0, 10**9, len(base) // 3))]) for _ in range(3)]
    return texts


ODD = [None, "", " \n\t", "one", "One", "one two", "one two three", "one two  THREE", "one two three four", "é É", "x " * 400, "x " * 9, ("a b c d e f g h i j " * 3000), ("a b c d e f g h i j " * 3000) + "tail"]


@pytest.mark.parametrize("seed,sampled", [(1, False), (2, True)])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, seed, sampled):
    if sampled:
        # Most keys of the families stand out and are dealt over salts.
        monkeypatch.setattr(jaccard, "SAMPLE", 200)
        monkeypatch.setattr(jaccard, "HOT", 2)
    rng = np.random.default_rng(seed)
    texts = [*families(rng, 40), *ODD]
    rows = [(None if k % 37 == 5 else int(d), t) for k, (d, t) in enumerate(zip(rng.permutation(len(texts)), texts))]
    rows += rows[:3] + [(rows[0][0], rows[9][1]), (None, None), (None, "only null ids"), (None, "only  null ids")]
    docs = spark.createDataFrame([(d, t, 1, "c", 0) for d, t in rows], "doc_id bigint, text string, node int, c string, n_shingles int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_ngram_jaccard(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert len({w[2] for w in want}) < len(rows) - 60


@pytest.mark.parametrize("percent", [85, 70])
def test_search_finds_every_pair(spark, percent):
    """Without the middles: each set is its own component, so the allocation alone must find all pairs."""
    rng = np.random.default_rng(percent)
    texts = families(rng, 14)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    marks = materialize(jaccard._marks(docs, 4, percent), "m")
    nodes = materialize(marks.groupBy("node").agg(*[jaccard.F.max(c).alias(c) for c in ("key", "n", "units", "own", "below")]), "n")
    live = materialize(jaccard._live(jaccard._rows(docs, nodes, len(texts), 4, percent), percent), "l")
    sets = materialize(jaccard._sets(docs.select("text", jaccard.text_key().alias("key")).join(nodes.select("node", "key"), "key"), 4), "s")
    found = jaccard._similar(jaccard._searched(live, nodes, sets, percent), sets, percent)
    node = {r.doc_id: r.node for r in marks.collect()}
    want = {tuple(sorted((node[i], node[j]))) for i in node for j in node if node[i] != node[j] and linked(grams(texts[i]), grams(texts[j]), percent)}
    assert {(r.a, r.b) for r in found.collect()} == want and len(want) > 40


def test_large_group_gives_few_candidates(spark, monkeypatch):
    """Copies ever farther from their text: those too far have so many words of their own that nobody is compared with them."""
    rng = np.random.default_rng(8)
    base = [f"b{x}" for x in range(150)]
    texts = []
    for k in range(300):
        w = list(base)
        for at in rng.choice(150, k % 14, replace=False):
            w[at] = f"own{rng.integers(0, 10**9)}"
        texts.append(" ".join(w))
    checked = []
    similar = jaccard._similar
    monkeypatch.setattr(jaccard, "_similar", lambda pairs, sets, percent: checked.append(pairs.count()) or similar(pairs, sets, percent))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(map(tuple, jaccard.join(docs).collect()))
    assert got == sorted(brute(list(enumerate(texts)))) and len(checked) == 2 and sum(checked) < 600


def test_keys_that_go_over_batches():
    """A key's rows may come in any cuts."""
    rng = np.random.default_rng(0)
    import pyarrow as pa

    class Held:
        def repartition(self, *a):
            return self

        def sortWithinPartitions(self, *a):
            return self

        def mapInArrow(self, run, schema):
            return run

    run = jaccard._shared(Held(), [])
    top = -(1 << 63)
    for _ in range(200):
        rows = sorted((int(k), int(n) + (top if o else 0)) for k, n, o in zip(rng.integers(0, 6, 30), rng.integers(0, 3, 30), rng.integers(0, 2, 30)))
        cuts = [0, *sorted(rng.integers(0, 31, 5).tolist()), 30]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a:b]], pa.int64()) for i in (0, 1)], ["key", "node"]) for a, b in zip(cuts, cuts[1:])]
        got = [(k, n, o) for b in run(batches) for k, n, o in zip(*(c.to_pylist() for c in b.columns))]
        of = {}
        for k, n in rows:
            of.setdefault(k, set()).add(n)
        want = sorted((k, n & ((1 << 63) - 1), n < 0) for k, ns in of.items() if len(ns) > 1 and min(ns) < 0 for n in ns)
        assert sorted(got) == want


def test_empty_table(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
