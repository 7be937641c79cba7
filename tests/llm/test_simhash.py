import re

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st

from turnstone.llm import simhash


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    k = min(4, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), seed=42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items):
    best = {i: d for i, (d, _) in enumerate(items)}
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i][1] ^ items[j][1]).count("1") <= 4:
                root[find(i)] = find(j)
    low = {}
    for i in best:
        low[find(i)] = min((x for x in (low.get(find(i)), best[i]) if x is not None), default=None)
    return sorted(((d, f"{fp:016x}", low[find(i)]) for i, (d, fp) in enumerate(items)), key=str)


def test_fingerprint():
    for t in (None, "", " \t", "One", "a b c d e f g a b c d e", "É à\x0bB c\n d é " * 70000):
        assert simhash.fingerprint(t) == brute_fp(t)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 600), st.integers(1, 9))
def test_forest_keeps_every_connection(seed, n, flips):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fp = centre[rng.integers(0, 5, n)]
    for _ in range(flips):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    node = rng.integers(0, 3, n)
    order = np.lexsort((simhash.gray_rank(fp), node))
    fp, node = fp[order], node[order]
    a, b = simhash.link_forest(fp, node)
    assert (np.bitwise_count(fp[a] ^ fp[b]) >= 0).all() and len(a) < n
    got = simhash._merge(np.arange(n), a, b)
    near = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4) & (node[:, None] == node[None, :])
    x, y = np.nonzero(near)
    assert (simhash._merge(np.arange(n), x, y) == got).all()


def test_masks_are_exact():
    rng = np.random.default_rng(1)
    for n in (10, 10**8, 10**12):
        masks = simhash.upper_masks(n)
        for _ in range(200):
            d = sum({1 << int(b) for b in rng.integers(0, 64, 4)})
            assert any(d & m == 0 for m in masks)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    base = " ".join(f"w{i}" for i in rng.integers(0, 900, 400))
    texts = [base, base, base.upper(), base + " tail", base.replace("w5", "x5", 1), None, "", "  ", "one", "two words", "one"] + [" ".join(f"v{i}" for i in rng.integers(0, 50, 30)) for _ in range(60)]
    rows = [(None if i == 3 else 100 - i, t, 1, "x") for i, t in enumerate(texts)] + [(100, base, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int, component_id string")
    got = sorted(map(tuple, simhash.report(simhash.near_duplicates(docs)).collect()), key=str)
    assert got == brute_components([(r[0], brute_fp(r[1])) for r in rows])
    kept = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == {c for *_, c in got}


def test_salted_nodes(spark):
    rng = np.random.default_rng(3)
    fp = np.unique(np.uint64(0xABCDEF0123456789) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 20, 300, dtype=np.uint64)))
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp bigint")
    got = {r.node: r.component for r in simhash.components(simhash.links(nodes, node_rows=40)).collect()}
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    want = simhash._merge(np.arange(len(fp)), *np.nonzero(near))
    groups = {}
    for i, x in enumerate(fp.view(np.int64).tolist()):
        groups.setdefault(int(want[i]), set()).add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
