import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from turnstone.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, min_words=24):
    """Stretches in which words q apart are equal, by every q, without those that a smaller period explains."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            if length >= max(min_words, 3 * q) and not any(a <= s and s + length <= a + m for a, m in found):
                found[s, length] = q
    return sorted((s, m, q) for (s, m), q in found.items())


def brute(doc_id, text, planted=True):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *row, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


@pytest.mark.parametrize("letters", [1, 2, 3, 40])
def test_runs_of_words(letters):
    rng = np.random.default_rng(letters)
    for _ in range(60):
        n = int(rng.integers(0, 160))
        w = [f"w{x}".encode() for x in rng.integers(0, letters, n)]
        for _ in range(int(rng.integers(0, 4))):
            at, p, times = int(rng.integers(0, n + 1)), int(rng.integers(1, 14)), int(rng.integers(2, 9))
            w[at:at] = [f"w{x}".encode() for x in rng.integers(0, letters + 1, p)] * times
        assert runs.runs_of(w) == brute_runs(w)
        assert runs.with_repeats([w], 16)[0] or not brute_runs(w)
        assert runs.runs_of(w, 30) == brute_runs(w, 30)
        assert runs.with_repeats([[], w, [b"x"]], 20)[1] or not brute_runs(w, 30)


def test_runs_inside_runs():
    inner = [b"a"] * 30 + [b"b"]
    w = inner * 4
    assert runs.runs_of(w) == brute_runs(w) and len(brute_runs(w)) == 5


def test_sets_of_any_order():
    rng = np.random.default_rng(9)
    part = [[f"p{k}x{i}".encode() for i in range(20)] for k in range(4)]
    for _ in range(20):
        w = [x for k in rng.integers(0, 4, 40) for x in part[k]]
        assert runs.runs_of(w) == brute_runs(w)


def test_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    texts = [None, "", " \t\n", "one", "a  b\tc", "x " * 50, ("a b c\n" * 20) + "é ü " + ("a b c " * 20), "퟿ " * 24, "tail " * 24 + "end", "z" * 100_000 + " y"]
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 9, int(rng.integers(1, 200)))) for _ in range(250)] + ["k l " * 30_000]
    ids = [None, None, *range(len(texts) - 5), 7, 7, 10**15]
    rows = [(i, t, "src", 1, "clash", 2.5) for i, t in zip(ids, texts)] + [(7, texts[8], "src", 1, "clash", 2.5)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n int, document string, found double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    slow = lambda t: t and len(t) > 50_000 and " l" in t
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [brute(r[0], r[1]) for r in rows if not slow(r[1])]
    have = [tuple(r) for r in got.collect()]
    assert sum(h == (10**15, 1, 0, 60_000, 2, 30_000_000) for h in (x[:6] for x in have)) == 1
    assert sorted((h for h in have if h[0] != 10**15), key=repr) == sorted((w for w in want if w[0] != 10**15), key=repr)
    assert sum(w[1] > 0 for w in want) > 10 and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids) > 3


def test_columns_stay_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a " * 30, "mine", 4)], "doc_id bigint, text string, document string, `runs.x` int")
    row = runs.collapse(docs).first()
    assert row.document.asDict() == {"doc_id": 1, "document": "mine", "runs.x": 4} and row.found.text == "a" and [tuple(r) for r in row.found.runs] == [(0, 30, 1)]
    assert runs.report(runs.collapse(runs.periodic(docs.limit(0)))).count() == 0
