import hashlib
import re

from turnstone.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC, BENCH = "doc_id bigint, text string, item_id string", "item_id bigint, text string, doc_id string"


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench):
    out = []
    for d, text, *_ in docs:
        w, hit, items, near = split(text), set(), set(), set()
        for item, t, *_ in bench:
            b = split(t)
            for i in range(max(1, len(b) - 9) if b else 0):
                g = b[i : i + 10]
                for j in range(len(w) - len(g) + 1):
                    if w[j : j + len(g)] == g:
                        hit.update(range(j, j + len(g)))
                        items.add("null" if item is None else str(item))
                at = [{j for j, x in enumerate(w) if x == y} for y in g]
                if all(at) and any(all(any(s + k + e in p for e in range(-2, 3)) for k, p in enumerate(at)) for j in at[0] for s in range(j - 2, j + 3)):
                    near.add("null" if item is None else str(item))
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit), len(near)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    p = " ".join(f"w{i % 13}" for i in range(25))
    docs = [(1, f"xx {p} yy", "a"), (2, None, "a"), (3, "", "a"), (4, "W0, w1; É-w2", "a"), (4, "W0, w1; É-w2", "a"), (None, p.upper(), "a"), (5, "w " * 5000 + "short item " + "w " * 50, "a"), (6, " ".join(f"w{i}" for i in range(9)), "a"), (7, "short. ITEM", "a")]
    bench = [(1, p, "x"), (2, "short item", "x"), (3, None, "x"), (4, "...", "x"), (None, "w0 w1 é", "x"), (1, "w w w w w w w w w w w w", "x")]
    d, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(bench, BENCH)
    for options in ({}, {"block_words": 5}, {"group_words": 30}, {"max_terms": 1}):
        got = decontam.report(decontam.decontaminate(d, b, **options))
        assert sorted(map(tuple, got.collect()), key=str) == brute(docs, bench)
    assert sorted(r[0] for r in decontam.clean(d, b.filter("item_id = 2")).collect() if r[0]) == [1, 2, 3, 4, 4, 6]


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], DOC), spark.createDataFrame([], BENCH)
    assert decontam.report(decontam.decontaminate(d, b)).count() == 0
    got = decontam.report(decontam.decontaminate(spark.createDataFrame([(1, "a b", "")], DOC), b)).collect()
    assert [tuple(r[:4]) for r in got] == [(1, 2, 0, 0)]


def test_proximity(spark):
    docs = [(1, "a x b c", ""), (2, "a x x x x x b c", ""), (3, "c b a", ""), (4, "b a x c", ""), (5, "a b", "")]
    bench = [(1, "a b c", "")]
    got = decontam.report(decontam.decontaminate(spark.createDataFrame(docs, DOC), spark.createDataFrame(bench, BENCH)))
    assert {r.doc_id for r in got.collect() if r.n_near} == {1, 3, 4} and sorted(map(tuple, got.collect()), key=str) == brute(docs, bench)
