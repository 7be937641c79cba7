import hashlib

from turnstone.llm import line_dedup


def brute(rows, least=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    n = {}
    for _, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            n[k] = n.get(k, 0) + 1
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or n[key(x)] < least]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_hot_lines_are_salted(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HEAVY_LEAST", 20)
    rows = [(i, f"hot\nown {i}\nwarm {i // 12}") for i in range(60)]
    got = line_dedup.report(line_dedup.drop_frequent_lines(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_matches_brute_force(spark):
    rows = [(i, f"own {i}\n  Shared LINE\t\n\nend {i % 2}", "x", 1) for i in range(9)] + [(10, "shared line", "x", 1), (None, "SHARED LINE\nÀ\xa0", "x", 1), (11, None, "x", 1), (12, "", "x", 1), (13, "a\n" * 3000, "x", 1), (0, "own 0\n  Shared LINE\t\n\nend 0", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, h1 string, n_lines int")
    for n in (10, 2):
        assert sorted(map(tuple, line_dedup.report(line_dedup.drop_frequent_lines(docs, n)).collect()), key=str) == brute(rows, n)
    assert line_dedup.drop_frequent_lines(docs.limit(0)).count() == 0
