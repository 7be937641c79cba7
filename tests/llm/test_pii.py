import hashlib
import re

import numpy as np

from turnstone.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


TEXTS = [None, "", "no data", "é😀 a.b@c.de, x@y x@y.z_q@r.s.t. @@ a@b..c", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255 1.2.3.00256 1.2.3.4x", "4111 1111-1111 1111 and 4111111111111112 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "+1 (608) 555-0659 +1 2 +123456789012345678 +49 30 1234567-", "ñ 4199338693996156\n+1 (555) 555-5555\nq@w.e 10.0.0.1", "a" * 3000 + "@" + "b" * 3000 + "." + "9" * 30000, " ".join(f"u{i}@h{i}.org" for i in range(1500)), "\t+1.2.3.4.5.6.7.8.9"]


def test_base_matches_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "x"), (3, TEXTS[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = {(r.doc_id, r.base_sha256): r for r in pii.report(pii.detect(docs)).collect()}
    for d, t, _ in rows:
        want = brute(t)
        r = got[d, hashlib.sha256(",".join(want).encode()).hexdigest()]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in BASE]
        assert r.spans.split(",")[: len(want)] == (want or [""])[: len(want)]
    assert pii.report(pii.detect(docs.limit(0))).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail é a@b.cd or +1 (608) 555-0659!"), (2, None)], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in pii.redact(pii.detect(docs)).collect()} == {1: "mail é <email> or <phone>!", 2: ""}


def test_trees_compile_to_the_same_scores(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    trees = pii.Trees().fit(x, y)
    assert ((trees.score(x) > 0) == (y > 0)).mean() > 0.9
    got = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>").select("i", trees.expression(F.col("x")).alias("s")).collect()
    assert np.allclose([r.s for r in sorted(got)], trees.score(x))


def test_learnt_kinds_are_added(spark):
    rng = np.random.default_rng(6)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(60)]
    rows = [(i, f'Some words here, token = "{h}" and more.') for i, h in enumerate(hexes)] + [(100 + i, "Plain prose with supercalifragilistic" + "".join(rng.choice(list("abcdghmnopz"), 12)) + " words, nothing else.") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.report(pii.detect(docs)).collect()}
    assert sum("secret:26:66" in got[i] for i in range(60)) >= 55 and not any(got[i] for i in range(100, 160))


def test_runs_of_any_length_are_proposed(spark):
    from pyspark.sql import functions as F

    texts = ["token = " + "0123456789abcdef" * 10, "AKIA" + "Z9" * 100, "key=" + "aB3/" * 300 + "==", "n" * 300 + " [at] " + "host" * 100 + ".org", "x" * 100_000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", F.transform(pii.candidates(F.col("text")), lambda s: F.struct("text", s["start"], s["end"])).alias("c")).collect()
    found = {r.i: [texts[r.i][c[1] : c[2]] for c in r.c] for r in got}
    assert found[0] == ["0123456789abcdef" * 10] and found[1] == ["AKIA" + "Z9" * 100] and found[2] == ["aB3/" * 300 + "=="] and texts[3] in found[3]


def test_rivals_are_found_by_runs(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    rows = []
    for n in (0, 1, 2, 30, 700, 2000):
        start = rng.integers(0, 10 * n + 1, n)
        rows.append((n, [(int(a), int(a + rng.integers(1, 30)), int(rng.integers(0, 8)), f"t{i}", float(rng.choice([0.5, 1.0, 2.0, float("inf")]))) for i, a in enumerate(start)]))
    rows.append((-1, [(0, 5000, 4, "long", 1.0), *((10 * i, 10 * i + 3, 5, "short", 0.5) for i in range(400))]))
    df = spark.createDataFrame(rows, "n int, a array<struct<start:bigint,end:bigint,kind:int,text:string,score:double>>")
    got = {r.n: sorted(map(tuple, r.k)) for r in df.select("n", pii.unrivalled(F.col("a")).alias("k")).collect()}
    key = lambda x: (-x[4], x[0], x[2])
    for n, spans in rows:
        assert got[n] == sorted(x for x in spans if not any(x[0] < y[1] and y[0] < x[1] and key(y) < key(x) for y in spans)), n
    top = spark.createDataFrame([([3, 1, 4, 1, 5] * 400,)], "v array<bigint>").select(pii.prefix_max(F.col("v")).alias("m")).first().m
    assert top == np.maximum.accumulate([3, 1, 4, 1, 5] * 400).tolist()
