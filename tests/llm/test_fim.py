import hashlib
import re

import numpy as np

from turnstone.llm import fim, queries

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    t = text or ""
    u = [m.group() for m in UNIT.finditer(t)]
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in range(0, 32, 8))
    i, j = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    a, b, z = "".join(u[:i]), "".join(u[i:j]), "".join(u[j:])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90:
        return doc_id, len(u), "plain", None, None, sha(t), sha(t)
    out = f"<S>{z}<P>{a}<M>{b}" if h4 % 100 < 20 else f"<P>{a}<S>{z}<M>{b}"
    return doc_id, len(u), "spm" if h4 % 100 < 20 else "psm", len(a), len(b), sha(out), sha(t)


def test_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    texts = [None, "", "<P>", "a<S>b", "<", "<P", "P>", "S><", "<<<M", "\n\n", "é𝒳 ü", "word", "w" * 200_000, "a b " * 60_000, "<S" * 300 + "P>" * 200]
    texts += ["".join(rng.choice(list("ab <>PSM\n.é𝒳1"), int(rng.integers(1, 60)))) for _ in range(400)]
    rows = [(None if k % 50 == 3 else k % 300, t, "x", 1) for k, t in enumerate(texts)] + [(5, "twice", "x", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form string, n int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_fill_in_middle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = [brute(r[0], r[1]) for r in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}


def test_outputs_and_columns(spark):
    docs = spark.createDataFrame([(k, "one two, three", "mine", 9) for k in range(40)], "doc_id bigint, text string, fim string, `n.x` int")
    made = fim.transform(docs).collect()
    assert all(r.document.asDict() == {"doc_id": r.document.doc_id, "fim": "mine", "n.x": 9} for r in made)
    psm = next(r.fim for r in made if r.fim.form == "psm")
    assert psm.text == f"<P>{'one two, three'[:psm.prefix_chars]}<S>{'one two, three'[psm.prefix_chars + psm.middle_chars:]}<M>{'one two, three'[psm.prefix_chars:][:psm.middle_chars]}"
    assert fim.report(fim.transform(docs.limit(0))).count() == 0
