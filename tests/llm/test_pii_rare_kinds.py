import numpy as np

from turnstone.llm import pii


def test_a_rare_kind_is_found_in_a_large_table(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"Plain prose number {i}, nothing else.") for i in range(9000)]
    secret = [f"token = {''.join(rng.choice(list('0123456789abcdef'), 40))}" for _ in range(9)]
    rows += [(10000 + i, t) for i, t in enumerate(secret)] + [(20000, "Write to jane.doe [at] example [dot] org today.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.report(pii.detect(docs)).filter("spans <> ''").collect()}
    assert got == {**{10000 + i: "secret:8:48" for i in range(9)}, 20000: "obfuscated_email:9:40"}
