from turnstone.llm import decontam, minhash, simhash

SCHEMA = "doc_id bigint, text string, source string"


def test_null_and_repeated_ids_keep_clean_documents(spark):
    text = lambda i: " ".join(f"d{i}x{k}" for k in range(30))
    rows = [(None, text(i), "s") for i in range(8)] + [(7, text(100 + i), "s") for i in range(5)] + [(7, text(100), "s"), (None, text(100), "s"), (9, None, "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for stage in (minhash.one_of_each, simhash.one_of_each):
        got = [(r.doc_id, r.text) for r in stage(docs).collect()]
        assert sorted(got, key=str) == sorted({(d, t) for d, t, _ in rows if (d, t) != (None, text(100))}, key=str)
    bench = spark.createDataFrame([(1, text(3)), (2, text(102))], "item_id bigint, text string")
    left = [(r.doc_id, r.text) for r in decontam.clean(docs, bench).collect()]
    assert len(left) == len(rows) - 2 and not {text(3), text(102)} & {t for _, t in left}
