"""The pipeline's near-copy stage has the links of SimHash fingerprints and those of like shingle sets."""

import numpy as np

import corpus_pipeline
from turnstone.llm import minhash, simhash


def test_both_kinds_of_links(spark):
    rng = np.random.default_rng(5)
    words = lambda n: ["".join(rng.choice(list("abdeghilmnorstu"), rng.integers(3, 9))) for _ in range(n)]
    para = words(21) * 100
    a, b = " ".join(para + words(25)), " ".join(para + words(25))
    base = words(300)
    near = [w + "x" if i in (50, 150, 250) else w for i, w in enumerate(base)]
    rows = [(1, a), (2, b), (3, " ".join(base)), (4, " ".join(near)), (5, " ".join(words(80))), (6, None)]
    apart = lambda x, y: bin(simhash.fingerprint(x) ^ simhash.fingerprint(y)).count("1")
    assert apart(a, b) <= simhash.DISTANCE and minhash.similarity(minhash.shingles(a), minhash.shingles(b)) < minhash.SIMILARITY
    assert minhash.similarity(minhash.shingles(rows[2][1]), minhash.shingles(rows[3][1])) >= minhash.SIMILARITY
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {1, 3, 5, 6}
