import numpy as np
import pytest

import corpus_pipeline
from turnstone.llm import toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abdeghilmnorstu"), rng.integers(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    insults = ["blockhead", "nincompoop", "dunderhead"]
    rows, labels = [], []
    for i in range(400):
        w = prose(rng, 80).split()
        toxic = i % 4 == 0
        if toxic:
            for at in rng.integers(0, 80, 16):
                w[at] = str(rng.choice(insults))
        rows.append((i, " ".join(w) + ("\nShared footer line" if i % 2 else ""), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    passage = prose(rng, 30)
    rows += [(1000, prose(rng, 40) + " " + passage, "en", "s", 0), (1001, rows[1][1], "en", "s", 0), (1002, rows[1][1] + " tail", "en", "s", 0), (1003, None, "en", "s", 0), (None, prose(rng, 50), "en", "s", 0), (1004, " ".join(f"{w} {insults[k % 3]}s" for k, w in enumerate(prose(rng, 40).split())), "en", "s", 0)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, labels


def test_stages(spark, corpus):
    d, rows, labels = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["toxicity"](spark, docs, d)
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & {i for i in range(400) if i % 4 == 0}) <= 4 and len(ids & {i for i in range(400) if i % 4}) >= 296
    assert {None, 1003} <= ids and kept.columns == docs.columns
    lined = steps["line_dedup"](spark, docs, d)
    assert {r.doc_id for r in lined.collect() if "Shared footer" in r.text} == {1002} and lined.count() == len(rows) and lined.columns == docs.columns
    single = steps["near_duplicates"](spark, docs, d)
    left = {r.doc_id for r in single.collect()}
    assert 1 in left and not left & {1001, 1002} and {*range(400), None, 1003} <= left and single.columns == docs.columns
    clean = steps["decontamination"](spark, docs, d)
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {1000} and clean.columns == docs.columns
    packed = corpus_pipeline.run(spark, d)
    out = {r.doc_id for r in packed.collect()}
    assert 1000 not in out and 1001 not in out and None in out


def test_scores(spark, corpus):
    d, rows, labels = corpus
    got = {r.doc_id: r for r in toxicity.report(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect()}
    held = [i for i in range(400) if got[i].held_out]
    assert 60 < len(held) < 140
    assert sum((got[i].score >= 0.3) == (i % 4 == 0) == bool(got[i].predicted) for i in held) >= 0.95 * len(held)
    assert 0 <= got[1003].score < 0.3


def test_without_labels(spark, corpus):
    d, *_ = corpus
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    assert {r.predicted for r in toxicity.report(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.report(docs.limit(0), labels).count() == 0


def test_unseen_misspellings():
    rng = np.random.default_rng(11)
    insults = ["blockhead", "nincompoop", "dunderhead"]
    texts = [prose(rng, 80).split() for _ in range(300)]
    toxic = np.arange(300) % 4 == 0
    for t in (t for t, y in zip(texts, toxic) if y):
        for at in rng.integers(0, 80, 16):
            t[at] = str(rng.choice(insults))
    table, _ = toxicity.train([toxicity.words(" ".join(t)) for t in texts], toxic.astype(int))
    scorer = toxicity.Scorer(table)
    word = lambda w: scorer.evidence(w)[0]
    clean = max(word(w) for w in prose(rng, 200).split())
    assert all(word(w) > clean for w in ("blockheads", "nincompooop", "dunderhaed", "blokhead"))
