"""Columns of users, whatever their names, come out of every stage and operator as they went in."""

import numpy as np
import pytest

import corpus_pipeline
from turnstone.llm import line_dedup, pii, quality, toxicity
from turnstone.llm.common import free_names

NAMES = "score predicted n_lines n_dropped base spans measures base_failed kept _own _key _id _k _rows _row _bad h1 h2 key node root given Given2 _given id rows _doc _pos _gone _its _hash label toxic fp component a.b n"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    prose = lambda: " ".join(f"w{x}" for x in rng.integers(0, 900, 60))
    bad = lambda: " ".join(f"w{x} grunkle{x % 3}" for x in rng.integers(0, 900, 30))
    texts = [bad() if i % 3 == 0 else prose() for i in range(60)]
    texts += [texts[1], texts[1] + " more", None, "", prose() + "\nfooter", *[prose() + "\nfooter" for _ in range(12)], "mail a.b@example.org or +44 20 7946 0123"]
    d = str(tmp_path_factory.mktemp("clash"))
    names = NAMES.split()
    rows = [(i, t, *(f"{c} {i}" for c in names), {"m": i}, [float(i)]) for i, t in enumerate(texts)]
    kinds = ", ".join(f"`{c}` string" for c in names)
    spark.createDataFrame(rows, f"doc_id bigint, text string, {kinds}, `_m` map<string, int>, `_v` array<double>").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, texts[5])], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, names


def same(df, names):
    rows = df.collect()
    for r in rows:
        assert all(r[c] == f"{c} {r['doc_id']}" for c in names) and r["_m"] == {"m": r["doc_id"]} and r["_v"] == [float(r["doc_id"])]
    return {r["doc_id"] for r in rows}


def test_stages(spark, corpus):
    d, names = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "line_dedup", "near_duplicates", "decontamination"):
        out = steps[name](spark, docs, d)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        ids = same(out, names)
        assert len(ids) >= 40 and (name == "line_dedup") == (len(ids) == docs.count())
    assert corpus_pipeline.run(spark, d).count() > 30


def test_operators(spark, corpus):
    d, names = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    for out, added in ((toxicity.scored(docs, model).select("given.*"), []), (line_dedup.drop_frequent_lines(docs), ["n_lines_", "n_dropped_"]), (quality.judge(docs), ["measures_", "base_failed_", "kept_"]), (pii.detect(docs), ["base_", "spans_"])):
        assert out.columns == docs.columns + added
        same(out, names)
    clean = pii.redact(pii.detect(docs))
    assert clean.columns == docs.columns and "<email>" in clean.filter("text like '%mail%'").first().text
    same(clean, names)


def test_free_names():
    assert free_names(["a", "B", "b_"], "b", "a", "c", "c") == ["b__", "a_", "c", "c_"]
