import math
import re
from collections import Counter

from turnstone.llm import lm_score

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows):
    texts = [WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for _, t, *_ in rows]
    uni = Counter(w for t in texts for w in t)
    pairs = Counter(x for t in texts for x in zip(["<s>", *t], t))
    ctx = uni + Counter({"<s>": sum(bool(t) for t in texts)})
    total = sum(uni.values())
    out = []
    for (d, *_), t in zip(rows, texts):
        s = sum(math.log(pairs[p, w] / ctx[p]) if pairs[p, w] >= 2 else math.log(0.4 * uni[w] / total) for p, w in zip(["<s>", *t], t))
        out.append((d, len(t), round(s, 6), round(s / len(t), 6) if t else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r[0], r[1], round(r[2], 6) + 0.0, None if r[3] is None else round(r[3], 6)) for r in df.collect()), key=str)


ROWS = [(1, "The cat sat on the mat. The cat!"), (2, None), (3, ""), (4, "... !"), (None, "é日本 the cat"), (None, "hot pair hot pair"), (1, "The cat sat on the mat. The cat!"), (5, "x " * 70_000 + "the cat sat"), (6, " ".join(f"w{i % 37} w{i % 11}" for i in range(900))), *((100 + i, "hot pair other thing") for i in range(300))]


def test_matches_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, "z") for r in ROWS], "doc_id bigint, text string, h string")
    # All words with numbers; most words by their hashes; all by their hashes; pairs dealt over salts; long texts in stretches.
    for options in ({}, {"frequent": 20}, {"frequent": 1}, {"part_pairs": 4000}, {"frequent": 20, "part_pairs": 3000}):
        assert got(lm_score.score(docs, **options)) == brute(ROWS)
    assert lm_score.score(docs.limit(0)).count() == 0


def test_hot_pairs_meet_in_no_task(spark):
    """Two hot pairs, in no list of any kind: no key has many more rows than a part."""
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    numbers = lm_score.Numbers(sorted(Counter(w for _, t in ROWS for w in lm_score.words(t)).items(), key=lambda r: (-r[1], r[0])), len(ROWS))
    rows = lm_score.exploded(docs, spark.sparkContext.broadcast(numbers), 30).groupBy("gram", "other").count().collect()
    assert max(r["count"] for r in rows) < 60 and len({r["gram"] >> 2 * lm_score.BITS for r in rows if r["gram"] >= 0}) >= 10
