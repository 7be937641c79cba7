import re

from turnstone.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    where = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for p in where.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))


def test_counts_match_brute_force(spark):
    line = "the cat sat on a mat and then it ran off to the sea"
    texts = [None, "", " \t\n\x0b\x0c\r", "one", "a b c d e f g h", line, f"{line}\n{line}\nx", "a " * 30, "a a a a a a a a b a a a a a a a a", f"{line} # * $ <b> é à 日本\n \n{line[:20]}\n\n" * 3, "x" * 5000, "\xa0 \x85   w", f"{line} {line.upper()} " + " ".join(map(str, range(4000))), " ".join(str(i % 11) for i in range(100)), " ".join(str(i * i % 23) for i in range(200))]
    rows = [(i, t, True, "x") for i, t in enumerate(texts)] + [(None, line, True, "x"), (1, texts[5], True, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept boolean, measures string")
    got = quality.report(quality.judge(docs)).collect()
    assert sorted(((r[0], *r[1:7]) for r in got), key=str) == sorted(((d, *brute(t)) for d, t, *_ in rows), key=str)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.judge(docs.limit(0)).count() == 0


def test_plain_prose_stays_and_junk_goes(spark):
    prose = "It was a bright day, and the ship that had come in from the sea was full of grain for the town. Nobody knew whose it was."
    junk = "LOOK!! AT!! THIS!! " * 2 + " ".join(f"W{i}##$$%%" for i in range(40))
    docs = spark.createDataFrame([(1, prose), (2, junk)], "doc_id bigint, text string")
    assert {r.doc_id: r.kept for r in quality.report(quality.judge(docs)).collect()} == {1: True, 2: False}
