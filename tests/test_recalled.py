"""Recalled errors: equal texts are searched for once, with the results of all pairs."""

from turnstone.streaming import tick


def test_equal_texts_are_searched_for_once(spark):
    texts = ["code1 module1 failed", "code1 module2 failed", "code2 module2 failed", "alone"]
    rows = [(i, texts[i % 3]) for i in range(1, 40)] + [(99, texts[3])]
    seen = []

    def embed(df):
        seen.append(df.count())
        return tick.logs.embed(df)

    errors = spark.createDataFrame(rows, "id bigint, text string")
    got = {r.hot: (r.text, r.target, round(r.score, 6)) for r in tick.recalled(errors, errors, embed).collect()}
    assert got == {i: (t, str(next(j for j, x in rows if x == t and j != i)), 1.0) for i, t in rows if i != 99}
    assert seen == [4, 4]
