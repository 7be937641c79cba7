import hashlib

from hypothesis import given, settings, strategies as st

from turnstone.llm import chat

S = "conv_id bigint, turn bigint, role string, text string, formatted string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.lists(st.sampled_from(["<turn:", "<text>", "</turn>", "\\", "<", "/turn>", "a", "\n", "é😀"]), max_size=12).map("".join)), max_size=5))
def test_round_trip(turns):
    text, _ = chat.render(turns)
    assert chat.parse(text) == turns


def brute(rows):
    convs = {}
    for c, t, r, x, *_ in rows:
        convs.setdefault(c, []).append((t, r, x))
    key = lambda t: [(v is not None, v if v is not None else 0) for v in t]
    out = []
    for c, turns in convs.items():
        turns.sort(key=key)
        loss = "".join(x or "" for _, r, x in turns if r == "assistant")
        body = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in turns)
        out.append((c, len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", " <turn:x> ok\\</turn>\n "), (1, 2, "assistant", "..."), (2, 5, "assistant", None), (2, 1, None, "é😀 <text>"), (3, 0, "system", ""), (None, 0, "assistant", "日本😀"), (4, 0, "assistant", "x y. " * 4000), (4, 0, "assistant", "x y. " * 4000), (4, None, "user", "<|endoftext|>"), *[(5, i, ("user", "assistant")[i % 2], f" turn {i} ") for i in range(500)]]
    rows = [(*r, "extra") for r in rows]
    docs = spark.createDataFrame(rows, S)
    for size in (400_000, 1000):
        got = chat.report(chat.format_conversations(docs, segment_chars=size)).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    assert chat.report(chat.format_conversations(docs.limit(0))).count() == 0
    probe = {r.conv_id: r for r in chat.report(chat.format_conversations(chat.with_probe(docs))).collect()}[-7]
    assert probe.loss_chars == len(chat.PROBE_TEXT) and probe.loss_sha256 == hashlib.sha256(chat.PROBE_TEXT.encode()).hexdigest()
