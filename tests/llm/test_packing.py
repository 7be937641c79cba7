import zlib

import numpy as np
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from turnstone.llm import packing

TEXTS = [None, "", "Hello, World!  it's 12 o'clock\n\nÀÉ I\u0307 e\u0301 \x1c\x85\xa0x \u0301a", "a<|endoftext|>b <|startoftext|> c", "word " * 5000, "日本語 テスト 😀👍", "\t\r\n \x0b", "don't we'll"]


def brute(text, tok):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_tokenizer(text):
    tok, enc = _pair()
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


_made = []


def _pair():
    if not _made:
        path = packing.default_tokenizer()
        _made.extend((Tokenizer.from_file(path), packing.WordEncoder(path, cache_words=50)))
    return _made


def test_pieces_and_sequences(spark):
    tok = _pair()[0]
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 1), (2, TEXTS[2], "x", 1)] + [(100 + i, "lorem ipsum " * (i * 7 % 900), "x", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, piece string, offset int")
    got = packing.pack_documents(docs).collect()
    want = []
    for d, t, *_ in rows:
        ids = np.array(brute(t, tok), "<u4")
        want += [(d, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= 1.05 * total / 2048 + 2
    assert sum(len(r.ids) for r in packing.sequences(docs).collect()) == total
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_fullest_closes_first():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n)[0] for n in (9, 6, 8, 4, 2)] == [0, 1, 2, 1, 2]


def test_another_kind_of_tokenizer_encodes_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, texts = Tokenizer.from_file(path), ["Hello  World,\nhello world", "é 日本 x", "", None]
    encoder = packing.WordEncoder(path)
    assert not encoder.by_word and packing.WordEncoder(packing.default_tokenizer()).by_word
    assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == [own.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_long_chunks_are_not_kept():
    encoder = packing.WordEncoder(packing.default_tokenizer())
    encoder.encode("a" * 1000 + " short " + "-" * 1000)
    assert max(map(len, encoder)) <= packing.CACHED_OCTETS and max(map(len, encoder.parts)) <= packing.CACHED_OCTETS
