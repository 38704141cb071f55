import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
import sentencepiece

import public_tokenizers
from gridloom.llm import sentencepiece_sa as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "hello world", " a  b   c ", "▁x ▁", "naïve 中文字 ẞ \n\n\t x", "a" * 700, "abcdefgh" * 100, "<0x41> <s> </s> <unk>", "日本語" * 200, "\n", "\x00a\x00", "émé 🎉🎉", "x▁▁y", "مرحبا", "the the"]


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_equals_the_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PATH), S.encoder_of(PATH)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aehinorst  ,.\n1é▁") for _ in range(rng.randint(1, 400))) for _ in range(150)]
    for text, data in zip(texts, own.encode(texts)):
        want = library.encode(text)
        assert ids(data) == want
        assert own.decode(want) == library.decode(want)


def test_heap_and_rounds_agree():
    model = S.encoder_of(PATH).model
    parts = ["thisisalongpartofmanyletters" * 9, "internationalization" * 3]
    whole = model.segment(parts)
    limit, S.LONG = S.LONG, 1
    try:
        assert model.segment(parts) == whole
    finally:
        S.LONG = limit


def message(number, data):
    size, out = len(data), b""
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return bytes([number << 3 | 2]) + out + bytes([size]) + data


def unigram(pieces):
    raw = b"".join(message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([3 << 3, k])) for p, s, k in pieces)
    return raw + message(2, bytes([3 << 3, S.UNIGRAM])) + message(3, bytes([3 << 3, 0, 4 << 3, 0]))


def test_unigram_takes_the_best_path():
    pieces = [("<unk>", 0.0, S.UNKNOWN)] + [(p, -1.0 - len(p) * 0.3 - i * 0.01, S.NORMAL) for i, p in enumerate(["a", "b", "ab", "ba", "aba", "bab", "▁", "▁a", "b▁"])]
    model = S.Model(unigram(pieces))
    score = {p: s for p, s, _ in pieces[1:]}

    def best(text):
        value = [0.0] + [-math.inf] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(e):
                value[e] = max(value[e], value[s] + score.get(text[s:e], model.worst if e - s == 1 else -math.inf))
        return value[-1]

    rng = random.Random(2)
    for _ in range(100):
        text = "".join(rng.choice("ab▁c") for _ in range(rng.randint(1, 12)))
        got = ids(model.segment([text])[0])
        assert sum(pieces[i][1] if i else model.worst for i in got) == pytest.approx(best(text), abs=1e-4)


def test_models_that_are_refused():
    with pytest.raises(ValueError):
        S.Model(message(1, message(1, b"x") + bytes([3 << 3, S.USER_DEFINED])))
    with pytest.raises(ValueError):
        S.Model(message(3, message(2, b"table")))


def test_edge_cases(spark, edge_dir, edge_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = sorted((repr((r.doc_id, r.n_tokens, r.ids_crc32, r.round_trip)) for r in S.op4_sentencepiece(spark, edge_dir).collect()))
    want = []
    for i, t, _, _ in edge_rows:
        found = library.encode(t or "")
        want.append(repr((i, len(found), zlib.crc32(np.array(found, "<u4").tobytes()), library.decode(found) == (t or ""))))
    assert got == sorted(want)


def test_batches_of_any_size_agree(spark):
    rows = [(i, t) for i, t in enumerate(ODD * 3 + [None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = {r.doc_id: list(r.ids) for r in S.encode_pieces(docs, PATH, ["doc_id"]).collect()}
    assert len(want) == len(rows)
    for chars in (1, 100, 2000):
        got = S.encode_pieces(docs, PATH, ["doc_id"], batch_chars=chars, verify=True).collect()
        assert {r.doc_id: list(r.ids) for r in got} == want
        decoded = S.decode_pieces(S.encode_pieces(docs, PATH, ["doc_id"], batch_chars=chars), PATH, ["doc_id"]).collect()
        assert {r.doc_id: hashlib.sha256(r.decoded.encode()).hexdigest() for r in decoded} == {r.doc_id: r.decoded_sha256 for r in got}


def test_an_index_finds_every_occurrence():
    """All pieces in a text, against str.startswith at every place."""
    model = S.encoder_of(PATH).model
    text = "▁the▁internationalization▁of▁the▁thing,▁thethe▁naïve▁the"
    start, end, piece = model.edges(model.code[np.frombuffer(text.encode("utf-32-le"), "<u4")])
    want = {(k, k + len(p), i) for i, p in enumerate(model.pieces) if model.kinds[i] == S.NORMAL and len(p) > 1 for k in range(len(text)) if text.startswith(p, k)}
    assert set(zip(start.tolist(), end.tolist(), piece.tolist())) == want


def test_empty(spark, empty_dir):
    assert S.op4_sentencepiece(spark, empty_dir).count() == 0
