import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from gridloom.llm import tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["  a  b \n\n c\t\td's 'S we'll  ", "naïve ½ ² Ⅷ 中文 <|endoftext|> x", " ", "\n", "a\x1cb", "ŉ ſ «x» ...\n\n\n--", "'s's ''s", " x y", "\x0b \x0c\x00a", "it''ll 'd", "it's"]


@pytest.mark.parametrize("text", ODD)
def test_pieces_give_the_librarys_ids(text):
    own = tokenfiles.ByteLevelEncoder(PATH)
    assert own.encode(text) == np.array(own.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_full_memory_still_encodes():
    own = tokenfiles.ByteLevelEncoder(PATH, max_cache=0)
    for text in ODD * 2:
        assert own.encode(text) == np.array(own.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_contract_on_edge_cases(spark, edge_dir, edge_rows):
    got = sorted(tokenfiles.op5_token_files(spark, edge_dir).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(PATH)
    want = {}
    for i, t, _, _ in edge_rows:
        found = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(i, []).append((len(found), zlib.crc32(found.tobytes())))
    start, last = 0, -1
    for r in got:
        assert r.start == start
        start += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        assert (r.doc_id if r.doc_id is not None else -1) >= last
        last = r.doc_id if r.doc_id is not None else -1
    assert not any(want.values())


def test_file_format(spark, tmp_path):
    docs = spark.createDataFrame([(5, "hello"), (3, "hello world")], "doc_id long, text string").withColumn("part", F.lit("clash"))
    (row,) = tokenfiles.write_token_files(docs.coalesce(1), PATH, 2).collect()
    path = row.idx.removeprefix("file:").replace("///", "/")
    raw = open(path, "rb").read()
    magic, width, _, n = struct.unpack_from(tokenfiles.HEADER, raw)
    assert (magic, width, n) == (tokenfiles.MAGIC, 2, 2)
    assert os.path.getsize(path[:-3] + "bin") == 2 * row.n_ids


def test_empty(spark, empty_dir):
    assert tokenfiles.op5_token_files(spark, empty_dir).count() == 0


@pytest.mark.parametrize("text", ["end <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "plain"])
def test_added_tokens_as_the_unmodified_library_has_them(text):
    library = Tokenizer.from_file(PATH)
    assert tokenfiles.ByteLevelEncoder(PATH).encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_rolled_files_and_reads_in_pieces(spark):
    docs = spark.createDataFrame([(i if i % 9 else None, "word " * (i * 7 % 50) + str(i)) for i in range(200)], "doc_id long, text string")
    whole = tokenfiles.read_token_files(tokenfiles.write_token_files(docs, PATH, 2)).collect()
    manifest = tokenfiles.write_token_files(docs, PATH, 2, roll_bytes=700)
    assert manifest.count() > 10 and manifest.agg(F.max("turn")).first()[0] > 0
    for task_bytes in (1, 300, 1 << 20):
        got = tokenfiles.read_token_files(manifest, task_bytes=task_bytes).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == sorted(map(tuple, whole), key=lambda r: r[1])
