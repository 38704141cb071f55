import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from gridloom.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["  a  b \n\n c\t\td's 'S we'll  ", "naïve ½ ² Ⅷ 中文 <|endoftext|> x", " ", "\n", "a\x1cb", "ŉ ſ «x» ...\n\n\n--", "'s's ''s", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "\U0003d000\U000323b0 ҈", "x" * 70_000, "ab" * 5_000, ""]


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert token_counts.MergeCounter(PATH).count(text) == library(text)


OWN = token_counts.MergeCounter(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert OWN.count(text) == library(text)


def test_pieces_by_plain_merging():
    """Against merging the leftmost pair of least rank, looked for from the start each time."""
    rng = random.Random(5)
    for _ in range(300):
        piece = bytes(rng.choice(b"etaoin shrdlu") for _ in range(rng.randint(1, 30)))
        symbols = [OWN.symbols[b] for b in piece]
        while len(symbols) > 1:
            found = min((OWN.table.get(a << 32 | b, (1 << 30, 0))[0], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if found[0] == 1 << 30:
                break
            i = found[1]
            symbols[i : i + 2] = [OWN.table[symbols[i] << 32 | symbols[i + 1]][1]]
        assert OWN.count_piece(piece) == len(symbols)


def test_full_memory_still_counts():
    own = token_counts.MergeCounter(PATH, most_known=0)
    assert [own.count(x) for x in ODD * 2] == [library(x) for x in ODD * 2]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        token_counts.MergeCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_contract_on_edge_cases(spark, edge_dir, edge_rows):
    got = token_counts.op12_token_counts(spark, edge_dir)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), library(t), library(t) > 1024) for i, t, _, _ in edge_rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in token_counts.op12_token_counts(spark, sf).collect():
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), library(texts[r.doc_id]))


def test_kept_columns_may_clash_and_empty_tables(spark, empty_dir):
    docs = spark.createDataFrame([(1, "a b", "c")], "n_bytes2 long, row string, n_chars string").withColumn("text", F.lit("clash"))
    (r,) = token_counts.count_tokens(docs, PATH, ["text", "n_bytes2"], text_col="row").collect()
    assert tuple(r) == ("clash", 1, 3, 2)
    assert token_counts.op12_token_counts(spark, empty_dir).count() == 0
