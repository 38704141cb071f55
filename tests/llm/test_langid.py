import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import langid


def slow_grams(text):
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    out = Counter()
    for w in words:
        padded = f" {w} "
        out.update(("1", c) for c in w)
        out.update(("2", padded[i : i + 2]) for i in range(len(padded) - 1))
        out.update(("3", padded[i : i + 3]) for i in range(len(padded) - 2))
    return out


@pytest.mark.parametrize("text", ["Hello, wörld!  Hello", "x", "123 . ", "", "a1b2 中文字\n\t'quote'"])
def test_grams_by_brute_force(text):
    codes, n = langid.counted(langid.grams(text))

    def name(code):
        parts = [int(code) >> s & langid._PAD for s in (42, 21, 0)]
        pads = sum(p == langid._PAD for p in parts)
        return str(3 - pads), "".join(chr(p) if p else " " for p in parts[pads:])

    got = Counter({name(c): int(k) for c, k in zip(codes, n)})
    want = slow_grams(text)
    # blanks between neighbouring words are shared by both
    assert {k: v for k, v in got.items() if k[1] != "  "} == dict(want)


def write(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


def test_held_out_accuracy_and_determinism(spark, tmp_path):
    rng = random.Random(4)
    alphabets = {"xx": "abcdefgh", "yy": "efghijkl", "zz": "ijklmnop"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(2, 7))) for _ in range(60)), lang) for i in range(300) for lang in [rng.choice(list(alphabets))]]
    got = langid.op8_langid(spark, write(spark, tmp_path, rows)).collect()
    truth = {i: lang for i, _, lang in rows}
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_brute_force_distance(spark, tmp_path):
    rows = [(1, "ab ab abc", "p"), (3, "xyz xy xy", "q"), (5, "ab xy", None), (9, "xyz", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.op8_langid(spark, write(spark, tmp_path, rows)).collect()}
    learned = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    profiles = {lang: {c: k for k, c in enumerate(langid.top_codes(text, langid.TOP).tolist())} for _, text, lang in learned}
    for i, text, _ in rows:
        own = langid.top_codes(text, langid.TOP).tolist()
        far = {lang: sum(min(langid.TOP, abs(p[c] - k)) if c in p else langid.TOP for k, c in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get) if far else "und"
        assert got[i][0] == best
        assert got[i][1] == pytest.approx(1 - far[best] / (langid.TOP * len(own)) if far else 0)


def test_edge_cases(spark, edge_dir, edge_rows):
    got = langid.op8_langid(spark, edge_dir).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in edge_rows)
    by = {r.doc_id: r for r in got}
    for i in (1, 2, 3, 15):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[4].lang_pred == by[5].lang_pred != "und"
    assert by[None].held_out is False


def test_nothing_to_learn(spark, tmp_path, empty_dir):
    got = langid.op8_langid(spark, write(spark, tmp_path, [(1, "some words", None), (2, "more", None)])).collect()
    assert {r.lang_pred for r in got} == {"und"}
    assert langid.op8_langid(spark, empty_dir).count() == 0
