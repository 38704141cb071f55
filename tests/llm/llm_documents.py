"""Tables of edge cases for the corpus operators' tests."""

import random

#: Names that operators use inside; a table that has them too must not disturb.
CLASHING = ["rep", "node", "sig", "digest", "key", "size", "start", "src", "tie", "near", "base", "text_key", "label", "component", "n_shingles", "media", "lang_pred", "score", "ids", "sha1", "first_id", "__text", "__words", "kept", "taken"]

SYLLABLES = "ba be bi bo bu da de di do du fa fe fi fo fu ga ge gi go gu ka ke ki ko ku la le li lo lu".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words))


def documents() -> list[tuple]:
    """(doc_id, text, lang, source): nulls in every column, empty, blank, very long, repeated and near texts."""
    rng = random.Random(3)
    long = prose(rng, 20_000)
    near = prose(rng, 120)
    words = near.split()
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "b"), (4, long, "en", "a"), (5, long, None, None), (6, "x" * 70_000, "de", "c"),
        (7, near, "en", "a"), (8, near, "en", "a"), (9, " ".join([*words[:60], "zzz", *words[61:]]), "fr", "b"), (9, "one", "fr", "b"), (9, "one", "fr", "b"), (None, "null id " + near, "en", "a"),
        (10, "one two", "en", "c"), (11, "ONE\x0bTWO", "en", "c"), (12, "naïve café \U0001f389 中文 \x00 end", "fr", "d"), (13, "Mail bob@example.com or 10.0.0.1, +49 151 2345678, 4111 1111 1111 1111 now", "en", "d"),
        (14, "Under the MIT License, not the Apache License", "en", "d"), (15, "123 456 789", "en", "e"),
    ]
    return rows + [(100 + i, prose(rng, rng.randint(3, 300)), rng.choice(["en", "de", None]), rng.choice("abcde")) for i in range(40)]


def write_documents(spark, path, rows, extra=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHING if extra else []:
        df = df.withColumn(name, F.lit("clash"))
    df.repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)
