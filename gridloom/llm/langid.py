"""Language ID by rank-order profiles (Cavnar and Trenkle, 1994).

A text's profile is its ``top`` most frequent letter n-grams of one to ``MAX_N`` code points, words bounded by a blank; a
language's profile is the same over all its training texts. The out-of-place distance sums, over the document's
n-grams, how far their ranks lie apart, or ``top`` where the language lacks one. Score: 1 - distance / largest possible distance.

Counts are summed in each task, then by one exchange of distinct n-grams; only ``top`` rows for each language reach the driver.

Defined results: a null text, or one without letters, is ``und`` with score 0; ties go to the smaller n-gram code and the
smaller language name; rows of null language or id teach nothing; without any training row every text is ``und``; repeated rows
count as often as they occur; an empty table gives none; a very long text is one profile of all its n-grams; other columns, whatever their names, aren't looked at. More than
``MAX_LANGUAGES`` languages are refused with a ValueError: the profiles go to every task, so their number is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.files import limit_batches, tidied
from gridloom.plans.shared import materialize, release

MAX_N, TOP = 3, 400
#: More languages than this is a mistake in the label column.
MAX_LANGUAGES = 2000
_PAD = (1 << 21) - 1  # above all code points


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text, 21 bits a code point; shorter ones are filled up on the left."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    is_letter = _letters()[cp]
    if not is_letter.any():
        return np.empty(0, np.int64)
    before = np.concatenate(([False], is_letter[:-1]))
    s = np.concatenate(([0], np.where(is_letter, cp, 0)[is_letter | before], [0]))
    one = s[s > 0]
    a, b = s[:-1], s[1:]
    two = (a << 21 | b)[(a > 0) | (b > 0)]
    three = (s[:-2] << 42 | s[1:-1] << 21 | s[2:])[s[1:-1] > 0]
    return np.concatenate((one | _PAD << 21 | _PAD << 42, two | _PAD << 42, three))


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, np.int64)
    return codes[at], np.diff(np.append(at, len(codes)))


def top_codes(text: str, top: int) -> np.ndarray:
    codes, n = counted(grams(text))
    return codes[np.argsort(-n, kind="stable")[:top]]


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> DataFrame:
    """(lang, code, n, place): for each language its ``top`` n-grams, from every row that has language and text."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, codes: np.ndarray, n: np.ndarray) -> None:
            old = kept.get(lang)
            if old is not None:
                codes, n = np.concatenate((old[0], codes)), np.concatenate((old[1], n))
                order = np.argsort(codes, kind="stable")
                codes, n = codes[order], n[order]
                at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
                codes, n = codes[at], np.add.reduceat(n, at)
            kept[lang] = (codes, n)

        waiting: dict[str, list[str]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                waiting.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] > 1 << 18:
                    found = counted(grams("\n".join(waiting.pop(lang))))
                    size[lang] = 0
                    if len(found[0]):
                        add(lang, *found)
        for lang, texts in waiting.items():
            found = counted(grams("\n".join(texts)))
            if len(found[0]):
                add(lang, *found)
        for lang, (codes, n) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])

    limit_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(tidied(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # a rank below a limit: each task keeps its own best ``top`` of a language before any of them move
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = materialize(counts.withColumn("place", rank - 1).where(F.col("place") < top), "ngram-profiles")
    release(counts)
    if best.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in {lang_col}")
    return best


def predict_language(docs: DataFrame, profiles: DataFrame, keep: list[str], text_col: str = "text", top: int = TOP) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score. The profiles, at most MAX_LANGUAGES * top rows, go to each task."""
    rows = profiles.collect()
    langs = sorted({r.lang for r in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    rows = sorted((r.code, number[r.lang], r.place) for r in rows)
    table = np.array(rows, np.int64).reshape(-1, 3)
    codes, first = np.unique(table[:, 0], return_index=True)
    # a code's languages and their ranks stand from first[i] up to first[i + 1]
    model = docs.sparkSession.sparkContext.broadcast((langs, codes, np.append(first, len(table)), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)))

    def predict(batches: Iterator) -> Iterator:
        import pyarrow as pa

        langs, codes, first, whose, place = model.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column(batch.num_columns - 1):
                own = top_codes(text.as_py() or "", top)
                if not len(own) or not langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                at = np.searchsorted(codes, own)
                mine = np.flatnonzero((at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == own))
                lo, n = first[at[mine]], first[at[mine] + 1] - first[at[mine]]
                entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                nearer = top - np.minimum(top, np.abs(place[entry] - np.repeat(mine, n)))
                apart = top * len(own) - np.bincount(whose[entry], nearer, len(langs)).astype(np.int64)
                best = int(np.argmin(apart))
                names.append(langs[best])
                scores.append(float(1 - apart[best] / (top * len(own))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names), pa.array(scores)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    limit_batches(docs.sparkSession)
    fields = [docs.schema[c] for c in keep]
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    from pyspark.sql import types as T

    return rows.mapInArrow(tidied(predict), T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def fold(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    profiles = learn_profiles(docs.where(fold("doc_id") != 2))
    rows = docs.select("doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), "text")
    return predict_language(rows, profiles, ["doc_id", "held_out"])
