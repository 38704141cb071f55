"""From raw documents to token ids, in five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs; all but the last return the columns of their docs.

1. language: documents whose language can't be told go (no text, no letters, or a score below ``MIN_SCORE``); ``lang`` becomes the prediction.
2. near_duplicates: of each group of similar documents (five-word shingles, similarity 0.8) the smallest id stays, once.
3. pii: personal data and the terms that disclose it are replaced.
4. mixing: sources are mixed to their target weights; a row for each pass over a document.
5. tokens: SentencePiece ids, with a check that they decode to the text.

Defined results: rows of null id stay in stage 2, as nothing can be said of them; a text that stage 3 or 4 leaves empty stays a row; empty
tables give empty results. Very long texts go through every stage whole. Of near duplicates the smallest id stays; rows that share an id share its fate, and of those with the same text one stays;
other ties are those of the operators. Extra columns are carried along, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.files import small_side
from gridloom.llm.langid import learn_profiles, predict_language
from gridloom.llm.minhash_join import near_duplicates
from gridloom.llm.mixing import mixed_documents, plan_mix
from gridloom.llm.pii import sanitise
from gridloom.llm.sentencepiece_sa import encode_pieces
from gridloom.plans.shared import materialize, release

MIN_SCORE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct("*").alias("row"), "text")  # a table may have columns of the operators' names
    found = predict_language(rows, learn_profiles(docs), ["row"])
    known = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return known.select(*(F.col("lang_pred").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    near = materialize(near_duplicates(docs, k=5, threshold=(80, 100)), "dedup")
    gone = small_side(materialize(near.where("doc_id IS NOT NULL AND NOT kept").select("doc_id").distinct(), "dedup-gone"))
    # rows that share an id share its fate; of those with the same text one stays
    twice = materialize(near.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "dedup-repeats")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("hash"))
    kept = rows.join(gone, "doc_id", "left_anti")
    if not twice.isEmpty():
        repeated = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "hash"])
        kept = kept.join(twice, "doc_id", "left_anti").unionByName(repeated)
    return kept.select("row.*")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, plan_mix(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return encode_pieces(docs, model, ["doc_id", "lang", "source"], verify=True)


STAGES = [("language", language), ("near_duplicates", deduplicate), ("pii", pii), ("mixing", mixing), ("tokens", tokens)]

#: SQL has no way to say MinHash trees, block permutations or byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
