"""Source divergence audit: how far the sources of a language differ in their use of the language's common terms.

Terms are counted by (language, source, term), in each task first, and every term that enough of the language's documents hold is pivoted into a wide vector: an array with a
place for each of the language's sources, zero where the source lacks the term. Counts become parts per billion, smoothed by two, in whole numbers throughout. Higher-order
functions turn a vector into the contributions of its pairs of sources, (p - q)^2 / (p + q), which are summed in each task before the one exchange. A vector's pairs are laid out one source at a
time, so a row's memory grows with the number of sources and not with its square.

A language's list of sources is one row's array; the report has a row for each ordered pair of them, so their number bounds both.

Defined results: a null text, language or source is the empty string, and such groups are groups like others; a group without terms gives every term count 0; a language without common terms has pairs of value 0
and no terms; repeated rows, and rows that share an id, are documents each; equal values go by the item's UTF-8 bytes; a very long text is read whole by one task; an empty table gives none; other columns, whatever their
names, aren't looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.files import text_batches, tidied
from gridloom.plans.shared import materialize, small_side

#: Documents of a language that must hold a term; the shares' unit; what each count is raised by; terms reported of a group.
MIN_DOCS, UNIT, SMOOTH, TOP_TERMS = 10, 1_000_000_000, 2, 10
#: A term's bytes in UTF-8, A-Z in lower case: ASCII letters, and all bytes of characters beyond ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Terms that a task holds before it hands their counts on.
HELD = 250_000
COUNTS = "lang string, source string, term string, n long, docs long"


def _count_terms(batches: Iterator, most: int) -> Iterator:
    """(lang, source, term, occurrences, documents) of batches (lang, source, text as bytes), as often as ``most`` terms have come together."""
    import pyarrow as pa

    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            columns = [pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, terms), pa.int64())]
            for at in range(0, len(terms), 50_000):
                part = [c.slice(at, 50_000) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part[0])), pa.repeat(source, len(part[0])), *part], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            terms = _TERM.findall(text.lower())  # of bytes: A-Z alone
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            n.update(terms)
            docs.update(set(terms))
            size += len(n)
            if size >= most:
                yield from flush()
                size = 0
    yield from flush()


def term_vectors(docs: DataFrame, min_docs: int = MIN_DOCS, held: int = HELD) -> DataFrame:
    """(lang, term, total, counts array<struct<source, n>>) of the terms that at least ``min_docs`` documents of the language hold."""
    found = text_batches(docs.select("lang", "source", F.encode("text", "UTF-8")), tidied(partial(_count_terms, most=held)), COUNTS)
    counted = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    wide = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return wide.where(F.col("docs") >= min_docs).select("lang", "term", "total", "counts")


def language_facts(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(lang, sources array<struct<source, n>> in their order, v, n): every source that occurs and its terms' occurrences, the number of terms and of their occurrences."""
    sums = vectors.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    sources = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("sources"))
    sizes = vectors.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n"))
    return sources.join(sizes, "lang", "left").select("lang", "sources", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n", F.lit(0)).alias("n"))


def share(count: Column, all_: Column, v: Column) -> Column:
    """Parts of UNIT, one at least, in whole numbers: products may pass 64 bits, so they are decimals."""
    wide = lambda x: x.cast("decimal(38,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(count + SMOOTH) * F.lit(UNIT).cast("decimal(10,0)"), wide(all_ + SMOOTH * v))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank). ``pair``: the item is another source of the language, the value their divergence over all terms.
    ``term``: the item is a term that the source uses more than its language does, the value its contribution; the ``top_terms`` largest."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(blank("lang"), blank("source"), blank("text"))
    vectors = materialize(term_vectors(docs, min_docs, held), "terms")
    facts = materialize(language_facts(docs, vectors), "term-facts")
    bytes_ = F.aggregate("sources", F.lit(0), lambda s, x: s + 48 + F.octet_length(x["source"]))
    rows = vectors.join(small_side(facts, bytes_), "lang")
    # a place for each source, in order: those that lack the term come in with 0
    absent = F.array_except(F.transform("sources", lambda s: s["source"]), F.transform("counts", lambda c: c["source"]))
    dense = F.array_sort(F.concat("counts", F.transform(absent, lambda s: F.struct(s.alias("source"), F.lit(0).cast("long").alias("n")))))
    shares = F.zip_with("sources", "dense", lambda s, c: share(c["n"], s["n"], F.col("v")))
    rows = rows.withColumn("dense", dense).withColumn("p", shares)

    pairs = rows.select("lang", "p", F.posexplode("p").alias("i", "x"))
    pairs = pairs.select("lang", "i", F.posexplode(F.transform(F.expr("slice(p, i + 2, size(p))"), lambda y: apart(F.col("x"), y))).alias("k", "f"))
    sums = pairs.groupBy("lang", "i", (F.col("i") + F.col("k") + 1).alias("j")).agg(F.sum("f").alias("value"))
    ends = facts.select("lang", F.posexplode("sources.source").alias("i", "source"), "sources")
    ends = ends.select("lang", "i", "source", F.posexplode("sources.source").alias("j", "item")).where("i <> j")
    both = sums.unionByName(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    pairs = ends.join(both, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    terms = rows.withColumn("q", share(F.col("total"), F.col("n"), F.col("v"))).select("lang", "term", "q", F.explode(F.arrays_zip("dense", "p")).alias("c"))
    terms = terms.where((F.col("c.dense.n") > 0) & (F.col("c.p") > F.col("q")))
    terms = terms.select("lang", F.col("c.dense.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("c.p"), F.col("q")).alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionByName(terms.withColumn("rank", place).where(F.col("rank") <= top_terms))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
w AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER s + 2 * count(*) OVER s) AS p FROM w WINDOW s AS (PARTITION BY lang, source)),
a AS (SELECT lang, term, sum(n) AS n FROM w GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER s + 2 * count(*) OVER s) AS q FROM a WINDOW s AS (PARTITION BY lang)),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
found AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""
