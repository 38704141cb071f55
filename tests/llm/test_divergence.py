import re
from collections import Counter, defaultdict

import duckdb
import pytest

from gridloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, top=10):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    kept = {lang: [t for t, n in c.items() if n >= min_docs] for lang, c in docs.items()}

    def share(c, terms):
        all_ = sum(c[x] for x in terms) + 2 * len(terms)
        return {t: 1 + 10**9 * (c[t] + 2) // all_ for t in terms}

    p = {(lang, s): share(c, kept[lang]) for (lang, s), c in groups.items()}
    out = []
    for (lang, s), mine in p.items():
        all_ = share(sum((c for (x, _), c in groups.items() if x == lang), Counter()), kept[lang])
        pairs = [(sum((mine[t] - q[t]) ** 2 // (mine[t] + q[t]) for t in mine), o) for (x, o), q in p.items() if x == lang and o != s]
        terms = [((mine[t] - all_[t]) ** 2 // (mine[t] + all_[t]), t) for t in mine if groups[lang, s][t] and mine[t] > all_[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or rank <= top:
                    out.append((lang, s, part, item, v, rank))
    return sorted(out)


@pytest.mark.parametrize("min_docs", [1, 3, 10])
def test_brute_force_on_edge_cases(spark, edge_dir, edge_rows, min_docs):
    got = divergence.source_divergence(spark.read.parquet(f"{edge_dir}/documents.parquet"), min_docs)
    assert sorted(map(tuple, got.collect())) == brute([(t, lang, s) for _, t, lang, s in edge_rows], min_docs)


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(divergence.OP13_SQL)
    got = divergence.op13_source_divergence(spark, sf)
    assert got.columns == want.columns
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_counts_beyond_64_bits_of_product(spark):
    df = spark.createDataFrame([(10**14, 3 * 10**14, 7)], "c long, n long, v long")
    (r,) = df.select(divergence.share(df.c, df.n, df.v).alias("p")).collect()
    assert r.p == 1 + 10**9 * (10**14 + 2) // (3 * 10**14 + 14)


def test_case_and_characters(spark):
    rows = [("É é KELVIN K ß aB1c_d", "x", "s")] * 2 + [("z", "x", None)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = divergence.source_divergence(docs, min_docs=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, 2)
    assert {r.term for r in divergence.term_vectors(docs, min_docs=2).collect()} == {"É", "é", "kelvin", "K", "ß", "ab", "c", "d"}


def test_counts_handed_on_in_parts(spark, edge_dir, edge_rows):
    got = divergence.source_divergence(spark.read.parquet(f"{edge_dir}/documents.parquet"), 2, held=50)
    assert sorted(map(tuple, got.collect())) == brute([(t, lang, s) for _, t, lang, s in edge_rows], 2)


def test_empty(spark, empty_dir):
    assert divergence.op13_source_divergence(spark, empty_dir).count() == 0


def test_no_pairs_of_rows(spark):
    """Pairs come from vectors' places; the only joins are on languages and groups."""
    plan = divergence.op13_source_divergence(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Cross" not in plan
