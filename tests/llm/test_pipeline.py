import corpus_pipeline as P
from gridloom.llm import minhash_join


def stage(spark, docs, name, path):
    out = dict(P.STAGES)[name](spark, docs, "")
    out.write.mode("overwrite").parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/{name}")


def test_stages_on_edge_cases(spark, edge_dir, edge_rows, tmp_path):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    columns, kept = docs.columns, docs
    for name, _ in P.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, name, tmp_path)
        assert kept.columns == columns, name
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "language":
            assert not ids & {1, 2, 3, 15} and {4, 5, 7, 8, 10, 14, None} <= ids
        if name == "near_duplicates":
            assert {4, 7, 10, None} <= ids and not ids & {5, 8, 9}  # rows that share an id share its fate
            left = minhash_join.near_duplicates(kept, k=5, threshold=(80, 100)).where("doc_id IS NOT NULL AND NOT kept")
            assert left.count() == 0
        if name == "pii":
            (text,) = [r.text for r in kept.where("doc_id = 13").collect()]
            assert text == "Mail [EMAIL] or [IP], [PHONE], [CARD] now"
    last = stage(spark, kept, "tokens", tmp_path)
    assert last.where("NOT round_trip").count() == 0 and last.count() == kept.count()


def test_run_equals_its_stages(spark, edge_dir):
    assert P.run(spark, edge_dir).count() > 0
    assert {"doc_id", "ids", "n_tokens"} <= set(P.run(spark, edge_dir).columns)


def test_empty(spark, empty_dir):
    assert P.run(spark, empty_dir).count() == 0


def test_clashing_columns_come_through(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    for name, f in P.STAGES[:-1]:
        assert f(spark, docs, "").columns == docs.columns, name


def small_corpus():
    """Two languages, near and exact copies, personal data, texts without letters; (doc_id, text, lang, source)."""
    import random

    rng = random.Random(17)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(150)] for lang, letters in (("xx", "abcdefghi"), ("yy", "hijklmnopq"))}
    rows = []
    for i in range(90):
        lang = ("xx", "yy")[i % 2]
        text = " ".join(rng.choices(words[lang], k=rng.randint(3, 70)))
        if i % 6 == 0:
            text += f" mail u{i}@acme.org Zweig"
        if i % 7 == 0:
            text += f' token = "{rng.getrandbits(160):040x}" end'
        rows.append((i, text, lang, "abc"[i % 3] if i % 11 else None))
    near = [(100 + i, " ".join([*rows[i][1].split(), "ab"]), rows[i][2], "a") for i in range(0, 30, 3)]
    return rows + near + [(200 + i, rows[i][1], None, "b") for i in range(5)] + [(300, "12 34", "xx", "a"), (301, None, "yy", "b"), (302, "", "yy", "c")]


def test_pipeline_by_brute_force(spark, tmp_path):
    """Every stage again from its definition: distances of profiles, all pairs of documents, terms of entities, words of sources, the library's ids."""
    import re
    from collections import Counter, defaultdict

    import numpy as np
    import public_tokenizers
    import sentencepiece
    from llm_documents import write_documents
    from test_minhash import brute
    from test_pii import brute_force

    from gridloom.llm import langid, mixing, pii

    rows = small_corpus()
    # language
    by = defaultdict(list)
    for _, text, lang, _ in rows:
        if text is not None and lang is not None:
            by[lang].append(text)
    profiles = {lang: {c: k for k, c in enumerate(langid.top_codes("\n".join(texts), langid.TOP).tolist())} for lang, texts in by.items()}
    left = []
    for i, text, _, source in rows:
        own = langid.top_codes(text or "", langid.TOP).tolist()
        if own:
            far = {lang: sum(min(langid.TOP, abs(p[c] - k)) if c in p else langid.TOP for k, c in enumerate(own)) for lang, p in profiles.items()}
            best = min(sorted(far), key=far.get)
            if 1 - far[best] / (langid.TOP * len(own)) >= P.MIN_SCORE:
                left.append((i, text, best, source))
    # near_duplicates
    kept = {i for i, _, _, mine in brute([(i, t) for i, t, _, _ in left], 5, 80, 100) if mine}
    left = [r for r in left if r[0] in kept]
    assert len(left) < 100 and not any(r[0] >= 200 for r in left)
    # pii
    told = brute_force([t for _, t, _, _ in left])
    clean = {}
    for k, (i, text, lang, source) in enumerate(left):
        spans = [{"start": a, "end": b, "disclosure": d} for (a, b), d in told.get(k, {}).items()]
        clean[i] = (pii.rewrite(text, spans), lang, source)
    assert told and not any("@" in t for t, _, _ in clean.values())
    # mixing
    words = lambda t: re.findall(mixing.WORD, t or "")
    sizes = Counter()
    for text, _, source in clean.values():
        sizes[source] += len(words(text))
    names = sorted(s for s in sizes if s is not None) + [None]
    goals = dict(zip(names, mixing.targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0)))

    path = write_documents(spark, tmp_path, rows, extra=False)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    taken, per_doc = Counter(), Counter()
    for r in P.run(spark, path).collect():
        text, lang, source = clean[r.doc_id]
        assert (r.lang, r.source) == (lang, source) and r.round_trip
        mixed = library.decode(list(r.ids))
        assert library.encode(mixed) == list(r.ids) and r.n_tokens == len(r.ids)
        if mixed != text:  # a partial pass: runs of words, in order
            at = 0
            for run in mixed.split("\n"):
                at = text.index(run, at) + len(run)
        taken[source] += len(words(mixed))
        per_doc[r.doc_id] += len(words(mixed))
    assert {s: taken[s] for s in names} == {s: round(goals[s]) for s in names}
    assert all(n <= 2 * len(words(clean[i][0])) for i, n in per_doc.items())
    assert np.isclose(sum(taken.values()), 1.5 * sum(sizes.values()), atol=len(names))
