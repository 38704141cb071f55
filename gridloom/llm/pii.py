"""PII: fixed patterns, and information-theoretic sanitisation of the terms of the texts that hold them.

Protected entities are the values that the patterns find, and secrets. A term is a run of letters and digits, in lower case, anywhere in a text that
holds an entity, outside the entities' spans. Over all documents, N of them, P(x) = documents that hold x / N, and the part of an entity's
information that a term gives away is

    disclosure(t, e) = log(P(t, e) / (P(t) P(e))) / -log P(e),

1 where the term never occurs without the entity. Most values stand in one document, which can't tell its terms apart, so a term is judged
against three entities for each value: the value, its form (a domain, a network, the first digits: what values of one owner share) and its
kind. For forms and kinds, which stand in many documents, a term must also meet the entity more often than chance (``CHANCE``) has it. Terms are
judged only if they meet the entity in ``SUPPORT`` texts of different words, so that copies of a document are no evidence. From ``REMOVE`` on, every
occurrence of the term in the texts that hold the entity goes; from ``GENERALISE`` on, it gives way to the class of its shape (``CLASSES``).

Beside the patterns' matches (base), ``number`` spans are cards and phones inside runs of digits that failed as a whole, and ``secret`` spans are
machine-made words: long, of letters and digits in turn, with ``SECRET_BITS`` bits of entropy a character.

Data flow: one pass finds spans and writes them, with the text where there are entities; one counts the documents of every term. Terms in so many
documents that they can't reach the threshold with any entity are set aside: those in a share of all documents, so a bounded number. Meetings of (entity, term) are
counted in each task first, for the entities that stand in enough texts, told by a bitmap of fixed size (a false hit costs rows, never a wrong count). Only texts with
entities are looked at again. The texts are never shuffled to find spans.

Defined results: null and empty texts have no spans; spans are counted in code points; equal texts have equal spans; repeated
rows are documents of their own in the counts; ties need no rule, as a term's largest disclosure counts; an empty table gives none; very long texts and
runs of any length are scanned whole, in linear time; columns of the operator's own names pass through ``sanitise`` unharmed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.files import small_side, text_batches, tidied
from gridloom.plans.shared import materialize, release

KINDS = ("email", "ip", "card", "phone")
SUPPORT, GENERALISE, REMOVE = 3, 0.7, 0.95
#: How likely all meetings of a term with a form or kind may be by chance.
CHANCE = 1e-4
#: Terms in this share of all documents, or more, can be set aside; there are at most (distinct terms of a document, on average) / SHARE of them.
SHARE = 0.01
#: Bits of a bitmap of terms or entities.
MAP_BITS = 1 << 20
#: A secret's entropy in bits a character, and its least changes between letter and digit.
SECRET_BITS, SECRET_TURNS = 2.5, 4
#: What a term of a shape is generalised to: all capitals, a capital first, digits, others.
CLASSES = ("[ACRONYM]", "[NAME]", "[NUMBER]", "[WORD]")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PART = re.compile(r"[0-9]+")
_WORD = re.compile(r"[^\W_]+")
_SECRET = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}")
_TURN = re.compile(r"(?<=[A-Za-z])_*[0-9]|(?<=[0-9])_*[A-Za-z]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address starts where the characters before an @ do, so only those are looked at."""
    past = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            past = domain.end()
            yield start, past
        at = text.find("@", max(past, at + 1))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """A dotted run of numbers holds an address for every four of them."""
    for run in _DOTTED.finditer(text):
        if "." not in run[0]:
            continue
        parts = list(_PART.finditer(text, *run.span()))
        for i in range(0, len(parts) - 3, 4):
            if all(len(p := x[0].lstrip("0")) <= 3 and int(p or 0) <= 255 for x in parts[i : i + 4]):
                yield parts[i].start(), parts[i + 3].end()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    found = [("email", *x) for x in _emails(text)] if "@" in text else []
    found += [("ip", *x) for x in _addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = "".join(_PART.findall(m[0]))
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(len, _PART.findall(m[0]))) <= 15]
    return found


def retried_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Cards and phones that the patterns swallow together with the digits beside them: groups of digits inside a run that failed, cards by Luhn from any
    group on, phones from the plus sign up to fifteen digits."""
    taken = {(k, a) for k, a, _ in base}
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 17 or ("card", m.start()) in taken:
            continue
        groups = list(_PART.finditer(text, *m.span()))
        i = 0
        while i < len(groups):
            digits, best = "", None
            for j in range(i, len(groups)):
                digits += groups[j][0]
                if len(digits) > 19:
                    break
                if len(digits) >= 16 and luhn(digits):
                    best = j
            if best is None:
                i += 1
                continue
            found.append(("card", groups[i].start(), groups[best].end()))
            i = best + 1
    for m in _PHONE.finditer(text) if "+" in text else ():
        if ("phone", m.start()) in taken:
            continue
        count, end = 0, None
        for part in _PART.finditer(text, *m.span()):
            count += len(part[0])
            if count > 15:
                break
            if count >= 8:
                end = part.end()
        if end is not None:
            found.append(("phone", m.start(), end))
    return sorted(found, key=lambda x: x[1:])


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """Long words of letters and digits in turn, as keys and digests are."""
    found = []
    for m in _SECRET.finditer(text):
        word = m[0]
        if len(_TURN.findall(word)) >= SECRET_TURNS:
            counts = [word.count(c) / len(word) for c in set(word)]
            if -sum(p * math.log2(p) for p in counts) >= SECRET_BITS:
                found.append(("secret", *m.span()))
    return found


def span_string(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def entities_of(kind: str, value: str) -> list[int]:
    """The value whatever its spelling (letters in lower case, or digits alone), its form and its kind; even numbers are values."""
    same = value.lower() if kind == "email" else ".".join(x.lstrip("0") or "0" for x in value.split(".")) if kind == "ip" else value if kind == "secret" else "".join(_PART.findall(value))
    form = same.rpartition("@")[2] if kind == "email" else same.rpartition(".")[0] if kind == "ip" else same[:6]
    return [_hash64(f"{kind}:{same}") & ~1, _hash64(f"{kind} form:{form}") | 1, _hash64(f"{kind}:") | 1]


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Every term outside the spans: (term, start, end)."""
    inside = sorted((a, b) for _, a, b in spans)
    found, i, past = [], 0, 0
    for m in _WORD.finditer(text):
        a, b = m.span()
        while i < len(inside) and inside[i][0] < b:
            past = max(past, inside[i][1])
            i += 1
        if past <= a:
            found.append((m[0].lower(), a, b))
    return found


def _entity_spans(text: str) -> list[tuple[str, int, int]]:
    return base_spans(text) + secret_spans(text)


@cache
def _term_hash(term: str) -> int:
    return _hash64(term)


def _hashes(terms) -> list[int]:
    """Term hashes; a worker remembers short terms, a bounded number of them."""
    if _term_hash.cache_info().currsize > 200_000:
        _term_hash.cache_clear()
    return [_term_hash(t) if len(t) <= 32 else _hash64(t) for t in terms]


def scan(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with text_key, n_email, n_ip, n_card, n_phone, base and more (span strings), keys (the entities) and, where there are entities,
    context (the same for the same terms in the same order) and the text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            strings, more, keys, contexts, texts = [], [], [], [], []
            for value in batch.column(batch.num_columns - 1):
                text = value.as_py() or ""
                spans, secrets = base_spans(text), secret_spans(text)
                for k in KINDS:
                    counts[k].append(sum(x[0] == k for x in spans) if spans else 0)
                strings.append(span_string(spans))
                more.append(span_string([("number", a, b) for _, a, b in retried_spans(text, spans)] + secrets))
                spans = spans + secrets
                keys.append(sorted({e for k, a, b in spans for e in entities_of(k, text[a:b])}))
                contexts.append(_hash64(" ".join(t for t, _, _ in terms_of(text, spans))) if spans else None)
                texts.append(text if spans else None)
            arrays = [*batch.columns[:-1], *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(strings, pa.string()), pa.array(more, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(contexts, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], *(f"n_{k}" for k in KINDS), "base", "more", "keys", "context", "own_text"])

    added = T._parse_datatype_string("text_key long, n_email long, n_ip long, n_card long, n_phone long, base string, more string, keys array<long>, context long, own_text string")
    rows = docs.select(*keep, F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("__text"))
    return text_batches(rows, tidied(run), T.StructType([*(docs.schema[c] for c in keep), *added.fields]))


def document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): in how many documents each term's hash stands, spans or no; summed in each task first."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([_hash64(t) for t in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
            counts.clear()
            return out

        size = 0
        for batch in batches:
            for value in batch.column(0):
                if text := value.as_py():
                    counts.update({x.lower() for x in set(_WORD.findall(text))})
                    size += len(text)
            if len(counts) > 200_000 or size > 1 << 26:  # in bytes as well: words may be long
                yield flush()
                size = 0
        yield flush()

    return text_batches(docs.select(text_col), tidied(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def _place(value: int) -> int:
    return value * 0x9E3779B97F4A7C15 % (1 << 64) >> 44


def _bitmap(values: DataFrame) -> np.ndarray:
    """The bits of the first column's numbers, gathered as MAP_BITS / 32 rows at most."""

    def positions(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_place(t) for t in batch.column(0).to_pylist()], pa.int64())], names=["at"])

    words = values.mapInArrow(tidied(positions), "at long").groupBy((F.col("at") / 32).cast("long").alias("word"))
    rows = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 AS int))")).alias("bits")).collect()
    bitmap = np.zeros(MAP_BITS // 32, "<u4")
    for row in rows:
        bitmap[row.word] = row.bits
    return bitmap.view(np.uint8)


def _held(bitmap: np.ndarray, value: int) -> bool:
    at = _place(value)
    return bool(bitmap[at >> 3] >> (at & 7) & 1)


def _meetings(own: DataFrame, entities: np.ndarray, frequent: list[int], support: int) -> DataFrame:
    """(entity, term, context, n) of the entities whose bit is set, without frequent terms, summed in each task first: the n of a pair's rows add up to the
    documents where they meet, and its rows have all its contexts, or ``support`` of them at least."""
    shared = own.sparkSession.sparkContext.broadcast((entities, frozenset(frequent)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bitmap, skip = shared.value
        counts: dict[tuple[int, int], list[int]] = {}  # documents, then contexts

        def flush() -> pa.RecordBatch:
            rows = [(e, t, c, found[0] if i == 0 else 0) for (e, t), found in counts.items() for i, c in enumerate(found[1:])]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(zip(*rows)) or [[]] * 4)], names=["entity", "term", "context", "n"])

        for batch in batches:
            for keys, context, text in zip(*(c.to_pylist() for c in batch.columns)):
                keys = [k for k in keys if _held(bitmap, k)]
                terms = set(_hashes({t for t, _, _ in terms_of(text, _entity_spans(text))})) - skip if keys else ()
                for key in keys:
                    for term in terms:
                        found = counts.setdefault((key, term), [0])
                        found[0] += 1
                        if len(found) <= support and context not in found[1:]:
                            found.append(context)
                if len(counts) > 100_000:
                    yield flush()
        yield flush()

    return text_batches(own.select("keys", "context", "own_text"), tidied(run), "entity long, term long, context long, n long")


def disclosing_terms(scanned: DataFrame, docs: DataFrame, text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, disclosure) of the terms, by their hashes, that meet an entity in enough different texts and disclose ``generalise`` of it or more."""
    own = scanned.where("own_text IS NOT NULL")
    stand = own.select(F.explode("keys").alias("entity"), "context").groupBy("entity", "context").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("texts"))
    n_e = materialize(stand.where(F.col("texts") >= support).select("entity", "n_e"), "pii-entities")
    most = n_e.agg(F.max("n_e")).first()[0]
    if most is None:
        return own.sparkSession.createDataFrame([], "entity long, term long, disclosure double")
    n = scanned.count()
    df = materialize(document_counts(docs, text_col), "pii-counts")
    # n_te <= n_e, so a term in more documents than n_e (n / n_e) ** (1 - generalise) is under the threshold
    limit = max(most * (n / most) ** (1 - generalise), n * SHARE)
    frequent = [r.term for r in df.where(F.col("df") > limit).select("term").collect()]
    met = _meetings(own, _bitmap(n_e.select("entity")), frequent, support).groupBy("entity", "term", "context").agg(F.sum("n").alias("n"))
    met = met.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count("*").alias("contexts")).where(F.col("contexts") >= support)
    met = materialize(met.select("entity", "term", "n_te"), "pii-pairs")
    joined = df.join(small_side(met), "term").join(small_side(n_e), "entity")
    ic = -F.log(F.col("n_e") / n)
    pmi = F.log(F.col("n_te") * n / (F.col("df") * F.col("n_e")))
    chance = F.pow(F.col("n_e") / n, F.col("n_te"))
    judged = joined.where((F.col("entity") % 2 == 0) | (chance <= CHANCE)).select("entity", "term", F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0)).alias("disclosure"))
    found = materialize(judged.where(F.col("disclosure") >= generalise), "pii-terms")
    release(n_e, df, met)
    return found


def term_spans(scanned: DataFrame, disclosing: DataFrame) -> DataFrame:
    """(text_key, terms): for each distinct text the spans of its disclosing terms, by start. ``disclosing`` is a written table."""
    shared = scanned.sparkSession.sparkContext.broadcast(_bitmap(disclosing.select("term").distinct()))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bitmap = shared.value
        for batch in batches:
            rows = []
            for key, keys, text in zip(*(c.to_pylist() for c in batch.columns)):
                terms = terms_of(text, _entity_spans(text))
                hashes = _hashes([t for t, _, _ in terms])
                rows += [(key, keys, h, a, b) for h, (_, a, b) in zip(hashes, terms) if _held(bitmap, h)]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(columns, kinds)], names=["text_key", "keys", "term", "start", "end"])

    own = scanned.where("own_text IS NOT NULL").select("text_key", "keys", "own_text")
    words = text_batches(own, tidied(run), "text_key long, keys array<long>, term long, start int, end int")
    hits = words.join(small_side(disclosing), "term").where(F.array_contains("keys", F.col("entity")))
    best = hits.groupBy("text_key", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    return best.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))


def find_spans(docs: DataFrame, keep: list[str], text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``docs`` scanned, and the term spans by text_key, both written to the shared folder."""
    scanned = materialize(scan(docs, keep, text_col), "pii-scan")
    disclosing = disclosing_terms(scanned, docs, text_col)
    found = materialize(term_spans(scanned, disclosing), "pii-spans")
    release(disclosing)
    return scanned, found


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with entities replaced by their kind in brackets and disclosing terms generalised or removed. Null texts stay null."""
    scanned, terms = find_spans(docs, [], text_col)
    release(scanned)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = batch.column(0)
            fields = list(rows.type)
            at = [f.name for f in fields].index(text_col)
            parts = rows.flatten()
            new = [None if t is None else rewrite(t, m or []) for t, m in zip(parts[at].to_pylist(), batch.column(1).to_pylist())]
            parts[at] = pa.array(new, fields[at].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(parts, fields=fields)], names=["row"])

    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("key"))
    found = small_side(terms.select(F.col("text_key").alias("key"), "terms"), F.size("terms") * 24)
    joined = rows.join(found, "key", "left").select("row", "terms")
    return text_batches(joined, tidied(run), T.StructType([T.StructField("row", docs.schema)])).select("row.*")


def shape_class(word: str) -> str:
    return CLASSES[2 if word.isdigit() else 0 if len(word) > 1 and word.isupper() else 1 if word[0].isupper() else 3]


def rewrite(text: str, terms: list[dict]) -> str:
    base = base_spans(text)
    spans = [(a, -b, f"[{k.upper()}]") for k, a, b in base + retried_spans(text, base) + secret_spans(text)]
    spans += [(t["start"], -t["end"], "" if t["disclosure"] >= REMOVE else shape_class(text[t["start"] : t["end"]])) for t in terms]
    parts, past = [], 0
    for a, b, label in sorted(spans):
        if a >= past:
            parts += [text[past:a], label]
            past = -b
        elif -b > past:  # overlaps the one before: its rest goes too
            past = -b
    return "".join(parts) + text[past:]


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scanned, terms = find_spans(docs, ["doc_id"])
    extra = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"]))
    columns = ("doc_id", *(f"n_{k}" for k in KINDS), "base", "more")
    plain = scanned.where(F.size("keys") == 0).select(*columns, F.lit(None).cast("array<string>").alias("extra"))
    found = small_side(terms.select(F.col("text_key").alias("same"), extra.alias("extra")), F.size("extra") * 24)
    near = scanned.where(F.size("keys") > 0).join(found, F.col("text_key") == F.col("same"), "left").select(*columns, "extra")
    filled = lambda c: F.when(c != "", c)  # noqa: E731  concat_ws leaves nulls out
    spans = F.concat_ws(",", filled(F.col("base")), filled(F.col("more")), filled(F.array_join("extra", ",")))
    return plain.unionByName(near).select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))
