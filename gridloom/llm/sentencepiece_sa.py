"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are normalised and cut where no piece of the vocabulary can stand across; the cuts' distinct parts
are joined and indexed by a suffix array (prefix doubling, as deep as the longest piece); nothing is remembered from batch to batch. Every piece is looked up in
it by binary search; its range of suffixes are its occurrences, the edges from where it starts to where it ends. Edges are sorted by part, score and
position and relaxed: for a BPE model, an edge is taken when it spans just two symbols and none better does, best
first; for a unigram model, by the best path to each position. Both give what the library gives.

Defined results: null and empty texts have no ids; characters outside the vocabulary become byte pieces, or the unknown id if there are none;
decoding takes the blank that encoding puts in front away and gives U+2581 back as a blank, as the format says; rows repeat
as they come; ties among pieces go to the smaller id, then the earlier place; a very long text is encoded whole (a part without blanks is relaxed by a heap of its
own); an empty table gives none; other columns, whatever their names, aren't looked at. Models with user-defined pieces or a normalisation table are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.files import text_batches, tidied

BLANK = "▁"
#: Fixed values of the model file: kinds of piece and of model.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Longer parts are relaxed by themselves, with a heap.
LONG = 256
#: Characters of a suffix array, but for a single part that is longer.
INDEX_CHARS = 1 << 18


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.type, self.dummy_prefix, self.squeeze = UNIGRAM, True, True
        for number, value in _fields(raw):
            if number == 1:
                part = dict(_fields(value))
                self.pieces.append(part.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
                self.kinds.append(part.get(3, NORMAL))
            elif number == 2:
                self.type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("the model has a normalisation table")
                self.dummy_prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if self.type not in (UNIGRAM, BPE) or USER_DEFINED in self.kinds:
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        kinds = np.array(self.kinds)
        self.normal = np.flatnonzero(kinds == NORMAL)
        self.unknown = int(np.flatnonzero(kinds == UNKNOWN)[0]) if UNKNOWN in self.kinds else 0
        self.bytes_at = {int(self.pieces[i][3:5], 16): int(i) for i in np.flatnonzero(kinds == BYTE)}
        #: by falling score; among equals the smaller id first
        score = np.array(self.scores)
        self.rank = np.empty(len(score), np.int64)
        self.rank[np.lexsort((np.arange(len(score)), -score))] = np.arange(len(score))
        self.worst = min((self.scores[i] for i in self.normal), default=0.0) - 10
        self._index_pieces()
        self.single = {self.pieces[i]: int(i) for i in self.normal if len(self.pieces[i]) == 1}
        self.raw_bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.encode() for p, k in zip(self.pieces, self.kinds)]

    def _index_pieces(self) -> None:
        """Codes of the characters in pieces, from 2; 0 is between parts, 1 any other character. Pieces of two characters or more as packed rows."""
        texts = [self.pieces[i] for i in self.normal]
        letters = sorted({c for t in texts for c in t})
        self.code = np.ones(0x110000, np.uint16)
        self.code[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
        self.code[0] = 0
        self.bits = int(len(letters) + 2).bit_length()
        self.per = 63 // self.bits  # characters in a packed column
        self.depth = max((len(t) for t in texts), default=1)
        long = [(t, i) for t, i in zip(texts, self.normal.tolist()) if len(t) > 1]
        self.piece_id = np.array([i for _, i in long], np.int64)
        self.piece_len = np.array([len(t) for t, _ in long], np.int64)
        columns = -(-self.depth // self.per)
        self.low = np.zeros((len(long), columns), np.int64)
        self.high = np.zeros((len(long), columns), np.int64)
        top = (1 << self.bits) - 1
        for row, (t, _) in enumerate(long):
            codes = self.code[[ord(c) for c in t]].tolist()
            for table, fill in ((self.low, 0), (self.high, top)):
                padded = codes + [fill] * (columns * self.per - len(codes))
                for c in range(columns):
                    value = 0
                    for x in padded[c * self.per : (c + 1) * self.per]:
                        value = value << self.bits | x
                    table[row, c] = value
        inner = any(BLANK in t[k:] and t[k - 1] != BLANK for t in texts for k in range(1, len(t)) if t[k] == BLANK)
        alone = "".join(c for c in "\n\r\t" if c not in set(letters))  # in no piece
        other = f"[^{BLANK}{alone}]"
        self.parts = re.compile(f"{BLANK}+{other}*|{other}+" + (f"|[{alone}]" if alone else "")) if not inner else re.compile(r"(?s).+")

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (BLANK if self.dummy_prefix else "") + text.replace(" ", BLANK)

    # -- matching -----------------------------------------------------------------------------------------------

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of every occurrence of a piece of two characters or more, by suffix array and binary search."""
        n, per = len(codes), self.per
        columns = self.low.shape[1]
        padded = np.concatenate((codes, np.zeros(per * (columns + 1), codes.dtype))).astype(np.int64)
        packed = np.zeros(n + per * columns, np.int64)
        for k in range(per):
            packed = packed << self.bits | padded[k : k + len(packed)]
        order = np.argsort(packed[:n])
        depth, key = per, packed[:n]
        while depth < self.depth:  # order by twice as many characters
            sorted_ = key[order]
            place = np.empty(n, np.int64)
            place[order] = np.cumsum(np.concatenate(([0], sorted_[1:] != sorted_[:-1])))
            later = np.concatenate((place[depth:] + 1, np.zeros(min(depth, n), np.int64)))[:n]
            key = place << 32 | later
            order = np.argsort(key)
            depth *= 2
        first = self._bound(packed, order, self.low, False)
        last = self._bound(packed, order, self.high, True)
        count = last - first
        hit = np.flatnonzero(count > 0)
        count = count[hit]
        at = np.repeat(first[hit] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        start = order[at]
        which = np.repeat(hit, count)
        return start, start + self.piece_len[which], self.piece_id[which]

    def _bound(self, packed: np.ndarray, order: np.ndarray, rows: np.ndarray, after: bool) -> np.ndarray:
        """For each row the first suffix that isn't below it, or the first above it."""
        whole = packed[order]  # the first column in order: it narrows most rows down to a few suffixes
        lo, hi = np.searchsorted(whole, rows[:, 0], "left"), np.searchsorted(whole, rows[:, 0], "right")
        while len(todo := np.flatnonzero(lo < hi)):
            mid = (lo[todo] + hi[todo]) // 2
            suffix, below, same = order[mid], np.zeros(len(todo), bool), np.ones(len(todo), bool)
            for c in range(rows.shape[1]):
                mine, theirs = packed[suffix + c * self.per], rows[todo, c]
                below |= same & (mine < theirs)
                same &= mine == theirs
            if after:
                below |= same
            lo[todo[below]] = mid[below] + 1
            hi[todo[~below]] = mid[~below]
        return lo

    # -- relaxing -----------------------------------------------------------------------------------------------

    def segment(self, parts: list[str]) -> list[bytes]:
        """Each part's ids, as little-endian uint32."""
        if not parts:
            return []
        cp = np.frombuffer("\0".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(p) for p in parts], np.int64)
        begins = np.concatenate(([0], np.cumsum(sizes + 1)))
        start, end, piece = self.edges(self.code[cp])
        part = np.searchsorted(begins, start, "right") - 1
        if self.type == UNIGRAM:
            bound, symbol = self._best_paths(cp, begins, sizes, start, end, piece, part)
        else:
            order = np.argsort((part * len(self.rank) + self.rank[piece]) * (len(cp) + 1) + start)
            start, end, piece, part = start[order], end[order], piece[order], part[order]
            bound, symbol = np.ones(len(cp) + 1, bool), np.full(len(cp), -1, np.int64)
            long = sizes[part] > LONG
            self._merge_all(bound, symbol, start[~long], end[~long], piece[~long], part[~long])
            for p in np.unique(part[long]).tolist():
                mine = part == p
                self._merge_one(bound, symbol, int(begins[p]), int(begins[p] + sizes[p]), start[mine], end[mine], piece[mine])
        at = np.flatnonzero(bound[: len(cp)])
        inside = np.ones(len(cp), bool)
        inside[begins[1:-1] - 1] = False
        at = at[inside[at]]
        ids = symbol[at]
        bare = np.flatnonzero(ids < 0)
        count = np.ones(len(at), np.int64)
        spelled: dict[int, list[int]] = {}
        for c in np.unique(cp[at[bare]]).tolist():
            known = self.single.get(chr(c))
            spelled[c] = [known] if known is not None else [self.bytes_at[b] for b in chr(c).encode("utf-8", "replace")] if self.bytes_at else [self.unknown]
        if len(bare):
            kinds, which = np.unique(cp[at[bare]], return_inverse=True)
            count[bare] = np.array([len(spelled[c]) for c in kinds.tolist()])[which]
            ids[bare] = np.array([spelled[c][0] for c in kinds.tolist()])[which]
        out = np.repeat(ids, count)
        if len(many := bare[count[bare] > 1]):
            to = np.cumsum(count) - count
            for i in many.tolist():
                out[to[i] : to[i] + count[i]] = spelled[int(cp[at[i]])]
        ends = np.cumsum(np.bincount(np.searchsorted(begins, at, "right") - 1, count, len(parts)).astype(np.int64)) * 4
        data, found, past = out.astype("<u4").tobytes(), [], 0
        for e in ends.tolist():
            found.append(data[past:e])
            past = e
        return found

    def _merge_all(self, bound, symbol, start, end, piece, part) -> None:
        """Rounds over all parts at once; edges are sorted by part, then best first, then position."""
        while len(start):
            upto = np.cumsum(bound)
            within = upto[end - 1] - upto[start]  # symbol bounds inside
            alive = bound[start] & bound[end] & (within > 0)
            fits = np.flatnonzero(alive & (within == 1))
            if not len(fits):
                return
            best = fits[np.concatenate(([True], part[fits][1:] != part[fits][:-1]))]
            middle = np.flatnonzero(bound)[upto[start[best]]]
            bound[middle] = False
            symbol[start[best]] = piece[best]
            going = np.zeros(int(part[-1]) + 1, bool)
            going[part[best]] = True
            keep = alive & going[part]
            start, end, piece, part = start[keep], end[keep], piece[keep], part[keep]

    def _merge_one(self, bound, symbol, lo, hi, start, end, piece) -> None:
        """The same for one long part: a heap of the edges that span two symbols."""
        known = {(s, e): i for s, e, i in zip(start.tolist(), end.tolist(), piece.tolist())}
        right = list(range(lo + 1, hi + 1))  # where the symbol that starts at lo + k ends
        left = [lo - 1, *range(lo, hi)]  # where the symbol before lo + k starts
        heap: list[tuple[int, int, int, int]] = []

        def offer(s: int, m: int, e: int) -> None:
            if (i := known.get((s, e))) is not None:
                heapq.heappush(heap, (int(self.rank[i]), s, m, e))

        for s in range(lo, hi - 1):
            offer(s, s + 1, s + 2)
        while heap:
            _, s, m, e = heapq.heappop(heap)
            if not (bound[s] and bound[m] and bound[e]) or right[s - lo] != m or right[m - lo] != e:
                continue
            bound[m] = False
            symbol[s] = known[s, e]
            right[s - lo] = e
            if e < hi:
                left[e - lo] = s
                offer(s, e, right[e - lo])
            if s > lo:
                offer(left[s - lo], s, e)

    def _best_paths(self, cp, begins, sizes, start, end, piece, part):
        """Unigram: relax edges in order of their end; a character of no piece costs ``worst``."""
        bound, symbol = np.zeros(len(cp) + 1, bool), np.full(len(cp), -1, np.int64)
        by_end: dict[int, list[tuple[int, int]]] = {}
        for s, e, i in zip(start.tolist(), end.tolist(), piece.tolist()):
            by_end.setdefault(e, []).append((s, i))
        for b, n in zip(begins.tolist(), sizes.tolist()):
            best, back = [0.0] + [0.0] * n, [(0, -1)] * (n + 1)
            for e in range(1, n + 1):
                i = self.single.get(chr(cp[b + e - 1]), -1)
                best[e], back[e] = best[e - 1] + (self.scores[i] if i >= 0 else self.worst), (e - 1, -1)
                for s, i in by_end.get(b + e, ()):
                    if (value := best[s - b] + self.scores[i]) > best[e]:
                        best[e], back[e] = value, (s - b, i)
            e = n
            while e:
                s, i = back[e]
                bound[b + s] = True
                symbol[b + s] = i
                e = s
        return bound, symbol


class Encoder:
    """A model; every call indexes its own texts."""

    def __init__(self, raw: bytes):
        self.model = Model(raw)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.model.parts.findall(self.model.normalise(t)) if t else [] for t in texts]
        parts = list(dict.fromkeys(chain.from_iterable(cut)))
        found, lo, size = {}, 0, 0
        for k, part in enumerate(parts, 1):  # an index of bounded size at a time
            size += len(part) + 1
            if size > INDEX_CHARS or k == len(parts):
                found |= zip(parts[lo:k], self.model.segment(parts[lo:k]))
                lo, size = k, 0
        get = found.__getitem__
        return [b"".join(map(get, parts)) for parts in cut]

    def decode(self, ids: list[int]) -> str:
        raw = self.model.raw_bytes
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@cache
def encoder_of(path: str) -> Encoder:
    """One for each Python worker, which runs many tasks."""
    with open(path, "rb") as f:
        return Encoder(f.read())


def encode_pieces(docs: DataFrame, model: str, keep: list[str], text_col: str = "text", batch_chars: int = 3 << 20, verify: bool = False) -> DataFrame:
    """``keep`` columns of ``docs`` and ids (array<int>). ``model`` is a path that every executor has, like a library's file. ``verify`` decodes in the
    same pass and adds n_tokens, ids_crc32 (unsigned, over little-endian uint32), decoded_sha256 (of the decoded text) and round_trip: whether that is the text again."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = encoder_of(model)

        def done(waiting: list[tuple]) -> Iterator[pa.RecordBatch]:
            found = iter(own.encode([t for _, _, texts in waiting for t in texts]))
            for batch, lo, texts in waiting:
                data = list(islice(found, len(texts)))
                ends = np.concatenate(([0], np.cumsum([len(d) // 4 for d in data]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(data), "<i4")))
                out = {n: c.slice(lo, len(texts)) for n, c in zip(batch.schema.names[:-1], batch.columns)} | {"ids": ids}
                if verify:
                    back = [own.decode(np.frombuffer(d, "<u4").tolist()) for d in data]
                    digest = [hashlib.sha256(b.encode()).hexdigest() for b in back]
                    same = [b == (t or "") for b, t in zip(back, texts)]
                    out |= {"n_tokens": pa.array([len(d) // 4 for d in data], pa.int64()), "ids_crc32": pa.array([zlib.crc32(d) for d in data], pa.int64()), "decoded_sha256": pa.array(digest, pa.string()), "round_trip": pa.array(same, pa.bool_())}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

        waiting, size = [], 0
        for batch in batches:
            lo, texts = 0, []
            for text in batch.column(batch.num_columns - 1):
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size > batch_chars:
                    yield from done([*waiting, (batch, lo, texts)])
                    lo, texts, waiting, size = lo + len(texts), [], [], 0
            if texts:
                waiting.append((batch, lo, texts))
        if waiting:
            yield from done(waiting)

    from pyspark.sql import types as T

    more = "ids array<int>, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean" if verify else "ids array<int>"
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string(more).fields])
    return text_batches(docs.select(*keep, F.col(text_col).alias("__text")), tidied(run), schema)


def decode_pieces(rows: DataFrame, model: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """``keep`` columns of ``rows`` with n_tokens, ids_crc32 (unsigned, over little-endian uint32) and the decoded text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = encoder_of(model)
        for batch in batches:
            sizes, crcs, texts = [], [], []
            for value in batch.column(batch.num_columns - 1):
                ids = value.values.to_numpy() if value.is_valid else np.empty(0, np.int32)
                sizes.append(len(ids))
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                texts.append(own.decode(ids.tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "n_tokens", "ids_crc32", "decoded"])

    from pyspark.sql import types as T

    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded", T.StringType())])
    return rows.select(*keep, ids_col).mapInArrow(tidied(run), schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encoded = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], verify=True)
    return encoded.select("doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip")
