"""Token counts by byte-pair merging over a heap and a linked list.

A piece of the pre-tokenizer starts as its bytes, chained both ways. A heap holds every adjacent pair that the merge table knows by (rank, place); the
lowest is popped and merged, and its new neighbours' pairs are pushed. An entry whose pair has changed since is passed over. Each merge takes one symbol away, so the
count is bytes minus merges, and no identifier is ever made. Time is n log n in a piece's length; a worker remembers the counts of short pieces.

Pieces are cut as the tokenizers library's byte-level pre-tokenizer cuts them: texts of the characters that ``tokenfiles`` knows by its pattern, all others by the library's
own pre-tokenizer, so that both read the same edition of Unicode. An added token in a text counts one and parts the text, the library's default.

Defined results: a null or empty text has no bytes and no tokens; rows that share an id, or repeat, keep one result each; a very long text is counted whole, in memory
of its pieces, and a very long piece in some hundred bytes of memory a byte; equal ranks go to the leftmost pair; an empty table gives none; other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.files import text_batches, tidied
from gridloom.llm.tokenfiles import LONG_PIECE, cut_by_pattern

#: Pieces whose counts a worker remembers.
MOST_KNOWN = 1_000_000
_PLACE = 34  # bits of a place in a heap entry: a string of Spark has fewer bytes


class MergeCounter:
    """Counts of a byte-level BPE file of the tokenizers library (``.json``)."""

    def __init__(self, path: str, most_known: int = MOST_KNOWN):
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model, cutter = stated["model"], stated["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or stated["normalizer"] or cutter.get("type") != "ByteLevel" or cutter["add_prefix_space"] or not cutter.get("use_regex", True) or odd:
            raise ValueError(f"{path} is not a plain byte-level BPE file {odd}")
        if any(t[k] for t in stated["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that take neighbouring characters")
        vocab = model["vocab"]
        letters = sorted(pre_tokenizers.ByteLevel.alphabet(), key=lambda c: (ord(c) >= 256, ord(c)))
        # bytes that are printable in Latin-1 stand for themselves, the others, in order, for 256 and on
        own = [c for c in letters if ord(c) < 256]
        others = iter(letters[len(own) :])
        letter = [chr(b) if chr(b) in own else next(others) for b in range(256)]
        self.symbols = [vocab[c] for c in letter]
        #: left << 32 | right -> (rank, merged symbol)
        self.table: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.table[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        added = sorted((t["content"] for t in stated["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.known: dict[str, int] = {}
        self.most_known = most_known

    def count_piece(self, piece: bytes) -> int:
        """Symbols that are left of a piece's bytes when no adjacent pair is in the merge table."""
        table, n = self.table, len(piece)
        symbol = [self.symbols[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [-1] * n  # of the pair that starts at a place, as last pushed; a popped entry with another rank is stale
        heap = []
        for i in range(n - 1):
            if found := table.get(symbol[i] << 32 | symbol[i + 1]):
                rank[i] = found[0]
                heap.append(found[0] << _PLACE | i)
        heapify(heap)
        merges, mask = 0, (1 << _PLACE) - 1
        while heap:
            entry = heappop(heap)
            i = entry & mask
            if rank[i] != entry >> _PLACE:
                continue
            j = after[i]
            symbol[i] = table[symbol[i] << 32 | symbol[j]][1]
            k = after[i] = after[j]
            rank[i] = rank[j] = -1
            merges += 1
            if k < n:
                before[k] = i
                if found := table.get(symbol[i] << 32 | symbol[k]):
                    rank[i] = found[0]
                    heappush(heap, found[0] << _PLACE | i)
            if (h := before[i]) >= 0:
                found = table.get(symbol[h] << 32 | symbol[i])
                rank[h] = found[0] if found else -1
                if found:
                    heappush(heap, found[0] << _PLACE | h)
        return n - merges

    def _part(self, text: str) -> int:
        pieces = cut_by_pattern(text)
        if pieces is None:
            pieces = [text[a:b] for _, (a, b) in self.cut(text)]
        known = self.known
        try:
            return sum(map(known.__getitem__, pieces))
        except KeyError:
            pass
        new = {x: self.count_piece(x.encode()) for x in set(pieces) if x not in known}
        if len(known) < self.most_known:
            known |= {x: n for x, n in new.items() if len(x) <= LONG_PIECE}
        return sum(new[x] if x in new else known[x] for x in pieces)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.added.split(text) if self.added else [text]
        return len(parts) - 1 + sum(self._part(x) for x in parts if x)


@cache
def counter_of(path: str) -> MergeCounter:
    """One for each Python worker, which runs many tasks."""
    return MergeCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with n_bytes (UTF-8) and n_tokens."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = counter_of(tokenizer)
        for batch in batches:
            found = pa.array([counter.count(x.as_py()) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["row", "n_tokens"])

    text = F.col(text_col)
    rows = docs.select(F.struct(*keep, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")).alias("row"), text.alias("text"))
    return text_batches(rows, tidied(count), f"row {rows.schema['row'].dataType.simpleString()}, n_tokens long").select("row.*", "n_tokens")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
