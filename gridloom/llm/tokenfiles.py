"""Token-ID / binary output: flat unsigned integer files plus 64-bit document offsets.

A partition of the id-ordered corpus becomes pairs of files of ``ROLL_BYTES`` at most, and a document: ``*.bin`` holds the token ids
end to end in the smallest unsigned type that holds the vocabulary; ``*.idx`` holds a header, n+1
offsets (uint64, in ids, from the file's start), n document ids (int64) and n null flags (uint8).
A file's base, the ids of all files before it, is a prefix sum over the manifest.

Defined results: a null or empty text is a document of the end id alone; a null document id sorts
first; rows that share an id keep one entry each, in order of their text's hash; a very long text is one document, encoded whole; an empty table
writes no files; other columns, whatever their names, aren't looked at. A re-run task writes files of its own, and only those that the
manifest names count, so a lost executor leaves no partial data.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.files import TASK_BYTES, make_dir, one_task_each, open_fs, text_batches
from gridloom.plans.shared import materialize, workdir

MAGIC = b"GLTOKIX1"
HEADER = "<8sIIQ"  # magic, bytes per id, 0, documents
#: Bytes of ids from which on a task starts another pair of files; characters of the pieces that are remembered.
ROLL_BYTES, LONG_PIECE = 256 << 20, 64

#: Texts of these characters alone are split by the pattern below; any other text goes to the library whole.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿĀ-ſ"
_ODD = re.compile(f"[^\\t\\n\\r -~{_LETTER}«»¿¡‘’“”–—…]")
#: Python takes these for white space.
_ODD_ASCII = "\x1c\x1d\x1e\x1f"
_PIECE = re.compile(f" ?[{_LETTER}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\\s{_LETTER}0-9]+|\\s+(?!\\S)|\\s+")


def _odd(text: str) -> bool:
    return any(c in text for c in _ODD_ASCII) if text.isascii() else bool(_ODD.search(text))


def cut_by_pattern(text: str) -> list[str] | None:
    """The pre-tokenizer's pieces of a text, or None where only the library can tell them."""
    return None if _odd(text) else _PIECE.findall(text)


class ByteLevelEncoder:
    """Texts to little-endian uint32 ids. A byte-level model never merges across the pieces that its pre-tokenizer cuts,
    but it looks for added tokens in the whole text first, so a text that holds one goes to the library whole. Of others,
    the library encodes a piece once and it is remembered; pieces beyond ``max_cache`` or LONG_PIECE characters are encoded each time."""

    def __init__(self, path: str, max_cache: int = 1_000_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [re.escape(x.content) for x in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        self.known: dict[str, bytes] = {}
        self.max_cache = max_cache
        (self.line_end,) = self.library.encode("\n", add_special_tokens=False).ids

    def _library(self, text: str) -> np.ndarray:
        (found,) = self.library.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, "<u4")

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pieces. Those without white space at their end go to the library as lines of one text: line ends are pieces of their own."""
        lines = [x for x in new if not x[-1].isspace()]
        ids = self._library("\n".join(lines))
        ends = [] if not lines else np.append(np.flatnonzero(ids == self.line_end), len(ids)).tolist()
        data, start, found = ids.tobytes(), 0, {}
        for piece, end in zip(lines, ends, strict=True):
            found[piece] = data[4 * start : 4 * end]
            start = end + 1
        return found | {x: self._library(x).tobytes() for x in new if x[-1].isspace()}

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _odd(text) or self.added and self.added.search(text):
            return self._library(text).tobytes()
        pieces = _PIECE.findall(text)
        known = self.known
        missing = [x for x in pieces if x not in known]
        if not missing:
            return b"".join(map(known.__getitem__, pieces))
        new = self._learn(list(set(missing)))
        if len(known) < self.max_cache:
            known |= {x: ids for x, ids in new.items() if len(x) <= LONG_PIECE}
        return b"".join([known.get(x) or new[x] for x in pieces])  # no piece is without ids


@cache
def encoder_of(path: str) -> ByteLevelEncoder:
    """One for each Python worker, which runs many tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return ByteLevelEncoder(path)


FILES = "part long, turn long, bin string, idx string, width long, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Encode ``docs`` and write them in ascending id order. Returns the manifest (part, turn, bin, idx,
    width, n_docs, n_ids, base), one row per pair of files."""
    spark = docs.sparkSession
    out = workdir(spark, "tokens")
    make_dir(out)

    def write(batches: Iterator) -> Iterator:
        import uuid
        from array import array

        import pyarrow as pa
        from pyspark import TaskContext

        encoder = encoder_of(tokenizer)
        width = 2 if max(encoder.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        kind = np.dtype(f"<u{width}")
        end = struct.pack("<I", end_id)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        done, sink = [], None

        def close() -> None:
            nonlocal sink
            sink.close()
            with system.open_output_stream(path + ".idx") as index:
                index.write(struct.pack(HEADER, MAGIC, width, 0, len(ids)))
                for values, dtype in ((ends, "<u8"), (ids, "<i8"), (nulls, "<u1")):
                    index.write(np.array(values).astype(dtype).tobytes())
            done.append({"part": part, "turn": len(done), "bin": name + ".bin", "idx": name + ".idx", "width": width, "n_docs": len(ids), "n_ids": ends[-1]})
            sink = None

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if sink is None:
                    name = f"{out}/part-{part:06d}-{len(done):04d}-{attempt}"
                    system, path = open_fs(name)
                    sink, ids, nulls, ends = system.open_output_stream(path + ".bin"), array("q"), array("b"), array("q", [0])
                data = np.frombuffer(encoder.encode(text.as_py()) + end, "<u4").astype(kind)
                sink.write(data.tobytes())
                ends.append(ends[-1] + len(data))
                ids.append(key or 0)
                nulls.append(key is None)
                if ends[-1] * width >= roll_bytes:
                    close()
        if sink is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([(f.split()[0], pa.string() if "string" in f else pa.int64()) for f in FILES.split(", ")]))

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    tie = F.xxhash64("t")
    ordered = rows.repartitionByRange("k", tie).sortWithinPartitions("k", tie)
    manifest = materialize(text_batches(ordered, write, FILES), "token-manifest")
    before = Window.orderBy("part", "turn").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Read files back: (doc_id, start, n_tokens, ids_crc32), start counted over the whole corpus. A task reads documents of about ``task_bytes``; local
    files are memory-mapped; a remote file is read a document at a time."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                system, path = open_fs(row["idx"])
                with system.open_input_file(path) as index:
                    at = struct.calcsize(HEADER)
                    magic, width, _, n = struct.unpack(HEADER, index.read_at(at, 0))
                    if magic != MAGIC or width != row["width"] or n != row["n_docs"]:
                        raise OSError(f"{row['idx']} is not the index that the manifest names")
                    first, count = row["lo"], row["hi"] - row["lo"]
                    ends = np.frombuffer(index.read_at(8 * (count + 1), at + 8 * first), "<u8").astype(np.int64)
                    keys = np.frombuffer(index.read_at(8 * count, at + 8 * (n + 1 + first)), "<i8")
                    nulls = np.frombuffer(index.read_at(count, at + 8 * (2 * n + 1) + first), "<u1").astype(bool)
                system, path = open_fs(row["bin"])
                local = system.type_name == "local"
                ids = np.memmap(path, f"<u{width}", "r") if local else system.open_input_file(path)
                for lo in range(0, count, 4096):
                    hi = min(count, lo + 4096)
                    crcs = np.empty(hi - lo, np.int64)
                    for i in range(lo, hi):
                        span = ids[ends[i] : ends[i + 1]] if local else np.frombuffer(ids.read_at(int(ends[i + 1] - ends[i]) * width, int(ends[i]) * width), f"<u{width}")
                        if len(span) != ends[i + 1] - ends[i]:
                            raise OSError(f"{row['bin']} is shorter than its index says")
                        crcs[i - lo] = zlib.crc32(span.astype("<u4").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo:hi], mask=nulls[lo:hi]), pa.array(ends[lo:hi] + row["base"]), pa.array(np.diff(ends[lo : hi + 1])), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    step = F.greatest(F.lit(1), F.floor(F.col("n_docs") * task_bytes / (F.col("n_ids") * F.col("width")))).cast("long")
    pieces = manifest.withColumn("step", step).withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.col("step"))))
    pieces = pieces.withColumn("hi", F.least("n_docs", F.col("lo") + F.col("step"))).drop("step")
    size = manifest.agg(F.count("*").alias("n"), F.sum(F.col("n_ids") * F.col("width")).alias("bytes")).first()
    return one_task_each(pieces, (size.bytes or 0) // task_bytes + 1).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))
