"""Media columns: AVI motion-JPEG. Parse RIFF indexes, decode intra frames, find shots, yield timed clips.

Frames that the writer makes are JPEG in the lossless sequential process (SOF3, 8-bit samples, one component, predictor 1), so what is
stored comes back bit by bit. The writer's Huffman table gives difference category s a code of 9-s bits; with the s bits
that follow, each sample takes 9 bits, and whole frames pack and unpack as arrays. The reader takes any table and any
of the predictors 1 to 7, tables of other shape bit by bit, and baseline frames (SOF0, DCT), of which it decodes the first component.

A shot ends where the histogram distance of neighbouring frames exceeds ``floor`` and the mean plus ``k`` standard
deviations of the distances around it.

Defined results: a null or empty text is a payload of 64 zero bytes, one frame and one clip; a null id stays null; repeated
rows give equal values; a very long text is one medium of as many frames as it fills, made whole by one task; a distance that equals its bound ends no shot; an empty table gives none; other
columns, whatever their names, aren't looked at. A clip row's times are in milliseconds, its end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.files import limit_batches, tidied

WIDTH, MAX_HEIGHT, FPS = 64, 64, 25
_BITS = bytes([1] * 9 + [0] * 7)  # one code of each length from 1 to 9
_VALUES = bytes(range(8, -1, -1))  # categories 8, 7 ... 0


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Difference + 255 -> 9-bit symbol, and symbol -> difference."""
    to = np.zeros(511, np.uint16)
    back = np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << 9 - s) - 2  # ones and a zero, 9-s bits
        symbol = code << s | (d if d >= 0 else d + (1 << s) - 1)
        to[d + 255], back[symbol] = symbol, d
    return to, back


_SYMBOL, _DIFFERENCE = _tables()
_K = np.arange(8, dtype=np.uint16)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """(n, h, 64) uint8 -> JPEG files."""
    n, h, w = frames.shape
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    s = _SYMBOL[d + 255].reshape(-1, 8)
    packed = np.zeros((len(s), 9), np.uint8)
    packed[:, :8] = s >> (_K + 1)
    packed[:, 1:] |= ((s & ((2 << _K) - 1)) << (7 - _K)).astype(np.uint8)
    data = packed.reshape(n, -1)
    head = b"\xff\xd8" + _segment(0xC3, struct.pack(">BHHBBBB", 8, h, w, 1, 1, 0x11, 0)) + _segment(0xC4, b"\0" + _BITS + _VALUES) + _segment(0xDA, struct.pack("BBBBBB", 1, 1, 0, 1, 0, 0))
    return [head + row.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9" for row in data]


def _slow_differences(data: bytes, bits: bytes, values: bytes, count: int) -> np.ndarray:
    """Differences under any Huffman table, a code at a time."""
    codes, code, k = {}, 0, 0
    for length, number in enumerate(bits, 1):
        for _ in range(number):
            codes[length, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    stream, at, out = int.from_bytes(data, "big"), len(data) * 8, np.empty(count, np.int32)

    def take(n: int) -> int:
        nonlocal at
        at -= n
        return stream >> at & ((1 << n) - 1) if at >= 0 else (1 << n) - 1

    for i in range(count):
        value = length = 0
        while (length, value) not in codes:
            value, length = value << 1 | take(1), length + 1
            if length > 16:
                raise ValueError("no such Huffman code")
        s = codes[length, value]
        raw = take(s) if 0 < s < 16 else 0
        out[i] = 32768 if s == 16 else raw if not s or raw >> (s - 1) else raw - (1 << s) + 1
    return out


def _predicted(d: np.ndarray, h: int, w: int, predictor: int) -> np.ndarray:
    d = d.reshape(h, w).astype(np.int64)
    if predictor == 1:
        d = d.copy()
        d[0, 0] += 128
        d[:, 0] = np.cumsum(d[:, 0])
        return np.cumsum(d, axis=1) & 0xFFFF
    x = np.zeros((h, w), np.int64)
    for i in range(h):
        for j in range(w):
            a, b, c = (x[i, j - 1] if j else 0), (x[i - 1, j] if i else 0), (x[i - 1, j - 1] if i and j else 0)
            p = (128 if not j else a) if not i else b if not j else (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[predictor - 1]
            x[i, j] = (p + d[i, j]) & 0xFFFF
    return x


_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_COSINE = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class _Bits:
    """Huffman-coded bits of a scan, stuffing taken out; past the end there are ones."""

    def __init__(self, data: bytes):
        self.data, self.at = data.replace(b"\xff\0", b"\xff") + b"\xff" * 8, 0

    def peek16(self) -> int:
        byte = min(self.at >> 3, len(self.data) - 4)
        return int.from_bytes(self.data[byte : byte + 3], "big") >> 8 - (self.at & 7) & 0xFFFF

    def code(self, table: tuple[list[int], list[int]]) -> int:
        window = self.peek16()
        if not table[0][window]:
            raise ValueError("no such Huffman code")
        self.at += table[0][window]
        return table[1][window]

    def value(self, size: int) -> int:
        """A signed value of ``size`` bits."""
        if not size:
            return 0
        raw = self.peek16() >> 16 - size
        self.at += size
        return raw if raw >> size - 1 else raw - (1 << size) + 1


def _lookup(bits: bytes, values: bytes) -> tuple[list[int], list[int]]:
    """Code length and value by the next sixteen bits."""
    lengths, found, at, k = [0] * 65536, [0] * 65536, 0, 0
    for length, number in enumerate(bits, 1):
        span = 1 << 16 - length
        for _ in range(number):
            lengths[at : at + span], found[at : at + span] = [length] * span, [values[k]] * span
            at, k = at + span, k + 1
    return lengths, found


def _decode_baseline(data: bytes, h: int, w: int, parts: list, chosen: dict, tables: dict, quant: dict, restart: int) -> np.ndarray:
    """The first component's samples. parts: (id, across, down, quantiser); chosen: id -> DC and AC table."""
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    units = (-(-w // (8 * across)), -(-h // (8 * down)))
    lookups = {k: _lookup(*t) for k, t in tables.items()}
    first = parts[0]
    blocks = np.zeros((units[1] * first[2], units[0] * first[1], 64))
    scans = re.split(b"\xff[\xd0-\xd7]", data)
    total, each = units[0] * units[1], restart or units[0] * units[1]
    for k in range(0, total, each):
        bits, last = _Bits(scans[k // each]), {p[0]: 0 for p in parts}
        for unit in range(k, min(total, k + each)):
            for part in parts:
                dc, ac = lookups[chosen[part[0]][0]], lookups[16 + chosen[part[0]][1]]
                for v in range(part[2]):
                    for u in range(part[1]):
                        block = [0] * 64
                        last[part[0]] += bits.value(bits.code(dc))
                        block[0], i = last[part[0]], 1
                        while i < 64:
                            symbol = bits.code(ac)
                            if not symbol & 15:
                                if symbol != 0xF0:
                                    break
                                i += 16
                                continue
                            i += symbol >> 4
                            block[_ZIGZAG[i]] = bits.value(symbol & 15)
                            i += 1
                        if part is first:
                            blocks[unit // units[0] * part[2] + v, unit % units[0] * part[1] + u] = block
    table = np.zeros(64)
    table[_ZIGZAG] = quant[first[3]]
    samples = np.einsum("ux,ijuv,vy->ijxy", _COSINE, (blocks * table).reshape(*blocks.shape[:2], 8, 8), _COSINE) + 128
    image = samples.transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, -1)
    return np.clip(np.rint(image[: -(-h * first[2] // down), : -(-w * first[1] // across)]), 0, 255).astype(np.uint8)


def decode_frame(jpeg: bytes) -> np.ndarray:
    """A JPEG frame, lossless of one component or baseline, -> (h, w) uint8, for baseline the first component's samples."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, tables, quant, parts, h, w, process, restart = 2, {}, {}, [], 0, 0, 0, 0
    while True:
        marker, size = struct.unpack_from(">xBH", jpeg, at)
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker in (0xC0, 0xC1, 0xC3):
            process = marker
            precision, h, w, n = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if precision != 8 or marker == 0xC3 and n != 1:
                raise ValueError("8-bit samples are supported, and one component where they are lossless")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]], body = (body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15], body = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(float), body[1 + n :]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            predictor = body[1 + 2 * body[0]]
            break
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError(f"process {marker:02X} is neither lossless nor baseline")
    coded = jpeg[at : jpeg.rindex(b"\xff\xd9")]
    if process != 0xC3:
        return _decode_baseline(coded, h, w, parts, chosen, tables, quant, restart)
    bits, values = tables[chosen[parts[0][0]][0]]
    data = coded.replace(b"\xff\0", b"\xff")
    if bits == _BITS and values == _VALUES and h * w % 8 == 0:
        b = np.frombuffer(data, np.uint8, h * w // 8 * 9).reshape(-1, 9).astype(np.uint16)
        s = ((b[:, :8] << (_K + 1)) & 0x1FF) | (b[:, 1:] >> (7 - _K))
        d = _DIFFERENCE[s].reshape(-1)
    else:
        d = _slow_differences(data, bits, values, h * w)
    return _predicted(d, h, w, predictor).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode_avi(payload: bytes, n_bytes: int) -> bytes:
    """A payload of a multiple of 64 bytes as an AVI of 64-wide frames, the last filled up with zeros."""
    rows = len(payload) // WIDTH
    n = -(-rows // MAX_HEIGHT)
    h = -(-rows // n)
    frames = encode_frames(np.frombuffer(payload.ljust(n * h * WIDTH, b"\0"), np.uint8).reshape(n, h, WIDTH))
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, max(map(len, frames)), WIDTH, h, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, n, max(map(len, frames)), 0xFFFFFFFF, 0, 0, 0, WIDTH, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, h, 1, 8, b"MJPG", WIDTH * h, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<QQ", n_bytes, len(payload))))
    movi, index, at = [b"movi"], [], 4
    for frame in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(frame)))
        movi.append(_chunk(b"00dc", frame))
        at += len(movi[-1])
    body = b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def parse_avi(media: bytes) -> tuple[dict, list[bytes]]:
    """Header fields and the frames that the index names (all ``##dc`` and ``##db`` chunks if there is no index)."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    found: dict = {"fps": float(FPS), "n_bytes": None, "payload_bytes": None}
    movi, index, listed = 0, b"", []

    def walk(at: int, end: int) -> None:
        nonlocal movi, index
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"LIST":
                if media[at + 8 : at + 12] == b"movi":
                    movi = at + 8
                walk(at + 12, min(end, at + 8 + size))
            elif name == b"strh" and media[at + 8 : at + 12] == b"vids":
                scale, rate = struct.unpack_from("<II", media, at + 28)
                found["fps"] = rate / max(1, scale)
            elif name == b"strd" and size >= 16:
                found["n_bytes"], found["payload_bytes"] = struct.unpack_from("<QQ", media, at + 8)
            elif name == b"idx1":
                index = media[at + 8 : at + 8 + size]
            elif name[2:] in (b"dc", b"db"):
                listed.append((at, size))
            at += 8 + size + size % 2

    walk(12, len(media))
    if index:
        entries = [struct.unpack_from("<III", index, k + 4) for k in range(0, len(index) - 15, 16) if index[k + 2 : k + 4] in (b"dc", b"db")]
        shift = movi if not entries or media[movi + entries[0][1] + 2 : movi + entries[0][1] + 4] in (b"dc", b"db") else 0  # offsets from movi or from the file's start
        listed = [(shift + at, size) for _, at, size in entries]
    return found, [media[at + 8 : at + 8 + size] for at, size in listed]


def shots(frames: np.ndarray, k: float = 2.0, floor: float = 0.05, reach: int = 8) -> list[int]:
    """The first frame of each shot."""
    n = len(frames)
    if n < 2:
        return [0]
    flat = frames.reshape(n, -1) >> 3
    histogram = np.bincount((flat + (np.arange(n) * 32)[:, None]).ravel(), minlength=32 * n).reshape(n, 32) / flat.shape[1]
    distance = np.abs(np.diff(histogram, axis=0)).sum(axis=1) / 2
    starts = [0]
    for i, x in enumerate(distance):
        near = np.delete(distance[max(0, i - reach) : i + reach + 1], min(i, reach))
        if x > floor and (not len(near) or x > near.mean() + k * near.std()):
            starts.append(i + 1)
    return starts


CLIP = "array<struct<clip:int,first_frame:int,frames:int,start_ms:long,end_ms:long,mean:double>>"


def encode_media(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): the text's UTF-8 bytes, filled up with zeros to a positive multiple of 64, as an AVI."""

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, media, size, lo = batch.column(0), [], 0, 0
            for i, text in enumerate(batch.column(1)):
                raw = (text.as_py() or "").encode()
                media.append(encode_avi(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)))
                size += len(media[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, i + 1 - lo), pa.array(media, pa.binary())], names=["doc_id", "media"])
                    media, size, lo = [], 0, i + 1
            yield pa.RecordBatch.from_arrays([ids.slice(lo), pa.array(media, pa.binary())], names=["doc_id", "media"])

    limit_batches(rows.sparkSession)
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(encode), "doc_id long, media binary")


def decode_media(media: DataFrame, k: float = 2.0, floor: float = 0.05) -> DataFrame:
    """Decode (doc_id, media): what was stored, and the clips."""

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        clip = pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("mean", pa.float64())])
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "clips"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(clip)]
        schema = pa.schema(list(zip(names, types)))
        for batch in batches:
            columns: list[list] = [[] for _ in names[1:]]
            for value in batch.column(1):
                stored = value.as_py()
                head, jpegs = parse_avi(stored)
                frames = np.stack([decode_frame(x) for x in jpegs])
                payload = frames.tobytes()[: head["payload_bytes"]]
                starts = shots(frames, k, floor)
                means = frames.reshape(len(frames), -1).mean(axis=1)
                ms = lambda f: round(1000 * f / head["fps"])
                clips = [{"clip": c, "first_frame": a, "frames": b - a, "start_ms": ms(a), "end_ms": ms(b), "mean": float(means[a:b].mean())} for c, (a, b) in enumerate(zip(starts, [*starts[1:], len(frames)]))]
                row = (head["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), len(frames), clips)
                for column, x in zip(columns, row):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types[1:]))], schema=schema)

    return media.select("doc_id", "media").mapInArrow(tidied(decode), f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames int, clips {CLIP}")


def clip_rows(decoded: DataFrame) -> DataFrame:
    """A row for each clip: doc_id, clip, first_frame, frames, start_ms, end_ms, mean."""
    return decoded.select("doc_id", F.inline("clips"))


def op7_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    decoded = decode_media(encode_media(docs))
    clip = F.transform("clips", lambda c: F.concat_ws("-", c["start_ms"], c["end_ms"], F.round(c["mean"]).cast("int")))
    feature = F.concat_ws(";", F.concat(F.col("frames"), F.lit(" frames")), F.concat(F.size("clips"), F.lit(" clips")), F.concat_ws(",", clip))
    return decoded.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
