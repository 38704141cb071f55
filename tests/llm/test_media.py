import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import media_avi as A


@pytest.mark.parametrize("size", [64, 128, 64 * 64, 64 * 65, 64 * 1000])
def test_round_trip(size):
    rng = np.random.default_rng(size)
    for payload in (rng.integers(0, 256, size, np.uint8).tobytes(), b"\xff" * size, b"\0" * size, bytes([0, 255]) * (size // 2)):
        head, jpegs = A.parse_avi(A.encode_avi(payload, size - 3))
        assert (head["n_bytes"], head["payload_bytes"], head["fps"]) == (size - 3, size, 25)
        assert b"".join(A.decode_frame(j).tobytes() for j in jpegs)[:size] == payload


def test_other_tables_and_predictors():
    """A frame coded bit by bit, with another Huffman table, comes back under each predictor."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (6, 10)).astype(int)
    bits, values = bytes([0, 0, 0, 9] + [0] * 12), bytes(range(9))  # categories 0 to 8, four bits each
    for predictor in range(1, 8):
        out = ""
        for i in range(6):
            for j in range(10):
                a, b, c = (x[i, j - 1] if j else 0), (x[i - 1, j] if i else 0), (x[i - 1, j - 1] if i and j else 0)
                p = (a if j else 128) if not i else b if not j else (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[predictor - 1]
                d = int(x[i, j] - p)
                if d < -255 or d > 255:
                    d = (d + 2**15) % 2**16 - 2**15
                s = abs(d).bit_length()
                if s > 8:
                    break
                out += f"{s:04b}" + (f"{d if d > 0 else d + (1 << s) - 1:0{s}b}" if s else "")
            else:
                continue
            break
        else:
            out += "1" * (-len(out) % 8)
            data = bytes(int(out[k : k + 8], 2) for k in range(0, len(out), 8)).replace(b"\xff", b"\xff\0")
            jpeg = b"\xff\xd8" + A._segment(0xC3, struct.pack(">BHHBBBB", 8, 6, 10, 1, 1, 0x11, 0)) + A._segment(0xC4, b"\0" + bits + values) + A._segment(0xDA, struct.pack("BBBBBB", 1, 1, 0, predictor, 0, 0)) + data + b"\xff\xd9"
            assert (A.decode_frame(jpeg) == x).all()


def baseline(image, restart=0, chroma=False):
    """A plain baseline encoder: eight-bit Huffman codes, quantiser 1."""
    h, w = image.shape
    symbols = bytes(r << 4 | s for r in range(16) for s in range(11) if s or r in (0, 15))
    dct = lambda b: np.rint(A._COSINE @ (b.astype(float) - 128) @ A._COSINE.T).astype(int).ravel()[A._ZIGZAG]
    value = lambda v: f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}" if v else ""
    padded = np.pad(image, ((0, -h % 8), (0, -w % 8)), mode="edge")
    scans, out, last = [], "", 0
    for k, (i, j) in enumerate((i, j) for i in range(0, h, 8) for j in range(0, w, 8)):
        if restart and k and k % restart == 0:
            scans.append(out)
            out, last = "", 0
        c = dct(padded[i : i + 8, j : j + 8])
        out += f"{abs(int(c[0]) - last).bit_length():04b}" + value(int(c[0]) - last)
        last, run = int(c[0]), 0
        for v in map(int, c[1:]):
            if not v:
                run += 1
                continue
            while run > 15:
                out += f"{symbols.index(0xF0):08b}"
                run -= 16
            out += f"{symbols.index(run << 4 | abs(v).bit_length()):08b}" + value(v)
            run = 0
        if run:
            out += f"{symbols.index(0):08b}"
        if chroma:
            out += ("0000" + f"{symbols.index(0):08b}") * 2
    scans.append(out)
    coded = b""
    for k, bits in enumerate(scans):
        bits += "1" * (-len(bits) % 8)
        coded += (bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + bytes(int(bits[x : x + 8], 2) for x in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    ids = [1, 2, 3] if chroma else [1]
    seg = A._segment
    head = b"\xff\xd8" + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC0, struct.pack(">BHHB", 8, h, w, len(ids)) + b"".join(bytes([i, 0x11, 0]) for i in ids))
    head += seg(0xC4, b"\0" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)) + b"\x10" + bytes([0] * 7 + [len(symbols)] + [0] * 8) + symbols)
    head += seg(0xDD, struct.pack(">H", restart)) if restart else b""
    return head + seg(0xDA, bytes([len(ids)]) + b"".join(bytes([i, 0]) for i in ids) + b"\0\x3f\0") + coded + b"\xff\xd9"


@pytest.mark.parametrize("restart, chroma", [(0, False), (3, False), (0, True)])
def test_baseline_frames(restart, chroma):
    rng = np.random.default_rng(9)
    image = np.clip(np.cumsum(rng.integers(-20, 21, (37, 50)), axis=1) + 128, 0, 255).astype(np.uint8)
    got = A.decode_frame(baseline(image, restart, chroma))
    assert got.shape == image.shape and np.abs(got.astype(int) - image).max() <= 2


def test_zigzag():
    assert A._ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(A._ZIGZAG) == list(range(64))


def test_index_is_followed():
    frames = [b"\x10" * 4096, b"\x80" * 4096, b"\xf0" * 4096]
    media = A.encode_avi(b"".join(frames), 3 * 4096)
    _, jpegs = A.parse_avi(media)
    at = media.index(b"idx1") + 8
    _, fewer = A.parse_avi(media[:at] + media[at + 16 :])  # an index without the first frame
    assert [A.decode_frame(j).tobytes() for j in jpegs] == frames and len(fewer) == 2
    _, unindexed = A.parse_avi(media[: at - 8])
    assert unindexed == jpegs


def test_shots_are_found_where_the_picture_changes():
    rng = np.random.default_rng(5)
    still = lambda level, n: np.clip(level + rng.integers(-3, 4, (n, 8, 8)), 0, 255).astype(np.uint8)
    frames = np.concatenate((still(40, 10), still(200, 12), still(90, 9)))
    assert A.shots(frames) == [0, 10, 22]
    assert A.shots(still(40, 1)) == [0]


def test_contract_on_edge_cases(spark, edge_dir, edge_rows):
    rows = A.op7_media_avi(spark, edge_dir).collect()
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows)
    want = Counter()
    for i, t, *_ in edge_rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert got == want
    same = [r for r in rows if r.doc_id in (7, 8)]
    assert len({(r.media_sha256, r.media_bytes, r.feature) for r in same}) == 1


def test_clips_cover_the_film(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    rows = A.clip_rows(A.decode_media(A.encode_media(docs.where("doc_id = 4")))).orderBy("clip").collect()
    assert [r.start_ms for r in rows[1:]] == [r.end_ms for r in rows[:-1]] and rows[0].start_ms == 0


def test_empty(spark, empty_dir):
    assert A.op7_media_avi(spark, empty_dir).count() == 0


def plain_feature(text):
    """The feature from its definition, without arrays."""
    from math import sqrt

    raw = (text or "").encode()
    raw = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    head, jpegs = A.parse_avi(A.encode_avi(raw, len((text or "").encode())))
    frames = [list(A.decode_frame(x).tobytes()) for x in jpegs]
    shares = [[sum(v // 8 == b for v in f) / len(f) for b in range(32)] for f in frames]
    apart = [sum(abs(x - y) for x, y in zip(a, b)) / 2 for a, b in zip(shares, shares[1:])]
    starts = [0]
    for i, x in enumerate(apart):
        near = [apart[j] for j in range(max(0, i - 8), min(len(apart), i + 9)) if j != i]
        mean = sum(near) / len(near) if near else 0.0
        if x > 0.05 and (not near or x > mean + 2 * sqrt(sum((v - mean) ** 2 for v in near) / len(near))):
            starts.append(i + 1)
    clips = []
    for a, b in zip(starts, [*starts[1:], len(frames)]):
        means = [sum(f) / len(f) for f in frames[a:b]]
        clips.append((round(1000 * a / 25), round(1000 * b / 25), sum(means) / len(means)))
    return len(frames), clips


def test_feature_by_brute_force(spark, tmp_path):
    import numpy as np
    from llm_documents import write_documents

    rng = np.random.default_rng(2)
    scenes = ["".join(rng.choice(list(letters), 9000)) for letters in ("abc", "XYZ", "0123", "abcXYZ", "~}|{")]
    texts = ["", None, "short", *scenes, "".join(scenes), "".join(scenes * 3), "ab" * 40_000]
    path = write_documents(spark, tmp_path, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r.doc_id: r.feature for r in A.op7_media_avi(spark, path).collect()}
    counts = set()
    for i, text in enumerate(texts):
        frames, clips = plain_feature(text)
        told = got[i].split(";")
        assert told[:2] == [f"{frames} frames", f"{len(clips)} clips"]
        for said, (a, b, mean) in zip(told[2].split(","), clips, strict=True):
            x, y, level = map(int, said.split("-"))
            assert (x, y) == (a, b) and abs(level - mean) <= 0.5 + 1e-6
        counts.add(len(clips))
    assert max(counts) > 2
