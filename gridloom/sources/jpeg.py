"""JPEG images: a reader of sequential eight-bit images, grey or in colour, and a writer of images without subsampling."""

from __future__ import annotations

import struct
from functools import cache

import numpy as np

SOI, EOI, RESTARTS = 0xD8, 0xD9, range(0xD0, 0xD8)
#: Fixed values of the format: the order in which a block's 64 coefficients are kept, by anti-diagonals that alternate their direction.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


@cache
def _cosines() -> np.ndarray:
    """Row u holds the u-th cosine at eight places; its transpose is its inverse."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)


def _lookup(counts: bytes, values: bytes) -> list[tuple[int, int]]:
    """(bits, value) for each sixteen bits that a code may begin."""
    table, code, at = [(0, 0)] * 65536, 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            lo = code << (16 - bits)
            if at >= len(values) or lo + (1 << (16 - bits)) > 65536:
                raise ValueError("a code table is damaged")
            table[lo : lo + (1 << (16 - bits))] = [(bits, values[at])] * (1 << (16 - bits))
            code, at = code + 1, at + 1
        code <<= 1
    return table


class _Bits:
    """Bits of a run of entropy-coded bytes; behind its end come zeros, of which some are fewer than a code."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def _fill(self) -> None:
        part = self.data[self.at : self.at + 8]
        if self.at > len(self.data) + 16:
            raise ValueError("the pixels are cut off")
        self.held = (self.held << 64) | int.from_bytes(part.ljust(8, b"\0"), "big")
        self.at, self.n = self.at + 8, self.n + 64

    def code(self, table: list[tuple[int, int]]) -> int:
        if self.n < 16:
            self._fill()
        bits, value = table[self.held >> (self.n - 16) & 0xFFFF]
        if not bits:
            raise ValueError("a code is unknown")
        self.n -= bits
        self.held &= (1 << self.n) - 1
        return value

    def number(self, bits: int) -> int:
        """A signed number: those below half of the range stand for the negative ones."""
        if not bits:
            return 0
        if self.n < bits:
            self._fill()
        self.n -= bits
        value = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return value if value >> (bits - 1) else value - (1 << bits) + 1


def _segments(data: bytes):
    """(marker, body, place behind it) up to the first scan."""
    if data[:2] != bytes([0xFF, SOI]):
        raise ValueError("not a JPEG")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is damaged")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        if size < 2 or at + 2 + size > len(data):
            raise ValueError("a segment is cut off")
        yield marker, data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDA:
            return
        at += 2 + size


def decode_jpeg(data: bytes) -> np.ndarray:
    """(height, width, channels) of a sequential JPEG of eight bits; other kinds and damaged ones are a ValueError. Smaller chroma planes are repeated to the image's size."""
    try:
        return _decode(data)
    except (IndexError, KeyError, struct.error) as error:
        raise ValueError(f"the image is damaged: {error!r}") from error


def _decode(data: bytes) -> np.ndarray:
    quant, codes, restart, adobe, frame, scan = {}, {}, 0, None, None, None
    for marker, body, behind in _segments(data):
        if marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                raw = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.float64)
                quant[k] = np.zeros(64)
                quant[k][ZIGZAG] = raw
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if bits != 8 or n not in (1, 3) or not height or not width or any(not 1 <= s <= 4 for _, h, v, _ in frame for s in (h, v)):
                raise ValueError("this kind of JPEG isn't read")
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("this kind of JPEG isn't read")
        elif marker == 0xDA:
            scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    if frame is None or scan is None or len(scan) != len(frame):
        raise ValueError("an image of one scan is asked for")
    if len(frame) == 1:
        frame = [(frame[0][0], 1, 1, frame[0][3])]
    most_h, most_v = max(h for _, h, _, _ in frame), max(v for _, _, v, _ in frame)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    planes = [np.zeros((down * v, across * h, 64)) for _, h, v, _ in frame]
    tables = [(codes[scan[i] >> 4], codes[16 | scan[i] & 15]) for i, *_ in frame]

    runs = _runs(data[behind:])
    bits, before = _Bits(runs[0]), [0] * len(frame)
    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            bits, before = _Bits(runs[unit // restart]), [0] * len(frame)
        row, column = divmod(unit, across)
        for c, (_, h, v, _) in enumerate(frame):
            dc, ac = tables[c]
            for dy in range(v):
                for dx in range(h):
                    before[c] += bits.number(bits.code(dc))
                    block = planes[c][row * v + dy, column * h + dx]
                    block[0] = before[c]
                    k = 1
                    while k < 64:
                        symbol = bits.code(ac)
                        if not symbol & 15:
                            if symbol != 0xF0:
                                break
                            k += 16
                            continue
                        k += symbol >> 4
                        block[ZIGZAG[k]] = bits.number(symbol & 15)
                        k += 1
    cosines, out = _cosines(), []
    for (_, h, v, q), plane in zip(frame, planes):
        blocks = (plane * quant[q]).reshape(*plane.shape[:2], 8, 8)
        pixels = np.einsum("ux,rcuv,vy->rxcy", cosines, blocks, cosines).reshape(8 * plane.shape[0], 8 * plane.shape[1]) + 128.0
        if most_h % h or most_v % v:
            raise ValueError("this kind of JPEG isn't read")
        out.append(np.clip(np.rint(pixels), 0, 255).repeat(most_v // v, 0).repeat(most_h // h, 1)[:height, :width])
    image = np.stack(out, 2)
    if len(out) == 3 and adobe != 0:
        y, cb, cr = image[:, :, 0], image[:, :, 1] - 128.0, image[:, :, 2] - 128.0
        # fixed values of the format: colours from lightness and two differences
        image = np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), 2)
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)


def _runs(data: bytes) -> list[bytes]:
    """The coded bytes between restart markers, up to the next other marker, without the zeros that stand behind bytes of ones."""
    runs, start, at = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("the image has no end")
        if data[at + 1] in RESTARTS:
            runs.append(data[start:at])
            start = at + 2
        elif data[at + 1]:
            runs.append(data[start:at])
            return [r.replace(b"\xff\x00", b"\xff") for r in runs]
        at += 2


def encode_jpeg(pixels: np.ndarray, step: int = 1) -> bytes:
    """A sequential JPEG of (height, width, 1 or 3) pixels whose coefficients are multiples of ``step``: 1 keeps pixels to within a level or two. Codes are of one length, which is plain, not short."""
    height, width, n = pixels.shape
    if n not in (1, 3):
        raise ValueError("one or three channels are asked for")
    image = pixels.astype(np.float64)
    if n == 3:
        r, g, b = np.moveaxis(image, 2, 0)
        y = 0.299 * r + 0.587 * g + 0.114 * b
        image = np.stack((y, (b - y) / 1.772 + 128.0, (r - y) / 1.402 + 128.0), 2)
    image = np.pad(image, ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge") - 128.0
    down, across = image.shape[0] // 8, image.shape[1] // 8
    blocks = image.reshape(down, 8, across, 8, n).transpose(0, 2, 4, 1, 3)
    cosines = _cosines()
    found = np.rint(np.einsum("ux,rcnxy,vy->rcnuv", cosines, blocks, cosines) / step).astype(int).reshape(down * across, n, 64)[:, :, ZIGZAG]
    symbols = [run << 4 | size for run in range(16) for size in range(1, 11)] + [0x00, 0xF0]
    of = {s: i for i, s in enumerate(symbols)}  # a code of eight bits is a symbol's place
    bits, before = [], [0] * n

    def number(v: int) -> str:
        size = abs(v).bit_length()
        return f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""

    for unit in found:
        for c in range(n):
            change = int(unit[c, 0]) - before[c]
            before[c] += change
            bits.append(f"{abs(change).bit_length():04b}" + number(change))
            zeros = 0
            last = np.flatnonzero(unit[c, 1:])
            for v in unit[c, 1 : 2 + last[-1] if len(last) else 1].tolist():
                if v == 0:
                    zeros += 1
                    continue
                bits.append(f"{of[0xF0]:08b}" * (zeros // 16) + f"{of[zeros % 16 << 4 | abs(v).bit_length()]:08b}" + number(v))
                zeros = 0
            if not len(last) or last[-1] < 62:
                bits.append(f"{of[0]:08b}")
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    coded = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    table = lambda kind, size, values: segment(0xC4, bytes([kind]) + bytes(len(values) if k == size else 0 for k in range(1, 17)) + bytes(values))
    head = segment(0xDB, b"\0" + bytes([step]) * 64) + segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(n)))
    scan = segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\0\x3f\0")
    return bytes([0xFF, SOI]) + head + table(0x00, 4, range(12)) + table(0x10, 8, symbols) + scan + coded + bytes([0xFF, EOI])
