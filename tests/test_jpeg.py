"""JPEG tiles: round trips, subsampling, restarts, and what isn't read."""

import struct

import numpy as np
import pytest

from gridloom.sources import jpeg


@pytest.mark.parametrize("shape", [(8, 8, 1), (16, 24, 3), (13, 21, 3), (1, 1, 1), (256, 256, 3)])
def test_round_trip(shape):
    pixels = np.random.default_rng(2).integers(0, 256, shape).astype(np.uint8)
    got = jpeg.decode_jpeg(jpeg.encode_jpeg(pixels))
    assert got.shape == shape and np.abs(got.astype(int) - pixels).max() <= 3


def test_order_of_coefficients():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64)) and jpeg.ZIGZAG[-3:].tolist() == [55, 62, 63]


def test_smooth_images_at_coarse_steps():
    y, x = np.mgrid[0:64, 0:64]
    pixels = np.stack((2 * x + y, 255 - 3 * x, x + 2 * y), 2).clip(0, 255).astype(np.uint8)
    got = jpeg.decode_jpeg(jpeg.encode_jpeg(pixels, step=8))
    assert np.abs(got.astype(int) - pixels).mean() < 3


def segments(data):
    found = list(jpeg._segments(data))
    return {m: b for m, b, _ in found}, data[found[-1][2] :]


def test_subsampled_chroma_and_restarts():
    """An image of 16 by 16 by hand: lightness in four blocks, chroma in one, a restart before each of two such units."""
    plain, _ = segments(jpeg.encode_jpeg(np.zeros((8, 8, 3), np.uint8)))
    dc = lambda v: f"{abs(v).bit_length():04b}" + (f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}" if v else "")
    end = f"{160:08b}"  # the place of the symbol for no more coefficients
    runs = []
    for chroma in (0, 200):
        text = "".join(dc(v) + end for v in (80, 0, 0, 40, chroma, 0))
        text += "1" * (-len(text) % 8)
        runs.append(int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0"))
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    head = struct.pack(">BHHB", 8, 16, 32, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    tables = b"".join(seg(m, b) for m, b, _ in jpeg._segments(jpeg.encode_jpeg(np.zeros((8, 8, 3), np.uint8))) if m in (0xDB, 0xC4))
    data = b"\xff\xd8" + tables + seg(0xC0, head) + seg(0xDD, struct.pack(">H", 1)) + seg(0xDA, plain[0xDA]) + runs[0] + b"\xff\xd0" + runs[1] + b"\xff\xd9"
    got = jpeg.decode_jpeg(data).astype(int)
    assert got.shape == (16, 32, 3)
    assert (got[:8, :16] == 138).all() and (got[8:, :8] == 138).all() and (got[8:, 8:16] == 143).all()  # 128 + 80 / 8, and 5 more
    blue = 138 + round(1.772 * 25)
    assert (got[:8, 16:, 2] == blue).all() and (got[:8, 16:, 0] == 138).all()


def test_what_is_not_read():
    good = jpeg.encode_jpeg(np.random.default_rng(1).integers(0, 256, (16, 16, 3)).astype(np.uint8))
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2", 1)
    for bad in (b"", b"GIF89a", good[:50], good[:400], progressive, good[:-2], good[:300] + b"\xff\xd9"):
        with pytest.raises(ValueError):
            jpeg.decode_jpeg(bad)
