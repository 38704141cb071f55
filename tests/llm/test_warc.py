import base64
import gzip
import hashlib
import zlib
from collections import Counter

import pytest
from gridloom.llm import warc
from pyspark.sql import functions as F

PAGES = [(1, "http://a", "<p>one"), (2, "http://b", "<p>two"), (3, None, "<p>one"), (4, "http://d", None), (5, "http://e", ""), (None, "http://f", "<p>one"), (None, "u", "<p>alone"), (1, "http://a", "<p>one"), (7, "http://g x\r\n", "é" * 200_000), (8, "h", "\x1f\x8b\x08 \x00 WARC/1.0\r\n\r\n")]


def expected(pages):
    least = {}
    for i, _, h in pages:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    out = Counter()
    for i, _, h in pages:
        raw = (h or "").encode()
        first = least.get(h or "")
        revisit = first is not None and i != first
        out[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None] += 1
    return out


def test_round_trip_with_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for name in ("sha1", "first_id", "same", "min_id", "n"):
        df = df.withColumn(name, F.lit("clash"))
    df.write.parquet(f"{tmp_path}/pages.parquet")
    assert Counter(map(tuple, warc.op1_warc(spark, str(tmp_path)).collect())) == expected(PAGES)


def test_empty(spark, empty_dir):
    assert warc.op1_warc(spark, empty_dir).count() == 0


def test_every_split_size_gives_each_record_once(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}" + "abc" * (i * 37 % 900)) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_warc(pages, roll_bytes=4000)
    assert manifest.count() > 1
    for split in (61, 997, 1 << 20):
        got = warc.read_warc(manifest, split_bytes=split).collect()
        assert sorted(r.page_id for r in got) == list(range(60))
        assert all(r.digest_ok for r in got)


def test_minimum_size_of_revisits(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read_warc(warc.write_warc(pages, min_bytes=5)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_false_magic_and_cut_off_members_are_skipped():
    good = gzip.compress(warc._record(1, "u", "body", "ab" * 20, None))
    other = gzip.compress(b"not a record")
    data = b"\x1f\x8b\x08junk" + other + good + b"\x1f\x8b" + good[:40]
    assert [at for at, _, _ in warc.RangeScan(Bytes(data), 0, len(data)).members()] == [8 + len(other) - 1]


def test_magic_inside_a_member_is_not_a_record():
    inner = gzip.compress(warc._record(2, "u", "inner", "ab" * 20, None))
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = stored.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner + b"\r\n\r\n") + stored.flush()
    found = list(warc.RangeScan(Bytes(outer), 0, len(outer)).members())
    assert [f[b"warc-type"] for _, _, f in found] == [b"resource"]


def test_head_of_any_length_is_read(spark):
    url = "data:" + base64.b64encode(b"".join(hashlib.sha512(b"%d" % i).digest() for i in range(3000))).decode()
    manifest = warc.write_warc(spark.createDataFrame([(1, url, "x"), (2, "u", "y")], "page_id long, url string, html string"))
    assert {r.page_id: r.target_uri for r in warc.read_warc(manifest).collect()} == {1: url, 2: "u"}


def test_lost_records_are_told(spark):
    manifest = warc.write_warc(spark.createDataFrame([(1, "a", "x"), (2, "u", "y")], "page_id long, url string, html string"))
    with pytest.raises(OSError, match="records"):
        warc.read_warc(manifest.withColumn("records", F.col("records") + 1)).count()


def a_file(spark, n=30):
    """The bytes of one archive of ``n`` records, and their offsets."""
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}" + hashlib.sha512(b"%d" % i).hexdigest() * 5) for i in range(n)], "page_id long, url string, html string").coalesce(1)
    (row,) = warc.write_warc(pages).collect()
    data = open(row.file.removeprefix("file://"), "rb").read()
    return data, [at for at, _, _ in warc.RangeScan(Bytes(data), 0, len(data)).members()]


def test_damaged_records_raise(spark, tmp_path):
    data, offsets = a_file(spark)
    where = offsets[11] + 3 * (offsets[12] - offsets[11]) // 4  # in the body: the head decodes
    flipped = data[:where] + bytes([data[where] ^ 0x55]) + data[where + 1 :]
    cut = data[:-12]
    longer = data + gzip.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 9\r\n\r\nbody\r\n\r\n")
    for name, bad, said in (("flipped", flipped, "damaged|long"), ("cut", cut, "cut off"), ("longer", longer, "long")):
        path = tmp_path / name
        path.write_bytes(bad)
        with pytest.raises(OSError, match=said):
            list(warc.RangeScan(Bytes(bad), 0, len(bad)).members())
        manifest = spark.createDataFrame([(f"file://{path}", len(bad), 30)], "file string, bytes long, records long")
        with pytest.raises(Exception, match=said):
            warc.read_warc(manifest).count()


def test_padding_between_members_passes(spark, tmp_path):
    data, offsets = a_file(spark)
    padded = b"".join(data[a:b] + bytes(k % 7) + b"\x1f\x8b pad" * (k % 2) for k, (a, b) in enumerate(zip(offsets, [*offsets[1:], len(data)])))
    path = tmp_path / "padded"
    path.write_bytes(padded)
    manifest = spark.createDataFrame([(f"file://{path}", len(padded), 30)], "file string, bytes long, records long")
    for split in (500, 1 << 20):
        assert sorted(r.page_id for r in warc.read_warc(manifest, split_bytes=split).collect()) == list(range(30))
