"""Images against plain versions: formats, exact area means, hashes and the round trip of every text."""

import hashlib
import io
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathfold.llm import media, queries

R = np.random.default_rng(0)


def area_plain(image, rows, columns):
    """Means by overlaps of intervals, in fractions."""
    height, width = image.shape
    share = lambda n, m: [[max(Fraction(0), min(Fraction((i + 1) * n, m), j + 1) - max(Fraction(i * n, m), j)) for j in range(n)] for i in range(m)]
    y, x, area = share(height, rows), share(width, columns), Fraction(height * width, rows * columns)
    return [[sum(y[i][a] * x[j][b] * int(image[a, b]) for a in range(height) if y[i][a] for b in range(width) if x[j][b]) / area for j in range(columns)] for i in range(rows)]


@pytest.mark.parametrize("height, width, rows, columns", [(1, 64, 8, 9), (7, 5, 3, 4), (64, 64, 16, 16), (3, 2, 5, 7), (23, 64, 8, 9)])
def test_area_means_are_exact(monkeypatch, height, width, rows, columns):
    monkeypatch.setattr(media, "STRIP", 4)
    image = R.integers(0, 256, (height, width), dtype=np.uint8)
    want = area_plain(image, rows, columns)
    sums = media.area_sums(image, rows, columns)
    assert [[Fraction(int(v), height * width) for v in row] for row in sums] == want
    assert media.resize(image, rows, columns).tolist() == [[int(v + Fraction(1, 2)) for v in row] for row in want]


def test_difference_hash():
    image = R.integers(0, 256, (40, 64), dtype=np.uint8)
    cells = area_plain(image, 8, 9)
    bits = "".join("1" if row[i] < row[i + 1] else "0" for row in cells for i in range(8))
    assert media.difference_hash(image) == f"{int(bits, 2):016x}"
    assert media.difference_hash(np.zeros((1, 64), dtype=np.uint8)) == "0" * 16


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (6, 8), (3, 5, 3), (64, 64, 3)])
@pytest.mark.parametrize("kind", ["netpbm", "bmp"])
def test_formats_round_trip(shape, kind):
    image = R.integers(0, 256, shape, dtype=np.uint8)
    assert np.array_equal(media.decode(media.encode(image, kind)), image)


def test_other_netpbm_forms():
    assert media.decode(b"P1\n# a bitmap\n3 2\n1 0 1\n010 # end\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 2 15 0 15 5 10").tolist() == [[0, 255], [85, 170]]
    assert media.decode(b"P3\n1 2\n255\n1 2 3\n4 5 6\n").tolist() == [[[1, 2, 3]], [[4, 5, 6]]]
    assert media.decode(b"P4\n10 1\n" + bytes([0b10000000, 0b01000000])).tolist() == [[0] + [255] * 8 + [0]]
    assert media.decode(b"P5 1 2 65535\n" + (65535).to_bytes(2, "big") + (257).to_bytes(2, "big")).tolist() == [[255], [1]]


def test_other_bmp_forms():
    def bmp(bits, width, height, palette, pixels):
        start = 54 + len(palette)
        head = b"BM" + (start + len(pixels)).to_bytes(4, "little") + bytes(4) + start.to_bytes(4, "little") + (40).to_bytes(4, "little") + width.to_bytes(4, "little") + height.to_bytes(4, "little", signed=True)
        return head + (1).to_bytes(2, "little") + bits.to_bytes(2, "little") + bytes(4 * 6) + palette + pixels

    black, white = bytes(4), b"\xff\xff\xff\0"
    assert media.decode(bmp(1, 3, -2, black + white, bytes([0b10100000, 0, 0, 0, 0b01000000, 0, 0, 0]))).tolist() == [[255, 0, 255], [0, 255, 0]]
    red = b"\0\0\xff\0"
    table = (black + red) * 8
    assert media.decode(bmp(4, 3, 1, table, bytes([0x01, 0x10, 0, 0]))).tolist() == [[[0, 0, 0], [255, 0, 0], [255, 0, 0]]]
    assert media.decode(bmp(32, 1, -1, b"", bytes([3, 2, 1, 9]))).tolist() == [[[1, 2, 3]]]


@pytest.mark.parametrize("data", [b"", b"P5", b"P5 2 2 255\n\0", b"P9 1 1 1", b"GIF89a", b"BM" + bytes(60), b"P2 1 1 255 300", b"P5 0 4 255\n", b"P1 2 2 1 0"])
def test_bytes_that_are_no_image(spark, data):
    with pytest.raises(ValueError):
        media.decode(data)
    row = media.tiles(spark.createDataFrame([(1, data)], "doc_id long, media binary"), keep=("doc_id",)).first()
    assert row.error and row.height is None and row.media_bytes == len(data)


def plain(text):
    data = (text or "").encode()
    payload = data + b"\0" * (-len(data) % 64 if data else 64)
    image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 64)
    if zlib.crc32(payload) % 2:
        numbers = [1078 + len(payload), 0, 1078, 40, 64, len(image)]
        stored = b"BM" + b"".join(x.to_bytes(4, "little") for x in numbers) + b"\1\0\10\0" + b"".join(x.to_bytes(4, "little") for x in (0, len(payload), 2835, 2835, 256, 0)) + b"".join(bytes((g, g, g, 0)) for g in range(256)) + image[::-1].tobytes()
    else:
        stored = f"P5\n64 {len(image)}\n255\n".encode() + payload
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(stored), sha(stored)


def test_every_text(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op11_media_columns"](spark, sf).collect()
    assert {r.doc_id: tuple(r[1:7]) for r in got} == {k: plain(t) for k, t in docs.items()} and len(got) == len(docs)
    for r in got[:20]:
        image = np.frombuffer(media.padded(docs[r.doc_id].encode()), dtype=np.uint8).reshape(-1, 64)
        assert r.feature == media.difference_hash(image)


def test_texts_of_all_kinds(spark):
    texts = [None, "", "a", "b" * 64, "c" * 65, "é日😀" * 30, "long " * 100_000, "a"]
    df = spark.createDataFrame([(None if i == 1 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("media", "n_bytes", "tile", "error")})
    got = {r.doc_id: r for r in media.round_trip(df).collect()}
    for i, t in enumerate(texts):
        r = got[None if i == 1 else i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == plain(t) and r.error is None
        tile = np.load(io.BytesIO(r.tile))
        assert tile.shape == (16, 16) and tile.dtype == np.uint8
    assert got[2].dhash == got[7].dhash and got[2].tile == got[7].tile and got[0].payload_bytes == 64
    assert media.round_trip(df.where("false")).collect() == []
