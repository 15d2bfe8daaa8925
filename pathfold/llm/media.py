"""Media columns: Netpbm and BMP images as binary columns, decoded to numpy arrays, area-resized by integral images and written as
NPY tiles with difference hashes.

    read      P1-P6 with 8 and 16-bit samples, comments and several white spaces; BMP with 1, 4, 8, 24 and 32 bits,
              palettes, bottom-up and top-down rows
    write     PGM (P5), PPM (P6), BMP with 8-bit grey palette or 24 bits
    resize    the mean of the pixels under each target cell, fractions of pixels included, from sums over the upper left of each
              corner (integral image). Sums are whole numbers, so results are exact; rows are added in strips of STRIP,
              so memory grows with the target and a strip, not with the image.
    hash      bit k tells whether a cell of the 9 x 8 image is darker than its right neighbour

Any bytes can be carried as an image: `payload_image` lays them out in rows of WIDTH grey samples.

Defined results: a null text is the empty one; null ids stay; a text of any length is one image; repeated rows give
repeated rows; equal bytes give equal images, tiles and hashes; an empty table gives an empty one; further columns are ignored. Bytes that
are no image of these kinds, or are cut short, are an error in `decode` and a row with null size and an `error` in `tiles`.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.llm.common import materialize
from pathfold.llm.workers import release, tidied

#: Samples of a row of a payload's image.
WIDTH = 64
#: Rows that are added at once.
STRIP = 4096
#: Rows and columns of a tile.
TILE = 16
#: Bytes of images that a batch of results comes from.
BATCH_BYTES = 8 << 20

# -- decoding -------------------------------------------------------------------------------------------------------


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[1] - ord("0"), 2, []
    while len(numbers) < (2 if kind in (1, 4) else 3):
        c = data[at : at + 1]
        if c == b"#":
            at = data.index(b"\n", at) + 1
        elif c.isspace():
            at += 1
        else:
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            if end == at:
                raise ValueError("a number is missing in the header")
            numbers.append(int(data[at:end]))
            at = end
    width, height, top = numbers[0], numbers[1], numbers[2] if len(numbers) > 2 else 1
    if not 0 < top < 65536 or not width or not height:
        raise ValueError("size or largest sample out of range")
    bands = 3 if kind in (3, 6) else 1
    n = width * height * bands
    if kind < 4:
        lines = [line.partition(b"#")[0] for line in data[at:].split(b"\n")]
        text = b" ".join(lines)
        flat = np.frombuffer(bytes(c for c in text if c in b"01"), dtype=np.uint8) - ord("0") if kind == 1 else np.array(text.split()[:n], dtype=np.int64)
        flat = flat[:n]
    else:
        raw = memoryview(data)[at + 1 :]  # one white space ends the header
        if kind == 4:
            row = (width + 7) // 8
            packed = np.frombuffer(raw[: row * height], dtype=np.uint8)
            if len(packed) < row * height:
                raise ValueError("the image is cut short")
            flat = np.unpackbits(packed.reshape(height, row), axis=1)[:, :width].ravel()
        else:
            wide = 1 + (top > 255)
            if len(raw) < n * wide:
                raise ValueError("the image is cut short")
            flat = np.frombuffer(raw[: n * wide], dtype=">u2" if wide == 2 else np.uint8)
    if len(flat) < n:
        raise ValueError("the image is cut short")
    if kind in (1, 4):
        flat = (1 - flat) * 255  # a set bit is black
    elif flat.max() > top:
        raise ValueError("a sample above the largest")
    elif top != 255:
        flat = (flat.astype(np.int64) * 255 + top // 2) // top
    out = flat.astype(np.uint8, copy=False)
    return out.reshape(height, width, 3) if bands == 3 else out.reshape(height, width)


def _bmp(data: bytes) -> np.ndarray:
    four = lambda at: int.from_bytes(data[at : at + 4], "little", signed=True)
    start, head, width, height = four(10), four(14), four(18), four(22)
    bits, packing, used = int.from_bytes(data[28:30], "little"), four(30), four(46)
    if head < 40 or packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height or (packing == 3 and bits != 32):
        raise ValueError("a BMP of another kind")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    if len(data) < start + rows * stride:
        raise ValueError("the image is cut short")
    grid = np.frombuffer(memoryview(data)[start : start + rows * stride], dtype=np.uint8).reshape(rows, stride)
    if height > 0:
        grid = grid[::-1]
    if bits >= 24:
        step = bits // 8
        return np.ascontiguousarray(grid[:, : width * step].reshape(rows, width, step)[:, :, 2::-1])
    if bits < 8:
        grid = np.unpackbits(grid, axis=1)
        if bits == 4:
            grid = np.packbits(grid.reshape(rows, -1, 4), axis=2)[:, :, 0] >> 4
    index = grid[:, :width]
    table = np.frombuffer(data[14 + head : 14 + head + 4 * (used or 1 << bits)], dtype=np.uint8).reshape(-1, 4)[:, 2::-1]
    if index.max() >= len(table):
        raise ValueError("a colour beyond the palette")
    if (table == table[:, :1]).all():  # greys
        return np.ascontiguousarray(index) if (table[:, 0] == np.arange(len(table))).all() else table[:, 0][index]
    return table[index]


def decode(data: bytes) -> np.ndarray:
    """uint8 array, (height, width) for grey images and (height, width, 3) for others."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        try:
            return _netpbm(data)
        except (IndexError, OverflowError) as error:
            raise ValueError("the image is cut short") from error
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


# -- encoding -------------------------------------------------------------------------------------------------------


def encode(image: np.ndarray, kind: str) -> bytes:
    """kind 'netpbm' (PGM or PPM) or 'bmp' (8-bit greys or 24 bits, bottom-up)."""
    height, width = image.shape[:2]
    colour = image.ndim == 3
    if kind == "netpbm":
        return b"P%d\n%d %d\n255\n" % (6 if colour else 5, width, height) + image.tobytes()
    if kind != "bmp":
        raise ValueError(f"no such kind: {kind}")
    bits = 24 if colour else 8
    row = width * bits // 8
    palette = b"" if colour else b"".join(bytes((g, g, g, 0)) for g in range(256))
    pixels = image[::-1, :, ::-1] if colour else image[::-1]
    pixels = np.pad(pixels.reshape(height, row), ((0, 0), (0, -row % 4)))
    start = 54 + len(palette)
    numbers = lambda *xs: b"".join(x.to_bytes(4, "little") for x in xs)
    head = b"BM" + numbers(start + pixels.size, 0, start, 40, width, height) + (1).to_bytes(2, "little") + bits.to_bytes(2, "little") + numbers(0, pixels.size, 2835, 2835, len(palette) // 4, 0)
    return head + palette + pixels.tobytes()


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of WIDTH."""
    return data + b"\0" * (-len(data) % WIDTH if data else WIDTH)


def payload_image(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(-1, WIDTH)


# -- resizing and hashing -------------------------------------------------------------------------------------------


def _corners(sums: np.ndarray, edges: np.ndarray, parts: int, axis: int) -> np.ndarray:
    """parts times the sums at the fractional places edges / parts, between the two whole places beside each."""
    low, rest = edges // parts, edges % parts
    shape = [-1 if i == axis else 1 for i in range(sums.ndim)]
    a, b = np.take(sums, low, axis), np.take(sums, np.minimum(low + 1, sums.shape[axis] - 1), axis)
    return a * parts + (b - a) * rest.reshape(shape)


def area_sums(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """rows * columns times the sum of the pixels (and fractions of pixels) under each cell of a rows x columns grid: whole numbers."""
    grey = image if image.ndim == 2 else image.sum(axis=2, dtype=np.int64)
    height, width = grey.shape
    y, x = np.arange(rows + 1) * height, np.arange(columns + 1) * width  # edges, times rows or columns
    need = np.unique(np.concatenate((y // rows, np.minimum(y // rows + 1, height))))
    # The integral image's needed rows only: strips are added and forgotten.
    kept, carry = np.zeros((len(need), width + 1), dtype=np.int64), np.zeros(width + 1, dtype=np.int64)
    for at in range(0, height, STRIP):
        strip = np.cumsum(np.cumsum(grey[at : at + STRIP], axis=1, dtype=np.int64), axis=0)
        own = np.flatnonzero((need > at) & (need <= at + len(strip)))
        kept[own, 1:] = strip[need[own] - at - 1]
        kept[own] += carry
        carry[1:] += strip[-1]
    low = np.searchsorted(need, y // rows)
    high = np.searchsorted(need, np.minimum(y // rows + 1, height))
    at_rows = kept[low] * rows + (kept[high] - kept[low]) * (y % rows)[:, None]
    corners = _corners(at_rows, x, columns, 1)
    return np.diff(np.diff(corners, axis=0), axis=1)


def resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of the pixels under each cell, rounded half up; bands are resized each for itself."""
    if image.ndim == 3:
        return np.stack([resize(image[:, :, b], rows, columns) for b in range(image.shape[2])], axis=2)
    area = image.shape[0] * image.shape[1]
    return ((2 * area_sums(image, rows, columns) + area) // (2 * area)).astype(np.uint8)


def difference_hash(image: np.ndarray, rows: int = 8, columns: int = 8) -> str:
    """rows * columns bits in hexadecimal: a cell is darker than its right neighbour, by exact sums."""
    sums = area_sums(image, rows, columns + 1)
    return np.packbits((sums[:, :-1] < sums[:, 1:]).ravel()).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


# -- on tables ------------------------------------------------------------------------------------------------------


def _by_size(batches: Iterator, column: int) -> Iterator:
    """Slices of the batches whose `column` has at most BATCH_BYTES bytes, or one longer value."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        held, size = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > held and size + n > BATCH_BYTES:
                yield batch.slice(held, i - held)
                held, size = i, 0
            size += n
        if batch.num_rows > held:
            yield batch.slice(held)


def from_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: every text's padded bytes as a grey image, a PGM if their CRC-32 is even and a BMP if it is odd."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in _by_size(batches, 1):
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            media = []
            for text in texts:
                payload = padded(text)
                media.append(encode(payload_image(payload), "bmp" if zlib.crc32(payload) % 2 else "netpbm"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
            del texts, media
            release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, n_bytes long, media binary")


_TILE_ROWS = "height long, width long, bands int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, tile binary, error string"


def tiles(media: DataFrame, rows: int = TILE, columns: int = TILE, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The columns `keep` and, for each image of media_col: its size, digests of its samples in order and of its stored bytes, the CRC-32
    of its last 64 samples, its difference hash and the NPY tile of rows x columns that it is resized to."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in _by_size(batches, len(keep)):
            out = []
            for data in batch.column(len(keep)).to_pylist():
                try:
                    image = decode(data or b"")
                except ValueError as error:
                    out.append((None,) * 6 + (len(data or b""), hashlib.sha256(data or b"").hexdigest(), None, None, str(error)))
                    continue
                samples = memoryview(np.ascontiguousarray(image)).cast("B")
                out.append((image.shape[0], image.shape[1], image.shape[2] if image.ndim == 3 else 1, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(image), npy(resize(image, rows, columns)), None))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], names=[*keep, *[c.split()[0] for c in _TILE_ROWS.split(", ")]])
            release()

    taken = media.select(*keep, F.col(media_col).cast("binary").alias("media"))
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in taken.schema.fields[:-1])
    return taken.mapInArrow(tidied(run), f"{own}, {_TILE_ROWS}")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts written as a table of images, read back, and written as a table of tiles and hashes, which is returned."""
    return materialize(tiles(materialize(from_texts(docs, id_col, text_col), "media")), "media-tiles")
