"""Media columns: Netpbm and BMP images to NPY tiles with difference hashes.

An image is decoded to a numpy array (rows, columns, channels), cut into tiles,
and each tile is stored as one NPY file image (bytes) beside its difference hash.
The hash comes from an area resize: every target pixel is the exact mean of the
source area that it covers, read off an integral image in four look-ups.

Null or undecodable media give no tiles and the row `error`; repeated rows give
repeated tiles; other columns are not looked at.  In the query a null text counts as
empty, and an empty one is 192 blanks; a very long one is one tall image, summed by
bands of rows; rows without doc_id stay.  A text travels as a P6 image
of 64 x n pixels (its UTF-8 bytes padded with blanks to 192 n), without loss.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_bytes, record_batch, staged, table

ROW = 192  # bytes in a row of 64 RGB pixels


# --- decoding -----------------------------------------------------------------------------------
def _netpbm_fields(data: bytes, count: int, at: int) -> tuple[list[int], int]:
    """Header numbers after the magic; comments run from # to the line's end."""
    out: list[int] = []
    n = len(data)
    while len(out) < count:
        while at < n and (data[at] in b" \t\r\n\v\f" or data[at] == 0x23):
            if data[at] == 0x23:
                end = data.find(b"\n", at)
                at = n if end < 0 else end
            else:
                at += 1
        start = at
        while at < n and 0x30 <= data[at] <= 0x39:
            at += 1
        if start == at:
            raise ValueError("netpbm header")
        out.append(int(data[start:at]))
    return out, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (rows, columns, channels); 8 bits where the maximum is under 256, else 16."""
    kind = data[1:2]
    if data[:1] != b"P" or kind not in b"123456" or not kind:
        raise ValueError("not netpbm")
    bits, channels = kind in b"14", 3 if kind in b"36" else 1
    fields, at = _netpbm_fields(data, 2 if bits else 3, 2)
    w, h, top = (*fields, 1) if bits else fields
    if not 0 < top < 65536 or w == 0 or h == 0:
        raise ValueError("netpbm size")
    n = w * h * channels
    if kind == b"1":  # digits may stand without white space between them
        body = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        flat = np.frombuffer(bytes(c for c in body if c in b"01"), np.uint8)[:n] - 0x30
    elif kind in b"23":
        flat = np.array(data[at:].split()[:n], dtype=np.int64).astype(np.uint8 if top < 256 else np.uint16)
    elif kind == b"4":
        wide = (w + 7) // 8
        rows = np.frombuffer(data, np.uint8, wide * h, at + 1).reshape(h, wide)
        flat = np.unpackbits(rows, axis=1)[:, :w].reshape(-1)
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    if flat.size < n:
        raise ValueError("netpbm is cut short")
    if bits:  # a set bit is black
        flat = (1 - flat).astype(np.uint8) * 255
    return flat.reshape(h, w, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8 (palette), 24 or 32 bits as RGB rows from the top."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    offset, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing not in (0, 3) or w <= 0 or h == 0 or depth not in (1, 4, 8, 24, 32):
        raise ValueError("BMP variant")
    rows, stride = abs(h), (w * depth + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, rows * stride, offset).reshape(rows, stride)
    if depth <= 8:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << depth
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + head).reshape(-1, 4)[:, 2::-1]
        per = 8 // depth
        index = raw if depth == 8 else np.stack([(raw >> (8 - depth * (i + 1))) & ((1 << depth) - 1) for i in range(per)], -1).reshape(rows, -1)
        image = palette[index[:, :w]]
    else:
        image = raw[:, : w * depth // 8].reshape(rows, w, depth // 8)[:, :, 2::-1]
    return image[::-1] if h > 0 else image


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_ppm(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


# --- features -----------------------------------------------------------------------------------
#: Pixels that are summed at a time.
SUMMED = 1 << 18


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Exact area means, of the channels' means where there are channels; borders inside a pixel take their share of it.

    The integral image is read between its grid points; only the lines of it that
    are read are kept, and pixels are summed by bands of rows, so memory holds a band
    however large the image is.
    """
    h, w = image.shape[:2]

    def between(edges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = np.minimum(edges.astype(np.int64), size)
        return low, np.minimum(low + 1, size), edges - low

    y0, y1, fy = between(np.arange(rows + 1) * h / rows, h)
    x0, x1, fx = between(np.arange(columns + 1) * w / columns, w)
    read = np.unique(np.concatenate([y0, y1]))
    lines = np.zeros((len(read), w + 1))
    running, band = np.zeros(w), max(1, SUMMED // w)
    for at in range(0, h, band):
        part = image[at : at + band].astype(np.float64)
        part = part.mean(axis=2) if part.ndim == 3 else part
        upto = np.cumsum(part, 0, out=part)
        here = np.flatnonzero((read > at) & (read <= at + len(part)))
        lines[here, 1:] = np.cumsum(running + upto[read[here] - at - 1], axis=1)
        running = running + upto[-1]
    total = dict(zip(read.tolist(), lines, strict=True))
    at_y = np.stack([total[a] * (1 - f) + total[b] * f for a, b, f in zip(y0.tolist(), y1.tolist(), fy, strict=True)])
    at = at_y[:, x0] * (1 - fx) + at_y[:, x1] * fx
    return np.diff(np.diff(at, axis=0), axis=1) / (h / rows * w / columns)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits, row by row: is a cell of the 8 x 9 reduction darker than its right neighbour? As 16 hex digits."""
    small = np.round(area_resize(pixels, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def to_npy(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(pixels), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


# --- operator -----------------------------------------------------------------------------------
TILES = pa.schema([("k", pa.int64()), ("tile_row", pa.int32()), ("tile_column", pa.int32()), ("npy", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])


def media_tiles(df: DataFrame, key: str, media: str, tile: int | None = 256) -> DataFrame:
    """One row per tile of each image: k, tile_row, tile_column, npy, dhash, error. tile None: the image is one tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    image = decode(data or b"")
                except (ValueError, IndexError, struct.error) as e:
                    yield record_batch(TILES, [(k, None, None, None, None, str(e)[:200])])
                    continue
                step = tile or max(image.shape[:2])
                for y in range(0, image.shape[0], step):
                    rows = []
                    for x in range(0, image.shape[1], step):
                        part = image[y : y + step, x : x + step]
                        rows.append((k, y // step, x // step, to_npy(part), difference_hash(part), None))
                    yield record_batch(TILES, rows)

    inner = df.select(F.col(key).cast("long").alias("k"), F.col(media).cast("binary").alias("m"))
    return inner.mapInArrow(run, "k long, tile_row int, tile_column int, npy binary, dhash string, error string")


STORED = pa.schema([("k", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
#: Rows in an output batch; a batch is also closed at so many bytes.
ROWS, BYTES = 2048, 16_000_000


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, size = [], 0
        for k, t in zip(batch.column(0), batch.column(1), strict=True):
            text = t.as_py()
            n = max(1, -(-len(text) // ROW))
            image = b"P6\n64 %d\n255\n" % n + text.ljust(n * ROW, b" ")
            npy = to_npy(decode(image))
            rows.append((k.as_py(), len(text), npy))
            size += len(npy)
            if size >= BYTES or len(rows) >= ROWS:
                yield record_batch(STORED, rows)
                rows, size = [], 0
        if rows:
            yield record_batch(STORED, rows)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for k, n, m in zip(*batch.columns, strict=True):
            media = m.as_py()
            pixels = from_npy(media)
            payload = pixels.tobytes()
            rows.append((k.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(pixels)))
        yield record_batch(READ, rows)


def text_media(docs: DataFrame) -> DataFrame:
    """Texts as P6 images, decoded and stored as NPY tiles in a table of the shared folder, read back from there, and described."""
    stored = staged(doc_bytes(docs).mapInArrow(_store, "k long, n_bytes long, media binary"), "media")
    return stored.mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
