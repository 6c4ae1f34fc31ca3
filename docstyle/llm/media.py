"""Operator 3, media columns: Netpbm and BMP to numpy, area resizing by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table, text_of

UNIT = 64
_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A grey 8-bit image as binary PGM (P5)."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, dtype=np.uint8).tobytes()


def encode_bmp(rgb: np.ndarray) -> bytes:
    """A colour 8-bit image as an uncompressed 24-bit BMP, bottom row first."""
    h, w, _ = rgb.shape
    pad = -3 * w % 4
    rows = np.pad(rgb[::-1, :, ::-1].reshape(h, 3 * w), ((0, 0), (0, pad))).astype(np.uint8)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode(data: bytes | None) -> np.ndarray | None:
    """Netpbm P1 to P6 and uncompressed BMP of 8, 24 or 32 bits as (height, width[, 3]) arrays; None if it is neither or broken."""
    try:
        if data[:2] == b"BM":
            at, (size, w, h, _, bits, packed) = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<IiiHHI", data, 14)
            if packed not in (0, 3) or bits not in (8, 24, 32) or w <= 0 or h == 0:
                return None
            stride = (w * bits + 31) // 32 * 4
            if stride * abs(h) > len(data):
                return None
            rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, : w * bits // 8]
            rows = rows if h < 0 else rows[::-1]
            if bits == 8:
                palette = np.frombuffer(data, np.uint8, min(1024, at - 14 - size), 14 + size).reshape(-1, 4)[:, 2::-1]
                return palette[rows]
            return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]
        kind = int(data[1:2]) if data[:1] == b"P" else 0
        if not 1 <= kind <= 6:
            return None
        head, at = [], 2
        for _ in range(2 if kind in (1, 4) else 3):
            m = _TOKEN.match(data, at)
            head.append(int(m[1]))
            at = m.end()
        (w, h), most = head[:2], (head[2] if len(head) == 3 else 1)
        depth = 3 if kind in (3, 6) else 1
        # a sample takes a bit at least, and the largest value of one is 1 to 65535
        if w * h * depth > 8 * len(data) or not 0 < most < 65536:
            return None
        if kind <= 3:
            body = data[at:]
            flat = np.array([int(c) for c in re.findall(rb"[01]", body)] if kind == 1 else body.split()[: w * h * depth], dtype=np.int64)[: w * h * depth]
        elif kind == 4:
            bits = np.unpackbits(np.frombuffer(data, np.uint8, (w + 7) // 8 * h, at + 1).reshape(h, -1), axis=1)
            flat = bits[:, :w].reshape(-1)
        else:
            flat = np.frombuffer(data, np.uint8 if most < 256 else ">u2", w * h * depth, at + 1)
        if kind in (1, 4):
            flat = (1 - flat) * 255
        elif most != 255:
            flat = flat.astype(np.int64) * 255 // most
        return flat.astype(np.uint8).reshape((h, w, 3) if depth == 3 else (h, w))
    except (ValueError, TypeError, struct.error, IndexError, OverflowError):
        return None


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image.astype(np.uint32) @ np.array([299, 587, 114], dtype=np.uint32) // 1000).astype(np.uint8)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the source area of each target pixel, fractions of pixels included, from one integral image.

    The integral is read at fractional positions by interpolation between its corners, which is exact for it is
    linear inside a pixel. Rows are summed in strips, so memory is one row of sums per strip and not the whole image."""
    h, w = image.shape
    ys, xs = np.arange(height + 1) * (h / height), np.arange(width + 1) * (w / width)
    across = np.zeros((h, width + 1), dtype=np.float64)
    x0 = np.minimum(xs.astype(np.int64), w - 1)
    for top in range(0, h, 4096):
        strip = image[top : top + 4096]
        sums = np.zeros((len(strip), w + 1))
        np.cumsum(strip, axis=1, out=sums[:, 1:])
        across[top : top + 4096] = sums[:, x0] + (xs - x0) * strip[:, x0]
    integral = np.zeros((h + 1, width + 1))
    np.cumsum(across, axis=0, out=integral[1:])
    y0 = np.minimum(ys.astype(np.int64), h - 1)
    corner = integral[y0] + (ys - y0)[:, None] * across[y0]
    return np.diff(np.diff(corner, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, one for each pair of neighbours in a 8 x 9 reduction; unlike a cryptographic hash it moves little with the image."""
    small = area_resize(grey(image), 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    np.lib.format.write_array(out := io.BytesIO(), np.ascontiguousarray(tile), allow_pickle=False)
    return out.getvalue()


def tiles(df: DataFrame, id_col: str, media_col: str, height: int = 32, width: int = 32) -> DataFrame:
    """A media column to (id, height, width, tile: NPY bytes of the grey area-resized image, dhash).

    What can't be decoded, null included, keeps its row with nulls. Other columns are left behind."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [decode(x.as_py()) for x in b.column(1)]
            found = [x if x is not None and x.size else None for x in found]
            small = [None if x is None else np.rint(area_resize(grey(x), height, width)).clip(0, 255).astype(np.uint8) for x in found]
            yield pa.record_batch([b.column(0), pa.array([None if x is None else x.shape[0] for x in found], pa.int32()), pa.array([None if x is None else x.shape[1] for x in found], pa.int32()), pa.array([None if x is None else npy(x) for x in small], pa.binary()), pa.array([None if x is None else difference_hash(x) for x in found], pa.string())], names=[id_col, "height", "width", "tile", "dhash"])

    return df.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, height int, width int, tile binary, dhash string")


def text_media(docs: DataFrame) -> DataFrame:
    """Every whole text as the samples of a PGM image, 64 a row: doc_id, n_bytes, media (the stored bytes).

    Null text counts as empty and is one row of zeros. Nothing is shuffled."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            raw = [x.as_buffer().to_pybytes() for x in b.column(1).cast(pa.binary())]
            media = [encode_pgm(np.frombuffer(x + bytes(-len(x) % UNIT if x else UNIT), np.uint8).reshape(-1, UNIT)) for x in raw]
            yield pa.record_batch([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return text_of(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_digest(media: DataFrame) -> DataFrame:
    """Reads stored media back through the decoder and gives the digests of what it finds, and the tile's hash with them."""

    def run(batches):
        for b in batches:
            rows = []
            for x in b.column(2):
                stored = x.as_buffer().to_pybytes()
                image = decode(stored)
                payload = image.tobytes()
                tile = np.rint(area_resize(image, 32, 32)).astype(np.uint8)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(image), npy(tile)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.record_batch([b.column(0), b.column(1), *cols], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(text_media(table(spark, sf_dir, "documents")))
