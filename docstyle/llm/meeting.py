"""Where short keyed rows of all documents meet: most rows of this kind are alone with their key, a few keys are hot.

Rows of a lot of texts are first met inside the lot, so that a key crosses the network once per lot however many rows
have it, and what a lot can tell alone is told there. The rest travels as blobs, one per lot and bucket of the key's hash:
byte planes of the columns under zstd take about half of what as many rows would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import partitions
from .textkernels import raw

#: Texts are taken in lots of about so many bytes.
LOT = 2 << 20
#: Buckets for each shuffle partition: a task holds the rows of one bucket at a time.
BUCKETS = 2
_U = np.uint64
_CODEC = pa.Codec("zstd", compression_level=1)


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit integers as bytes; the first is stored as differences, so ids in order cost little."""
    columns = [np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).ravel() for c in columns]
    return _CODEC.compress(np.concatenate(planes), asbytes=True)


def unpack(blob: bytes, n: int, kinds: list) -> list[np.ndarray]:
    flat = np.frombuffer(_CODEC.decompress(blob, decompressed_size=8 * n * len(kinds)), dtype=np.uint8)
    planes = flat.reshape(len(kinds), 8, n)
    out = [np.ascontiguousarray(p.T).view(k).ravel() for p, k in zip(planes, kinds)]
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out


def lots(batches, columns: int) -> Iterator[tuple[list, list[bytes]]]:
    """([column values of the first `columns` columns], texts) of lots of rows; the text is the column after them."""
    held: list[list] = [[] for _ in range(columns)]
    texts: list[bytes] = []
    size = 0
    for b in batches:
        own, t = [b.column(i).to_pylist() for i in range(columns)], raw(b.column(columns))
        at = 0
        for i, x in enumerate(t):
            size += len(x)
            if size >= LOT:
                for h, o in zip(held, own):
                    h += o[at : i + 1]
                yield held, texts + t[at : i + 1]
                held, texts, size, at = [[] for _ in range(columns)], [], 0, i + 1
        for h, o in zip(held, own):
            h += o[at:]
        texts += t[at:]
    if texts:
        yield held, texts


def blobs(key: np.ndarray, columns: list[np.ndarray], buckets: int) -> tuple[list[int], list[int], list[bytes]]:
    """(bucket, rows, blob) of the rows (columns..., key) of one lot."""
    bucket = ((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in (*columns, key)]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(first[1:], len(bucket))
    return bucket[first].tolist(), (ends - first).tolist(), [pack([c[lo:hi] for c in columns]) for lo, hi in zip(first.tolist(), ends.tolist())]


def buckets_of(df: DataFrame) -> int:
    return BUCKETS * partitions(df.sparkSession)


def met(rows: DataFrame) -> DataFrame:
    """Deals rows (bucket, ...) out by bucket, one bucket after the other in a task."""
    return rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket")


def by_bucket(batches, kinds: list) -> Iterator[tuple[list, list[np.ndarray]]]:
    """For each batch of dealt rows (bucket, n, blob, more...): ([the batch's rows without a blob], []), and, when a
    bucket is complete, (None, its columns)."""
    bucket, held = None, []

    def whole():
        parts = [unpack(x, n, kinds) for n, x in held]
        return [np.concatenate(c) for c in zip(*parts)]

    for b in batches:
        blob = b.column(2)
        yield b.filter(blob.is_null()), []
        for k, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), blob.to_pylist()):
            if x is None:
                continue
            if k != bucket and held:
                yield None, whole()
                held = []
            bucket = k
            held.append((n, x))
    if held:
        yield None, whole()
