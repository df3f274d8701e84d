"""Helpers for ``mapInArrow`` functions: bounded slices, text buffers, and
packed arrays of integers as binary cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` (text or binary) has at most
    ``max_bytes`` per slice; one longer value makes a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def lengths(col: pa.Array) -> np.ndarray:
    """Bytes of each value of a text or binary column (null: 0)."""
    offsets, _ = buffers(col)
    return np.diff(offsets)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a text or binary column without a copy of the
    bytes; nulls count as empty. Offsets start at 0."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def texts(col: pa.Array) -> list[bytes]:
    """The values of a text column as UTF-8 bytes (null: empty)."""
    offsets, raw = buffers(col)
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def pack_sorted(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending u64 keys and columns beside them as one compressed cell: the
    gaps' bytes lie by plane (high planes are mostly zero), columns raw."""
    gaps = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T
    body = [len(keys).to_bytes(8, "little"), np.ascontiguousarray(planes).tobytes()]
    for c in columns:
        kind = c.dtype.newbyteorder("<")
        body += [kind.str.encode().ljust(4), np.ascontiguousarray(c.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpack_sorted(cell: bytes) -> list[np.ndarray]:
    """Inverse of :func:`pack_sorted`: [keys, *columns]."""
    raw = zstandard.ZstdDecompressor().decompress(cell)
    n, at = int.from_bytes(raw[:8], "little"), 8
    planes = np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n)
    out, at = [np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)], at + 8 * n
    while at < len(raw):
        kind = np.dtype(raw[at : at + 4].decode().strip())
        planes = np.frombuffer(raw, np.uint8, kind.itemsize * n, at + 4).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += 4 + kind.itemsize * n
    return out
