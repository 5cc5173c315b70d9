"""Compact binary columns for shuffles: whole sorted arrays in one value instead of a row each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    """Unsigned or signed 64-bit integers, in any order: byte planes, compressed.  Sort and take ``deltas`` first where you can."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T if len(values) else np.zeros((1, 0), np.uint8)
    return len(values).to_bytes(6, "little") + bytes([values.dtype.itemsize]) + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, dtype=np.uint64) -> np.ndarray:
    n, size = int.from_bytes(blob[:6], "little"), blob[6]
    if not n:
        return np.zeros(0, dtype=dtype)
    planes = np.frombuffer(pa.decompress(blob[7:], decompressed_size=n * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).reshape(n)


def deltas(ordered: np.ndarray) -> np.ndarray:
    out = ordered.copy()
    out[1:] -= ordered[:-1]
    return out


def pack_sorted(ordered: np.ndarray) -> bytes:
    return pack(deltas(ordered))


def unpack_sorted(blob: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unpack(blob, dtype), dtype=dtype)
