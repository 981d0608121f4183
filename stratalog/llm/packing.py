"""Integer arrays as compressed bytes, for rows that carry a sorted piece of a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ZSTD = pa.Codec("zstd", compression_level=1)


def squeeze(x: np.ndarray) -> bytes:
    """Integers compressed by byte planes, after the sizes of both forms."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    data = _ZSTD.compress(planes, asbytes=True)
    return np.array([len(planes), len(data)], "<i8").tobytes() + data


def expand(data: bytes, kind: str, *, more: bool = False):
    """The integers; with `more` also the bytes that follow."""
    size, length = np.frombuffer(data[:16], "<i8").tolist()
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(_ZSTD.decompress(data[16 : 16 + length], decompressed_size=size, asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    out = np.ascontiguousarray(planes.reshape(width, size // width).T).reshape(-1).view(kind)
    return (out, data[16 + length :]) if more else out


def rises(sorted_: np.ndarray) -> bytes:
    """Sorted integers by their differences."""
    return squeeze(np.diff(sorted_, prepend=0).astype("<i8"))


def falls(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, "<i8"))
