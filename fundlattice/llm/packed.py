"""Sorted 64-bit keys and small numbers as bytes that compress well, dealt to buckets of the hash space."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers by planes of bytes, so that equal high bytes lie together."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(raw: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, each as its distance from the one before."""
    return pack(np.diff(keys, prepend=_U(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def cuts(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of the buckets of sorted keys, by their leading bits."""
    bucket = (keys >> _U(64 - bits)).astype(np.int64)
    edges = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(keys)] if len(keys) else np.zeros(1, np.int64)
    return [(int(bucket[a]), a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def bucket_bits(size: int, bucket_bytes: int, least: int) -> int:
    """Leading bits of a key that name its bucket, for `size` bytes of input: buckets don't grow with the input."""
    return max(1, (max(least, size // bucket_bytes) - 1).bit_length())


def planned_bytes(df: DataFrame, text_col: str) -> int:
    """The size of df as its plan knows it, without a job; where it doesn't, the bytes of its texts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 2**60 else df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
