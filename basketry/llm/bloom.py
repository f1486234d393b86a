"""A segmented Bloom filter of the hashes that may occur more than once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT_BITS = 1 << 20
PROBES = 4
#: Hashes a map task gathers before it hands them on: 4 MB.
GATHER = 500_000


def _positions(keys: np.ndarray) -> np.ndarray:
    """PROBES bit numbers within a segment for each hash, from two halves of the mixed hash."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        a, b = x >> np.uint64(44), (x & np.uint64(0xFFFFF)) | np.uint64(1)
        return ((a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(SEGMENT_BITS)).astype(np.int64)


def _segment(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys.astype(np.uint64) >> np.uint64(32)).astype(np.int64) % n


def slices(n_rows: int, max_bytes: int, bits_per_row: int = 16) -> int:
    """Into how many slices of the hash space the keys are dealt, so that the filter of one takes ``max_bytes`` at most."""
    return max(1, math.ceil(n_rows * bits_per_row / (8 * max(max_bytes, SEGMENT_BITS // 8))))


def slice_of(key: Column, n: int) -> Column:
    """The slice of a key; its hash is apart from those that pick a filter's segment and bits."""
    return F.pmod(F.xxhash64(key, F.lit(n)), F.lit(n)).cast("int")


def _bits(hashes: DataFrame, key: str, n: int, parts: int, least: int) -> list[bytes]:
    """The filter's ``n`` segments: bits that at least ``least`` of the hashes set.

    A map task hands on each hash ``least`` times at most, so copies don't pile up. A segment is built from ``parts``
    parts of its hashes, each by a task of its own; more than one part only where ``least`` is 1.
    """

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pd.DataFrame:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            if least > 1:
                keys = np.concatenate([keys, keys[counts > 1]])
            seg = _segment(keys, n) * parts + keys % parts
            order = np.argsort(seg, kind="stable")
            keys, seg = keys[order], seg[order]
            ids, starts = np.unique(seg, return_index=True)
            return pd.DataFrame({"segment": ids // parts, "part": ids % parts, "keys": [x.tobytes() for x in np.split(keys, starts[1:])]})

        for pdf in batches:
            held.append(pdf[key].to_numpy(np.int64))
            size += len(pdf)
            if size >= GATHER:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(pdf["keys"]), np.int64)
        hits = np.bincount(_positions(keys).ravel(), minlength=SEGMENT_BITS)
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "bits": [np.packbits(hits >= least).tobytes()]})

    def either(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["bits"]])
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "bits": [bits.tobytes()]})

    built = hashes.select(key).mapInPandas(gather, "segment long, part long, keys binary").groupBy("segment", "part").applyInPandas(build, "segment long, bits binary")
    if parts > 1:
        built = built.groupBy("segment").applyInPandas(either, "segment long, bits binary")
    bits = [bytes(SEGMENT_BITS // 8)] * n
    for row in built.collect():  # n rows of 128 KB: the caller's bound
        bits[row["segment"]] = bytes(row["bits"])
    return bits


def seen_twice(hashes: DataFrame, key: str, n_rows: int, bits_per_row: int = 16) -> list[bytes]:
    """Bits of filter B, one item a segment of about 65,000 hashes.

    Filter A takes every hash; a bit that a further hash sets again goes to B. A hash that occurs twice has all its
    bits in B, so none is missed. Callers bound the filter by :func:`slices`.
    """
    return _bits(hashes, key, max(1, math.ceil(n_rows * bits_per_row / SEGMENT_BITS)), 1, 2)


def members(hashes: DataFrame, key: str, max_bytes: int = 64 << 20, bits_per_row: int = 16) -> list[bytes]:
    """Filter of the hashes in a table, of at most ``max_bytes``: with more than ``max_bytes`` / 2 hashes it has fewer
    bits for each, so that more of the others pass; never does it miss one."""
    n_rows = hashes.count()
    n = min(math.ceil(n_rows * bits_per_row / SEGMENT_BITS), max_bytes * 8 // SEGMENT_BITS)
    n = max(1, n)
    return _bits(hashes, key, n, max(1, math.ceil(n_rows / n / GATHER)), 1)


def may_repeat(bits: list[bytes], key: Column, spark) -> Column:
    """True where the filter may have the hash."""
    shared, n = spark.sparkContext.broadcast(b"".join(bits)), len(bits)

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        table = np.frombuffer(shared.value, np.uint8)
        values = keys.to_numpy(np.int64)
        at = _positions(values) + (_segment(values, n) * SEGMENT_BITS)[:, None]
        return pd.Series(((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1))

    return test(key)
