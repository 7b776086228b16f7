"""Bloom filters: a level is (bits, number of hashes, packed bits)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 16 MB of bits a level at most.
MAX_BITS = 1 << 27

Level = tuple[int, int, np.ndarray]


def positions(h1: np.ndarray, h2: np.ndarray, i: int, m: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h1.view(np.uint64) + np.uint64(i) * (h2.view(np.uint64) | np.uint64(1))) % np.uint64(m)


def holds(level: Level, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    m, k, bits = level
    held = np.ones(len(h1), bool)
    for i in range(k):
        at = positions(h1, h2, i, m)
        held &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return held


def n_bits(n: int, p: float) -> int:
    return max(64, math.ceil(n * math.log2(1 / p) * 1.45))


#: Bytes of one row on the way to the driver.
BLOCK = 2048


def build(keys: DataFrame, m: int, k: int) -> Level:
    """Bits of all rows' (h1, h2): every task sends the blocks in which it has set bits, tasks by
    block unite them, and at most m / 8 / BLOCK blocks reach the driver."""
    size = -(-m // 8 // BLOCK) * BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for b in batches:
            h1, h2 = (np.asarray(b.column(i)) for i in (0, 1))
            for i in range(k):
                at = positions(h1, h2, i, m)
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        blocks = bits.reshape(-1, BLOCK)
        yield sent((int(i), blocks[i].tobytes()) for i in np.flatnonzero(blocks.any(axis=1)))

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits, out = None, np.zeros(BLOCK, np.uint8), []
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i != at:
                    if at is not None:
                        out.append((at, bits.tobytes()))
                    at, bits = i, np.zeros(BLOCK, np.uint8)
                bits |= np.frombuffer(v, np.uint8)
        if at is not None:
            out.append((at, bits.tobytes()))
        yield sent(out)

    def sent(rows) -> pa.RecordBatch:
        rows = list(rows)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["b", "v"])

    bits = np.zeros(size, np.uint8)
    rows = keys.select("h1", "h2").mapInArrow(run, "b long, v binary")
    for r in rows.repartition("b").sortWithinPartitions("b").mapInArrow(united, "b long, v binary").collect():
        bits[r["b"] * BLOCK : (r["b"] + 1) * BLOCK] = np.frombuffer(r["v"], np.uint8)
    return m, k, bits[: -(-m // 8)]


def of_pairs(rows: DataFrame, h1: str, h2: str, p: float = 1 / 64) -> Level:
    """A filter of two hash columns, of at most MAX_BITS whatever the number of rows: beyond, it
    holds more than it should, never less."""
    n = rows.count()
    m = min(MAX_BITS, n_bits(n, p))
    k = max(1, min(round(math.log2(1 / p)), round(0.69 * m / max(1, n))))
    return build(rows.select(F.col(h1).alias("h1"), F.col(h2).alias("h2")), m, k)


def of_longs(rows: DataFrame, name: str, p: float = 1 / 64) -> Level:
    """The same of one column of hashes."""
    return of_pairs(rows.withColumn("__0", F.lit(0).cast("long")), name, "__0", p)


def holds_longs(level: Level, values: np.ndarray) -> np.ndarray:
    return holds(level, values, np.zeros(len(values), np.int64))
