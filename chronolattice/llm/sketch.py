"""Count-min sketches of 64-bit names, made in partitions and merged slice by slice.

A cell's counter saturates; estimates are never below the true count (up to the ceiling). The size is fixed
by ``bits`` (2**bits cells), so what is broadcast does not grow with the data: more data make the estimates
coarser, never wrong on the low side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronolattice.llm.cluster import partitions, written

#: Many, so that however many tasks merge them, each is dealt few and reads little.
SLICES = 4096


def cells(name: np.ndarray, bits: int) -> np.ndarray:
    return (name >> np.uint64(64 - bits)).astype(np.uint32)


def parts(found: np.ndarray, bits: int) -> pa.RecordBatch | None:
    """A batch's cell numbers as one row for each slice that has any: the low parts, sorted."""
    if not len(found):
        return None
    found = np.sort(found)
    shift = bits - SLICES.bit_length() + 1
    edge = np.searchsorted(found, np.arange(SLICES + 1, dtype=np.uint64) << np.uint64(shift))
    low = (found & np.uint32((1 << shift) - 1)).astype(np.uint32)
    some = np.flatnonzero(np.diff(edge))
    ends = (np.concatenate((edge[some], edge[-1:])) * 4).astype(np.int32)
    lists = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(low.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), lists], ["slice", "cells"])


def merge(rows: DataFrame, bits: int, most: int) -> DataFrame:
    """(slice, counts): the counters of a slice, one byte each up to 255, or packed four to a byte if ``most`` is 3.

    Each task streams over the sorted slices it was dealt, so it holds one slice's counters at a time."""
    width = (1 << bits) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def out() -> pa.RecordBatch:
            c = total.astype(np.uint8)
            if most == 3:
                c = c.reshape(-1, 4)
                c = c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([c.tobytes()], pa.binary())], ["slice", "counts"])

        for batch in batches:
            for s, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                if s != now:
                    if now is not None:
                        yield out()
                    now, total = s, np.zeros(width, np.uint16)
                low = np.frombuffer(b.as_buffer(), np.uint32)
                one, n = np.unique(low, return_counts=True)
                total[one] = np.minimum(total[one] + np.minimum(n, most).astype(np.uint16), most)
        if now is not None:
            yield out()

    return rows.repartition(min(SLICES, partitions(rows.sparkSession)), "slice").sortWithinPartitions("slice").mapInArrow(run, "slice int, counts binary")


def table(merged: DataFrame, bits: int, most: int) -> bytes:
    """The whole sketch on the driver: 2**bits bytes, or a quarter of it, whatever the data. It is written first, so that all
    slices merge at once and not one partition after another."""
    per = (1 << bits) // SLICES // (4 if most == 3 else 1)
    out = bytearray(per * SLICES)
    for r in written(merged, "sketch").toLocalIterator():
        out[r["slice"] * per : (r["slice"] + 1) * per] = bytes(r["counts"])
    return bytes(out)


def reader(sketch: bytes, bits: int, most: int) -> Callable[[np.ndarray], np.ndarray]:
    """Estimates of names from the merged sketch."""
    t = np.frombuffer(sketch, np.uint8)
    if most == 3:
        def estimate(name: np.ndarray) -> np.ndarray:
            c = cells(name, bits)
            return t[c >> np.uint32(2)] >> ((c & np.uint32(3)) << np.uint32(1)).astype(np.uint8) & np.uint8(3)
    else:
        def estimate(name: np.ndarray) -> np.ndarray:
            return t[cells(name, bits)]
    return estimate
