"""Bloom filters over long columns: a superset test that is small enough to broadcast whatever the input.

A filter has 8 to 16 bits for each key, but MOST_BITS at most. Past MOST_BITS / 8 keys it lets more and more through, which costs
shuffled rows and nothing else: every use joins exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.hashing import mix

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26


def _positions(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.view(np.uint64))
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def build(ids: DataFrame) -> np.ndarray:
    """The filter (bytes, lowest bit first) over the one long column of ``ids``; nulls are left out."""
    size = min(max(1 << (8 * ids.count()).bit_length(), LEAST_BITS), MOST_BITS)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits = np.zeros(size, bool)
        for batch in batches:
            for at in _positions(batch.column(0).drop_null().to_numpy(), size):
                bits[at] = True
        packed = np.packbits(bits, bitorder="little").view(np.int64)
        (at,) = np.nonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], names=["at", "bits"])

    table = ids.mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    packed = np.zeros(size // 64, np.int64)
    packed[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return packed.view(np.uint8)


def member(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each int64 id: false if it certainly isn't in the filter."""
    found = np.ones(len(ids), bool)
    for at in _positions(ids, 8 * len(bits)):
        found &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found
