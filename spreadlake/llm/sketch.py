"""Count-min sketches of keys too many to shuffle: built per task, merged by ranges of cells.

A task hashes its keys into ``depth`` rows of ``2**bits`` cells and sends the cells it met with
their counts, cut into ranges. Ranges are added up where they meet, saturating, and only whether a
cell reached a threshold is kept: one bit per cell and threshold, so the merged sketch has a size
that its parameters fix and may be broadcast. An estimate is never below the true count.

A sketch that must grow with the keys is not broadcast: parcels of keys ask the shards of the cells
(``asked``), a shard adds up and answers every parcel with bits in the order of its cells
(``counted``), and the parcel reads them off (``answered``).
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from spreadlake.llm.common import partitions

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Multipliers that spread a key over the cells of a row.
_ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

#: Keys a task gathers before it sends them on.
_FLUSH = 1 << 21

#: Columns of what parcels ask and shards answer, and the most cells of a shard as a power of two.
QUESTION, ANSWER = "shard bigint, _parcel bigint, cells binary, times binary", "_parcel bigint, shard bigint, reached array<binary>"
SHARD_BITS = 25


def bits_for(keys: float, least: int = 16, most: int = 29) -> int:
    """Cells as a power of two, at least as many as ``keys``."""
    return min(most, max(least, math.ceil(math.log2(max(keys, 1)))))


def cells_of(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (keys * np.uint64(_ROWS[row])) >> np.uint64(64 - bits)


def _planes(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte in planes: the high planes are zeros, which compress."""
    return np.diff(values.astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    diff = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(diff, dtype=np.uint32)


class Reached:
    """Which cells of the merged sketch reached the threshold."""

    def __init__(self, rows: list[np.ndarray], bits: int):
        self.rows, self.bits = rows, bits

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Whether the estimate of each key reaches the threshold: every row must say so."""
        out = np.ones(len(keys), bool)
        for r, packed in enumerate(self.rows):
            cell = cells_of(keys, r, self.bits)
            out &= (packed[cell >> np.uint64(3)] >> (7 - (cell & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
        return out


def _shard_bits(bits: int) -> int:
    """Cells of a shard as a power of two; there are 16 shards at least."""
    return min(SHARD_BITS, bits - 4)


def _by_shard(cells: np.ndarray, bits: int):
    """(shard, first, end) of sorted cells."""
    shard = cells >> np.uint64(_shard_bits(bits))
    first = np.flatnonzero(np.diff(shard, prepend=~shard[:1]))
    return zip(shard[first].tolist(), first.tolist(), [*first[1:].tolist(), len(cells)]) if len(cells) else iter(())


def asked(parcel: int, keys: np.ndarray, bits: int) -> pa.Table:
    """The distinct cells of a parcel's keys with their counts, one row for each shard met."""
    cells, times = np.unique(cells_of(keys, 0, bits), return_counts=True)
    times = np.minimum(times, 255).astype(np.uint8)
    inside = cells & np.uint64((1 << _shard_bits(bits)) - 1)
    rows = [(shard, parcel, _planes(inside[a:b]), times[a:b].tobytes()) for shard, a, b in _by_shard(cells, bits)]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    columns = zip(*rows) if rows else [[]] * 4
    return pa.table([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], ["shard", "_parcel", "cells", "times"])


def counted(group: pa.Table, bits: int, thresholds: tuple[int, ...]) -> pa.Table:
    """A shard's answer to each parcel: for every threshold one bit per cell asked for."""
    total = np.zeros(1 << _shard_bits(bits), np.uint8)
    cells = [_from_planes(x) for x in group["cells"].to_pylist()]
    for at, times in zip(cells, group["times"].to_pylist()):
        total[at] = np.minimum(total[at].astype(np.uint16) + np.frombuffer(times, np.uint8), 255)
    reached = [[np.packbits(total[at] >= t).tobytes() for t in thresholds] for at in cells]
    return pa.table([group["_parcel"], group["shard"], pa.array(reached, pa.list_(pa.binary()))], ["_parcel", "shard", "reached"])


def answered(answers: pa.Table, keys: np.ndarray, bits: int, thresholds: int) -> list[np.ndarray]:
    """For each threshold, which of a parcel's keys reach it; ``keys`` are those it asked for, in any order."""
    cells, place = np.unique(cells_of(keys, 0, bits), return_inverse=True)
    said = dict(zip(answers["shard"].to_pylist(), answers["reached"].to_pylist()))
    out = [np.zeros(len(cells), bool) for _ in range(thresholds)]
    for shard, a, b in _by_shard(cells, bits):
        for t, raw in enumerate(said[shard]):
            out[t][a:b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=b - a)
    return [x[place] for x in out]


def count_min(
    df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, depth: int, thresholds: tuple[int, ...]
) -> list[list[np.ndarray]]:
    """For each threshold, the rows of packed bits that ``Reached`` reads.

    ``keys_of`` gives the 64-bit keys of a batch; a key counts as often as it is given. Counts
    saturate at 255, so thresholds lie between 1 and 255.
    """
    n = partitions(df.sparkSession)
    shard_bits = min(bits - 3, max(4, math.ceil(math.log2(4 * n))))
    width = 1 << (bits - shard_bits)

    def send(keys: np.ndarray):
        for r in range(depth):
            cells, times = np.unique(cells_of(keys, r, bits), return_counts=True)
            times = np.minimum(times, 255).astype(np.uint8)
            edges = np.searchsorted(cells, np.arange((1 << shard_bits) + 1, dtype=np.uint64) * np.uint64(width))
            met = np.flatnonzero(np.diff(edges))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((r << shard_bits) + met, pa.int64()),
                    pa.array([_planes(cells[edges[s] : edges[s + 1]] - np.uint64(s * width)) for s in met], pa.binary()),
                    pa.array([times[edges[s] : edges[s + 1]].tobytes() for s in met], pa.binary()),
                ],
                ["shard", "cells", "times"],
            )

    def part(batches):
        held, size = [], 0
        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                size += len(keys)
                if size >= _FLUSH:
                    yield from send(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield from send(np.concatenate(held))

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, cells, times in zip(*(c.to_pylist() for c in batch.columns)):
                total = sums.setdefault(shard, np.zeros(width, np.uint8))
                at = _from_planes(cells)
                total[at] = np.minimum(total[at].astype(np.uint16) + np.frombuffer(times, np.uint8), 255)
        for shard, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.array([[np.packbits(total >= t).tobytes() for t in thresholds]], pa.list_(pa.binary()))],
                ["shard", "reached"],
            )

    parts = df.mapInArrow(part, "shard bigint, cells binary, times binary")
    merged = parts.repartition(n, "shard").mapInArrow(merge, "shard bigint, reached array<binary>")
    out = [[np.zeros(1 << (bits - 3), np.uint8) for _ in range(depth)] for _ in thresholds]
    for shard, reached in merged.toLocalIterator():
        r, s = divmod(shard, 1 << shard_bits)
        for t, raw in enumerate(reached):
            out[t][r][s * width // 8 : (s + 1) * width // 8] = np.frombuffer(raw, np.uint8)
    return out
