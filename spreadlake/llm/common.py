"""What the corpus operators share: tables, stored frames, words as hashes.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``. Tasks that only need to
compare words hash all words of an Arrow batch at once with numpy: every byte is looked up in a
fixed table of random 64-bit numbers, weighted by a power of an odd number and summed per word
modulo 2**64, so that no Python object is made per word.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spreadlake.session import shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes hashed in one go; bounds the memory a long text needs.
CHUNK_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lets a finished write drop the shuffle files it was made from.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the cut in lineage that outlives executors.

    The shuffles behind it go with the write: nothing reads them again, and kept until the driver
    happens to collect its garbage they would fill the disks. Rows that differ in ``folders`` lie
    apart, so that a filter on these columns reads its own only.
    """
    path, conf = shared_dir(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        write = df.write.mode("overwrite")
        (write.partitionBy(*folders) if folders else write).parquet(path)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    return read.select(*df.columns) if folders else read


def forget(df: DataFrame, but: str = "") -> None:
    """Delete a stored frame that nothing reads any more; files whose path holds ``but`` stay."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if not but or but not in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id's decimal text modulo ``mod``: the fold that the contracts name."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % mod


def total_chars(docs: DataFrame, text: str) -> int:
    """Characters of all texts; one aggregate that stays in the JVM."""
    return int(docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0])


def buckets_for(spark: SparkSession, chars: int, each: int = 24_000_000) -> int:
    """How many buckets keep ``each`` characters per bucket, at least one per shuffle partition."""
    return max(partitions(spark), math.ceil(chars / each))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; in place where it can."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done, step = 1, base & _MASK
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step & _MASK
    return out[:n]


class WordHasher:
    """64-bit hashes of all words of a column of texts."""

    def __init__(self, lower: bool = False, salt: int = 7, endings: bool = False):
        self.endings = endings
        self.values = np.random.default_rng(salt).integers(1, 1 << 64, 256, dtype=np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.values[self.space] = 0
        if lower:
            self.values[65:91] = self.values[97:123]
        self.up = self.down = np.empty(0, np.uint64)

    def _room(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = powers(_ODD, n), powers(pow(_ODD, -1, 1 << 64), n)

    def _chunk(self, b: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, first bytes and endings of the words of ``b``; a new text begins at each of ``breaks``."""
        self._room(len(b))
        sep = self.space[b]
        start = ~sep
        start[1:] &= sep[:-1]
        inner = breaks[(breaks > 0) & (breaks < len(b))]
        start[inner] = ~sep[inner]
        at = np.flatnonzero(start)
        if not len(at):
            return np.empty(0, np.uint64), at, at
        sums = np.add.reduceat(self.values[b] * self.up[: len(b)], at)
        hashes = mix(sums * self.down[at])
        if not self.endings:
            return hashes, at, at[:0]
        stop = ~sep
        stop[:-1] &= sep[1:]
        stop[inner - 1] = ~sep[inner - 1]
        last = np.flatnonzero(stop)
        low = np.arange(256)
        low[65:91] += 32
        before = np.where(last > at, low[b[np.maximum(last - 1, 0)]], 0)
        return hashes, at, low[b[last]] * 256 + before

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in order, number of words of each text); null has none.

        With ``endings`` the last two bytes of each word are left in ``self.ended``.
        """
        data, off = utf8(column)
        hashes, ended, counts = [], [], np.zeros(len(off) - 1, np.int64)
        doc, pos, end = 0, int(off[0]), int(off[-1])
        while pos < end:
            stop = min(end, pos + CHUNK_BYTES)
            if stop < end:
                whole = int(off[np.searchsorted(off, stop, "right") - 1])
                stop = whole if whole > pos else self._cut(data, pos, stop, int(off[np.searchsorted(off, pos, "right")]))
            first = int(np.searchsorted(off, pos, "right")) - 1
            last = int(np.searchsorted(off, stop, "left"))
            edges = np.clip(off[first : last + 1] - pos, 0, stop - pos)
            h, at, tail = self._chunk(data[pos:stop], edges)
            hashes.append(h)
            ended.append(tail)
            counts[first:last] += np.diff(np.searchsorted(at, edges))
            pos = stop
        self.ended = np.concatenate(ended) if ended else np.empty(0, np.int64)
        return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts

    def _cut(self, data: np.ndarray, pos: int, stop: int, end: int) -> int:
        """Where a text longer than a chunk can be cut: behind the last space, else at the next one."""
        back = np.flatnonzero(self.space[data[pos:stop]])
        if len(back):
            return pos + int(back[-1]) + 1
        while stop < end:
            ahead = np.flatnonzero(self.space[data[stop : stop + CHUNK_BYTES]])
            if len(ahead):
                return min(end, stop + int(ahead[0]) + 1)
            stop += CHUNK_BYTES
        return end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, off


def runs(hashes: np.ndarray, counts: np.ndarray, width: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` consecutive words of one text, and how many each text has."""
    n = np.maximum(counts - width + 1, 0)
    if len(hashes) < width:
        return np.empty(0, np.uint64), n
    rng = np.random.default_rng(salt)
    weights = rng.integers(0, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = len(hashes) - width + 1
    out = np.zeros(total, np.uint64)
    for i in range(width):
        out += hashes[i : i + total] * weights[i]
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    keep = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return mix(out[keep]), n


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of one slice hold about ``limit`` bytes; a longer text is alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to

