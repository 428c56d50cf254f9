"""What the training-data operators share: Arrow text buffers, word hashes, worker set-up and cuts of lineage.

Texts are taken as UTF-8 bytes straight from Arrow's buffers and handled a few
megabytes at a time, whatever the batch size, so a task's memory does not depend
on how long its documents are, beyond its longest single document.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 20
#: Longest word that is hashed with all others at once.
LONG_SPAN = 64
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MASK = (1 << 64) - 1
#: Word bytes are ASCII letters (lowered), digits and all of a multi-byte character; any other byte separates words.
WORD_BYTE = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        WORD_BYTE[_b] = ord(chr(_b).lower()) if _b < 128 else _b


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver found it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    # Rows of whole texts: the default of 10,000 to a batch would hold tens of megabytes of them several times over.
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local session gets one of its own, removed at its end; a cluster, whose machines could not read it, an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir", "") and context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, folder: str) -> DataFrame:
    """The same rows, written to the folder as Parquet and read again; plans take their size from the files."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free(taken: Iterable[str], name: str) -> str:
    """The name, or one like it that none of those taken is, in any letter case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row is an empty one."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null("" if "string" in str(array.type) else b"")
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes each; a longer row stands alone."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
    inverse = pow(int(_BASE), -1, 1 << 64)
    for out, base in ((up, int(_BASE)), (down, inverse)):
        out[0], done, step = 1, 1, base
        while done < size:
            more = min(done, size - done)
            with np.errstate(over="ignore"):
                out[done : done + more] = out[:more] * np.uint64(step)
            step, done = step * step & _MASK, done + more
    return up, down


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    return _powers(max(CHUNK_BYTES + 1, 1 << max(1, size - 1).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j]-P[i] = the polynomial hash of values[i:j] times base^i."""
    up, _ = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return total


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and the rows' offsets into these; off starts at 0."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(off), np.int64)
    low = WORD_BYTE[raw]
    inside = low != 0
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < len(raw)]] = False
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return span_hashes(low, starts, ends), starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span: eight at a time, each step mixed; spans of more than LONG_SPAN bytes by xxHash."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    some = np.flatnonzero(size <= LONG_SPAN)
    at, left = starts[some], size[some]
    eight = np.ndarray((len(data) + 1,), np.uint64, padded, strides=(1,)) if len(data) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        while len(some):
            piece = eight[at]
            short = left < 8
            piece[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            out[some] = mix(out[some] * np.uint64(0xD6E8FEB86659FD93) + piece)
            more = left > 8
            some, at, left = some[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_SPAN):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of each range, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, sizes)


class Places:
    """Where 64-bit keys stand in an array: sorted by a mixed form, with the first place of each leading bit pattern."""

    def __init__(self, keys: np.ndarray):
        mixed = mix(keys.astype(np.uint64))
        self.order = np.argsort(mixed).astype(np.int32)
        self.mixed = mixed[self.order]
        self.bits = max(1, min(22, int(len(keys)).bit_length()))
        self.first = np.searchsorted(self.mixed >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among those given, -1 for the others."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.mixed):
            return out
        mixed = mix(keys.astype(np.uint64))
        bucket = (mixed >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        same = self.mixed[np.minimum(at, len(self.mixed) - 1)] == mixed
        hit = same & (at < end)
        out[hit] = self.order[at[hit]]
        left = np.flatnonzero(~hit & (at + 1 < end))
        at, end, mixed = at[left] + 1, end[left], mixed[left]
        while len(left):
            hit = self.mixed[at] == mixed
            out[left[hit]] = self.order[at[hit]]
            more = ~hit & (at + 1 < end)
            left, at, end, mixed = left[more], at[more] + 1, end[more], mixed[more]
        return out
