"""Shared ground of the training-data operators: shared-folder checkpoints, row keys, and byte kernels.

The byte kernels work on the UTF-8 buffer of an Arrow string column as numpy arrays, a few megabytes
at a time, so no Python object is made per document or per word.
"""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one kernel call works on; a longer document is worked on alone, whole.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a local one is made only where none is named."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = os.environ.setdefault("CITEFLOW_LOCAL_CHECKPOINTS", tempfile.mkdtemp(prefix="citeflow-"))
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that a lost executor costs no recomputation of what led to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(*cols: str) -> Column:
    """64-bit key of a row that is defined for nulls too; rows equal in these columns share it."""
    return F.xxhash64(*cols)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like _citeflow_name that df does not have, in any case."""
    held, found = {c.lower() for c in df.columns}, f"_citeflow_{name}"
    while found.lower() in held:
        found += "_"
    return found


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def trim() -> None:
    """Gives back what a worker no longer holds: workers stay, and allocators keep what large kernels freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# ---------------------------------------------------------------- byte kernels

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 12, 13, 32]] = True
NOT_SPACE = ~SPACE
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_M = np.uint64(0x9E3779B97F4A7C15)
_M_INV = np.uint64(pow(int(_M), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _M and of its inverse; the process keeps the last, in a place that pickled functions do not carry along."""
    held = sys.modules.setdefault("_citeflow_powers", types.ModuleType("_citeflow_powers"))
    if getattr(held, "size", 0) < size:
        up, down = np.full(size, _M), np.full(size, _M_INV)
        up[0] = down[0] = 1
        held.up, held.down, held.size = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64), size
    return held.up, held.down


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; another salt gives an independent hash."""
    x = x ^ np.uint64((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if offs is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offs, np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(col: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows of about size bytes."""
    data, at = buffers(col)
    row, n = 0, len(at) - 1
    while row < n:
        end = min(n, row + 4000, max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1))
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that stay inside a row."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[at] = True
    before = np.empty(len(mask), bool)
    before[0], before[1:] = False, mask[:-1]
    start = mask & (~before | edge[:-1])
    after = np.empty(len(mask), bool)
    after[-1], after[:-1] = False, mask[1:]
    return np.flatnonzero(start), np.flatnonzero(mask & (~after | edge[1:])) + 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run [start, end)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = max(CHUNK_BYTES, 1 << int(len(data)).bit_length()) + 1
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start], 1)


def hash_of(word: str) -> int:
    """What word_hashes gives for this one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def words(data: np.ndarray, at: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the number of words) of the runs of bytes in lut."""
    start, end = runs(lut[data], at)
    return start, end, np.searchsorted(start, at).astype(np.int64)
