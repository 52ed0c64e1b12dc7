"""Shared folder, materialised steps and array views of Arrow text columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space of the word contracts: blank and the bytes 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir of the session.

    Only where the session names none and runs in one process (tests) is a temporary folder set; on a cluster that raises,
    as executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts lineage with a written table, so a lost executor costs the re-run of the tasks of one step.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What empties the memories that a worker keeps between tasks.
FORGET: list[Callable[[], None]] = []


def lean_memory() -> None:
    """Have the allocator of this worker hand freed arrays back at once: workers share the memory of their executor.

    A worker that other tasks used before gives up what those kept.
    """
    for empty in FORGET:
        empty()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column in one array, and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[: n + 1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each span; depends on the bytes of the span alone."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data))[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * _powers(_INVERSE, len(data))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word of every text, the text it belongs to, and its start byte.

    A word is a run of bytes other than 0x20 and 0x09-0x0D; lower maps A-Z to a-z first. Multi-byte characters hold
    no such byte, so words in bytes are words in characters.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    starts = np.flatnonzero(begins)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:-1]
    ends = np.flatnonzero(last) + 1
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return span_hashes(data, starts, ends), owner, starts


_MULT = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingles(h: np.ndarray, owner: np.ndarray, n_texts: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of size words of each text, sorted by text and hash; and the text of each.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    counts = np.bincount(owner, minlength=n_texts)
    out_h, out_o = [], []
    if len(h) >= size:
        s = np.zeros(len(h) - size + 1, np.uint64)
        for j in range(size):
            s = (s + h[j : len(h) - size + 1 + j]) * _MULT[j % len(_MULT)]
            s ^= s >> np.uint64(29)
        whole = owner[: len(s)] == owner[size - 1 :]
        out_h.append(mix(s[whole]))
        out_o.append(owner[: len(s)][whole])
    ends = np.cumsum(counts)
    for t in np.flatnonzero((counts > 0) & (counts < size)):
        acc = np.uint64(counts[t])
        with np.errstate(over="ignore"):
            for x in h[ends[t] - counts[t] : ends[t]]:
                acc = (acc + x) * _MULT[0]
                acc ^= acc >> np.uint64(31)
        out_h.append(mix(np.array([acc], np.uint64)))
        out_o.append(np.array([t]))
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hs, os_ = np.concatenate(out_h), np.concatenate(out_o)
    order = np.lexsort((hs, os_))
    hs, os_ = hs[order], os_[order]
    keep = np.ones(len(hs), bool)
    keep[1:] = (hs[1:] != hs[:-1]) | (os_[1:] != os_[:-1])
    return hs[keep], os_[keep]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = 1 << 20):
    """Row slices of an Arrow batch with about ``limit`` bytes of text each, so that work arrays stay small.

    Texts are whole: a text longer than the limit has a slice of its own. Yields (batch slice, bytes, offsets).
    """
    if not batch.num_rows:
        return
    data, off = text_bytes(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def long_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (null: 0) and null mask of an integer column."""
    column = column.cast(pa.int64())
    mask = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False), mask
