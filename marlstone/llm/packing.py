"""Packing of token ids into rows of one length by best fit decreasing.

Each scan task packs its own documents in groups of bounded size, so nothing is shuffled and no task holds more than a
group; which documents share a row therefore depends on how the input is split. Overlong documents are split into pieces of whole rows and a rest; pieces are placed from the longest to the
shortest into the open row with the least room that is enough, which a segment tree over capacities finds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe import load_ranks
from .common import FORGET, long_column, text_bytes

#: Tokens of a group of documents that are packed together.
GROUP = 8 << 20
SCHEMA = "pack_id long, n_tokens long, doc_ids array<long>, doc_offsets array<long>, cu_seqlens array<int>, ids binary, positions binary"


class Capacities:
    """Open rows by free room: a segment tree over 0..size tells the least room of at least n that some row has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _mark(self, room: int, value: int) -> None:
        i = room + self.leaves
        self.some[i] = value
        while i > 1:
            i >>= 1
            now = self.some[2 * i] | self.some[2 * i + 1]
            if self.some[i] == now:
                return
            self.some[i] = now

    def add(self, room: int, row: int) -> None:
        if not self.rows[room]:
            self._mark(room, 1)
        self.rows[room].append(row)

    def take(self, least: int) -> tuple[int, int] | None:
        """Room and row of the tightest row with at least this room, which is then out of the tree."""
        i = least + self.leaves
        if not self.some[i]:
            # up until a right neighbour has a row, then down its left side
            while i > 1 and (i & 1 or not self.some[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        room = i - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self._mark(room, 0)
        return room, row


def best_fit_decreasing(sizes: np.ndarray, length: int) -> np.ndarray:
    """Row of each piece (1 <= size <= length); ties keep the order of the input."""
    place = np.zeros(len(sizes), np.int64)
    open_, n = Capacities(length), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = open_.take(size)
        room, row = found if found else (length, n)
        n += found is None
        place[i] = row
        if room > size:
            open_.add(room - size, row)
    return place


def byte_ids(data: np.ndarray) -> np.ndarray:
    """Ids of a text in UTF-8: its bytes."""
    return data.astype(np.uint16)


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def token_ids(path: str, pattern: str) -> Callable[[np.ndarray], np.ndarray]:
    """Ids of a text by the ranks of a tokenizer's file, for pack(); special tokens are text."""

    def ids(data: np.ndarray) -> np.ndarray:
        return np.array(_encoding(path, pattern).encode_ordinary(data.tobytes().decode()), np.uint16)

    return ids


def pack(docs: DataFrame, length: int = 2048, end_id: int = 256, pad_id: int = 257, ids: Callable[[np.ndarray], np.ndarray] = byte_ids, text: str = "text", key: str = "doc_id", group: int = GROUP) -> DataFrame:
    """Packed rows: pack_id, n_tokens, doc_ids, doc_offsets, cu_seqlens, ids, positions.

    ids and positions are binary rows of ``length`` little-endian uint16 (the matrices); cu_seqlens are the cumulative
    segment lengths, from 0; positions restart at 0 in each segment and are 0 in the padding. Segment i holds the
    tokens from doc_offsets[i] on of document doc_ids[i]; each document ends with end_id, so an empty or null text is
    one token and every row of docs can be rebuilt. Null keys are null in doc_ids; repeated rows are packed as often.
    pack_id is unique. Other columns are not read; an empty table gives no rows.
    """
    if not 0 < length < 1 << 16:
        raise ValueError("length must be from 1 to 65535")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            keys, null = long_column(batch.column(0))
            data, off = text_bytes(batch.column(1))
            for i in range(batch.num_rows):
                tokens = ids(data[off[i] : off[i + 1]])
                held.append((None if null[i] else int(keys[i]), tokens))
                size += len(tokens) + 1
                if size >= group:
                    for out in _pack(held, length, end_id, pad_id, number):
                        number += out.num_rows
                        yield out
                    held, size = [], 0
        for out in _pack(held, length, end_id, pad_id, number):
            yield out

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, SCHEMA)


def _pack(held: list, length: int, end_id: int, pad_id: int, number: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    stream = np.concatenate([np.r_[t, np.array([end_id])].astype(np.uint16) for _, t in held])
    sizes = np.array([len(t) + 1 for _, t in held])
    first = np.cumsum(sizes) - sizes
    n_pieces = -(-sizes // length)
    of = np.repeat(np.arange(len(held)), n_pieces)
    offset = (np.arange(len(of)) - (np.cumsum(n_pieces) - n_pieces)[of]) * length
    piece = np.minimum(sizes[of] - offset, length)
    row = best_fit_decreasing(piece, length)
    order = np.lexsort((offset, of, row))
    of, offset, piece, row = of[order], offset[order], piece[order], row[order]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    stops = np.r_[starts[1:], len(row)]
    for lo in range(0, len(starts), 1024):
        out: list[list] = [[] for _ in range(7)]
        for a, b in zip(starts[lo : lo + 1024], stops[lo : lo + 1024], strict=True):
            ids, positions = np.full(length, pad_id, np.uint16), np.zeros(length, np.uint16)
            cu = np.r_[0, np.cumsum(piece[a:b])]
            for k in range(a, b):
                src, n, to = first[of[k]] + offset[k], piece[k], cu[k - a]
                ids[to : to + n] = stream[src : src + n]
                positions[to : to + n] = np.arange(n)
            values = number + row[a], int(cu[-1]), [held[i][0] for i in of[a:b]], offset[a:b].tolist(), cu.tolist(), ids.astype("<u2").tobytes(), positions.astype("<u2").tobytes()
            for column, value in zip(out, values, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["pack_id", "n_tokens", "doc_ids", "doc_offsets", "cu_seqlens", "ids", "positions"])


FORGET.append(_encoding.cache_clear)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write packed rows to Parquet files under path; the ids and positions of a file are its matrices, in order of pack_id."""
    packed.write.mode("error").parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """Packed rows that write_matrices wrote."""
    return spark.read.schema(SCHEMA).parquet(path)


def matrix(rows: list[bytes], length: int = 2048) -> np.ndarray:
    """Matrix of the ids or positions of packed rows."""
    return np.stack([np.frombuffer(x, "<u2", length) for x in rows]) if rows else np.zeros((0, length), np.uint16)
