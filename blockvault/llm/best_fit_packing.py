"""Best-fit-decreasing packing of token ids, and the arrays that training reads.

A task packs its documents in shards of bounded size, without a shuffle.  Documents longer than a window are
split into whole windows and a rest, without loss.  The pieces of a shard go from the longest to the shortest
into the open window with the least room that suffices, which a segment tree over capacities finds: it holds,
for each capacity, how many windows have that room, and the least capacity of at least the piece's length is
found in a logarithmic number of steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import small_batches

#: A shard is closed when it holds so many tokens.
SHARD_TOKENS = 2_000_000


class Rooms:
    """Windows by the room that is left in them: a segment tree over 0..width of the numbers of windows."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, room: int, by: int) -> None:
        k = self.size + room
        while k:
            self.count[k] += by
            k >>= 1

    def push(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def pop(self, least: int) -> tuple[int, int] | None:
        """Takes out a window with the least room that is at least ``least``; gives its room and number."""
        k = self.size + least
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.size
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit(lengths: Sequence[int], width: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length), for documents of the given lengths (at least 1)."""
    windows: list[list[tuple[int, int, int]]] = []
    pieces: list[tuple[int, int, int]] = []
    for k, n in enumerate(lengths):
        whole = n - n % width
        windows += [[(k, at, width)] for at in range(0, whole, width)]
        if n > whole:
            pieces.append((k, whole, n - whole))
    rooms = Rooms(width)
    for piece in sorted(pieces, key=lambda p: -p[2]):
        if found := rooms.pop(piece[2]):
            room, window = found
        else:
            room, window = width, len(windows)
            windows.append([])
        windows[window].append(piece)
        if room > piece[2]:
            rooms.push(room - piece[2], window)
    return windows


def pack_best_fit(df: DataFrame, vocabulary: str, width: int = 4096, end_id: int = 2, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per window: sequence_id, doc_ids, starts, cu_seqlens (cumulative segment lengths from 0), n_tokens,
    input_ids (binary: ``width`` little-endian unsigned 32-bit ids, padded with ``pad_id``) and position_ids
    (binary: as many positions, which begin at 0 in each segment; 0 in the padding).

    A document's ids end with ``end_id``, so that a null or empty text is one id.  Rows that repeat an id are
    documents of their own; an empty table gives no windows; other columns are not read.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = T.StructType(
        [
            T.StructField("sequence_id", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(rows.schema["_id"].dataType)),
            *T.StructType.fromDDL("starts array<long>, cu_seqlens array<int>, n_tokens int, input_ids binary, position_ids binary").fields,
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        v = bpe.load(vocabulary)
        number = TaskContext.get().partitionId() << 40
        ids: list = []
        docs: list[np.ndarray] = []
        tokens = 0

        def shard() -> Iterator[pa.RecordBatch]:
            nonlocal number
            windows = best_fit([len(x) for x in docs], width)
            for k in range(0, len(windows), 256):
                columns: list[list] = [[] for _ in arrow]
                for window in windows[k : k + 256]:
                    lengths = [n for _, _, n in window]
                    total = sum(lengths)
                    matrix = np.full(width, pad_id, "<u4")
                    matrix[:total] = np.concatenate([docs[d][at : at + n] for d, at, n in window])
                    places = np.zeros(width, "<u4")
                    places[:total] = np.concatenate([np.arange(n) for n in lengths])
                    row = (number, [ids[d] for d, _, _ in window], [at for _, at, _ in window], [0, *np.cumsum(lengths).tolist()], total, matrix.tobytes(), places.tobytes())
                    for column, x in zip(columns, row, strict=True):
                        column.append(x)
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            found, limits = v.encode_column(batch.column(1), end_id)
            for doc, a, b in zip(batch.column(0).to_pylist(), limits, limits[1:], strict=False):
                ids.append(doc)
                docs.append(found[a:b])
                tokens += len(docs[-1])
                if tokens >= SHARD_TOKENS:
                    yield from shard()
                    ids, docs, tokens = [], [], 0
        yield from shard()

    return rows.mapInArrow(run, schema)


def digests(windows: DataFrame) -> DataFrame:
    """Windows without their matrices: crc32 of both instead."""
    return windows.select("sequence_id", "doc_ids", "starts", "cu_seqlens", "n_tokens", F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))


def write_binary(windows: DataFrame, path: str) -> None:
    """Write windows as Parquet with fixed-width id and position matrices, one row each."""
    windows.write.mode("overwrite").parquet(path)


def unpack(rows: Sequence[dict]) -> dict[object, np.ndarray]:
    """The ids of each document from windows, as written: the inverse of packing, for readers and tests."""
    parts: dict[object, list[tuple[int, np.ndarray]]] = {}
    for row in rows:
        ids = np.frombuffer(row["input_ids"], "<u4")
        for doc, start, a, b in zip(row["doc_ids"], row["starts"], row["cu_seqlens"], row["cu_seqlens"][1:], strict=False):
            parts.setdefault(doc, []).append((start, ids[a:b]))
    return {doc: np.concatenate([x for _, x in sorted(p, key=lambda y: y[0])]) for doc, p in parts.items()}


