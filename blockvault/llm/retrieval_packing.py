"""Packing by lexical retrieval: each window holds a seed document and its nearest unused neighbours.

Documents are range-partitioned by a hash of a min-hash of their words (ties by id, so that copies spread),
which brings lexically close ones together.  A partition is worked off in shards of bounded size.  A shard has an
inverted index with BM25 weights; a seed's distinct tokens query it, and the unused documents fill the
seed's window in the order of their scores.  The document that reaches the window's end is cut there; its
rest is the next seed.  The last window of a partition is cut into lengths that are powers of two, which
need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import small_batches

#: BM25's usual constants.
K1, B = 1.2, 0.75
#: A shard is closed when it holds so many tokens.
SHARD_TOKENS = 262_144


class Index:
    """The inverted index of a shard: for each token the documents that hold it, with BM25 weights."""

    def __init__(self, docs: Sequence[np.ndarray]):
        n = len(docs)
        sizes = np.array([len(x) for x in docs], np.int64)
        owner = np.repeat(np.arange(n, dtype=np.uint32), sizes)
        tokens = np.concatenate(docs) if n else np.zeros(0, np.uint32)
        keys = np.sort((tokens * np.uint32(n) + owner) if n << 16 < 1 << 32 else tokens.astype(np.uint64) * np.uint64(n) + owner)
        begins = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]]))
        tf = np.diff(begins, append=len(keys))
        token, doc = np.divmod(keys[begins], np.uint32(max(n, 1)))
        doc = doc.astype(np.int64)
        first = np.flatnonzero(np.concatenate([[len(token) > 0], token[1:] != token[:-1]]))
        df = np.diff(first, append=len(token))
        # As usual, a token of more than half the documents tells nothing and weighs nothing.
        idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0.0)
        length = K1 * (1 - B + B * sizes / max(sizes.mean(), 1e-9)) if n else sizes
        weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + length[doc])
        self.first, self.df = first, df
        self.doc, self.weight, self.n = doc, weight, n
        # The terms of each document in turn, those that tell something.
        term = np.repeat(np.arange(len(df)), df)
        useful = np.flatnonzero(idf[term] > 0)
        by_doc = useful[np.argsort(doc[useful].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
        self.term_of = term[by_doc]
        self.limits = np.searchsorted(doc[by_doc], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document for the distinct tokens of the seed."""
        terms = self.term_of[self.limits[seed] : self.limits[seed + 1]]
        first, size = self.first[terms], self.df[terms]
        ends = np.cumsum(size)
        if not len(ends) or not ends[-1]:
            return np.zeros(self.n)
        at = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
        return np.bincount(self.doc[at], self.weight[at], self.n)


class Windows:
    """Takes pieces into windows of ``width`` ids, one after the other."""

    def __init__(self, width: int, first: int):
        self.width, self.number, self.filled = width, first, 0
        self.open: list[list] = []
        self.done: list[list] = []

    def put(self, doc: object, ids: np.ndarray, start: int, most: int) -> int:
        """Place up to ``most`` ids of the document from ``start``; returns how many fitted."""
        n = min(most, self.width - self.filled)
        self.open.append([doc, start, n, ids, self.number, self.filled])
        self.filled += n
        if self.filled == self.width:
            self.done += self.open
            self.open, self.filled, self.number = [], 0, self.number + 1
        return n

    def close(self) -> None:
        """Cut the open window into powers of two, the largest first."""
        rest, self.open = self.open, []
        room = offset = 0
        left = self.filled
        for doc, start, n, ids, _, _ in rest:
            while n:
                if not room:
                    room, offset = 1 << (left.bit_length() - 1), 0
                take = min(n, room)
                self.done.append([doc, start, take, ids, self.number, offset])
                start, n, room, offset, left = start + take, n - take, room - take, offset + take, left - take
                self.number += not room
        self.filled = 0


def pack_shard(ids: Sequence[object], docs: Sequence[np.ndarray], windows: Windows) -> None:
    index = Index(docs)
    unused = np.ones(len(docs), bool)
    seed, start, next_seed = -1, 0, 0
    while True:
        if seed < 0:
            while next_seed < len(docs) and not unused[next_seed]:
                next_seed += 1
            if next_seed == len(docs):
                return
            seed, start = next_seed, 0
            unused[seed] = False
        at, size = seed, len(docs[seed])
        seed = -1
        while start < size:
            start += windows.put(ids[at], docs[at], start, size - start)
        if not windows.filled or not unused.any():
            continue
        scores = index.scores(at)
        near = np.flatnonzero(unused & (scores > 0))
        for k in near[np.lexsort((near, -scores[near]))].tolist():
            unused[k] = False
            size = len(docs[k])
            placed = windows.put(ids[k], docs[k], 0, size)
            if not windows.filled:
                if placed < size:
                    seed, start = k, placed
                break


def pack_by_retrieval(df: DataFrame, vocabulary: str, width: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids (binary).

    Ids are little-endian unsigned 32-bit numbers.  Each token of each row of ``df`` lies in exactly one piece.

    A document's ids end with ``end_id``, so that a null or empty text gives one piece of one id.  Every
    sequence has ``width`` ids but the last few of a partition, whose lengths are powers of two.  Rows that
    repeat an id are documents of their own.  An empty table gives an empty result; other columns are not read.
    """
    small_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.transform(F.split(text, " "), lambda w: F.when(F.length(w) > 3, F.xxhash64(w)).otherwise(F.lit((1 << 63) - 1)))
    rows = df.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(F.array_min(words)).alias("_sign"))  # hashed anew, as the least of many words is small
    dealt = rows.repartitionByRange("_sign", "_id").sortWithinPartitions("_sign", "_id", "_text").select("_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.load(vocabulary)
        windows = Windows(width, TaskContext.get().partitionId() << 40)
        ids: list = []
        docs: list[np.ndarray] = []
        tokens = 0

        def out() -> Iterator[pa.RecordBatch]:
            done, windows.done = windows.done, []
            if done:
                raw = [x[3][x[1] : x[1] + x[2]] for x in done]
                columns = [[x[0] for x in done], [x[1] for x in done], [x[2] for x in done], [zlib.crc32(x) for x in raw], [len(x[3]) for x in done], [x[4] for x in done], [x[5] for x in done]]
                if with_ids:
                    columns.append([x.tobytes() for x in raw])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names)

        for batch in batches:
            found, limits = v.encode_column(batch.column(1), end_id)
            for doc, a, b in zip(batch.column(0).to_pylist(), limits, limits[1:], strict=False):
                ids.append(doc)
                docs.append(found[a:b])
                tokens += len(docs[-1])
                if tokens >= SHARD_TOKENS:
                    pack_shard(ids, docs, windows)
                    ids, docs, tokens = [], [], 0
                    yield from out()
        pack_shard(ids, docs, windows)
        windows.close()
        yield from out()

    schema = T.StructType([dealt.schema["_id"], *T.StructType.fromDDL("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids).fields])
    names = schema.names
    arrow = [to_arrow_type(f.dataType) for f in schema]
    return dealt.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def to_arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type as of

    return of(kind)
