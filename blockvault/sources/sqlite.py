"""SQLite databases as DataFrames.

A database is one file that Spark's readers bring as bytes, from any store they reach; a task opens it in memory
and sends out the rows of one table.  Up to two envelopes are peeled by their magic: encryption, then zstd.  A
live write-ahead log beside the file is applied.
"""

from __future__ import annotations

import os
import sqlite3
import tempfile
from collections.abc import Iterator, Mapping

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec as K
from ..schema import TABLES, CorruptData

MAGIC = b"SQLite format 3\0"
#: What a database may have at most once it is decompressed.
LARGEST = 1 << 30


def peeled(content: Column, vault_key: Column | None = None) -> Column:
    """The content without its encryption envelope, where it has one and there is a key; zstd is left to the reader."""
    sealed = F.substring(content, 1, 4) == F.lit(b"aHlT")
    if vault_key is None:
        return F.when(~sealed, content)
    clear = K.ctr(F.substring(content, 65, 1 << 30), vault_key, F.substring(content, 9, 16))
    return F.when(sealed, clear).otherwise(content)


def unzstd(data: bytes, largest: int = LARGEST) -> bytes:
    return _bounded(data, largest) if data[:4] == b"\x28\xb5\x2f\xfd" else data


def _bounded(data: bytes, largest: int) -> bytes:
    parts, size = [], 0
    with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as reader:
        while part := reader.read(1 << 20):
            size += len(part)
            if size > largest:
                raise CorruptData(f"more than {largest} bytes when decompressed")
            parts.append(part)
    return b"".join(parts)


def open_database(data: bytes, wal: bytes | None = None) -> sqlite3.Connection:
    """The database in memory; with a write-ahead log, which has to be applied from files, in a temporary folder of the
    task that is gone when this returns."""
    data = unzstd(data)
    if data[:16] != MAGIC:
        raise CorruptData("no SQLite database")
    out = sqlite3.connect(":memory:")
    if not wal:
        # Read-only memory cannot follow a log: say that there is none.
        out.deserialize(data[:18] + b"\x01\x01" + data[20:])
        return out
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "db")
        for name, content in ((path, data), (f"{path}-wal", wal)):
            with open(name, "wb") as file:
                file.write(content)
        with sqlite3.connect(path) as live:
            live.backup(out)
        live.close()
    return out


def read_rows(connection: sqlite3.Connection, table: str, required: Mapping[str, str], optional: Mapping[str, str]) -> Iterator[tuple]:
    """The declared columns in the order of rowids; a missing required column raises, a missing optional one is null."""
    there = {r[1] for r in connection.execute(f'PRAGMA table_info("{table}")')}
    if not there:
        raise CorruptData(f"no table {table}")
    if absent := [c for c in required if c not in there]:
        raise CorruptData(f"{table}: missing columns: {', '.join(absent)}")
    columns = ", ".join(f'"{c}"' if c in there else "NULL" for c in (*required, *optional))
    yield from connection.execute(f'SELECT {columns}, rowid FROM "{table}" ORDER BY rowid')


def read_table(spark: SparkSession, files: DataFrame, table: str, required: Mapping[str, str] | None = None, optional: Mapping[str, str] | None = None, vault_key: Column | None = None) -> DataFrame:
    """The table of all database files in ``files`` (path, content, and optionally wal), with _file and row_id.

    The declared columns are those of the catalog table of that name unless given.  Values of a wrong type raise.
    """
    if required is None:
        required, optional = TABLES[table]
    optional = optional or {}
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    columns = {**required, **optional}
    schema = T.StructType.fromDDL(", ".join(["_file string", *[f"`{c}` {t}" for c, t in columns.items()], "row_id bigint"]))
    arrow = pa.schema([("_file", pa.string()), *[(c, kinds[t]) for c, t in columns.items()], ("row_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, wal in zip(*(batch.column(c) for c in ("path", "content", "wal")), strict=True):
                connection = open_database(content.as_py() or b"", wal.as_py())
                rows, found = read_rows(connection, table, required, optional), []
                while found := [r for _, r in zip(range(8192), rows)]:  # noqa: B905
                    try:
                        arrays = [pa.array([path.as_py()] * len(found), pa.string()), *[pa.array(c, t) for c, t in zip(zip(*found, strict=True), arrow.types[1:], strict=True)]]
                    except (pa.ArrowInvalid, pa.ArrowTypeError) as e:
                        raise CorruptData(f"{path}: {table}: {e}") from e
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
                connection.close()

    wal = F.col("wal") if "wal" in files.columns else F.lit(None).cast("binary")
    return files.select("path", peeled(F.col("content"), vault_key).alias("content"), wal.alias("wal")).mapInArrow(run, schema)


def tables_of(data: bytes) -> list[str]:
    with open_database(data) as connection:
        return [r[0] for r in connection.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
