"""Exports as files: a DataSource whose tasks write staged parts, which the commit puts into place.

A row is (file, offset, data).  Rows are dealt by segments of files and sorted by offset before the write; the tasks of
a file write at their offsets into one part ``<name>.part-<job>``, which appears under its name only when the whole
job committed.  A task that runs again writes the same bytes at the same places, and an aborted job leaves nothing under
the final names.  Gaps between rows stay holes where the file system knows them.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: What one task writes of a file at a time.
SEGMENT_BYTES = 1 << 28


@dataclass
class Written(WriterCommitMessage):
    staged: list[tuple[str, str]]
    bytes_written: int


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str, job: str):
        self.folder, self.job = folder, job

    def _final(self, name: str) -> str:
        path = os.path.normpath(os.path.join(self.folder, name))
        if not path.startswith(os.path.join(os.path.normpath(self.folder), "")):
            raise ValueError(f"{name!r} leaves the export folder")
        return path

    def write(self, rows: Iterator) -> Written:
        staged, total, name, file = [], 0, None, None
        try:
            for row in rows:
                if row["file"] != name:
                    if file:
                        file.close()
                    name = row["file"]
                    final = self._final(name)
                    part = f"{final}.part-{self.job}"
                    os.makedirs(os.path.dirname(final), exist_ok=True)
                    file = os.fdopen(os.open(part, os.O_RDWR | os.O_CREAT, 0o666), "r+b")
                    staged.append((part, final))
                file.seek(row["offset"])
                file.write(row["data"])
                total += len(row["data"])
        finally:
            if file:
                file.close()
        return Written(staged, total)

    def commit(self, messages: list) -> None:
        for part, final in {pair for message in messages if message for pair in message.staged}:
            os.replace(part, final)
        self._sweep()

    def abort(self, messages: list) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """Parts of tasks that failed or ran twice."""
        for part in glob.glob(os.path.join(glob.escape(self.folder), "**", f"*.part-{self.job}"), recursive=True):
            os.remove(part)


class FileExport(DataSource):
    """``df.write.format("vaultfiles").save(folder)``; the folder must be one that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "vaultfiles"

    def schema(self) -> str:
        return "file string, offset bigint, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], uuid.uuid4().hex[:8])


def export_files(rows: DataFrame, folder: str) -> None:
    """Write rows (file, offset, data) as files below the folder."""
    rows.sparkSession.dataSource.register(FileExport)
    segment = F.floor(F.col("offset") / F.lit(SEGMENT_BYTES))
    dealt = rows.select("file", "offset", "data").repartition("file", segment).sortWithinPartitions("file", "offset")
    dealt.write.format("vaultfiles").mode("append").save(folder)
