"""Integrity checks: what is wrong is data, a relation of findings; nothing that one part lacks stops the others.

A finding has stage, symptom, path, detail and ref (text or null).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import bounded_batches
from ..functions import codec as K
from ..functions.address import pack
from ..functions.names import masked
from ..schema import CorruptData

FINDING = "stage string, symptom string, path string, detail string, ref string"
STAGES = ("repo_info", "composition", "bucket", "chunk", "fingerprint", "catalog")
#: Findings that were put right are told, but are no problem.
REPAIRED = "REPAIRED"


def finding(stage: str, symptom: str, path: Column, detail: Column, ref: Column | None = None) -> list[Column]:
    return [F.lit(stage).alias("stage"), F.lit(symptom).alias("symptom"), path.alias("path"), detail.alias("detail"), (F.lit(None) if ref is None else ref).cast("string").alias("ref")]


def bucket_chunks(files: DataFrame) -> DataFrame:
    """Chunks and findings of bucket files (path, stream, bucket, content): one pass, each file in one row.

    A row of a chunk has stream, bucket, chunk, type, encrypted, stored and crc_ok; a row of a finding has the
    finding's columns instead.
    """
    schema = f"path string, stream long, bucket long, chunk int, type int, encrypted boolean, stored binary, crc_ok boolean, {FINDING.replace(', path string', '')}"
    fields = ["path", "stream", "bucket", "chunk", "type", "encrypted", "stored", "crc_ok", "stage", "symptom", "detail", "ref"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.bool_(), *[pa.string()] * 4]

    def rows(path: str, stream: int, bucket: int, content: bytes) -> Iterator[tuple]:
        none = (None,) * 4
        try:
            mode, chunks, findings = K.parse_bucket(content)
        except CorruptData as e:
            yield path, stream, bucket, None, None, None, None, None, "bucket", "CORRUPT", str(e), None
            return
        for text in findings:
            yield path, stream, bucket, None, None, None, None, None, "bucket", REPAIRED if "repaired" in text else "CORRUPT", text, None
        for slot, kind, stored, crc in chunks:
            yield path, stream, bucket, slot, kind, bool(mode & K.VAULT_ENCRYPT), stored, None if crc is None else crc == K.crc32(stored), *none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("path", "stream", "bucket", "content")), strict=True):
                found = list(rows(*(x.as_py() for x in row)))
                for k in range(0, len(found), 1024):
                    part = list(zip(*found[k : k + 1024], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds, strict=True)], fields)

    bounded_batches(files.sparkSession)
    return files.select("path", F.col("stream").cast("bigint"), F.col("bucket").cast("bigint"), "content").mapInArrow(run, schema)


def decoded(chunks: DataFrame, vault_key: Column | None = None) -> DataFrame:
    """The chunks (rows with a slot) with their plaintext: decrypted where the bucket says so, then decompressed.

    What cannot be decoded, and encrypted chunks without a key, have null plaintext.
    """
    bounded_batches(chunks.sparkSession)
    rows = chunks.filter(F.col("chunk").isNotNull()).withColumn("address", pack(F.col("stream"), F.col("bucket"), F.col("chunk")))
    clear = F.col("stored")
    if vault_key is not None:
        clear = F.when(F.col("encrypted"), K.ctr(F.col("stored"), vault_key, K.chunk_iv(F.col("address")))).otherwise(F.col("stored"))
    else:
        clear = F.when(~F.col("encrypted"), clear)
    return rows.withColumn("_clear", clear).withColumn("plain", K.decompressed(F.col("type"), F.col("_clear"))).drop("_clear")


def check_chunks(chunks: DataFrame) -> DataFrame:
    """Findings of the bucket parse, and of chunks whose stored bytes do not match their checksum."""
    where = F.concat(F.lit("chunk "), F.col("chunk").cast("string"))
    # One pass: a row of a finding has no checksum, and one of a chunk no stage.
    wrong = chunks.filter(F.col("stage").isNotNull() | ~F.col("crc_ok"))
    told = [F.coalesce(c, x).alias(c) for c, x in (("stage", F.lit("chunk")), ("symptom", F.lit("CORRUPT")))]
    return wrong.select(*told, "path", F.coalesce("detail", where).alias("detail"), "ref")


def check_json_files(files: DataFrame, magic: bytes, stage: str) -> DataFrame:
    """Findings of files (path, content) that are no valid files of a header with that magic and a JSON object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    if not isinstance(json.loads(K.parse_json_file(content.as_py(), magic)), dict):
                        raise CorruptData("no JSON object")
                except ValueError as e:  # CorruptData is one
                    row = [stage, "CORRUPT", path.as_py(), str(e), None]
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], ["stage", "symptom", "path", "detail", "ref"])

    return files.select("path", "content").mapInArrow(run, FINDING)


def check_fingerprints(plain: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Findings of chunks whose plaintext has another SHA-256 than was stored, that have none stored, or no plaintext.

    A missing key is told once, at the first bucket that needs it.
    """
    stored = fingerprints.select("stream", "bucket", "chunk", "fingerprint")
    both = plain.filter(F.col("type") != K.COMPACTED).join(stored, ["stream", "bucket", "chunk"], "left")
    where = F.concat(F.lit("chunk "), F.col("chunk").cast("string"))
    wrong = F.when(F.col("fingerprint").isNull(), "MISSING").when(F.col("plain").isNull() & F.col("encrypted"), "KEY_MISSING").when(F.col("plain").isNull() | (F.unhex(F.sha2("plain", 256)) != F.col("fingerprint")), "CORRUPT")
    found = both.withColumn("symptom", wrong).filter("symptom IS NOT NULL").select(F.lit("fingerprint").alias("stage"), "symptom", "path", where.alias("detail"), F.lit(None).cast("string").alias("ref"))
    blind = found.filter("symptom = 'KEY_MISSING'").agg(F.min("path").alias("path")).filter("path IS NOT NULL")
    return found.filter("symptom <> 'KEY_MISSING'").unionByName(blind.select(*finding("fingerprint", "KEY_MISSING", F.col("path"), F.lit("bucket is encrypted and there is no key"))))


def check_references(references: DataFrame, buckets: DataFrame) -> DataFrame:
    """Findings of buckets that are referred to but are not there, with the first reference as ref."""
    claimed = references.groupBy("stream", "bucket").agg(F.min("ref").alias("ref"))
    missing = claimed.join(buckets.select("stream", "bucket").distinct(), ["stream", "bucket"], "left_anti")
    path = F.concat_ws("/", F.col("stream").cast("string"), F.col("bucket").cast("string"))
    return missing.select(*finding("bucket", "MISSING", path, F.lit("bucket is missing"), F.col("ref")))


def grouped(findings: DataFrame) -> DataFrame:
    """Findings of one kind together: those with a ref by it, others by their detail with what varies masked."""
    key = F.when(F.col("ref").isNotNull(), F.concat(F.lit("ref:"), "ref")).otherwise(F.concat(F.lit("tpl:"), masked(F.col("detail"))))
    return findings.groupBy("stage", "symptom", key.alias("key")).agg(F.count(F.lit(1)).alias("findings"), F.min("path").alias("first_path"), F.min("detail").alias("first_detail"))


def summary(findings: DataFrame) -> DataFrame:
    """One row: problems, and findings that were put right."""
    fixed = F.col("symptom") == REPAIRED
    return findings.agg(F.count_if(~fixed).alias("problems"), F.count_if(fixed).alias("repaired"))


def ordered(findings: DataFrame) -> DataFrame:
    """Findings in the order in which they are shown."""
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    return findings.orderBy(place, "symptom", F.col("ref").asc_nulls_first(), "path", "detail")
