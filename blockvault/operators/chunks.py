"""The chunk store as relations: files as fixed chunks, a pool of distinct chunks, extents, reads and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.address import BUCKET_CHUNKS, CHUNK_BYTES, bucket_of, chunk_of, from_linear, linear, stream_of


#: Groups that are counted together.
GROUPS = 4096


def chunked(df: DataFrame, key: str, content: str, size: int) -> DataFrame:
    """(key, chunk_no, chunk, fingerprint): the content in pieces of ``size``, the last one shorter.

    A null or empty content has no chunks.
    """
    # One pass over the content, and rows that carry their chunk alone, not the whole content.
    pieces = F.regexp_extract_all(content, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    rows = df.select(key, F.posexplode(pieces).alias("chunk_no", "chunk"))
    return rows.withColumn("fingerprint", F.sha2(F.col("chunk").cast("binary"), 256))


def numbered(df: DataFrame, order: Sequence[str], group: Column, name: str = "number") -> DataFrame:
    """Number rows from 0 in the order of ``order``, without sorting them in one task.

    ``group`` is a number that never falls along the order.  Rows are numbered within their group; the numbers
    before a group come from counts: of the groups before it among ``GROUPS`` neighbouring ones, and of all groups of
    ``GROUPS`` before those, so that the one window that is not partitioned has a row for ``GROUPS`` groups.
    """
    rows = df.withColumn("_group", group)
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).withColumn("_super", F.floor(F.col("_group") / GROUPS))
    supers = counts.groupBy("_super").agg(F.sum("_n").alias("_n")).withColumn("_first", before(Window.orderBy("_super"))).drop("_n")
    inside = counts.withColumn("_inside", before(Window.partitionBy("_super").orderBy("_group"))).drop("_n")
    offsets = inside.join(supers, "_super").select("_group", (F.col("_first") + F.col("_inside")).alias("_before"))
    within = rows.withColumn("_within", F.row_number().over(Window.partitionBy("_group").orderBy(*order)) - 1)
    return within.join(offsets, "_group").withColumn(name, (F.col("_before") + F.col("_within")).cast("bigint")).drop("_group", "_before", "_within")


def pool(chunks: DataFrame, key: str, stream: int = 1, per_group: int = 4096) -> DataFrame:
    """The distinct chunks in the order in which they were first seen, with their addresses."""
    first = chunks.groupBy("fingerprint").agg(F.min(F.struct(F.col(key), F.col("chunk_no"))).alias("_first"), F.count(F.lit(1)).alias("references"))
    flat = first.select("fingerprint", "references", F.col(f"_first.{key}").alias("first_key"), F.col("_first.chunk_no").alias("first_chunk"))
    placed = numbered(flat, ["first_key", "first_chunk"], F.floor(F.col("first_key") / F.lit(per_group)).cast("bigint"))
    return placed.withColumn("address", from_linear(F.lit(stream), F.col("number"))).drop("number")


def reassemble(chunks: DataFrame, key: str, content: str = "text") -> DataFrame:
    """Files from their chunks, in the order of the chunk numbers."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "chunk")))
    return chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["chunk"]), "").alias(content))


def read_range(chunks: DataFrame, requests: DataFrame, key: str, size: int, offset: str = "offset", length: str = "length", content: str = "data") -> DataFrame:
    """The bytes [offset, offset + length) of files, cut at the file's end and never padded.

    Only the chunks that a request touches take part.  A request beyond the end, or of length 0, reads nothing.
    """
    asked = requests.withColumns({"_first": F.floor(F.col(offset) / F.lit(size)), "_last": F.floor((F.col(offset) + F.col(length) - 1) / F.lit(size))})
    near = chunks.join(asked, key).filter((F.col("chunk_no") >= F.col("_first")) & (F.col("chunk_no") <= F.col("_last")))
    from_ = F.greatest(F.col(offset) - F.col("chunk_no") * size, F.lit(0)).cast("int")
    to = F.least(F.col(offset) + F.col(length) - F.col("chunk_no") * size, F.lit(size)).cast("int")
    part = near.withColumn("chunk", F.substring(F.col("chunk"), from_ + 1, to - from_))
    read = reassemble(part, key, content)
    return requests.join(read, key, "left").withColumn(content, F.coalesce(content, F.lit("")))


def planned(entries: DataFrame, lo: Column, hi: Column, start: str = "file_offset", template: str = "template", repeat: str = "repeat") -> DataFrame:
    """Mapping entries clipped to a window: first and last chunk index of the entry that the window needs.

    Whole chunks are decoded, so the window is widened to chunk edges.
    """
    total = F.col(template) * (F.col(repeat) + 1)
    first = F.greatest(F.floor((lo - F.col(start)) / F.lit(CHUNK_BYTES)), F.lit(0)).cast("bigint")
    last = F.least(F.ceil((hi - F.col(start)) / F.lit(CHUNK_BYTES)), total).cast("bigint") - 1
    return entries.withColumns({"first_k": first, "last_k": last}).filter(F.col("first_k") <= F.col("last_k"))


def chunk_runs(entries: DataFrame, keep: Sequence[str], address: str = "address", template: str = "template") -> DataFrame:
    """Entries with first_k..last_k as runs of chunks that lie side by side in one bucket.

    The template starts again at the base address after ``template`` chunks, and a run ends where a bucket does.
    Rows are made for cycles and for buckets, never for single chunks.
    """
    cycles = entries.withColumn("_cycle", F.explode(F.sequence(F.floor(F.col("first_k") / F.col(template)), F.floor(F.col("last_k") / F.col(template)))))
    a = F.greatest(F.col("first_k") - F.col("_cycle") * F.col(template), F.lit(0))
    b = F.least(F.col("last_k") - F.col("_cycle") * F.col(template), F.col(template) - 1)
    spans = cycles.withColumns({"_a": linear(F.col(address)) + a, "_b": linear(F.col(address)) + b})
    split = spans.withColumn("_bucket", F.explode(F.sequence(F.shiftright("_a", 13), F.shiftright("_b", 13))))
    first = F.greatest(F.col("_a"), F.col("_bucket") * BUCKET_CHUNKS)
    last = F.least(F.col("_b"), F.col("_bucket") * BUCKET_CHUNKS + (BUCKET_CHUNKS - 1))
    at = F.col("_cycle") * F.col(template) + (first - linear(F.col(address)))
    return split.select(
        *keep, stream_of(F.col(address)).alias("stream"), F.col("_bucket").alias("bucket"), (first - F.col("_bucket") * BUCKET_CHUNKS).alias("chunk"), (last - first + 1).alias("n"), at.cast("bigint").alias("k")
    )


def bucket_plan(chunk_refs: DataFrame, address: str = "address") -> DataFrame:
    """What a read needs of each bucket: distinct chunks, and the first and last of them."""
    a = F.col(address)
    slots = chunk_refs.select(stream_of(a).alias("stream"), bucket_of(a).alias("bucket"), chunk_of(a).alias("chunk"))
    return slots.groupBy("stream", "bucket").agg(F.count_distinct("chunk").alias("chunks"), F.min("chunk").alias("first_chunk"), F.max("chunk").alias("last_chunk"), F.count(F.lit(1)).alias("references"))

