"""A repository's files as DataFrames: listings, buckets, fingerprints, composition records, catalogs.

All files come through Spark's ``binaryFile`` reader, so that a repository may lie in any store that Spark reaches:
a local disk, HDFS, S3 or Azure.  Listings do not read contents.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import codec as K
from ..functions.formats import record_length
from ..operators import asof
from ..schema import CorruptData

#: Fixed values of the format.
ALLOCATION_AT, ALLOCATION_BYTES, SEGMENT_BYTES, GROUP = 12288, 8192, 1 << 22, 1024
#: Tables whose generations need a marker instead of a committed transaction: fixed values.
SUPPLEMENTAL = frozenset(
    "agent_connection connection_config copy_file copy_source_version copy_target_version copy_target_version_meta copy_target_file file_meta workload_config".split()
)
#: Tables that lie in the database of another name: fixed values.
STORED_IN = {"copy_target_file": "copy_target_version"}
POOL, COMPOSITION = "@data/Pool", "@data/Composition"
#: So many files at most are loaded by their paths; more are loaded with their folder and joined.
BY_PATH = 20_000


def relative(path: Column, root: str) -> Column:
    """The path below the root, whatever the scheme is written like."""
    tail = root.rstrip("/").rpartition(":")[2].lstrip("/")
    return F.regexp_replace(F.substring_index(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), f"/{tail}/", -1), "^/+", "")


def _stored(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, root: str, folder: str) -> dict[str, int]:
    """Name and size of the files that lie in a catalog folder, which has few; none if there is no such folder."""
    store, place = _stored(spark, f"{root}/{folder}")
    return {x.getPath().getName(): x.getLen() for x in store.listStatus(place) if x.isFile()} if store.exists(place) else {}


def files(spark: SparkSession, root: str, glob: str | None = None, folder: str = "", paths: Sequence[str] | None = None) -> DataFrame:
    """path (below the root), size, modified and content of all files below a folder of the root, or of some of them.

    The contents of other files are not read; a folder that is not there has no files.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    store, place = _stored(spark, f"{root}/{folder}" if folder else root)
    if paths is None and not store.exists(place) or paths is not None and not paths:
        return spark.createDataFrame([], "path string, size bigint, modified timestamp, content binary")
    found = reader.load([f"{root}/{p}" for p in paths] if paths else place.toString())
    return found.select(relative(F.col("path"), root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def chosen(spark: SparkSession, root: str, wanted: DataFrame, glob: str, folder: str) -> DataFrame:
    """Those files of a folder whose paths ``wanted`` has: only their contents are read, unless there are very many."""
    every = files(spark, root, glob, folder)
    there = every.select("path").join(wanted.select("path").distinct(), "path", "left_semi")
    first = [r[0] for r in there.limit(BY_PATH + 1).collect()]
    return files(spark, root, paths=first) if len(first) <= BY_PATH else every.join(wanted.select("path").distinct(), "path", "left_semi")


def listing(spark: SparkSession, root: str, folder: str = "") -> DataFrame:
    """The immediate children of a folder: name, is_folder and size (null for folders), by name."""
    inside = files(spark, root).select("path", "size").filter(F.col("path").startswith(f"{folder}/" if folder else ""))
    rest = F.substring("path", F.lit(len(folder) + 2 if folder else 1), F.length("path")) if folder else F.col("path")
    rows = inside.select(F.substring_index(rest, "/", 1).alias("name"), rest.contains("/").alias("is_folder"), "size")
    return rows.groupBy("name").agg(F.max("is_folder").alias("is_folder"), F.max(F.when(~F.col("is_folder"), F.col("size"))).alias("size")).orderBy("name")


def layouts(spark: SparkSession, root: str) -> DataFrame:
    """The repositories below a root: folders that hold repo_info or a db folder together with a data folder."""
    paths = files(spark, root).select("path")
    base = F.regexp_extract("path", r"^(.*?)/?(?:repo_info(?:\.[0-9]+)?$|db/|@data/)", 1)
    marked = paths.filter(F.col("path").rlike(r"(^|/)(repo_info(\.[0-9]+)?$|db/|@data/)"))
    kinds = marked.select(base.alias("root"), F.col("path").rlike(r"repo_info(\.[0-9]+)?$").alias("info"), F.col("path").rlike(r"(^|/)db/").alias("db"), F.col("path").rlike(r"(^|/)@data/").alias("data"))
    return kinds.groupBy("root").agg(*[F.max(c).alias(c) for c in ("info", "db", "data")]).filter(F.col("db") & (F.col("data") | F.col("info")))


def current(listed: DataFrame, folder: str) -> DataFrame:
    """Of a folder's files with sequence suffixes the latest of each name."""
    inside = listed.filter(F.col("path").startswith(f"{folder}/")).withColumn("name", F.substring_index("path", "/", -1))
    return asof.latest_sequence(inside.withColumn("folder", F.lit(folder)), ["folder"])


def transaction_id(spark: SparkSession, root: str) -> int | None:
    """The committed transaction: the number inside the transaction file with the highest suffix, the only one read."""
    numbers = [int(n.rpartition(".")[2]) for n in names(spark, root, "repo_transactions") if re.fullmatch(r"repo_transaction\.[0-9]+", n)]
    if not numbers:
        return None
    found = files(spark, root, paths=[f"repo_transactions/repo_transaction.{max(numbers)}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [K.parse_json_file(x.as_py(), b"rPTs").decode() for x in batch.column("content")]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["payload"])

    payload = found.select("content").mapInArrow(run, "payload string")
    return payload.select(F.get_json_object("payload", "$.transaction_id").cast("bigint")).first()[0]


def database(spark: SparkSession, root: str, name: str, txn: int | None = None) -> DataFrame:
    """The current file of the database ``db/<name>``: path, content and its write-ahead log, if that is not empty.

    With a committed transaction a table's largest generation strictly below it; of a supplemental table the largest one
    with a marker, if the repository has markers.  Without transactions the latest.
    """
    name = STORED_IN.get(name, name)
    there = names(spark, root, "db")
    listed = spark.createDataFrame([(0, n) for n in there if re.fullmatch(rf"{re.escape(name)}(\.[0-9]+)?", n)], "k int, name string")
    marks = names(spark, root, "suppl_transaction_ids") if name in SUPPLEMENTAL else {}
    if txn is None:
        best = asof.latest_sequence(listed, ["k"])
    else:
        markers = spark.createDataFrame([(0, name, int(n)) for n in marks if n.isascii() and n.isdigit()], "k int, logical string, n bigint") if marks else None
        best = asof.committed_generation(listed, ["k"], spark.range(1).select(F.lit(0).alias("k"), F.lit(txn).alias("txn")), markers)
    row = best.first()
    if row is None:
        raise FileNotFoundError(f"db/{name}")
    if row["physical"] is None:
        raise CorruptData(f"db/{name}: no generation is valid")
    path = f"db/{row['physical']}"
    wal = f"{row['physical']}-wal"
    found = files(spark, root, paths=[path]).select("path", "content")
    if not there.get(wal):
        return found.withColumn("wal", F.lit(None).cast("binary"))
    return found.crossJoin(files(spark, root, paths=[f"db/{wal}"]).select(F.col("content").alias("wal")))  # one row each


def buckets(found: DataFrame) -> DataFrame:
    """Bucket files with their stream and bucket id, from their paths: path, stream, bucket, size, content."""
    name = r"@data/Pool/([0-9]+)/(?:[0-9]+/)*([0-9]+)\.buk$"
    rows = found.filter(F.col("path").rlike(name))
    return rows.select("path", F.regexp_extract("path", name, 1).cast("bigint").alias("stream"), F.regexp_extract("path", name, 2).cast("bigint").alias("bucket"), "size", "content")


def fingerprints(found: DataFrame) -> DataFrame:
    """(stream, bucket, chunk, fingerprint) of all groups: their allocation tables joined with their segments."""
    where = r"@data/Pool/([0-9]+)/(?:[0-9]+/)*([0-9]+)"
    infos = found.filter(F.col("path").rlike(where + r"\.inf(\.[0-9]+)?$"))
    keyed = infos.select(F.regexp_extract("path", where, 1).cast("bigint").alias("stream"), F.regexp_extract("path", where, 2).cast("bigint").alias("group"), asof.sequence(F.col("path")).alias("n"), "content")
    latest = keyed.groupBy("stream", "group").agg(F.max_by("content", F.coalesce("n", F.lit(-1))).alias("content"))
    rows = latest.mapInArrow(_allocations, "stream bigint, group bigint, bucket bigint, at bigint, records int, segment bigint")
    segment = where + r"_([0-9]+)\.fgp(\.[0-9]+)?$"
    segments = found.filter(F.col("path").rlike(segment)).select(
        F.regexp_extract("path", where, 1).cast("bigint").alias("stream"), F.regexp_extract("path", where, 2).cast("bigint").alias("group"), F.regexp_extract("path", segment, 3).cast("bigint").alias("segment"),
        asof.sequence(F.col("path")).alias("n"), "content",
    )
    data = segments.groupBy("stream", "group", "segment").agg(F.max_by("content", F.coalesce("n", F.lit(-1))).alias("content"))
    joined = rows.join(data, ["stream", "group", "segment"])
    base = F.col("segment") * SEGMENT_BYTES
    first = F.greatest(F.col("at"), base)
    last = F.least(F.col("at") + F.col("records") * 32, base + SEGMENT_BYTES)
    part = joined.withColumn("i", F.explode(F.sequence(F.floor((first - F.col("at")) / 32), F.floor((last - F.col("at")) / 32) - 1))).filter(last > first)
    mark = F.substring(F.col("content"), (F.col("at") + F.col("i") * 32 - base + 1).cast("int"), F.lit(32))
    return part.select("stream", "bucket", F.col("i").cast("int").alias("chunk"), mark.alias("fingerprint")).filter(F.length("fingerprint") == 32)


def _allocations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["stream", "group", "bucket", "at", "records", "segment"]
    for batch in batches:
        for stream, group, content in zip(*(batch.column(c) for c in ("stream", "group", "content")), strict=True):
            data = content.as_py()
            K.parse_header(data, b"GMet")
            if len(data) < ALLOCATION_AT + ALLOCATION_BYTES:
                raise CorruptData("allocation table is cut off")
            out = []
            for i, (word, _) in enumerate(struct.iter_unpack(">II", data[ALLOCATION_AT : ALLOCATION_AT + ALLOCATION_BYTES])):
                at, records = (word >> 15) * 4096, word & 0x7FFF
                for segment in range(at // SEGMENT_BYTES, (at + 32 * records - 1) // SEGMENT_BYTES + 1) if records else ():
                    out.append((stream.as_py(), group.as_py(), group.as_py() + i, at, records, segment))
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)


def sessions(found: DataFrame) -> DataFrame:
    """Composition sub-files: stream, session, sub, size and content."""
    name = r"@data/Composition/([0-9]+)/(?:[0-9]+/)*([0-9]+)\.com/(?:[0-9]+/)*c([0-9]+)$"
    rows = found.filter(F.col("path").rlike(name))
    return rows.select("path", *[F.regexp_extract("path", name, i + 1).cast("bigint").alias(c) for i, c in enumerate(("stream", "session", "sub"))], "size", "content")


HEAD = 32


def _number(head: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(head, at + 1, size)), 16, 10).cast("bigint")


def _spans(wanted: DataFrame, parts: DataFrame) -> DataFrame:
    """(stream, session, offset, first, last): the sub-files that each record lies in, by the lengths in its head.

    A head that does not match its checksum says nothing: its record is looked for where it begins.
    """
    key = ["stream", "session", "offset"]
    asked = wanted.select(*key).distinct()
    heads = asked.withColumn("sub", F.explode(F.sequence(A.sub_file(F.col("offset")), A.sub_file(F.col("offset") + HEAD - 1))))
    # A sub-file meets its heads once, and rows of heads do not carry it.
    asking = heads.groupBy("stream", "session", "sub").agg(F.collect_list("offset").alias("offsets"))
    begin = F.col("sub") * (1 << A.SUB_FILE_BITS)
    piece = lambda o: F.substring(F.col("content"), (F.greatest(o - begin, F.lit(0)) + 1).cast("int"), (F.lit(HEAD) - F.greatest(begin - o, F.lit(0))).cast("int"))
    pieces = F.transform("offsets", lambda o: F.struct(o.alias("offset"), piece(o).alias("piece")))
    found = asking.join(parts, ["stream", "session", "sub"]).select("stream", "session", "sub", F.inline(pieces))
    found = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("sub", "piece"))).alias("pieces"))
    head = F.aggregate("pieces", F.lit(b""), lambda a, x: F.concat(a, x["piece"]))
    found = found.select(*key, head.alias("head"))
    good = (F.length("head") == HEAD) & (F.crc32(F.substring("head", 1, HEAD - 4)) == _number(F.col("head"), HEAD - 4, 4))
    number, attributes = _number(F.col("head"), 6, 8), _number(F.col("head"), 20, 4)
    sane = good & (number < (1 << 40))
    end = F.when(sane, F.col("offset") + record_length(number, attributes)).otherwise(F.col("offset") + HEAD)
    whole = asked.join(found.select(*key, end.alias("end")), key, "left")
    return whole.select(*key, A.sub_file(F.col("offset")).alias("first"), A.sub_file(F.coalesce("end", F.col("offset") + HEAD) - 1).alias("last"))


def records(wanted: DataFrame, parts: DataFrame) -> DataFrame:
    """Chunk map entries of the records at (stream, session, offset) of ``wanted``, and what is wrong with them.

    A record meets only the sub-files that it lies in, never its whole session; records of the same sub-files come
    together.  A record that cannot be read is one row with ``problem``.
    """
    schema = "stream bigint, session bigint, offset bigint, place int, kind string, file_offset bigint, template bigint, repeat bigint, address bigint, inherit boolean, length bigint, repaired boolean, problem string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.int32(), pa.string()] + [pa.int64()] * 4 + [pa.bool_(), pa.int64(), pa.bool_(), pa.string()]
    group = ["stream", "session", "first", "last"]
    asked = _spans(wanted, parts).groupBy(*group).agg(F.array_sort(F.collect_list("offset")).alias("offsets"))
    header = parts.filter("sub = 0").select("stream", "session", F.substring("content", 1, K.HEADER_BYTES).alias("header"))
    # A damaged length may name more sub-files than there are: no more than those are asked for.
    most = parts.groupBy("stream", "session").agg(F.max("sub").alias("most"))
    needed = asked.select(*group).join(most, ["stream", "session"]).withColumn("sub", F.explode(F.sequence("first", F.greatest(F.col("first"), F.least("last", "most")))))
    held = needed.join(parts, ["stream", "session", "sub"]).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("sub", "content"))).alias("subs"))
    both = asked.join(held, group, "left").join(header, ["stream", "session"], "left").select(*group, "offsets", "subs", "header")

    def rows(stream: int, session: int, first: int, last: int, offsets: Sequence[int], subs: Sequence[dict] | None, header: bytes | None) -> Iterator[tuple]:
        data, problem = b"", None
        if header is None or not subs or [s["sub"] for s in subs] != list(range(first, last + 1)):
            problem = "missing sub-file"
        else:
            try:
                K.parse_header(header, b"cMpS", 1)
            except CorruptData as e:
                problem = str(e)
            data = b"".join(s["content"] for s in subs)
        for offset in offsets:
            try:
                if problem:
                    raise CorruptData(problem)
                entries, _, _, repaired = K.parse_record(data, offset - (first << A.SUB_FILE_BITS))
            except CorruptData as e:
                yield (stream, session, offset, *[None] * 9, str(e))
                continue
            for i, e in enumerate(entries):
                yield (stream, session, offset, i, e["kind"], e["file_offset"], e["template"], e["repeat"], e["address"], e["inherit"], e["length"], repaired, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                found = list(rows(*(x.as_py() for x in row)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names)

    return both.mapInArrow(run, schema)


def walk(parts: DataFrame) -> DataFrame:
    """All records of each session in the order in which they lie: stream, session, offset, entries, status of the map.

    A session's sub-files pass one after the other, and what is left of one goes before the next.  The walk of a session
    ends where a record's head is not valid.
    """
    names = ["stream", "session", "offset", "entries", "length", "repaired", "problem"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, data, at, base, ended = None, b"", 0, 0, False

        def read(last: bool) -> list[tuple]:
            """Records that are whole, or, at a session's end, all."""
            nonlocal at, ended
            out: list[tuple] = []
            while not ended and at + HEAD <= len(data):
                if not any(data[at : at + HEAD]):
                    ended = True
                    break
                try:
                    entries, _, after, repaired = K.parse_record(data, at)
                    if after > len(data) and not last:
                        break
                except CorruptData as e:
                    if not last and at + HEAD + 20 * int.from_bytes(data[at + 6 : at + 14], "big") + (1 << 16) > len(data):
                        break  # it may go on in the next sub-file
                    out.append((*key, base + at, None, None, None, str(e)))
                    ended = True
                    break
                out.append((*key, base + at, len(entries), after - at, repaired, None))
                at = after
            return out

        def told(out: list[tuple]) -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            for stream, session, content in zip(*(batch.column(c) for c in ("stream", "session", "content")), strict=True):
                if (stream.as_py(), session.as_py()) != key:
                    if key:
                        yield from told(read(True))
                    key, data, at, base, ended = (stream.as_py(), session.as_py()), b"", K.HEADER_BYTES, 0, False
                base += at if data else 0
                data, at = (data[at:], 0) if data else (b"", at)
                data += content.as_py()
                yield from told(read(False))
        if key:
            yield from told(read(True))

    ordered = parts.select("stream", "session", "sub", "content").repartition("stream", "session").sortWithinPartitions("stream", "session", "sub")
    return ordered.mapInArrow(run, "stream bigint, session bigint, offset bigint, entries bigint, length bigint, repaired boolean, problem string")
