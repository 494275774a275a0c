"""A repository as a set of DataFrames: open it, list it, read it, verify it, export from it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import codec as K
from .functions.address import BUCKET_CHUNKS, CHUNK_BYTES, pool_path
from .operators import asof, catalog, chunks, intervals, trees, verify
from .schema import CorruptData, catalog_table
from .sources import repository as source
from .sources import sink, sqlite


class Repository:
    """One repository below ``root``, in any store that Spark reaches.  Nothing is read before it is asked for.

    ``key`` is an administrator's key string, ``id@base64``; it is checked against the wrapped key when it is
    needed first.
    """

    def __init__(self, spark: SparkSession, root: str, key: str | None = None):
        self.spark, self.root, self._key = spark, root.rstrip("/"), key
        self._txn: int | None = None
        self._vault: bytes | None = None

    # -- catalogs ------------------------------------------------------------------------------------------

    def transaction(self) -> int | None:
        """The committed transaction, or none in a repository without transactions."""
        if self._txn is None:
            self._txn = source.transaction_id(self.spark, self.root)
        return self._txn

    def table(self, name: str, database: str | None = None) -> DataFrame:
        """A catalog table of the generation that is committed; optional columns that are absent are null."""
        file = source.database(self.spark, self.root, database or name, self.transaction())
        return catalog_table(sqlite.read_table(self.spark, file, name), name)

    def connections(self) -> DataFrame:
        return catalog.connections(self.table("connection_config"), self._all_versions(), self.table("workload_config"), self.table("vault_link_key"))

    def workloads(self, connection_config_id: int) -> DataFrame:
        return catalog.workloads_of(self.table("workload_config"), self._all_versions(), F.col("connection_config_id") == connection_config_id)

    def _all_versions(self) -> DataFrame:
        return self.table("copy_target_version")

    def versions(self, include_deleted: bool = False) -> DataFrame:
        """Versions that can be browsed; encrypted specs are read with the key, and hidden without it."""
        rows = self._all_versions()
        if self.encrypted() and self._key:
            clear = K.ctr(F.unbase64("version_spec"), F.lit(self.vault_key()), K.spec_iv(F.col("version_uid")))
            rows = rows.withColumn("version_spec", F.when(clear.isNotNull(), F.try_validate_utf8(clear.cast("string"))))
        return catalog.browsable_versions(rows, self.table("copy_target_version_meta"), include_deleted)

    def version_tree(self, version_id: int) -> DataFrame:
        """The files of a device version as nodes."""
        mine = self.table("copy_target_file", "copy_target_version").filter(F.col("version_id") == version_id)
        return trees.path_tree(mine.join(self.table("file_meta"), "fid"), "path")

    # -- keys ----------------------------------------------------------------------------------------------

    def encrypted(self) -> bool:
        """Whether the last key record is another than that of a repository without encryption."""
        keys = sqlite.read_table(self.spark, source.database(self.spark, self.root, "vault_encryption_key"), "vault_encryption_key")
        last = keys.orderBy(F.col("row_id").desc()).select("user_key_uuid").first()
        return last is not None and last[0] != "NoEncryption"

    def vault_key(self) -> bytes:
        if self._vault is None:
            if not self._key:
                raise PermissionError("the repository is encrypted; a key is needed")
            keys = sqlite.read_table(self.spark, source.database(self.spark, self.root, "vault_encryption_key"), "vault_encryption_key")
            ident, key = K.parse_key_string(F.lit(self._key))
            row = keys.filter(F.col("user_key_uuid") == ident).select(K.unwrap_key(F.col("encrypted_data_key"), key, ident)).first()
            if row is None or row[0] is None:
                raise PermissionError("the key does not fit")
            self._vault = bytes(row[0])
        return self._vault

    def _key_column(self) -> Column | None:
        return F.lit(self.vault_key()) if self._key and self.encrypted() else None

    # -- content -------------------------------------------------------------------------------------------

    def locations(self) -> DataFrame:
        """Where every path's record is, its size and whether it can be read."""
        file_map = self.table("file_map")
        return catalog.locate_files(file_map.select("path").distinct(), file_map, self.table("file_meta"))

    def entries(self, located: DataFrame) -> DataFrame:
        """Chunk map entries of located paths, in order, with the path; records that cannot be read have ``problem``."""
        wanted = located.select("path", F.col("stream_id").cast("bigint").alias("stream"), F.col("session_id").alias("session"), F.col("comp_offset").alias("offset"))
        return wanted.join(source.records(wanted, self._sessions()), ["stream", "session", "offset"])

    def _sessions(self) -> DataFrame:
        return source.sessions(source.files(self.spark, self.root, "c*", source.COMPOSITION))

    def _buckets(self, wanted: DataFrame | None = None) -> DataFrame:
        """Bucket files, or those of (stream, bucket) only, whose contents alone are read then."""
        if wanted is None:
            return source.buckets(source.files(self.spark, self.root, "*.buk", source.POOL))
        paths = wanted.select(pool_path(F.col("stream"), F.col("bucket")).alias("path"))
        return source.buckets(source.chosen(self.spark, self.root, paths, "*.buk", source.POOL))

    def _fingerprints(self) -> DataFrame:
        infos, segments = (source.files(self.spark, self.root, glob, source.POOL) for glob in ("*.inf*", "*.fgp*"))
        return source.fingerprints(infos.unionByName(segments))

    def _decoded(self, buckets: DataFrame) -> DataFrame:
        return verify.decoded(verify.bucket_chunks(self._buckets(buckets)), self._key_column())

    def read(self, path: str, offset: int = 0, length: int | None = None) -> DataFrame:
        """(file_offset, data) of the stored chunks that the range touches, cut to it, in no order.

        What no row covers reads as zeros: holes and zero ranges are not made into rows.
        """
        located = self.locations().filter(F.col("path") == path)
        row = located.select("state", "file_size").first()
        if row is None or row["state"] == "MISSING":
            raise FileNotFoundError(path)
        if row["state"] != "OK" or row["file_size"] is None:
            raise CorruptData(path)
        end = row["file_size"] if length is None else min(row["file_size"], offset + length)
        return self._read(located, F.lit(offset), F.lit(end)).select("file_offset", "data")

    def _read(self, located: DataFrame, lo: Column, hi: Column) -> DataFrame:
        entries = self.entries(located).filter("kind = 'DATA'")
        plan = chunks.planned(entries, lo, hi)
        runs = chunks.chunk_runs(plan, ["path", "file_offset"])
        # One row for each chunk that is read; a chunk that is used often is decoded once and joined.
        slots = runs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
        slots = slots.select("path", "stream", "bucket", (F.col("chunk") + F.col("i")).cast("int").alias("chunk"), (F.col("file_offset") + (F.col("k") + F.col("i")) * CHUNK_BYTES).alias("at"))
        plain = self._decoded(slots.select("stream", "bucket").distinct()).select("stream", "bucket", "chunk", "plain")
        joined = slots.join(plain, ["stream", "bucket", "chunk"], "left")
        checked = F.when(F.col("plain").isNull(), F.raise_error(F.concat(F.lit("chunk cannot be read: "), F.concat_ws("/", *[F.col(c).cast("string") for c in ("stream", "bucket", "chunk")])))).otherwise(F.col("plain"))
        first = F.greatest(lo - F.col("at"), F.lit(0)).cast("int")
        last = F.least(hi - F.col("at"), F.lit(CHUNK_BYTES)).cast("int")
        return joined.select("path", (F.col("at") + first).alias("file_offset"), F.substring(checked, first + 1, last - first).alias("data"))

    def extents(self) -> DataFrame:
        """All files' extents: their entries and the holes between, before and after them."""
        located = self.locations().filter("state = 'OK'")
        entries = self.entries(located).filter(F.col("kind").isNotNull())
        rows = entries.select("path", F.col("file_offset").alias("start"), (F.col("file_offset") + F.col("length")).alias("end"), "kind")
        return intervals.extents(rows, located.select("path", F.col("file_size").alias("size")), ["path"])

    def export(self, paths: DataFrame, folder: str) -> None:
        """Write the files of ``paths`` (column path) below a folder, sparse: holes and zero ranges are not written."""
        located = self.locations().join(paths.select("path"), "path", "left_semi").filter("state = 'OK'")
        sizes = located.select("path", "file_size")
        data = self._read(located, F.lit(0), F.lit(1 << 62)).join(sizes, "path")
        cut = data.filter(F.col("file_offset") < F.col("file_size")).withColumn("data", F.substring("data", F.lit(1), F.least(F.lit(CHUNK_BYTES), F.col("file_size") - F.col("file_offset")).cast("int")))
        # A last byte gives a file its length when it ends in a hole; an empty file is a row without data.
        tails = sizes.filter("file_size > 0").join(cut.filter(F.col("file_offset") + F.length("data") == F.col("file_size")).select("path").distinct(), "path", "left_anti")
        rows = cut.select(F.col("path").alias("file"), F.col("file_offset").alias("offset"), "data").unionByName(
            tails.select(F.col("path").alias("file"), (F.col("file_size") - 1).alias("offset"), F.unhex(F.lit("00")).alias("data"))
        ).unionByName(sizes.filter("file_size = 0").select(F.col("path").alias("file"), F.lit(0).cast("bigint").alias("offset"), F.lit(b"").alias("data")))
        sink.export_files(rows, folder)

    def object_bytes(self, path: str, offset: int, length: int) -> DataFrame:
        """One row (path, content): a byte range of a file as one value, holes as zeros.  For objects of moderate size."""
        parts = self.read(path, offset, length).agg(F.array_sort(F.collect_list(F.struct("file_offset", "data"))).alias("parts"))

        @F.pandas_udf(T.BinaryType())
        def joined(parts: pd.Series) -> pd.Series:
            out = bytearray(length)
            for rows in parts:
                for row in rows:
                    at = row["file_offset"] - offset
                    out[at : at + len(row["data"])] = row["data"]
            return pd.Series([bytes(out)])

        return parts.select(F.lit(path).alias("path"), joined("parts").alias("content"))

    def stream_file(self, stream_uuid: str, connection: str, requested: int, cap: int) -> str | None:
        """The path of the generation of a SaaS stream that holds the requested one: the nearest complete one from it
        on, unless that is beyond ``cap``."""
        paths = catalog.prefix_scan(self.table("file_map").filter(F.col("status") == catalog.COMPLETE), "path", f"{stream_uuid}/{connection}/")
        shape = rf"^{re.escape(stream_uuid)}/{re.escape(connection)}/([0-9]+)/saas_obj$"
        found = paths.filter(F.col("path").rlike(shape)).select("path", F.regexp_extract("path", shape, 1).cast("bigint").alias("n"))
        nearest = found.filter(F.col("n") >= requested).agg(F.min("n").alias("n"), F.min_by("path", "n").alias("path")).first()
        return nearest["path"] if nearest["n"] is not None and nearest["n"] <= cap else None

    def object_table(self, path: str, object_db_id: str) -> DataFrame:
        """(object_id, offset, length) of a stream's objects, from the database at the address ``<uuid>_<offset>_<length>``."""
        _, offset, length = object_db_id.rsplit("_", 2)
        content = self.object_bytes(path, int(offset), int(length))
        rows = sqlite.read_table(self.spark, content, "object_table", {"object_id": "string", "offset": "bigint", "length": "bigint"})
        return rows.select("object_id", "offset", "length")

    def service_table(self, path: str, objects: DataFrame, object_id: str, table: str, required: dict[str, str], optional: dict[str, str] | None = None) -> DataFrame:
        """A table of a service database, which is an object of the stream; missing optional columns are null."""
        where = objects.filter(F.col("object_id") == object_id).select("offset", "length").first()
        if where is None:
            raise FileNotFoundError(object_id)
        return sqlite.read_table(self.spark, self.object_bytes(path, where["offset"], where["length"]), table, required, optional)

    def walk_records(self) -> DataFrame:
        """All records of all sessions as they lie, also those that no file refers to any more."""
        return source.walk(self._sessions())

    def report(self) -> dict:
        """What there is: transaction, encryption, and how many connections, workloads, versions and files."""
        counts = {name: self.table(name).count() for name in ("connection_config", "workload_config", "copy_target_version", "file_map")}
        return {"root": self.root, "transaction": self.transaction(), "encrypted": self.encrypted(), **counts}

    # -- verification --------------------------------------------------------------------------------------

    def reachable_paths(self) -> DataFrame:
        """(path, version_id) of what live versions consist of: the registered files of device versions, and of SaaS
        versions the stream's files up to the nearest complete generation from theirs on."""
        live = self._all_versions().filter(F.coalesce("deleted", F.lit(0)) == 0)
        registered = self.table("copy_target_file").join(live, "version_id", "left_semi").join(self.table("file_meta"), "fid").select("path", "version_id")
        shape = r"^([^/]+)/([^/]+)/([0-9]+)/saas_obj$"
        part = lambda k: F.regexp_extract("path", shape, k)
        streams = self.table("file_map").filter(F.col("path").rlike(shape)).select("path", part(1).alias("saas_stream_uuid"), part(2).alias("connection_id"), part(3).cast("bigint").alias("n"))
        asked = live.filter("saas_stream_uuid IS NOT NULL AND saas_version_id IS NOT NULL").join(self.table("connection_config"), "connection_config_id")
        asked = asked.select("version_id", "saas_stream_uuid", "connection_id", "saas_version_id")
        reached = asof.forward_asof(asked, streams, ["saas_stream_uuid", "connection_id"], "saas_version_id", "n").withColumnRenamed("nearest", "n")
        return registered.unionByName(reached.join(streams, ["saas_stream_uuid", "connection_id", "n"]).select("path", "version_id"))

    def check_repo_info(self) -> DataFrame:
        """Findings of the file ``repo_info``: that it is missing, or that it is no valid file of its kind."""
        suffixed = [n for n in source.names(self.spark, self.root, "") if re.fullmatch(r"repo_info(\.[0-9]+)?", n)]
        name = max(suffixed, key=lambda n: int(n.partition(".")[2] or -1), default=None)
        if name is None:
            return self.spark.createDataFrame([("repo_info", "MISSING", "repo_info", "repo_info not found", None)], verify.FINDING)
        return verify.check_json_files(source.files(self.spark, self.root, paths=[name]), b"RpiF", "repo_info")

    def verify(self, full: bool = False, live: bool = False) -> DataFrame:
        """Findings of everything that the files of ``file_map`` reach, or only those that ``live`` versions consist of;
        ``full`` also reads and checks every chunk.

        A problem is a finding and stops nothing; only a store that fails raises.
        """
        located = self.locations()
        if live:
            located = located.join(self.reachable_paths().select("path").distinct(), "path", "left_semi")
        path = F.col("path")
        states = located.filter("state <> 'OK'").select(*verify.finding("catalog", "CORRUPT", path, F.concat(F.lit("file is "), F.lower("state"))))
        entries = self.entries(located.filter("state = 'OK'"))
        broken = entries.filter("problem IS NOT NULL").select(*verify.finding("composition", "CORRUPT", path, F.col("problem"), path))
        mended = entries.filter("repaired").select("path").distinct().select(*verify.finding("composition", verify.REPAIRED, path, F.lit("chunk map repaired"), path))
        whole = entries.filter("kind = 'DATA'").withColumns({"first_k": F.lit(0).cast("bigint"), "last_k": F.col("template") - 1})
        reached = chunks.chunk_runs(whole, ["path"]).select("path", "stream", "bucket", "chunk", "n")
        referred = reached.groupBy("stream", "bucket").agg(F.min("path").alias("ref"))
        out = [self.check_repo_info(), states, broken, mended, verify.check_references(referred, self._buckets())]
        parsed = verify.bucket_chunks(self._buckets(referred))
        if full:
            out.append(verify.check_chunks(parsed))
            out.append(verify.check_fingerprints(verify.decoded(parsed, self._key_column()), self._fingerprints()))
        else:
            out.append(parsed.filter("stage IS NOT NULL").select("stage", "symptom", "path", "detail", "ref"))
        result = out[0]
        for more in out[1:]:
            result = result.unionByName(more)
        return result

    def inspect_bucket(self, stream: int, bucket: int) -> DataFrame:
        """How many chunks of which type a bucket has, and their stored bytes."""
        one = self.spark.range(1).select(F.lit(stream).cast("bigint").alias("stream"), F.lit(bucket).cast("bigint").alias("bucket"))
        return verify.bucket_chunks(self._buckets(one)).filter("chunk IS NOT NULL").groupBy("type", "encrypted").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("stored")).alias("stored_bytes"))

    def unreferenced_chunks(self) -> DataFrame:
        """Slots of buckets that no readable file refers to."""
        whole = self.entries(self.locations().filter("state = 'OK'")).filter("kind = 'DATA'").withColumns({"first_k": F.lit(0).cast("bigint"), "last_k": F.col("template") - 1})
        runs = chunks.chunk_runs(whole, [])
        used = intervals.merge_ranges(runs.select("stream", "bucket", F.col("chunk").alias("start"), (F.col("chunk") + F.col("n")).alias("end")), ["stream", "bucket"])
        slots = verify.bucket_chunks(self._buckets()).filter("chunk IS NOT NULL").select("stream", "bucket", "chunk")
        near = intervals.covering(slots, used, ["stream", "bucket"], "chunk", BUCKET_CHUNKS).select("stream", "bucket", "chunk")
        return slots.join(near, ["stream", "bucket", "chunk"], "left_anti")


def discover(spark: SparkSession, root: str, key: str | None = None) -> list[Repository]:
    """The repositories below a root; there are few, so their roots are collected."""
    return [Repository(spark, f"{root.rstrip('/')}/{r['root']}".rstrip("/"), key) for r in source.layouts(spark, root).orderBy("root").collect()]
