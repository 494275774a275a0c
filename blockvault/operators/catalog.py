"""Catalog relations: connections, workloads, versions, file locations.  Joins of small key sets, all declarative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.formats import epoch_seconds
from ..functions.names import text_after_second_underscore, workload_name

#: Statuses of versions that landed data: fixed values.
LANDED = ("COMPLETED", "PARTIAL", "CANCELED")
#: file_map.status: fixed values of the format.
COMPLETE, CORRUPTED, TAINTED = 2, 4, 5


def link_names(links: DataFrame) -> DataFrame:
    """(connection_id, display_name) from link names ``<connection_id>_<other>_<name>``: the first link that has a name.

    An id may hold underscores itself, so a link is offered to each id that it begins with, up to an underscore;
    the join with connections is then one by equality.  The name is what follows the second underscore of all.
    """
    rows = links.select("key", text_after_second_underscore(F.col("key")).alias("name"), F.split("key", "_").alias("parts")).filter("name IS NOT NULL")
    begins = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", F.lit(1), i), "_"))
    return rows.select("key", "name", F.explode(begins).alias("connection_id")).groupBy("connection_id").agg(F.min_by("name", "key").alias("display_name"))


def connections(config: DataFrame, versions: DataFrame, workloads: DataFrame, links: DataFrame) -> DataFrame:
    """One row per connection: ids, display_name, namespaces, workloads and versions (0 where there are none).

    Counts hold deleted versions too.  Namespaces are the distinct non-empty ones of the connection's workloads, in
    the order of workload ids.
    """
    pairs = versions.groupBy("connection_config_id", "workload_id").agg(F.count(F.lit(1)).alias("n"))
    space = workloads.select("workload_id", F.nullif(F.get_json_object("workload_spec", "$.namespace"), F.lit("")).alias("namespace"))
    joined = pairs.join(space, "workload_id", "left")
    first = joined.filter("namespace IS NOT NULL").groupBy("connection_config_id", "namespace").agg(F.min("workload_id").alias("at"))
    spaces = first.groupBy("connection_config_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "namespace"))), lambda x: x["namespace"]).alias("namespaces"))
    counts = pairs.groupBy("connection_config_id").agg(F.count(F.lit(1)).alias("workloads"), F.sum("n").alias("versions"))
    out = config.join(counts, "connection_config_id", "left").join(spaces, "connection_config_id", "left").join(link_names(links), "connection_id", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "connection_config_id", "connection_id", F.coalesce("display_name", "connection_id").alias("display_name"),
        F.coalesce("namespaces", F.array().cast("array<string>")).alias("namespaces"), F.coalesce("workloads", zero).alias("workloads"), F.coalesce("versions", zero).alias("versions"),
    )


def workloads_of(workloads: DataFrame, versions: DataFrame, connection: Column) -> DataFrame:
    """The workloads that have versions of the connections that the condition picks, with their display names."""
    wanted = versions.filter(connection).select("workload_id").distinct()
    spec = F.col("workload_spec")
    return workloads.join(wanted, "workload_id", "left_semi").withColumn("display_name", workload_name(spec, F.col("workload_type")))


def version_status(spec: Column) -> Column:
    """(status, start_time, end_time, additional_meta) of a version's spec; nulls where it is no JSON object."""
    of = "struct<status:struct<status:string,start_time:string,end_time:string,additional_meta:string>>"
    return F.from_json(spec, of)["status"]


def backup_epoch(status: Column) -> Column:
    """The start, else the end, in epoch seconds; 0 and texts that are no numbers are unset."""
    return F.coalesce(epoch_seconds(status["start_time"]), epoch_seconds(status["end_time"]))


def browsable_versions(versions: DataFrame, meta: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Versions that landed data, with their metadata directory where there is one, newest first by ``place``.

    An unreadable spec hides a version.  Versions without a time come last; ties go to the higher id.
    """
    rows = versions.withColumn("_status", version_status(F.col("version_spec"))).filter(F.col("_status.status").isin(*LANDED))
    if not include_deleted:
        rows = rows.filter(F.coalesce("deleted", F.lit(0)) == 0)
    names = F.from_json("meta_filenames", T.ArrayType(T.StringType()))
    one = meta.groupBy("version_uid").agg(F.min("target_meta_path").alias("target_meta_path"), F.min("meta_filenames").alias("meta_filenames"))
    out = rows.join(one, "version_uid", "left").withColumns({"epoch": backup_epoch(F.col("_status")), "status": F.col("_status.status"), "files": names})
    w = Window.partitionBy("workload_id").orderBy(F.col("epoch").desc_nulls_last(), F.col("version_id").desc())
    return out.select("version_id", "workload_id", "version_uid", "status", "epoch", "target_meta_path", "files").withColumn("place", F.row_number().over(w))


def locate_files(paths: DataFrame, file_map: DataFrame, file_meta: DataFrame) -> DataFrame:
    """Where each path's record is, and whether it can be read: OK, CORRUPT or MISSING.

    A path that file_meta has more than once takes its first row, that of the smallest fid; one that file_map has more
    than once takes the least of its rows.
    """
    others = [c for c in file_map.columns if c != "path"]
    file_map = file_map.groupBy("path").agg(F.min(F.struct(*others)).alias("_row")).select("path", *[F.col(f"_row.{c}").alias(c) for c in others])
    sizes = file_meta.groupBy("path").agg(F.min_by("file_size", "fid").alias("file_size"))
    rows = paths.join(file_map, "path", "left").join(sizes, "path", "left")
    state = F.when(F.col("status") == COMPLETE, "OK").when(F.col("status").isin(CORRUPTED, TAINTED), "CORRUPT").otherwise("MISSING")
    return rows.withColumn("state", state)


def registrations(files: DataFrame, file_meta: DataFrame, file_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A version's files as (registered, missing): fids that lead to a path of file_map, and those that do not."""
    found = files.join(file_meta, "fid").join(file_map.select("path"), "path", "left_semi")
    return found, files.join(found.select("version_id", "fid"), ["version_id", "fid"], "left_anti")


def group_workloads(workloads: DataFrame) -> DataFrame:
    """Workloads by platform, tenant and kind: devices by their type, SaaS workloads by tenant or domain and application."""
    at = lambda p: F.get_json_object("workload_spec", p)
    saas = F.col("workload_type").isin("M365", "GW")
    keyed = workloads.select(
        F.when(saas, F.col("workload_type")).otherwise("DEVICE").alias("platform"), F.when(saas, F.coalesce(at("$.spec.tenant_id"), at("$.spec.domain"), F.lit(""))).otherwise("").alias("tenant"),
        F.when(saas, at("$.spec.workload_type")).otherwise(F.col("workload_type")).alias("kind"), "workload_id",
    )
    return keyed.groupBy("platform", "tenant", "kind").agg(F.count(F.lit(1)).alias("workloads"), F.min("workload_id").alias("first"))


def stream_versions(versions: DataFrame, snapshots: DataFrame, infos: DataFrame) -> DataFrame:
    """The generation that each SaaS version was written to: snapshot uuid, snapshot id, stream version."""
    return versions.join(snapshots.select(F.col("snapshot_uuid").alias("saas_snapshot_uuid"), "snapshot_id"), "saas_snapshot_uuid").join(
        infos.select("snapshot_id", F.col("version_id").alias("saas_version_id"), "stream_version"), ["snapshot_id", "saas_version_id"]
    )


def prefix_scan(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose text begins with the prefix, which is pushed to the scan; % and _ are ordinary characters."""
    return df.filter(F.col(column).startswith(prefix))


def object_address(object_db_id: Column) -> tuple[Column, Column, Column]:
    """(stream uuid, offset, length) of ``<uuid>_<offset>_<length>``, parsed from the right; nulls if it is none."""
    shape = r"^(.+)_([0-9]+)_([0-9]+)$"
    part = lambda k: F.nullif(F.regexp_extract(object_db_id, shape, k), F.lit(""))
    return part(1), part(2).cast("bigint"), part(3).cast("bigint")


def named_objects(versions: DataFrame, spec: str = "version_spec") -> DataFrame:
    """(version_id, name, object_id) from the versions' additional metadata, JSON within JSON; none where unreadable."""
    meta = F.from_json(version_status(F.col(spec))["additional_meta"], "struct<object_db_id:string,db_object_ids:struct<db_objects:array<struct<name:string,object_id:string>>>>")
    return versions.select("version_id", F.explode(meta["db_object_ids"]["db_objects"]).alias("o")).select("version_id", "o.name", "o.object_id")


def first_alias(aliases: DataFrame, existing: DataFrame, keys: list[str], rank: str, name: str) -> DataFrame:
    """Of ordered aliases the first whose table exists."""
    found = aliases.join(existing, [*keys, name], "left_semi")
    return found.groupBy(*keys).agg(F.min_by(name, rank).alias(name), F.min(rank).alias(rank))


def group_labels(members: DataFrame, definitions: DataFrame, item: str, group: str, name: str, order: str) -> DataFrame:
    """The names of the groups of each item, in the order of the memberships; a group without a name keeps its id."""
    named = members.join(definitions.select(group, F.col(name).alias("_name")), group, "left")
    label = F.coalesce(F.nullif(F.col("_name"), F.lit("")), F.col(group).cast("string"))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), label.alias("l"))))
    return named.groupBy(item).agg(F.array_join(F.transform(listed, lambda x: x["l"]), ", ").alias("labels"))
