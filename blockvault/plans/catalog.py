"""Queries over catalogs; orders, customers and nations play versions, workloads and connections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..registry import query, table


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of their customers; the specs of some are no JSON, and some have no start time."""
    k = F.col("o_orderkey")
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("FAILED")
    spec = F.concat(
        F.lit('{"status":{"status":"'), status, F.lit('","start_time":"'), F.when(k % 5 == 0, "0").otherwise(at), F.lit('","end_time":'), at, F.lit("}}")
    )
    rows = table(spark, sf_dir, "orders").select(
        k.alias("version_id"), F.col("o_custkey").alias("workload_id"), F.concat(F.lit("uid"), k.cast("string")).alias("version_uid"),
        F.when(k % 11 == 0, 1).otherwise(0).alias("deleted"), F.when(k % 13 == 0, "{broken").otherwise(spec).alias("version_spec"),
    )
    nations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("workload_id"), F.col("c_nationkey").cast("bigint").alias("connection_config_id"))
    return rows.join(nations, "workload_id")


def _workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    saas = F.col("c_custkey") % 3 == 0
    spec = F.when(
        saas, F.concat(F.lit('{"namespace":"'), "c_mktsegment", F.lit('","spec":{"workload_type":"MAIL","tenant_id":"t'), (F.col("c_custkey") % 4).cast("string"), F.lit('"}}'))
    ).otherwise(F.concat(F.lit('{"namespace":"'), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(""), F.lit('","spec":{"workload_name":"'), "c_name", F.lit('"}}')))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("workload_id"), F.when(saas, "M365").when(F.col("c_custkey") % 3 == 1, "VM").otherwise("PC").alias("workload_type"), spec.alias("workload_spec")
    )


@query("""WITH v AS (SELECT c_nationkey AS k, o_custkey AS w, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
s AS (SELECT k, c_mktsegment AS namespace, min(w) AS w0 FROM v JOIN customer ON c_custkey = w WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0 GROUP BY 1, 2),
a AS (SELECT k, string_agg(namespace, ',' ORDER BY w0) AS namespaces FROM s GROUP BY k), c AS (SELECT k, count(*) AS workloads, CAST(sum(n) AS BIGINT) AS versions FROM v GROUP BY k)
SELECT CAST(n_nationkey AS BIGINT) AS connection_config_id, 'c' || n_nationkey AS connection_id, CASE WHEN n_nationkey % 4 = 0 THEN 'c' || n_nationkey ELSE n_name || '_x' END AS display_name,
coalesce(namespaces, '') AS namespaces, coalesce(workloads, 0) AS workloads, coalesce(versions, 0) AS versions FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN a ON a.k = n_nationkey""")
def connections_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    ident = F.concat(F.lit("c"), F.col("n_nationkey").cast("string"))
    config = nation.select(F.col("n_nationkey").cast("bigint").alias("connection_config_id"), ident.alias("connection_id"))
    links = nation.filter("n_nationkey % 4 <> 0").select(F.concat(ident, F.lit("_o_"), "n_name", F.lit("_x")).alias("key"))
    out = C.connections(config, _versions(spark, sf_dir), _workloads(spark, sf_dir), links)
    return out.withColumn("namespaces", F.array_join("namespaces", ","))


@query("""SELECT c_custkey AS workload_id, CASE c_custkey % 3 WHEN 0 THEN 'MAIL' ELSE c_name END AS display_name FROM customer
WHERE c_nationkey = 3 AND c_custkey IN (SELECT o_custkey FROM orders)""")
def workloads_of_connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.workloads_of(_workloads(spark, sf_dir), _versions(spark, sf_dir), F.col("connection_config_id") == 3)
    return found.select("workload_id", "display_name")


@query("""WITH v AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(epoch(o_orderdate) AS BIGINT) AS epoch FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0 AND o_orderstatus IN ('F', 'P'))
SELECT o_orderkey AS version_id, o_custkey AS workload_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' ELSE 'PARTIAL' END AS status, epoch,
CASE WHEN o_orderkey % 2 = 0 THEN '/meta/' || o_orderkey END AS target_meta_path, CASE WHEN o_orderkey % 2 = 0 THEN 'a' || o_orderkey END AS first_file,
CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY epoch DESC, o_orderkey DESC) AS INTEGER) AS place FROM v""")
def browsable_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _versions(spark, sf_dir)
    key = F.col("version_id").cast("string")
    meta = versions.filter("version_id % 2 = 0").select(
        "version_uid", F.concat(F.lit("/meta/"), key).alias("target_meta_path"), F.concat(F.lit('["a'), key, F.lit('", "target.db"]')).alias("meta_filenames")
    )
    out = C.browsable_versions(versions, meta)
    return out.select("version_id", "workload_id", "status", "epoch", "target_meta_path", F.col("files")[0].alias("first_file"), "place")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN 'OK' WHEN 4 THEN 'CORRUPT' WHEN 5 THEN 'CORRUPT' ELSE 'MISSING' END AS state, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 6 END AS status,
CASE WHEN o_custkey % 2 = 0 THEN o_custkey * 100 END AS file_size FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT o_orderkey, 'MISSING', NULL, CASE WHEN o_custkey % 2 = 0 THEN o_custkey * 100 END FROM orders WHERE o_orderkey % 7 = 0""")
def locate_file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("path", F.concat(F.lit("f/"), F.col("o_orderkey").cast("string")))
    file_map = rows.filter("o_orderkey % 7 <> 0").select("path", (F.col("o_orderkey") % 6).alias("status"))
    size = F.col("o_custkey") * 100
    file_meta = rows.filter("o_custkey % 2 = 0").select("path", F.explode(F.array(F.struct(F.lit(1).alias("fid"), size.alias("file_size")), F.struct(F.lit(2).alias("fid"), (size + 1).alias("file_size")))).alias("m"))
    file_meta = file_meta.select("path", "m.fid", "m.file_size")
    return C.locate_files(rows.select("o_orderkey", "path"), file_map, file_meta).select("o_orderkey", "state", "status", "file_size")


@query("""SELECT l_orderkey AS version_id, l_partkey AS fid FROM lineitem WHERE l_partkey % 5 = 0 OR l_partkey % 7 = 0 GROUP BY 1, 2""")
def missing_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of versions that lead to no record: their fid has no path, or the path has no record."""
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_partkey").alias("fid")).distinct()
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fid"), F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("path"))
    return C.registrations(files, part.filter("fid % 5 <> 0"), part.filter("fid % 7 <> 0"))[1]


@query("""WITH k AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'M365' ELSE 'DEVICE' END AS platform, CASE WHEN c_custkey % 3 = 0 THEN 't' || (c_custkey % 4) ELSE '' END AS tenant,
CASE c_custkey % 3 WHEN 0 THEN 'MAIL' WHEN 1 THEN 'VM' ELSE 'PC' END AS kind, c_custkey FROM customer) SELECT platform, tenant, kind, count(*) AS workloads, min(c_custkey) AS first FROM k GROUP BY 1, 2, 3""")
def group_workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.group_workloads(_workloads(spark, sf_dir))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN nullif(event_id * 10, 0) END AS epoch FROM events""")
def version_status_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses read from JSON: some of it is broken, and a time of 0 is unset."""
    spec = F.concat(F.lit('{"status":{"status":"x","start_time":"'), F.when(F.col("event_id") % 3 == 0, (F.col("event_id") * 10).cast("string")).otherwise("0"), F.lit('","end_time":0}}'))
    rows = table(spark, sf_dir, "events").select("event_id", "props", F.when(F.col("event_id") % 3 == 1, "{no").otherwise(spec).alias("spec"))
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), C.backup_epoch(C.version_status(F.col("spec"))).alias("epoch"))


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://www')")
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prefix_scan(table(spark, sf_dir, "pages").select("page_id", "url"), "url", "https://www")


@query("""SELECT l_orderkey, string_agg(CASE WHEN l_suppkey % 4 = 0 THEN CAST(l_suppkey AS VARCHAR) ELSE s_name END, ', ' ORDER BY l_linenumber, CASE WHEN l_suppkey % 4 = 0 THEN CAST(l_suppkey AS VARCHAR) ELSE s_name END) AS labels FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey""")
def group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the suppliers of an order as groups; some groups have no definition."""
    members = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("g"), "l_linenumber")
    definitions = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("g"), "s_name")
    return C.group_labels(members, definitions, "l_orderkey", "g", "s_name", "l_linenumber")


@query("""SELECT o_orderkey, 's' || o_custkey || '_x' AS stream, o_orderkey * 64 AS "offset", o_custkey AS length FROM orders""")
def object_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("_", F.concat(F.lit("s"), F.col("o_custkey").cast("string")), F.lit("x"), (F.col("o_orderkey") * 64).cast("string"), F.col("o_custkey").cast("string"))
    stream, offset, length = C.object_address(F.col("id"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("id")).select("o_orderkey", stream.alias("stream"), offset.alias("offset"), length.alias("length"))


@query("""SELECT o_orderkey AS version_id, n AS name, n || o_orderkey AS object_id FROM orders, (SELECT unnest(['mail_db', 'contact_db']) AS n) WHERE o_orderkey % 3 <> 0""")
def service_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service databases by name, from JSON within the JSON of versions."""
    key = F.col("o_orderkey").cast("string")
    objects = F.array(*[F.struct(F.lit(n).alias("name"), F.concat(F.lit(n), key).alias("object_id")) for n in ("mail_db", "contact_db")])
    inner = F.to_json(F.struct(F.struct(objects.alias("db_objects")).alias("db_object_ids")))
    spec = F.to_json(F.struct(F.struct(F.lit("COMPLETED").alias("status"), inner.alias("additional_meta")).alias("status")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"), F.when(F.col("o_orderkey") % 3 != 0, spec).alias("version_spec"))
    return C.named_objects(rows)


@query("""SELECT o_custkey, arg_min(name, r) AS name, min(r) AS rank FROM (SELECT DISTINCT o_custkey, 'db' || o_orderkey % 3 AS name, CAST((o_orderkey % 3 + o_custkey) % 3 AS INTEGER) AS r FROM orders) GROUP BY o_custkey""")
def first_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the ordered aliases of a service database that exists."""
    name = F.concat(F.lit("db"), (F.col("o_orderkey") % 3).cast("string"))
    existing = table(spark, sf_dir, "orders").select("o_custkey", name.alias("name")).distinct()
    aliases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("i"))
    aliases = aliases.select("o_custkey", F.concat(F.lit("db"), F.col("i").cast("string")).alias("name"), ((F.col("i") + F.col("o_custkey")) % 3).cast("int").alias("rank"))
    return C.first_alias(aliases, existing, ["o_custkey"], "rank", "name")


@query("""SELECT o_orderkey AS version_id, o_custkey % 50 AS stream_version FROM orders WHERE o_orderkey % 4 <> 0""")
def stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    uuid = F.concat(F.lit("u"), F.col("o_orderkey").cast("string"))
    versions = orders.select(F.col("o_orderkey").alias("version_id"), uuid.alias("saas_snapshot_uuid"), (F.col("o_orderkey") + 1).alias("saas_version_id"))
    snapshots = orders.filter("o_orderkey % 4 <> 0").select(uuid.alias("snapshot_uuid"), (F.col("o_orderkey") * 2).alias("snapshot_id"))
    infos = orders.select((F.col("o_orderkey") * 2).alias("snapshot_id"), (F.col("o_orderkey") + 1).alias("version_id"), (F.col("o_custkey") % 50).alias("stream_version"))
    return C.stream_versions(versions, snapshots, infos).select("version_id", "stream_version")
