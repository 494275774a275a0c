"""Queries over trees; urls, parts and nations play directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trees as T
from ..registry import query, table

_PATHS = """WITH s AS (SELECT page_id, [x for x in string_split(url, '/') if x <> ''] AS p FROM pages), n AS (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS n FROM s)
"""


@query(_PATHS + "SELECT DISTINCT nullif(array_to_string(p[1:n - 1], '/'), '') AS parent, array_to_string(p[1:n], '/') AS id, p[n] AS name, n = len(p) AS is_leaf FROM n")
def path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.path_tree(table(spark, sf_dir, "pages"), "url")


@query(_PATHS + "SELECT page_id, CAST(n - 1 AS INTEGER) AS depth, array_to_string(p[1:n], '/') AS ancestor FROM n")
def ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ancestors(table(spark, sf_dir, "pages"), "page_id", "url")


_PARTS = """WITH n AS (SELECT CASE WHEN p_partkey // 4 > 0 THEN CAST(p_partkey // 4 AS VARCHAR) END AS parent, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_partkey * 4 > (SELECT max(p_partkey) FROM part) AS is_leaf FROM part)
"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    most = part.agg(F.max("p_partkey")).first()[0] or 0
    rows = part.withColumn("up", F.floor(F.col("p_partkey") / 4).cast("string"))
    return T.recursive_nodes(rows, "p_partkey", "up", "p_name", F.col("p_partkey") * 4 > most, root="0")


@query(_PARTS + """, o AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY is_leaf, name, id) - 1 AS r FROM n)
SELECT parent, id, name, is_leaf, CAST(r // 3 AS INTEGER) AS page, CAST(r % 3 AS INTEGER) AS place FROM o""")
def children_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of three children of all nodes, folders first."""
    return T.pages(_parts(spark, sf_dir), 3)


@query(_PARTS + "SELECT parent, id, name, is_leaf FROM n WHERE parent = '5' ORDER BY is_leaf, name, id LIMIT 2 OFFSET 1")
def children_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.children(_parts(spark, sf_dir), "5", 1, 2)


@query("WITH RECURSIVE " + _PARTS[5:] + """, t(ancestor, id, depth) AS (SELECT id, id, 0 FROM n UNION ALL SELECT t.ancestor, n.id, t.depth + 1 FROM n JOIN t ON n.parent = t.id)
SELECT ancestor, id, CAST(depth AS INTEGER) AS depth FROM t""")
def recursive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node below every ancestor, by doubling paths."""
    return T.closure(_parts(spark, sf_dir))


@query("WITH RECURSIVE " + _PARTS[5:] + """, t(id, depth) AS (SELECT id, 0 FROM n WHERE parent IS NULL UNION ALL SELECT n.id, t.depth + 1 FROM n JOIN t ON n.parent = t.id)
SELECT id, CAST(depth AS INTEGER) AS depth FROM t""")
def subtree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole tree from its top."""
    return T.depths(_parts(spark, sf_dir))


@query("""WITH u AS (SELECT NULL AS parent, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, false AS is_leaf FROM nation
UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'c' || c_custkey, c_name, true FROM customer), o AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY is_leaf, name, id) - 1 AS r FROM u)
SELECT parent, id, name, is_leaf, CAST(r // 10 AS INTEGER) AS page, CAST(r % 10 AS INTEGER) AS place FROM o""")
def folder_then_leaf_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = table(spark, sf_dir, "nation").select(F.lit(None).cast("string").alias("parent"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.lit(False).alias("is_leaf"))
    leaves = table(spark, sf_dir, "customer").withColumn("key", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    return T.pages(T.folders_and_leaves(folders, leaves, "c_nationkey", "key", "c_name"), 10)


@query("""WITH r AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN 'My contacts' ELSE c_mktsegment END AS g, CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer)
SELECT NULL AS parent, g AS id, g AS name, false AS is_leaf FROM r GROUP BY g UNION ALL SELECT g, id, name, true FROM r""")
def synthetic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("g", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")))
    return T.value_groups(rows, "g", "c_custkey", "c_name", "My contacts")


@query("""SELECT NULL AS parent, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, false AS is_leaf FROM nation WHERE n_regionkey < 3
UNION ALL SELECT CAST(s_nationkey AS VARCHAR), CAST(s_suppkey AS VARCHAR), s_name, true FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""")
def named_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    definitions = table(spark, sf_dir, "nation").filter("n_regionkey < 3").withColumnRenamed("n_nationkey", "k")
    return T.named_groups(definitions, table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "k"), "k", "n_name", "s_suppkey", "s_name")


@query("""SELECT NULL AS parent, CAST(r_regionkey AS VARCHAR) AS id, r_name AS name, false AS is_leaf FROM region
UNION ALL SELECT CASE WHEN p_partkey // 6 = 0 THEN CAST(p_partkey % 5 AS VARCHAR) ELSE (p_partkey % 5) || '/' || (p_partkey // 6) END, (p_partkey % 5) || '/' || p_partkey, p_name, p_size > 25 FROM part""")
def named_group_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    definitions = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("g"), "r_name", F.lit(0).cast("bigint").alias("root"))
    rows = table(spark, sf_dir, "part").withColumns({"g": F.col("p_partkey") % 5, "up": F.floor(F.col("p_partkey") / 6)})
    return T.named_group_trees(definitions, rows, "g", "r_name", "root", "p_partkey", "up", "p_name", F.col("p_size") > 25)


@query("""WITH c AS (SELECT c_custkey, c_name, CASE c_custkey % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'private' ELSE 'standard' END AS k FROM customer)
SELECT NULL AS parent, 'category:' || k AS id, CASE k WHEN 'standard' THEN 'Standard channels' ELSE 'Private channels' END AS name, false AS is_leaf, CASE k WHEN 'standard' THEN 0 ELSE 1 END AS place FROM c GROUP BY k
UNION ALL SELECT 'category:' || k, CAST(c_custkey AS VARCHAR), c_name, true, NULL FROM c""")
def categorized_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.lit(None).cast("string").alias("parent"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.lit(True).alias("is_leaf"))
    k = F.col("id").cast("int") % 3
    kind = F.when(k == 0, "standard").when(k == 1, "private").otherwise("odd")
    return T.categorized(rows, kind, [("standard", "Standard channels"), ("private", "Private channels"), ("shared", "Shared channels")])


@query("""WITH o AS (SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 5 <> 0), n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE p_name END AS name FROM part WHERE p_partkey % 6 <> 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'ADDED' WHEN n.id IS NULL THEN 'REMOVED' ELSE 'RELABELLED' END AS change FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.name <> n.name""")
def tree_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    new = part.filter("id % 6 <> 0").withColumn("name", F.when(F.col("id") % 7 == 0, "x").otherwise(F.col("name")))
    return T.difference(part.filter("id % 5 <> 0"), new)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '_single' ELSE 'u' || (p_partkey % 4) END AS disk, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS "index" FROM part""")
def disk_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of disks by their names; names of another shape are disks of their own."""
    key = F.col("p_partkey").cast("string")
    split = F.concat(F.lit("0/dev/ses/D(u"), (F.col("p_partkey") % 4).cast("string"), F.lit(")O(4096)V(v)S("), F.col("p_size").cast("string"), F.lit(")_2.img"))
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("0/dev/ses/a_"), key, F.lit(".img"))).otherwise(split)
    rows = table(spark, sf_dir, "part").select("p_partkey", T.disk_key(F.col("p_partkey"), path).alias("k"))
    return rows.select("p_partkey", "k.disk", "k.index")
