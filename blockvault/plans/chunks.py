"""Queries over files as chunks of a deduplicated pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as A
from ..operators import chunks as C
from ..registry import query, table

#: Characters of a chunk in these queries; the format's chunks have 4096 bytes.
SIZE = 64

_CHUNKS = f"""WITH c AS (
  SELECT doc_id, i AS chunk_no, substr(text, CAST({SIZE} * i + 1 AS BIGINT), {SIZE}) AS chunk
  FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / {SIZE}.0) AS BIGINT))) AS i FROM documents)
), f AS (SELECT doc_id, chunk_no, chunk, sha256(chunk) AS fingerprint FROM c)
"""
_POOL = (
    _CHUNKS
    + """, p AS (
  SELECT fingerprint, min(doc_id * 1000000 + chunk_no) AS seen, count(*) AS refs FROM f GROUP BY fingerprint
), a AS (
  SELECT fingerprint, refs, seen, row_number() OVER (ORDER BY seen) - 1 AS n FROM p
)
"""
)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", SIZE)


@query(_CHUNKS + "SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, fingerprint FROM f")
def chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "chunk_no", "fingerprint")


@query(_POOL + "SELECT fingerprint, refs AS \"references\", seen // 1000000 AS first_key, CAST(seen % 1000000 AS INTEGER) AS first_chunk, (1::BIGINT << 56) | ((n // 8192) << 16) | (n % 8192) AS address FROM a")
def dedup_pool_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pool(_chunks(spark, sf_dir), "doc_id")


@query(
    _CHUNKS
    + """SELECT lang, count(*) AS chunks, count(DISTINCT fingerprint) AS distinct_chunks, CAST(sum(length(chunk)) AS BIGINT) AS logical_chars
FROM f JOIN documents USING (doc_id) GROUP BY lang"""
)
def dedup_ratio_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.length("chunk").cast("bigint")
    # Chunks of a language meet by fingerprint first, so that a language with most rows is counted by many tasks.
    both = C.chunked(docs.withColumn("key", F.struct("doc_id", "lang")), "key", "text", SIZE)
    per = both.groupBy(F.col("key.lang").alias("lang"), "fingerprint").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("chars"))
    return per.groupBy("lang").agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("distinct_chunks"), F.sum("chars").alias("logical_chars"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey % 100 AS stream, l_orderkey * 37 AS bucket, l_partkey % 8192 AS chunk, l_suppkey * 811 AS k FROM lineitem),
b AS (SELECT *, bucket * 8192 + chunk + k AS lin, (stream << 56) | (bucket << 16) | chunk AS address FROM a)
SELECT l_orderkey, l_linenumber, address, address >> 56 AS stream, (address >> 16) & 1099511627775 AS bucket, address & 65535 AS chunk,
       (stream << 56) | ((lin // 8192) << 16) | (lin % 8192) AS advanced FROM b""")
def address_unpack_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn(
        "address", A.pack(F.col("l_suppkey") % 100, F.col("l_orderkey") * 37, F.col("l_partkey") % 8192)
    )
    a = F.col("address")
    return rows.select(
        "l_orderkey", "l_linenumber", "address", A.stream_of(a).alias("stream"), A.bucket_of(a).alias("bucket"), A.chunk_of(a).alias("chunk"), A.advance(a, F.col("l_suppkey") * 811).alias("advanced")
    )


@query("""WITH i AS (SELECT o_orderkey, o_orderkey * o_orderkey * 97 AS id FROM orders)
SELECT o_orderkey, '@data/Pool/7/' ||
  CASE WHEN id >> 30 > 0 THEN (id >> 30) || '/' ELSE '' END || CASE WHEN id >> 20 > 0 THEN (id >> 20) || '/' ELSE '' END ||
  CASE WHEN id >> 10 > 0 THEN (id >> 10) || '/' ELSE '' END || id || '.buk' AS pool_path,
  (id >> 10) << 10 AS group_start, id >> 24 AS sub_file, id & 16777215 AS sub_offset FROM i""")
def layer_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    ids = table(spark, sf_dir, "orders").select("o_orderkey", (key * key * 97).alias("id"))
    i = F.col("id")
    return ids.select("o_orderkey", A.pool_path(F.lit(7), i).alias("pool_path"), A.group_start(i).alias("group_start"), A.sub_file(i).alias("sub_file"), A.sub_offset(i).alias("sub_offset"))


@query("""WITH e AS (
  SELECT row_number() OVER () AS line, l_orderkey, l_linenumber, l_partkey * 8192 + 8185 AS base, l_linenumber + 2 AS template, CAST(l_quantity AS BIGINT) % 4 AS repeat FROM lineitem
), k AS (SELECT *, unnest(range(template * (repeat + 1))) AS k FROM e),
c AS (SELECT line, l_orderkey, l_linenumber, k, base + k % template AS lin FROM k),
r AS (SELECT *, lin // 8192 AS bucket, lag(lin) OVER (PARTITION BY line ORDER BY k) AS before FROM c),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR lin <> before + 1 OR before // 8192 <> bucket THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY k) AS run FROM r)
SELECT l_orderkey, l_linenumber, CAST(min(bucket) AS BIGINT) AS bucket, min(lin) % 8192 AS chunk, count(*) AS n, min(k) AS k FROM g GROUP BY line, l_orderkey, l_linenumber, run""")
def run_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        A.from_linear(F.lit(3), F.col("l_partkey") * 8192 + 8185).alias("address"),
        (F.col("l_linenumber") + 2).cast("bigint").alias("template"),
        (F.floor("l_quantity").cast("bigint") % 4).alias("repeat"),
    )
    whole = rows.withColumns({"first_k": F.lit(0).cast("bigint"), "last_k": F.col("template") * (F.col("repeat") + 1) - 1})
    return C.chunk_runs(whole, ["l_orderkey", "l_linenumber"]).drop("stream")


@query("SELECT doc_id, text FROM documents WHERE length(text) > 0")
def reassemble_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reassemble(_chunks(spark, sf_dir), "doc_id")


@query("SELECT doc_id, doc_id % 500 AS \"offset\", doc_id % 300 AS length, substr(text, CAST(doc_id % 500 + 1 AS BIGINT), CAST(doc_id % 300 AS BIGINT)) AS data FROM documents")
def read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 500).alias("offset"), (F.col("doc_id") % 300).alias("length"))
    return C.read_range(_chunks(spark, sf_dir), asked, "doc_id", SIZE)


@query("""SELECT doc_id, v AS view, substr(text, CAST(v * length(text) // 4 + 1 AS BIGINT), CAST((v + 1) * length(text) // 4 - v * length(text) // 4 AS BIGINT)) AS data
FROM documents, (SELECT unnest(range(4)) AS v)""")
def byte_range_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four views side by side of each file, which together are all of it: an offset and a length."""
    docs = table(spark, sf_dir, "documents").withColumn("view", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))))
    at = lambda v: F.floor(v * F.length("text") / 4).cast("int")
    first, last = at(F.col("view")), at(F.col("view") + 1)
    return docs.select("doc_id", "view", F.substring("text", first + 1, last - first).alias("data"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_linenumber * 40960 AS start, l_linenumber + 2 AS template, CAST(l_quantity AS BIGINT) % 4 AS repeat FROM lineitem),
w AS (SELECT *, greatest(CAST(floor((100000 - start) / 4096.0) AS BIGINT), 0) AS a, least(CAST(ceil((200000 - start) / 4096.0) AS BIGINT), template * (repeat + 1)) - 1 AS b FROM e)
SELECT l_orderkey, CAST(sum(b - a + 1) * 4096 AS BIGINT) AS planned_bytes FROM w WHERE a <= b GROUP BY l_orderkey""")
def planned_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        (F.col("l_linenumber") * 40960).cast("bigint").alias("file_offset"),
        (F.col("l_linenumber") + 2).cast("bigint").alias("template"),
        (F.floor("l_quantity").cast("bigint") % 4).alias("repeat"),
    )
    plan = C.planned(rows, F.lit(100000), F.lit(200000))
    return plan.groupBy("l_orderkey").agg((F.sum(F.col("last_k") - F.col("first_k") + 1) * 4096).alias("planned_bytes"))


_REFS = _POOL + ", r AS (SELECT doc_id, chunk_no, f.fingerprint, n, n // 1000 AS bucket, n % 1000 AS slot FROM f JOIN a USING (fingerprint))\n"


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of documents to pool chunks, in buckets of 1000 chunks."""
    chunks = _chunks(spark, sf_dir)
    placed = C.pool(chunks, "doc_id").select("fingerprint", A.linear(F.col("address")).alias("n"))
    refs = chunks.select("doc_id", "chunk_no", "fingerprint").join(placed, "fingerprint")
    return refs.withColumn("address", A.pack(F.lit(1), F.floor(F.col("n") / 1000), F.col("n") % 1000))


@query(_REFS + "SELECT CAST(1 AS BIGINT) AS stream, bucket, count(DISTINCT slot) AS chunks, min(slot) AS first_chunk, max(slot) AS last_chunk, count(*) AS \"references\" FROM r GROUP BY bucket")
def bucket_group_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bucket_plan(_refs(spark, sf_dir))


@query(_REFS + "SELECT bucket, min(doc_id) AS claimed_by, count(DISTINCT doc_id) AS reached_by FROM r GROUP BY bucket")
def reachable_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bucket that a document reaches, claimed by the first."""
    pairs = _refs(spark, sf_dir).select(A.bucket_of(F.col("address")).alias("bucket"), "doc_id").distinct()
    return pairs.groupBy("bucket").agg(F.min("doc_id").alias("claimed_by"), F.count(F.lit(1)).alias("reached_by"))


@query(_REFS + "SELECT DISTINCT fingerprint FROM r WHERE doc_id % 10 = 3 AND fingerprint NOT IN (SELECT fingerprint FROM r WHERE doc_id % 10 <> 3)")
def unreachable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that nothing would reach if every tenth version were deleted."""
    chunks = _chunks(spark, sf_dir)
    live = F.max((F.col("doc_id") % 10 != 3).cast("int"))
    return chunks.groupBy("fingerprint").agg(live.alias("live")).filter("live = 0").select("fingerprint")


@query(
    _CHUNKS
    + """SELECT doc_id, count(*) AS chunks, CAST(sum(CASE WHEN regexp_matches(chunk, '[aA]') THEN length(chunk) ELSE 0 END) AS BIGINT) AS bytes_written,
CAST(sum(CASE WHEN regexp_matches(chunk, '[aA]') THEN 0 ELSE length(chunk) END) AS BIGINT) AS zero_bytes FROM f GROUP BY doc_id"""
)
def export_sparse_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a sparse export in which chunks without a letter a stand for zero chunks, which are not written."""
    data = F.col("chunk").rlike("[aA]")
    size = F.length("chunk").cast("bigint")
    return _chunks(spark, sf_dir).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.when(data, size).otherwise(0)).alias("bytes_written"), F.sum(F.when(data, 0).otherwise(size)).alias("zero_bytes")
    )
