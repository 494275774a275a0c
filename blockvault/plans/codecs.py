"""Round trips of the codecs over whole tables: encoded, perhaps damaged, decoded; the SQL is the untouched input."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec as K
from ..registry import query, table

_KEY = "00112233445566778899aabbccddeeff00112233445566778899aabbccddeeff"


def _key() -> Column:
    return F.unhex(F.lit(_KEY))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of each document in chunks as the format has them: 4096 bytes, the last one padded with zeros.

    A row has doc_id, the chunk's place, the number of the document's chunks, one at least, and the block.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("raw"))
    docs = docs.withColumn("chunks", F.greatest(F.ceil(F.length("raw") / 4096), F.lit(1)).cast("int"))
    rows = docs.select("doc_id", "raw", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("place"))
    return rows.select("doc_id", "place", "chunks", F.rpad(F.substring("raw", F.col("place") * 4096 + 1, F.lit(4096)), 4096, F.unhex(F.lit("00"))).alias("block"))


def _round_trip(spark: SparkSession, sf_dir: str, kind: int) -> DataFrame:
    """Whether every chunk of a document comes back."""
    rows = blocks(spark, sf_dir).withColumn("stored", K.compressed(F.lit(kind), F.col("block")))
    same = K.decompressed(F.lit(kind), F.col("stored")) == F.col("block")
    return rows.select("doc_id", F.coalesce(same, F.lit(False)).alias("same")).groupBy("doc_id").agg(F.bool_and("same").alias("same"))


_BLOCK_SQL = "SELECT doc_id, true AS same FROM documents"


@query(_BLOCK_SQL)
def roundtrip_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, K.ZSTD)


@query(_BLOCK_SQL)
def roundtrip_lz4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, K.LZ4)


@query("SELECT doc_id, text AS decoded FROM documents")
def roundtrip_ctr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through AES-256-CTR and back, with the IV of an address."""
    iv = K.chunk_iv(F.col("doc_id") * 65537)
    rows = table(spark, sf_dir, "documents").select("doc_id", K.ctr(F.encode("text", "utf-8"), _key(), iv).alias("secret"), iv.alias("iv"))
    return rows.select("doc_id", F.decode(K.ctr(F.col("secret"), _key(), F.col("iv")), "utf-8").alias("decoded"))


@query("SELECT c_custkey, sha256(c_name) AS vault_key, c_custkey % 2 = 0 AS right_key FROM customer")
def roundtrip_gcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vault keys wrapped and unwrapped; a wrong user key is seen by the tag."""
    ident = F.lpad(F.col("c_custkey").cast("string"), 12, "k")
    key = F.unhex(F.sha2(F.col("c_name").cast("binary"), 256))
    rows = table(spark, sf_dir, "customer").select("c_custkey", key.alias("key"), ident.alias("ident"), K.wrap_key(key, _key(), ident).alias("wrapped"))
    other = F.when(F.col("c_custkey") % 2 == 0, _key()).otherwise(F.unhex(F.lit("ff" * 32)))
    tried = K.unwrap_key(F.col("wrapped"), other, F.col("ident")).isNotNull()
    return rows.select("c_custkey", F.lower(F.hex(K.unwrap_key(F.col("wrapped"), _key(), F.col("ident")))).alias("vault_key"), tried.alias("right_key"))


@query("""SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, CASE l_partkey % 4 WHEN 3 THEN 4 ELSE CAST(l_partkey % 4 AS INTEGER) END AS type,
CASE l_partkey % 4 WHEN 0 THEN 4096 WHEN 3 THEN 0 ELSE CAST(l_suppkey * 31 % 4095 + 1 AS INTEGER) END AS size FROM lineitem""")
def roundtrip_sizestore(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_partkey") % 4 == 3, 4).otherwise(F.col("l_partkey") % 4).cast("int")
    size = (F.col("l_suppkey") * 31 % 4095 + 1).cast("int")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", kind.alias("type"), size.alias("size")))).alias("e"))
    packed = rows.select("l_orderkey", F.col("e.l_linenumber").alias("lines"), K.size_store(F.col("e.type"), F.col("e.size")).alias("store"))
    opened = packed.select("l_orderkey", F.explode(F.arrays_zip("lines", K.size_store_entries(F.col("store"), F.size("lines")).alias("entry"))).alias("x"))
    return opened.select("l_orderkey", F.col("x.lines").alias("l_linenumber"), "x.entry.type", "x.entry.size")


@F.pandas_udf(T.BinaryType())
def _pack_map(entries: pd.Series) -> pd.Series:
    return pd.Series([K.pack_chunk_map([(e["kind"], e["at"], e["address"], e["template"], e["repeat"], e["inherit"]) for e in row]) for row in entries])


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) * 4096 AS file_offset, CASE WHEN l_returnflag = 'R' THEN 'ZERO' ELSE 'DATA' END AS kind, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_partkey * 65536 END AS address,
l_suppkey + 1 AS template, CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS repeat, l_linestatus = 'F' AS inherit,
CAST((l_suppkey + 1) * (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 1 + CAST(l_quantity AS BIGINT) END) * 4096 AS BIGINT) AS length FROM lineitem""")
def roundtrip_chunkmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.col("l_returnflag") == "R"
    entry = F.struct(
        F.col("l_linenumber").cast("bigint").alias("at"), F.when(zero, K.ZERO).otherwise(K.MAPPING).alias("kind"), (F.col("l_partkey") * 65536).alias("address"),
        (F.col("l_suppkey") + 1).alias("template"), F.floor("l_quantity").cast("bigint").alias("repeat"), (F.col("l_linestatus") == "F").alias("inherit"),
    )
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    opened = rows.select("l_orderkey", F.inline(K.chunk_map_entries(_pack_map(F.col("e")))))
    return opened.select("l_orderkey", "file_offset", "kind", "address", "template", "repeat", "inherit", "length")


@query("SELECT doc_id, sha256(text) AS sha FROM documents WHERE length(text) > 0")
def roundtrip_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with one damaged byte, rebuilt from their redundancy."""
    raw = F.encode("text", "utf-8")
    rows = table(spark, sf_dir, "documents").filter(F.length("text") > 0).select("doc_id", raw.alias("raw"))
    at = (F.col("doc_id") * 7919 % F.length("raw")).cast("int")
    damaged = F.concat(F.substring("raw", F.lit(1), at), F.unhex(F.lit("00")), F.substring("raw", at + 2, F.lit(1 << 30)))
    rows = rows.select("doc_id", damaged.alias("damaged"), K.redundancy(F.col("raw"), F.lit(256)).alias("blob"), F.crc32("raw").alias("crc"))
    return rows.select("doc_id", F.sha2(K.repaired("damaged", "blob", F.lit(256), F.col("crc")), 256).alias("sha"))
