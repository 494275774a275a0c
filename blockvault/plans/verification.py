"""Queries over integrity findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec as K
from ..operators import verify as V
from ..registry import query, table
from .codecs import blocks


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as findings: every fourth was put right, some have a reference."""
    k = F.col("turn") + F.col("conv_id")
    detail = F.concat(F.lit("chunk "), F.col("turn").cast("string"), F.lit(" of '"), "role", F.lit("' at "), F.col("conv_id").cast("string"))
    return table(spark, sf_dir, "conversations").select(
        F.when(k % 2 == 0, "bucket").otherwise("chunk").alias("stage"), F.when(k % 4 == 0, "REPAIRED").when(k % 4 == 1, "CORRUPT").otherwise("MISSING").alias("symptom"),
        F.concat(F.lit("p/"), F.col("conv_id").cast("string")).alias("path"), detail.alias("detail"), F.when(k % 5 == 0, F.col("role")).alias("ref"),
    )


_FINDINGS = """WITH f AS (SELECT CASE WHEN (turn + conv_id) % 2 = 0 THEN 'bucket' ELSE 'chunk' END AS stage, CASE (turn + conv_id) % 4 WHEN 0 THEN 'REPAIRED' WHEN 1 THEN 'CORRUPT' ELSE 'MISSING' END AS symptom,
'p/' || conv_id AS path, 'chunk ' || turn || ' of ''' || role || ''' at ' || conv_id AS detail, CASE WHEN (turn + conv_id) % 5 = 0 THEN role END AS ref FROM conversations)
"""


@query(_FINDINGS + """SELECT stage, symptom, CASE WHEN ref IS NOT NULL THEN 'ref:' || ref ELSE 'tpl:' || regexp_replace(regexp_replace(detail, '''[^'']*''', '<s>', 'g'), '[0-9]+', '<n>', 'g') END AS key,
count(*) AS findings, min(path) AS first_path, min(detail) AS first_detail FROM f GROUP BY 1, 2, 3""")
def findings_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.grouped(_findings(spark, sf_dir))


@query(_FINDINGS + "SELECT CAST(count_if(symptom <> 'REPAIRED') AS BIGINT) AS problems, CAST(count_if(symptom = 'REPAIRED') AS BIGINT) AS repaired FROM f")
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.summary(_findings(spark, sf_dir))


@query("""SELECT doc_id, 'fingerprint' AS stage, CASE WHEN doc_id % 97 = 0 THEN 'CORRUPT' ELSE 'MISSING' END AS symptom FROM documents WHERE doc_id % 97 = 0 OR doc_id % 89 = 0""")
def verify_fingerprint_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which one chunk was changed after its fingerprint, or one chunk has none; all chunks are checked."""
    docs = blocks(spark, sf_dir)
    wrong = F.col("place") == F.pmod(F.col("doc_id") * 7919, F.col("chunks"))
    slot = [F.lit(1).cast("bigint").alias("stream"), (F.col("doc_id") * 1024 + F.floor(F.col("place") / 8192)).alias("bucket"), (F.col("place") % 8192).cast("int").alias("chunk")]
    # No UTF-8 text holds the byte that damages it.
    plain = F.when(wrong & (F.col("doc_id") % 97 == 0), F.concat(F.unhex(F.lit("ff")), F.substring("block", 2, 4095))).otherwise(F.col("block"))
    stored = docs.select("doc_id", *slot, F.lit(K.ZSTD).alias("type"), F.lit(False).alias("encrypted"), K.compressed(F.lit(K.ZSTD), plain).alias("stored"), F.col("doc_id").cast("string").alias("path"))
    marks = docs.filter(~wrong | (F.col("doc_id") % 89 != 0) | (F.col("doc_id") % 97 == 0)).select(*slot, F.unhex(F.sha2("block", 256)).alias("fingerprint"))
    return V.check_fingerprints(V.decoded(stored), marks).select(F.col("path").cast("bigint").alias("doc_id"), "stage", "symptom")


@query("""WITH r AS (SELECT l_partkey % 50 AS bucket, l_orderkey FROM lineitem) SELECT '3/' || bucket AS path, min(lpad(CAST(l_orderkey AS VARCHAR), 12, '0')) AS ref FROM r WHERE bucket % 7 = 0 GROUP BY bucket""")
def missing_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").select(F.lit(3).alias("stream"), (F.col("l_partkey") % 50).alias("bucket"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("ref"))
    there = spark.range(50).filter("id % 7 <> 0").select(F.lit(3).alias("stream"), F.col("id").alias("bucket"))
    return V.check_references(refs, there).select("path", "ref")
