"""Exact dedup by content sort, in DataFrame operations alone.

Rows are range-partitioned by (first bytes, hash) of the normalised text, with splitters that Spark
samples, and sorted there by the whole normalised text (an external sort), so equal texts lie next to
each other; the window compares whole neighbouring texts and keeps the smallest id of a run.

A text that fills more than one partition's share of the rows is *hot*.  Its rows get extra splitter
values from a hash of the id, so that its run is cut into segments of about a partition's share.  There are
fewer hot texts than partitions, so what joins their segments is of bounded size and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions

#: Runs of these become one space.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: Characters of the text that the splitters see before its hash.
HEAD = 16
#: A text with fewer rows than this is never hot.
LEAST_HOT = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def _keyed(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), text.alias("_text"), *more)
    return rows.withColumns({"_head": F.substring(normalised(F.col("_text")), 1, HEAD), "_hash": F.xxhash64(normalised(F.col("_text")))})


def _salted(keyed: DataFrame, total: int) -> DataFrame:
    """With columns _salts (null but for rows of hot texts) and _salt."""
    n = partitions(keyed.sparkSession)
    share = max(total / n, LEAST_HOT)
    # Fewer than n rows by construction: each stands for more than 1/n of all rows.
    hot = keyed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_count")).filter(F.col("_count") > share)
    hot = hot.select("_hash", F.ceil(F.col("_count") / F.lit(share)).alias("_salts"))
    return keyed.join(F.broadcast(hot), "_hash", "left").withColumn(
        "_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(F.col("_id")), F.col("_salts"))).otherwise(F.lit(0))
    )


def _segments(rows: DataFrame) -> DataFrame:
    """Sort by content and compare neighbours: a row's segment is its run of equal texts in one place."""
    ranged = rows.repartitionByRange("_head", "_hash", "_salt")
    # The range partitioning already clusters these keys: no further exchange.
    run = Window.partitionBy("_head", "_hash", "_norm", "_salt")
    ranged = ranged.withColumn("_norm", normalised(F.col("_text")))
    return (
        (ranged if "_null" in rows.columns else ranged.drop("_text"))
        .withColumns(
            {
                "_first": F.min("_id").over(run),
                "_rows": F.count(F.lit(1)).over(run),
                "_place": F.row_number().over(run.orderBy(F.col("_id").asc_nulls_last())),
            }
        )
        .withColumn("_sha", F.sha2(F.col("_norm"), 256))
        .drop("_norm", "_head")
    )


def _joined(salted: DataFrame) -> DataFrame:
    """The least id and the rows of each hot text, from its segments; fewer than n rows."""
    hot = salted.filter(F.col("_salts").isNotNull()).select("_id", "_text", "_head", "_hash", "_salt")
    return _segments(hot).filter(F.col("_place") == 1).groupBy("_hash", "_sha").agg(F.min("_first").alias("_hot_first"), F.sum("_rows").alias("_hot_rows"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical after each run of ASCII white space became one space.
    A null text counts as empty.  Of equal texts the smallest id stays; of rows that share text and id one
    stays; a null id stays only if the group has no other.  An empty table gives an empty result; other columns
    are not read.
    """
    salted = _salted(_keyed(df, id_col, text_col), df.count())
    whole = _segments(salted).join(F.broadcast(_joined(salted)), ["_hash", "_sha"], "left")
    keep = F.when(F.col("_hot_rows").isNotNull(), F.col("_hot_first")).otherwise(F.col("_first"))
    return whole.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_hot_rows", "_rows").alias("group_size"),
        ((F.col("_place") == 1) & F.col("_id").eqNullSafe(keep)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``exact_dedup`` keeps, with all their columns; texts move once."""
    others = [F.struct(*[F.col(c) for c in df.columns if c not in (id_col, text_col)] or [F.lit(0).alias("none")]).alias("_others"), F.col(text_col).isNull().alias("_null")]
    salted = _salted(_keyed(df, id_col, text_col, *others), df.count())
    firsts = _segments(salted).filter(F.col("_place") == 1).join(F.broadcast(_joined(salted)), ["_hash", "_sha"], "left")
    kept = firsts.filter(F.col("_hot_rows").isNull() | F.col("_id").eqNullSafe(F.col("_hot_first")))
    back = {id_col: F.col("_id"), text_col: F.when(~F.col("_null"), F.col("_text"))}
    return kept.select(*[back.get(c, F.col("_others")[c]).alias(c) for c in df.columns])


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
