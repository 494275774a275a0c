"""A corpus pipeline: each stage works on all that the one before it kept.

The stages are those of ``blockvault.llm``; all but the last return the columns of ``documents``.  The first two
score documents with models, which SQL cannot express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockvault.llm import exact_dedup as exact
from blockvault.llm import language, near_copies, quality, retrieval_packing
from blockvault.llm.common import cut, read_table
from blockvault.llm.queries import VOCABULARY

#: Documents whose language is known with less than this go.
LEAST_LANGUAGE = 0.4


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.learn(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model, carry=docs.columns, least=quality.THRESHOLD).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: not those without a letter, nor those of no clear language."""
    return language.predict(docs, language.learn(docs), carry=docs.columns, least=LEAST_LANGUAGE).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact.keep_first(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: by SimHash, and by min-hashes beyond its
    distance, both verified by the similarity 0.8 of five-word shingles."""
    found = near_copies.near_components(docs)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 ids."""
    return retrieval_packing.pack_by_retrieval(docs, VOCABULARY, with_ids=False)


STAGES = [("quality", quality_stage), ("language", language_stage), ("exact_dedup", exact_stage), ("simhash_dedup", simhash_stage), ("packing", packing_stage)]

#: Models score the first two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
