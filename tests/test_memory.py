"""Rows that hold chunks or buckets go to Python and back in batches of bounded bytes, and are built once."""

import pyarrow as pa
from pyspark.sql import functions as F

from blockvault.batches import BATCH_BYTES, bounded_batches
from blockvault.functions import codec as K
from blockvault.operators import verify as V
from blockvault.plans import store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_are_bounded_by_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(0, 600, 1, 1).select(F.col("id").cast("string").alias("path"), "id", F.rpad(F.lit(b"x"), 1 << 16, F.lit(b"y")).alias("content"))
    seen = lambda batches: iter([pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches])
    V.bucket_chunks(rows.select("path", F.col("id").alias("stream"), F.col("id").alias("bucket"), "content"))
    assert rows.select("content").mapInArrow(seen, "n long").agg(F.max("n")).first()[0] <= BATCH_BYTES // (1 << 16) + 1
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000000")
    bounded_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1000000"


def test_buckets_are_parsed_once_and_not_shuffled(spark, sf_dir):
    damaged = plan(store.bucket_damage(spark, sf_dir))
    assert damaged.count("MapInArrow") == 1 and damaged.count("ArrowEvalPython") == 1 and "Exchange" not in damaged
    assert "Exchange" not in plan(store.bucket_round_trip(spark, sf_dir))


def test_texts_of_several_buckets(spark, tmp_path):
    texts = [(1, "é" * 4096 * 4096 + "end"), (2, ""), (3, None), (4, "x" * 4096)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in store._buckets(spark, str(tmp_path)).collect():
        _, chunks, findings = K.parse_bucket(bytes(r["content"]))
        assert not findings and r["path"] == f"{r['stream']}/{r['bucket']}"
        got[r["stream"], r["bucket"]] = b"".join(K.decompress_chunk(t, x) for _, t, x, _ in chunks)
    assert sorted(got) == [(1, 0), (1, 1), (2, 0), (3, 0), (4, 0)]
    assert len(got[1, 0]) == 8192 * 4096 and (got[1, 0] + got[1, 1]).rstrip(b"\0") == texts[0][1].encode()
    assert got[2, 0] == got[3, 0] == bytes(4096) and got[4, 0] == b"x" * 4096


def test_decoding_is_bounded_too(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    schema = "stream long, bucket long, chunk int, type int, encrypted boolean, stored binary"
    V.decoded(spark.createDataFrame([(1, 0, 0, K.NONE, False, bytearray(4096))], schema))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH_BYTES
