"""Every registered query of the engine against its SQL in DuckDB."""

import pytest

from blockvault import queries as Q

from .support import oracle, rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_matches_sql(spark, sf_dir, con, name):
    got = Q.queries()[name](spark, sf_dir).toPandas()
    want = con.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_blocks_hold_whole_texts(spark, sf_dir):
    from blockvault.plans.codecs import blocks

    held = {}
    for r in blocks(spark, sf_dir).orderBy("doc_id", "place").collect():
        held[r["doc_id"]] = held.get(r["doc_id"], b"") + bytes(r["block"])
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        raw = r["text"].encode()
        assert held[r["doc_id"]] == raw.ljust(max(1, -(-len(raw) // 4096)) * 4096, b"\0")
    assert max(map(len, held.values())) > 4096


def test_every_chunk_is_stored_and_marked(spark, sf_dir, monkeypatch):
    from blockvault.plans import verification

    seen = {}
    monkeypatch.setattr(verification.V, "check_fingerprints", lambda plain, marks: seen.update(plain=plain.count(), marks=marks.count()) or plain.selectExpr("path", "'' AS stage", "'' AS symptom"))
    verification.verify_fingerprint_mismatch(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    chunks = sum(max(1, -(-len(r["text"].encode()) // 4096)) for r in docs)
    assert seen["plain"] == chunks > len(docs)
    assert seen["marks"] == chunks - sum(r["doc_id"] % 89 == 0 and r["doc_id"] % 97 != 0 for r in docs)


def test_bucket_damage_tells_what_is_found(spark, monkeypatch):
    """No row of bucket_damage stands in for a check: what cannot be repaired is not told as repaired, no other failure as
    a missing header, and later buckets are checked too."""
    from blockvault.functions import codec as K
    from blockvault.plans import store

    good = bytearray(K.build_bucket([(K.NONE, b"x" * K.CHUNK_BYTES)] * 3))
    broken = lambda at: good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]
    files = [(55, 0, broken(len(good) - 1)), (110, 0, good), (77, 0, good), (7, 0, good), (1, 0, broken(20)), (2, 0, good), (2, 1, broken(K.DATA_AT)), (3, 0, good[:-1]), (5, 1, good)]
    rows = spark.createDataFrame([(f"{k}/{b}", k, b, bytearray(x)) for k, b, x in files], "path string, stream long, bucket long, content binary")
    monkeypatch.setattr(store, "_buckets", lambda *_: rows)
    assert sorted(map(tuple, store.bucket_damage(spark, "").collect())) == sorted([
        (55, "bucket", "CORRUPT", "size store checksum"), (55, "bucket", "CORRUPT", "no header"), (110, "bucket", "REPAIRED", "size store repaired"), (110, "bucket", "CORRUPT", "no header"),
        (77, "bucket", "CORRUPT", "no header"), (7, "chunk", "CORRUPT", "chunk 0"), (1, "bucket", "CORRUPT", "header checksum"), (2, "chunk", "CORRUPT", "chunk 0"), (3, "bucket", "CORRUPT", "bucket size"),
    ])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
