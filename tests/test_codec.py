"""Codecs against published values, round trips and damage."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockvault.functions import codec as K
from blockvault.schema import CorruptData

from .support import ctr

entries = st.lists(st.tuples(st.sampled_from([K.NONE, K.LZ4, K.ZSTD, K.COMPACTED]), st.integers(1, 4095)), max_size=300)


def test_crc32_check_value():
    assert K.crc32(b"123456789") == 0xCBF43926


def test_header_round_trip_and_damage():
    raw = K.build_header(b"bFiL", b"body", 3)
    assert K.parse_header(raw, b"bFiL", 3).body.startswith(b"body")
    for bad in (raw[:40], raw[:10] + b"x" + raw[11:], K.build_header(b"cMpS"), K.build_header(b"bFiL", major=4)):
        with pytest.raises(CorruptData):
            K.parse_header(bad, b"bFiL", 3)


@settings(max_examples=50, deadline=None)
@given(entries)
def test_size_store(pairs):
    types, sizes = [t for t, _ in pairs], [s for _, s in pairs]
    raw = K.pack_size_store(types, sizes)
    assert len(raw) == -(-len(pairs) * 15 // 8)
    t, s = K.unpack_size_store(raw, len(pairs))
    assert t.tolist() == types
    assert s.tolist() == [4096 if k == K.NONE else 0 if k == K.COMPACTED else n for k, n in pairs]


def test_size_store_bits_by_hand():
    # 001 000000000101 then 010 000000000011, most significant bit first.
    assert K.pack_size_store([1, 2], [5, 3]) == int("001000000000101" + "010000000000011" + "00", 2).to_bytes(4, "big")


def test_size_store_refuses_unknown_type():
    with pytest.raises(CorruptData):
        K.unpack_size_store(K.pack_size_store([3], [1]), 1)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=2000), st.integers(0, 1999), st.integers(1, 300))
def test_parity_repairs_one_region(data, at, length):
    coverage = 256
    blob = K.build_redundancy(data, coverage)
    assert len(blob) == K.redundancy_length(len(data), coverage)
    at %= len(data)
    end = min(len(data), at + min(length, coverage))
    damaged = data[:at] + bytes(b ^ 0xFF for b in data[at:end]) + data[end:]
    assert K.repair(damaged, blob, coverage, K.crc32(data)) == data


def test_parity_cannot_repair_distant_damage():
    data = bytes(range(256)) * 8
    bad = b"\xff" + data[1:1800] + b"\xff" + data[1801:]
    assert K.repair(bad, K.build_redundancy(data, 256), 256, K.crc32(data)) is None


def test_chunk_map_round_trip():
    raw = K.pack_chunk_map([(K.MAPPING, 5, (200 << 56) | 7, 3, 2, True), (K.ZERO, 20, 0, 70000, 0, False), (K.MAPPING, 0, 1, 0, 0, False)])
    a, b, c = K.unpack_chunk_map(raw)
    assert (a["kind"], a["file_offset"], a["address"], a["length"], a["inherit"]) == ("DATA", 5 * 4096, ((200 << 56) | 7) - (1 << 64), 9 * 4096, True)
    assert (b["kind"], b["length"], c["length"]) == ("ZERO", 70000 * 4096, 0)
    with pytest.raises(CorruptData):
        K.unpack_chunk_map(struct.pack(">QQI", 2 << 56, 0, 0))


def test_record_repairs_its_map_and_finds_the_next():
    one = K.build_record([(K.MAPPING, i, i, 1, 0, False) for i in range(1000)], b'{"a":1}')
    both = bytearray(one + K.build_record([]))
    both[100] ^= 1
    found, attributes, after, repaired = K.parse_record(bytes(both), 0)
    assert len(found) == 1000 and attributes == b'{"a":1}' and after == len(one) and repaired
    assert K.parse_record(bytes(both), after)[0] == []
    both[2] ^= 1
    with pytest.raises(CorruptData):
        K.parse_record(bytes(both), 0)


def test_bucket_parse_and_damage():
    chunk = bytes(range(256)) * 16
    stored = [(k, K.compress_chunk(chunk, k)) for k in (K.NONE, K.LZ4, K.ZSTD)] + [(K.COMPACTED, b"")]
    raw = bytearray(K.build_bucket(stored))
    mode, chunks, findings = K.parse_bucket(bytes(raw))
    assert mode == 3 and not findings
    assert [K.decompress_chunk(t, x) for _, t, x, _ in chunks[:3]] == [chunk] * 3
    assert all(K.crc32(x) == c for _, _, x, c in chunks[:3])
    with pytest.raises(CorruptData):
        K.decompress_chunk(chunks[3][1], chunks[3][2])
    raw[66] ^= 0x10
    assert K.parse_bucket(bytes(raw))[2] == ["size store repaired"]


def test_ctr_published_vectors(spark):
    # NIST SP 800-38A, F.5.5: fixed values.
    key = bytes.fromhex("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4")
    iv = bytes.fromhex("f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff")
    clear = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e5130c81c46a35ce411e5fbc1191a0a52eff69f2445df4f9b17ad2b417be66c3710")
    secret = bytes.fromhex("601ec313775789a5b7a7f504bbf3d228f443e3ca4d62b59aca84e990cacaf5c52b0930daa23de94ce87017ba2d84988ddfc9c58db67aada613c2dd08457941a6")
    assert ctr(spark, clear, key, iv) == secret
    assert ctr(spark, secret[:37], key, iv) == clear[:37]


def test_key_custody(spark):
    vault, user, ident = bytes(range(32)), bytes(range(1, 33)), "keyid0000001"
    row = spark.range(1).select(K.wrap_key(F.lit(vault), F.lit(user), F.lit(ident)).alias("w"))
    good, bad = (row.select(K.unwrap_key(F.col("w"), F.lit(k), F.lit(ident))).first()[0] for k in (user, vault))
    assert bytes(good) == vault and bad is None
    ident_, key = K.parse_key_string(F.lit("a@b@AAEC"))
    assert tuple(map(str, spark.range(1).select(ident_, F.hex(key)).first())) == ("a@b", "000102")
