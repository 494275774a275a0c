"""Binary structures of the format: headers, size stores, chunk maps, redundancy, compression, encryption.

Plain functions work on bytes and serve tests and encoders; the column functions below them wrap the decoders
as Arrow UDFs.  A structure that breaks the format raises ``CorruptData`` in the former and is null in the latter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CorruptData
from .address import CHUNK_BYTES

#: Fixed values of the format.
HEADER_BYTES = 64
MAGICS = {b"bFiL": "bucket", b"GMet": "group_info", b"bRfC": "group_references", b"RpiF": "repo_info", b"rPTs": "repo_transaction", b"cMpS": "composition", b"aHlT": "envelope", b"lINk": "link"}
DATA_AT, PLAIN_AT = 16384, 4096
COMPRESS, CHUNK_CRC, VAULT_ENCRYPT = 0x01, 0x02, 0x80
NONE, LZ4, ZSTD, COMPACTED = 0, 1, 2, 4
BUCKET_COVERAGE, RECORD_COVERAGE = 256, 8192
MAPPING, ZERO = 0, 1


def crc32(data: bytes) -> int:
    return zlib.crc32(data)


# -- headers -----------------------------------------------------------------------------------------------


def build_header(magic: bytes, body: bytes = b"", major: int = 1, minor: int = 0) -> bytes:
    head = struct.pack(">4sHH52s", magic, major, minor, body.ljust(52, b"\0"))
    return head + struct.pack(">I", crc32(head))


@dataclass(frozen=True)
class Header:
    magic: bytes
    major: int
    minor: int
    body: bytes


def parse_header(data: bytes, magic: bytes | None = None, most_major: int | None = None) -> Header:
    if len(data) < HEADER_BYTES:
        raise CorruptData("header too short")
    found, major, minor, body, crc = struct.unpack(">4sHH52sI", data[:HEADER_BYTES])
    if magic is not None and found != magic or found not in MAGICS:
        raise CorruptData(f"magic {found!r}")
    if crc != crc32(data[:60]):
        raise CorruptData("header checksum")
    if most_major is not None and major > most_major:
        raise CorruptData(f"major version {major}")
    return Header(found, major, minor, body)


def build_json_file(magic: bytes, payload: bytes, uuid: str = "") -> bytes:
    return build_header(magic, struct.pack(">IQ16s", crc32(payload), len(payload), uuid.encode()[:16])) + payload


def parse_json_file(data: bytes, magic: bytes) -> bytes:
    crc, size = struct.unpack(">IQ", parse_header(data, magic).body[:12])
    payload = data[HEADER_BYTES : HEADER_BYTES + size]
    if len(payload) != size or crc32(payload) != crc:
        raise CorruptData("payload checksum")
    return payload


# -- size store: 15 bits for each chunk, type and size, most significant bit first ---------------------------


def pack_size_store(types: Sequence[int], sizes: Sequence[int]) -> bytes:
    words = (np.asarray(types, np.uint16) << 12) | (np.asarray(sizes, np.uint16) & 0xFFF)
    bits = (words[:, None] >> np.arange(14, -1, -1, dtype=np.uint16)) & 1 if len(words) else np.zeros((0, 15), np.uint16)
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def unpack_size_store(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Types and stored lengths of ``n`` chunks."""
    if len(data) < (n * 15 + 7) // 8:
        raise CorruptData("size store too short")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * 15).reshape(n, 15).astype(np.int64)
    words = bits @ (1 << np.arange(14, -1, -1))
    types, sizes = words >> 12, words & 0xFFF
    if not np.isin(types, (NONE, LZ4, ZSTD, COMPACTED)).all():
        raise CorruptData("chunk type")
    return types, np.where(types == NONE, CHUNK_BYTES, np.where(types == COMPACTED, 0, sizes))


# -- redundancy: cumulative checksums find the first damaged window, parity rebuilds it ----------------------


def redundancy_length(size: int, coverage: int) -> int:
    return 16 + 4 * -(-size // coverage) + min(size, 2 * coverage)


def build_redundancy(data: bytes, coverage: int) -> bytes:
    windows = [data[i : i + coverage] for i in range(0, len(data), coverage)]
    crcs, crc = [], 0
    for w in windows:
        crc = zlib.crc32(w, crc)
        crcs.append(crc)
    halves = b"".join(_parity(windows[k::2], coverage) for k in (0, 1))
    return struct.pack(">2sHIQ", b"RD", 0, coverage, len(data)) + struct.pack(f">{len(crcs)}I", *crcs) + halves[: min(len(data), 2 * coverage)]


def _parity(windows: Sequence[bytes], coverage: int) -> bytes:
    out = np.zeros(coverage, np.uint8)
    for w in windows:
        out[: len(w)] ^= np.frombuffer(w, np.uint8)
    return out.tobytes()


def repair(data: bytes, blob: bytes, coverage: int, expected_crc: int) -> bytes | None:
    """The data as it was, if one damaged window, or it and the next one, can be rebuilt; else null."""
    size, n = len(data), -(-len(data) // coverage)
    if len(blob) < redundancy_length(size, coverage) or blob[:2] != b"RD":
        return None
    _, _, covered, total = struct.unpack(">2sHIQ", blob[:16])
    if covered != coverage or total != size:
        return None
    steps = struct.unpack(f">{n}I", blob[16 : 16 + 4 * n])
    halves = blob[16 + 4 * n :].ljust(2 * coverage, b"\0")
    windows = [data[i : i + coverage] for i in range(0, size, coverage)]
    crc, bad = 0, None
    for i, w in enumerate(windows):
        crc = zlib.crc32(w, crc)
        if crc != steps[i]:
            bad = i
            break
    if bad is None:
        return data if crc32(data) == expected_crc else None
    for damaged in ((bad,), (bad, bad + 1)):
        fixed = list(windows)
        for i in damaged:
            if i < n:
                others = [w for k, w in enumerate(windows) if k % 2 == i % 2 and k != i]
                half = halves[(i % 2) * coverage : (i % 2 + 1) * coverage]
                fixed[i] = _parity([half, *others], coverage)[: len(windows[i])]
        whole = b"".join(fixed)
        if crc32(whole) == expected_crc:
            return whole
    return None


# -- chunk maps: 20 bytes for each range of a file -----------------------------------------------------------

ENTRY = np.dtype([("word", ">u8"), ("address", ">u8"), ("count", ">u4")])


def pack_chunk_map(entries: Sequence[tuple]) -> bytes:
    """Entries (kind, file chunk, address, template, repeat, inherit); a zero range has its chunk count as template."""
    out = np.zeros(len(entries), ENTRY)
    for row, (kind, at, address, template, repeat, inherit) in zip(out, entries, strict=True):
        row["word"] = (int(inherit) << 60) | (kind << 56) | at
        row["address"] = address if kind == MAPPING else 0
        row["count"] = (template << 16) | repeat if kind == MAPPING else template
    return out.tobytes()


def unpack_chunk_map(data: bytes) -> list[dict]:
    """Entries as rows: kind, file_offset, address, template, repeat, inherit and length in bytes."""
    if len(data) % ENTRY.itemsize:
        raise CorruptData("chunk map length")
    out = []
    for word, address, count in np.frombuffer(data, ENTRY).tolist():
        kind = word >> 56 & 0xF
        if kind not in (MAPPING, ZERO) or word >> 61:
            raise CorruptData(f"entry type {kind}")
        template, repeat = (count >> 16, count & 0xFFFF) if kind == MAPPING else (count, 0)
        row = {"kind": "DATA" if kind == MAPPING else "ZERO", "file_offset": (word & (1 << 56) - 1) * CHUNK_BYTES, "template": template, "repeat": repeat}
        out.append(row | {"address": address - (1 << 64) if address >> 63 else address, "inherit": bool(word >> 60 & 1), "length": template * (1 + repeat) * CHUNK_BYTES})
    return out


def build_record(entries: Sequence[tuple], attributes: bytes = b"{}", status: int = 0) -> bytes:
    array = pack_chunk_map(entries)
    head = struct.pack(">2sHHQIHII", b"Mu", status, 0, len(entries), crc32(array), 1, len(attributes), crc32(attributes))
    return head + struct.pack(">I", crc32(head)) + array + attributes + build_redundancy(array, RECORD_COVERAGE)


def parse_record(data: bytes, offset: int = 0) -> tuple[list[dict], bytes, int, bool]:
    """Entries, attributes, the next record's offset, and whether the map had to be repaired."""
    head = data[offset : offset + 32]
    if len(head) < 32 or crc32(head[:28]) != struct.unpack(">I", head[28:])[0]:
        raise CorruptData("record head checksum")
    magic, status, _, n, map_crc, mode, attr_size, attr_crc = struct.unpack(">2sHHQIHII", head[:28])
    if magic != b"Mu" or status not in (0, 1):
        raise CorruptData("record head")
    at = offset + 32
    array, attributes = data[at : at + 20 * n], data[at + 20 * n : at + 20 * n + attr_size]
    end = at + 20 * n + attr_size
    size = redundancy_length(20 * n, RECORD_COVERAGE) if mode & 1 else 0
    repaired = False
    if crc32(array) != map_crc:
        fixed = repair(array, data[end : end + size], RECORD_COVERAGE, map_crc) if size else None
        if fixed is None:
            raise CorruptData("chunk map checksum")
        array, repaired = fixed, True
    if crc32(attributes) != attr_crc:
        raise CorruptData("attribute checksum")
    return unpack_chunk_map(array), attributes, end + size, repaired


# -- compression and buckets ---------------------------------------------------------------------------------


def compress_chunk(chunk: bytes, kind: int) -> bytes:
    if kind == NONE:
        return chunk
    return pa.compress(chunk, codec={LZ4: "lz4_raw", ZSTD: "zstd"}[kind], asbytes=True)


def decompress_chunk(kind: int, data: bytes) -> bytes:
    if kind == COMPACTED:
        raise CorruptData("compacted chunk")
    try:
        out = data if kind == NONE else pa.decompress(data, CHUNK_BYTES, codec={LZ4: "lz4_raw", ZSTD: "zstd"}[kind], asbytes=True)
    except (OSError, KeyError, pa.ArrowInvalid) as e:
        raise CorruptData(f"chunk does not decompress: {e}") from e
    if len(out) != CHUNK_BYTES:
        raise CorruptData(f"chunk of {len(out)} bytes")
    return out


def build_bucket(stored: Sequence[tuple[int, bytes]], encrypted: bool = False) -> bytes:
    """A bucket of (type, stored bytes), in slot order.  What does not get smaller is stored as it is, as type NONE."""
    if any(t in (LZ4, ZSTD) and not 0 < len(x) < CHUNK_BYTES for t, x in stored):
        raise ValueError("a compressed chunk must be smaller than a chunk")
    store = pack_size_store([t for t, _ in stored], [0 if t == COMPACTED else len(x) & 0xFFF for t, x in stored])
    crcs = b"".join(struct.pack(">I", crc32(x)) for t, x in stored if t != COMPACTED)
    mode = COMPRESS | CHUNK_CRC | (VAULT_ENCRYPT if encrypted else 0)
    body = struct.pack(">III9sI", mode, len(stored), crc32(store), b"", crc32(crcs))
    data = b"".join(x for t, x in stored if t != COMPACTED)
    return (build_header(b"bFiL", body, major=3) + store).ljust(DATA_AT, b"\0") + data + crcs + build_redundancy(store, BUCKET_COVERAGE)


def parse_bucket(data: bytes) -> tuple[int, list[tuple[int, int, bytes, int | None]], list[str]]:
    """Mode, chunks (slot, type, stored bytes, checksum of them) and what is wrong but could be put right or told."""
    header = parse_header(data, b"bFiL", 3)
    mode, n, store_crc, _, crcs_crc = struct.unpack(">III9sI", header.body[:25])
    findings: list[str] = []
    if not mode & COMPRESS:
        chunks = [(i, NONE, data[PLAIN_AT * (i + 1) : PLAIN_AT * (i + 2)], None) for i in range(n)]
        if any(len(x) != CHUNK_BYTES for _, _, x, _ in chunks):
            raise CorruptData("bucket is cut off")
        return mode, chunks, findings
    packed = (n * 15 + 7) // 8
    store = data[HEADER_BYTES : HEADER_BYTES + packed]
    if crc32(store) != store_crc:
        blob = data[len(data) - redundancy_length(packed, BUCKET_COVERAGE) :]
        fixed = repair(store, blob, BUCKET_COVERAGE, store_crc)
        if fixed is None:
            raise CorruptData("size store checksum")
        store = fixed
        findings.append("size store repaired")
    types, lengths = unpack_size_store(store, n)
    ends = DATA_AT + np.cumsum(lengths)
    total = DATA_AT + int(lengths.sum())
    live = int((lengths > 0).sum())
    if len(data) != total + 4 * live * bool(mode & CHUNK_CRC) + redundancy_length(packed, BUCKET_COVERAGE):
        findings.append("bucket size")
    crcs: list[int | None] = [None] * live
    if mode & CHUNK_CRC:
        raw = data[total : total + 4 * live]
        if len(raw) == 4 * live and crc32(raw) == crcs_crc:
            crcs = list(struct.unpack(f">{live}I", raw))
        else:
            findings.append("checksum store checksum")
    found = iter(crcs)
    chunks = [(i, int(t), data[int(e) - int(k) : int(e)], next(found) if k else None) for i, (t, k, e) in enumerate(zip(types, lengths, ends, strict=True))]
    return mode, chunks, findings


# -- columns -------------------------------------------------------------------------------------------------


def _nullable(function: Callable, kind: T.DataType) -> Callable[..., Column]:
    """A column function of bytes that is null where the input is null or corrupt."""

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns, strict=True):
            try:
                out.append(None if any(x is None for x in row) else function(*row))
            except CorruptData:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run


decompressed = _nullable(lambda kind, data: decompress_chunk(int(kind), data), T.BinaryType())
compressed = _nullable(lambda kind, data: compress_chunk(data, int(kind)), T.BinaryType())
repaired = _nullable(lambda data, blob, coverage, crc: repair(data, blob, int(coverage), int(crc)), T.BinaryType())
redundancy = _nullable(lambda data, coverage: build_redundancy(data, int(coverage)), T.BinaryType())
size_store = _nullable(lambda types, sizes: pack_size_store(list(types), list(sizes)), T.BinaryType())
_ENTRY_FIELDS = {"kind": T.StringType(), "file_offset": T.LongType(), "template": T.LongType(), "repeat": T.LongType(), "address": T.LongType(), "inherit": T.BooleanType(), "length": T.LongType()}
# Types as objects: workers import this module, and cannot parse types there.
ENTRIES = T.ArrayType(T.StructType([T.StructField(k, t) for k, t in _ENTRY_FIELDS.items()]))
SIZES = T.ArrayType(T.StructType([T.StructField("type", T.IntegerType()), T.StructField("size", T.IntegerType())]))


@F.pandas_udf(SIZES)
def size_store_entries(data: pd.Series, n: pd.Series) -> pd.Series:
    out = []
    for raw, k in zip(data, n, strict=True):
        try:
            out.append([{"type": int(t), "size": int(s)} for t, s in zip(*unpack_size_store(raw, int(k)), strict=True)])
        except CorruptData:
            out.append(None)
    return pd.Series(out, dtype=object)


@F.pandas_udf(ENTRIES)
def chunk_map_entries(data: pd.Series) -> pd.Series:
    out = []
    for raw in data:
        try:
            out.append(None if raw is None else unpack_chunk_map(raw))
        except CorruptData:
            out.append(None)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.BinaryType())
def _counters(iv: pd.Series, size: pd.Series) -> pd.Series:
    """The counter blocks of CTR: the IV as one big-endian number of 128 bits, counting up."""
    out = []
    for v, n in zip(iv, size, strict=True):
        if v is None or pd.isna(n):
            out.append(None)
            continue
        high, low = np.frombuffer(v, ">u8").astype(np.uint64)
        blocks = np.empty((-(-int(n) // 16), 2), ">u8")
        counted = low + np.arange(len(blocks), dtype=np.uint64)  # modulo 2**64
        blocks[:, 1], blocks[:, 0] = counted, high + (counted < low)
        out.append(blocks.tobytes())
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.BinaryType())
def _xor(data: pd.Series, stream: pd.Series) -> pd.Series:
    out = [None if a is None or b is None else (np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)[: len(a)]).tobytes() for a, b in zip(data, stream, strict=True)]
    return pd.Series(out, dtype=object)


def ctr(data: Column, key: Column, iv: Column) -> Column:
    """AES-CTR, which encrypts and decrypts alike.  The key stream is the counter blocks in ECB, which the JVM
    computes; ECB's last block is padding and is not used."""
    return _xor(data, F.aes_encrypt(_counters(iv, F.length(data)), key, F.lit("ECB"), F.lit("PKCS")))


def chunk_iv(address: Column) -> Column:
    """A chunk's IV: its address, big-endian, twice."""
    eight = F.unhex(F.lpad(F.hex(address), 16, "0"))
    return F.concat(eight, eight)


def spec_iv(version_uid: Column) -> Column:
    """The IV of a version's spec: the first 16 hex digits of its MD5, as text."""
    return F.substring(F.md5(version_uid.cast("binary")), 1, 16).cast("binary")


def parse_key_string(key: Column) -> tuple[Column, Column]:
    """The key's id and its bytes, from ``id@base64``, split at the last @."""
    return F.regexp_extract(key, "^(.*)@[^@]*$", 1), F.unbase64(F.substring_index(key, "@", -1))


def wrap_key(vault_key: Column, user_key: Column, user_key_id: Column) -> Column:
    sealed = F.aes_encrypt(vault_key, user_key, F.lit("GCM"), F.lit("DEFAULT"), user_key_id.cast("binary"))
    return F.base64(F.substring(sealed, 13, 1 << 30))  # without the nonce, which is the key's id


def unwrap_key(wrapped: Column, user_key: Column, user_key_id: Column) -> Column:
    """The vault key; null where the tag shows that the key string is wrong."""
    sealed = F.concat(user_key_id.cast("binary"), F.unbase64(F.regexp_replace(wrapped, r"\s", "")))
    return F.try_aes_decrypt(sealed, user_key, F.lit("GCM"))


HEADER_TYPE = T.StructType([T.StructField(n, t) for n, t in zip(("magic", "kind", "major", "minor", "body"), (T.StringType(), T.StringType(), T.IntegerType(), T.IntegerType(), T.BinaryType()), strict=True)])


@F.pandas_udf(HEADER_TYPE)
def header_fields(data: pd.Series) -> pd.DataFrame:
    rows = []
    for raw in data:
        try:
            h = parse_header(raw or b"")
            rows.append((h.magic.decode(), MAGICS[h.magic], h.major, h.minor, h.body))
        except CorruptData:
            rows.append((None,) * 5)
    return pd.DataFrame(rows, columns=HEADER_TYPE.names)
