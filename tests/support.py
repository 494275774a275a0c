"""Small helpers, and a synthetic repository for tests."""

from __future__ import annotations

import hashlib
import json
import math
import os
import random
import sqlite3
import struct
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from blockvault.functions import codec as K

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return None if math.isnan(x) else int(x) if x == int(x) else x
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def rows(frame: pd.DataFrame) -> list[str]:
    """All rows as texts, sorted, with columns in the order of their names."""
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in frame.itertuples(index=False, name=None))


def oracle(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def ctr(spark, data: bytes, key: bytes, iv: bytes) -> bytes:
    frame = spark.createDataFrame([(bytearray(data), bytearray(iv))], "data binary, iv binary")
    return bytes(frame.select(K.ctr(F.col("data"), F.lit(key), F.col("iv"))).first()[0])


def database(path: Path, **tables: tuple[str, list[tuple]]) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    con = sqlite3.connect(path)
    for name, (columns, values) in tables.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        if values:
            con.executemany(f"INSERT INTO {name} VALUES ({','.join('?' * len(values[0]))})", values)
    con.commit()
    con.close()


def build_repository(root: Path, spark=None, encrypted: bool = False, seed: int = 3) -> dict[str, bytes]:
    """A small repository of one stream: files that share chunks, holes, zero ranges, repeats, a bucket wrap.

    Returns each path's bytes.
    """
    rng = random.Random(seed)
    vault, user, ident = bytes(range(32)), bytes(range(32, 64)), "keyid0000001"
    chunk = [bytes(rng.randrange(97, 123) for _ in range(64)) * 64 for _ in range(12)]
    zero = b"\0" * K.CHUNK_BYTES
    address = lambda bucket, slot: (1 << 56) | (bucket << 16) | slot
    # Bucket 0 ends at slot 8191; chunks 8190 and 8191 of it and 0.. of bucket 1 lie side by side.
    plain = {(0, 8190): chunk[0], (0, 8191): chunk[1], **{(1, i): chunk[2 + i] for i in range(8)}}
    stored: dict[int, list] = {0: [(K.COMPACTED, b"")] * 8190, 1: []}
    kinds = [K.LZ4, K.ZSTD, K.NONE]
    for k, ((bucket, slot), data) in enumerate(sorted(plain.items())):
        kind = kinds[k % 3]
        raw = K.compress_chunk(data, kind)
        if encrypted:
            raw = ctr(spark, raw, vault, struct.pack(">QQ", address(bucket, slot), address(bucket, slot)))
        stored[bucket].append((kind, raw))
    pool = root / "@data" / "Pool" / "1"
    pool.mkdir(parents=True)
    marks = b""
    table = bytearray(8192)
    for bucket, chunks in stored.items():
        (pool / f"{bucket}.buk").write_bytes(K.build_bucket(chunks, encrypted))
        at = len(marks)
        struct.pack_into(">I", table, 8 * bucket, (at // 4096) << 15 | len(chunks))
        slots = [hashlib.sha256(plain.get((bucket, i), b"")).digest() for i in range(len(chunks))]
        marks += b"".join(slots)
        marks = marks.ljust(-(-len(marks) // 4096) * 4096, b"\0")
    (pool / "0.inf.1").write_bytes(K.build_header(b"GMet").ljust(12288, b"\0") + bytes(table))
    (pool / "0_0.fgp.1").write_bytes(marks)

    files: dict[str, tuple[list[tuple], int]] = {
        "a/one.img": ([(K.MAPPING, 0, address(0, 8190), 4, 0, False)], 4 * 4096 - 100),  # across buckets
        "a/two.img": ([(K.MAPPING, 1, address(1, 0), 2, 2, True), (K.ZERO, 8, 0, 2, 0, False)], 12 * 4096 + 5),  # hole, repeat, hole, zeros, hole
        "a/b/empty.img": ([], 0),
        "a/b/hole.img": ([], 5000),
        "c.img": ([(K.MAPPING, 0, address(1, 3), 5, 0, False)], 5 * 4096),
    }
    content = {}
    for path, (entries, size) in files.items():
        data = bytearray(max([size, *[(at + (t * (1 + r) if kind == K.MAPPING else t)) * 4096 for kind, at, _, t, r, _ in entries]]))
        for kind, at, base, template, repeat, _ in entries:
            for k in range(template * (1 + repeat) if kind == K.MAPPING else template):
                number = ((base >> 16) & ((1 << 40) - 1)) * 8192 + (base & 0xFFFF) + k % template
                data[(at + k) * 4096 : (at + k + 1) * 4096] = plain[divmod(number, 8192)] if kind == K.MAPPING else zero
        content[path] = bytes(data[:size])
    session = bytearray(K.build_header(b"cMpS", struct.pack(">I", 1 << 24)))
    offsets = {}
    for path, (entries, _) in files.items():
        offsets[path] = len(session)
        session += K.build_record(entries)
    sub = root / "@data" / "Composition" / "1" / "7.com"
    sub.mkdir(parents=True)
    (sub / "c0").write_bytes(bytes(session))

    transactions = root / "repo_transactions"
    transactions.mkdir()
    for n, txn in ((9, 5), (10, 8)):
        (transactions / f"repo_transaction.{n}").write_bytes(K.build_json_file(b"rPTs", json.dumps({"transaction_id": str(txn)}).encode()))
    (root / "repo_info").write_bytes(K.build_json_file(b"RpiF", b"{}", "u" * 16))

    db = root / "db"
    file_map = "path TEXT PRIMARY KEY, stream_id INTEGER, session_id INTEGER, comp_offset INTEGER, status INTEGER"
    rows_ = [(p, 1, 7, offsets[p], 2) for p in files]
    database(db / "file_map.6", file_map=(file_map, rows_ + [("old.img", 1, 7, 64, 4)]))
    database(db / "file_map.8", file_map=(file_map, []))  # not committed: its number is not below the transaction
    sizes = [(i + 1, p, s) for i, (p, (_, s)) in enumerate(files.items())]
    database(db / "file_meta.6", file_meta=("fid INTEGER PRIMARY KEY, path TEXT, file_size INTEGER", sizes))
    spec = json.dumps({"status": {"status": "COMPLETED", "start_time": "1700000000", "end_time": 0}})
    uid = "11111111-2222"
    if encrypted:
        import base64

        spec = base64.b64encode(ctr(spark, spec.encode(), vault, hashlib.md5(uid.encode()).hexdigest()[:16].encode())).decode()
    database(
        db / "copy_target_version.6",
        copy_target_version=(
            "version_id INTEGER, workload_id INTEGER, connection_config_id INTEGER, version_uid TEXT, target_type TEXT, target_id TEXT, deleted INTEGER, version_spec TEXT",
            [(1, 10, 100, uid, "PC", "t", 0, spec), (2, 10, 100, "x", "PC", "t", 1, spec), (3, 10, 100, "y", "PC", "t", 0, "{broken")],
        ),
        copy_target_file=("version_id INTEGER, fid INTEGER", [(1, 1), (1, 2), (1, 3)]),
    )
    database(db / "copy_target_version_meta.6", copy_target_version_meta=("version_uid TEXT, target_meta_path TEXT, meta_filenames TEXT", [(uid, "/m/1", '["a","b"]')]))
    database(db / "connection_config.6", connection_config=("connection_config_id INTEGER, connection_id TEXT", [(100, "c1"), (200, "c2")]))
    database(db / "workload_config.6", workload_config=("workload_id INTEGER, workload_uid TEXT, workload_type TEXT, workload_spec TEXT", [(10, "w", "PC", '{"namespace":"ns","spec":{"workload_name":"box"}}')]))
    database(db / "vault_link_key.6", vault_link_key=("key TEXT", [("c1_o_My_Server",)]))
    wrapped = ""
    if encrypted:
        row = spark.range(1).select(K.wrap_key(F.lit(vault), F.lit(user), F.lit(ident))).first()
        wrapped = row[0]
    database(db / "vault_encryption_key", vault_encryption_key=("user_key_uuid TEXT, encrypted_data_key TEXT", [(ident if encrypted else "NoEncryption", wrapped)]))
    return content


def key_string() -> str:
    import base64

    return "keyid0000001@" + base64.b64encode(bytes(range(32, 64))).decode()


def read_tree(folder: str) -> dict[str, bytes]:
    return {os.path.relpath(os.path.join(d, f), folder): Path(d, f).read_bytes() for d, _, names in os.walk(folder) for f in names if not f.startswith((".", "_"))}
