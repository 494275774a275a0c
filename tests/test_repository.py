"""A synthetic repository, end to end: catalogs, reads, exports, verification, streaming."""

import pytest
from pyspark.sql import functions as F

from blockvault.repository import Repository, discover
from blockvault.schema import CorruptData, conform
from blockvault.sources import repository as source
from blockvault.sources import sqlite
from blockvault.streaming.watch import findings_of_new_buckets

from .support import build_repository, key_string, read_tree


@pytest.fixture(scope="module", params=[False, True], ids=["plain", "encrypted"])
def built(request, spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo") / "r"
    root.mkdir()
    content = build_repository(root, spark, request.param)
    return root, content, Repository(spark, str(root), key_string() if request.param else None), request.param


def assemble(frame, size, offset=0):
    out = bytearray(size)
    for r in frame.collect():
        out[r["file_offset"] - offset : r["file_offset"] - offset + len(r["data"])] = r["data"]
    return bytes(out)


def test_catalog(built):
    _, _, repo, encrypted = built
    assert repo.transaction() == 8
    assert repo.encrypted() is encrypted
    rows = {r["connection_id"]: r for r in repo.connections().collect()}
    assert rows["c1"]["display_name"] == "My_Server" and rows["c1"]["versions"] == 3 and rows["c1"]["namespaces"] == ["ns"]
    assert rows["c2"]["versions"] == 0
    assert [r["display_name"] for r in repo.workloads(100).collect()] == ["box"]
    versions = repo.versions().collect()
    assert [(r["version_id"], r["epoch"], r["files"]) for r in versions] == [(1, 1700000000, ["a", "b"])]
    tree = {(r["parent"], r["name"], r["is_leaf"]) for r in repo.version_tree(1).collect()}
    assert tree == {(None, "a", False), ("a", "one.img", True), ("a", "two.img", True), ("a", "b", False), ("a/b", "empty.img", True)}


@pytest.mark.parametrize("path,offset,length", [("a/one.img", 0, None), ("a/two.img", 0, None), ("a/two.img", 5000, 30000), ("c.img", 4095, 2), ("c.img", 10**6, 5), ("a/b/hole.img", 0, None)])
def test_read(built, path, offset, length):
    _, content, repo, _ = built
    want = content[path][offset:] if length is None else content[path][offset : offset + length]
    assert assemble(repo.read(path, offset, length), len(want), offset) == want


def test_read_refuses_what_is_not_there(built):
    _, _, repo, _ = built
    with pytest.raises(FileNotFoundError):
        repo.read("none.img")
    with pytest.raises(CorruptData):
        repo.read("old.img")


def test_export(built, tmp_path):
    _, content, repo, _ = built
    repo.export(repo.locations().select("path"), str(tmp_path / "out"))
    got = read_tree(str(tmp_path / "out"))
    assert got == content


def test_extents(built):
    _, _, repo, _ = built
    rows = [tuple(r) for r in repo.extents().filter("path = 'a/two.img'").orderBy("start").select("start", "end", "kind").collect()]
    c = 4096
    assert rows == [(0, c, "HOLE"), (c, 7 * c, "DATA"), (7 * c, 8 * c, "HOLE"), (8 * c, 10 * c, "ZERO"), (10 * c, 12 * c + 5, "HOLE")]


def test_verify_clean_and_damaged(built, spark, tmp_path):
    root, _, repo, encrypted = built
    found = repo.verify(full=True).collect()
    assert [(r["stage"], r["path"]) for r in found] == [("catalog", "old.img")]
    if encrypted:
        blind = Repository(spark, str(root)).verify(full=True).select("symptom").distinct().collect()
        assert {r[0] for r in blind} == {"CORRUPT", "KEY_MISSING"}
    copy = tmp_path / "r"
    copy.mkdir()
    build_repository(copy, spark, encrypted)
    bucket = copy / "@data/Pool/1/1.buk"
    raw = bytearray(bucket.read_bytes())
    raw[16384 + 10] ^= 1
    bucket.write_bytes(bytes(raw))
    (copy / "@data/Pool/1/0.buk").unlink()
    broken = Repository(spark, str(copy), key_string() if encrypted else None).verify(full=True).collect()
    kinds = {(r["stage"], r["symptom"]) for r in broken}
    assert {("bucket", "MISSING"), ("chunk", "CORRUPT"), ("fingerprint", "CORRUPT"), ("catalog", "CORRUPT")} <= kinds


def test_unreferenced(built):
    _, _, repo, _ = built
    free = repo.unreferenced_chunks().filter("bucket = 1 OR chunk >= 8190").collect()
    assert [(r["bucket"], r["chunk"]) for r in free] == [(1, 2)]


def test_inspect_listing_and_discovery(built, spark):
    root, _, repo, encrypted = built
    kinds = repo.inspect_bucket(1, 1).collect()
    assert sum(r["chunks"] for r in kinds) == 8 and {r["encrypted"] for r in kinds} == {encrypted}
    names = [r["name"] for r in source.listing(spark, str(root)).collect()]
    assert names == ["@data", "db", "repo_info", "repo_transactions"]
    assert [r.root for r in discover(spark, str(root.parent))] == [str(root)]


def test_streaming(built, spark, tmp_path):
    root, _, _, _ = built
    query = findings_of_new_buckets(spark, str(root)).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("found").count() == 0


def test_sqlite_envelopes_and_drift(spark, tmp_path):
    import sqlite3

    import zstandard

    con = sqlite3.connect(tmp_path / "x.db")
    con.execute("CREATE TABLE t (a TEXT, b INTEGER)")
    con.execute("INSERT INTO t VALUES ('x', 1), (NULL, NULL)")
    con.commit()
    con.close()
    raw = zstandard.compress((tmp_path / "x.db").read_bytes())
    files = spark.createDataFrame([("p", bytearray(raw))], "path string, content binary")
    got = sqlite.read_table(spark, files, "t", {"a": "string"}, {"c": "bigint"}).orderBy("row_id").collect()
    assert [(r["a"], r["c"], r["row_id"]) for r in got] == [("x", None, 1), (None, None, 2)]
    with pytest.raises(Exception, match="missing columns: z"):
        sqlite.read_table(spark, files, "t", {"z": "string"}).collect()
    assert sqlite.tables_of(raw) == ["t"]
    with pytest.raises(CorruptData):
        sqlite.unzstd(raw, largest=10)


def test_conform(spark):
    df = spark.range(2).withColumn("x", F.lit("7"))
    assert conform(df, {"id": "int"}, {"y": "string"}).dtypes == [("id", "int"), ("y", "string")]
    with pytest.raises(CorruptData):
        conform(df, {"nope": "int"})


def test_walk_report_and_commands(built, capsysbinary):
    import json

    from blockvault.__main__ import main

    root, content, repo, encrypted = built
    walked = repo.walk_records().orderBy("offset").collect()
    assert [r["entries"] for r in walked] == [1, 2, 0, 0, 1] and all(r["problem"] is None for r in walked)
    assert repo.report()["file_map"] == 6
    key = ["--key", key_string()] if encrypted else []
    assert main([*key, "cat", str(root), "a/two.img", "--offset", "4000", "--length", "9000"]) == 0
    assert capsysbinary.readouterr().out == content["a/two.img"][4000:13000]
    assert main([*key, "verify", str(root)]) == 1
    assert json.loads(capsysbinary.readouterr().out.splitlines()[-1]) == {"problems": 1, "repaired": 0}
    assert main([*key, "tree", str(root), "1", "--parent", "a", "--limit", "1"]) == 0
    assert json.loads(capsysbinary.readouterr().out)["id"] == "a/b"


def test_objects_of_a_stream(built):
    _, content, repo, _ = built
    row = repo.object_bytes("a/two.img", 4000, 9000).first()
    assert bytes(row["content"]) == content["a/two.img"][4000:13000]
    assert repo.stream_file("u", "c", 1, 9) is None


def test_only_wanted_files_are_read(spark, tmp_path):
    """A file that no reader can load lies beside the catalogs, and a bucket that nothing refers to."""
    root = tmp_path / "r"
    root.mkdir()
    content = build_repository(root, spark)
    for path in ("db/huge", "@data/Pool/1/99.buk", "@data/Composition/1/7.com/other"):
        with open(root / path, "wb") as file:
            file.truncate(3 << 30)
    repo = Repository(spark, str(root))
    assert repo.report()["file_map"] == 6
    assert assemble(repo.read("c.img"), len(content["c.img"])) == content["c.img"]
    assert [(r["stage"], r["path"]) for r in repo.verify().collect()] == [("catalog", "old.img")]


def test_supplemental_tables_go_by_markers(spark, tmp_path):
    from .support import database

    root = tmp_path / "r"
    root.mkdir()
    build_repository(root, spark)
    shape = "connection_config_id INTEGER, connection_id TEXT"
    database(root / "db" / "connection_config.7", connection_config=(shape, [(100, "by transaction")]))
    database(root / "db" / "connection_config.20", connection_config=(shape, [(100, "by marker")]))
    database(root / "db" / "connection_config.30", connection_config=(shape, [(100, "unmarked")]))
    (root / "repo_transactions" / "repo_transaction.8").write_bytes(b"damaged, but not the highest")
    assert [r["connection_id"] for r in Repository(spark, str(root)).table("connection_config").collect()] == ["by transaction"]
    marks = root / "suppl_transaction_ids"
    marks.mkdir()
    for n in (6, 20, 40):
        (marks / str(n)).write_bytes(b"")
    repo = Repository(spark, str(root))
    assert [r["connection_id"] for r in repo.table("connection_config").collect()] == ["by marker"]
    assert repo.table("file_map").count() == 6  # by the transaction
    assert {r["path"] for r in repo.reachable_paths().collect()} == {"a/one.img", "a/two.img", "a/b/empty.img"}
    assert repo.verify(live=True).count() == 0
    (marks / "6").unlink()
    with pytest.raises(CorruptData):
        repo.table("file_meta").count()
    (root / "repo_info").unlink()
    assert [r["symptom"] for r in repo.check_repo_info().collect()] == ["MISSING"]


def test_records_over_sub_files(spark):
    from blockvault.functions import codec as K

    size = 1 << 24
    entry = lambda k: (K.MAPPING, k, (1 << 56) | (k << 16), 1, 0, False)
    head = K.build_header(b"cMpS", size.to_bytes(4, "big"))
    large = K.build_record([entry(k) for k in range(900_000)])  # over sub-files
    data, offsets = head, []
    for record in (K.build_record([entry(1)]), large, K.build_record([entry(2), entry(3)])):
        offsets.append(len(data))
        data += record
    parts = [(1, 7, k // size, bytearray(data[k : k + size])) for k in range(0, len(data), size)]
    assert len(parts) > 1
    df = spark.createDataFrame(parts, "stream long, session long, sub long, content binary")
    wanted = spark.createDataFrame([(1, 7, o) for o in [*offsets, 70, size - 5, 1 << 40]], "stream long, session long, offset long")
    got = {r["offset"]: (r["n"], r["problems"]) for r in source.records(wanted, df).groupBy("offset").agg(F.count("place").alias("n"), F.count("problem").alias("problems")).collect()}
    assert got == {offsets[0]: (1, 0), offsets[1]: (900_000, 0), offsets[2]: (2, 0), 70: (0, 1), size - 5: (0, 1), 1 << 40: (0, 1)}
    lost = source.records(wanted.limit(3), df.filter("sub <> 1")).groupBy("offset").agg(F.max("problem").alias("p")).collect()
    assert {r["offset"]: r["p"] for r in lost}[offsets[1]] == "missing sub-file"
    walked = source.walk(df).orderBy("offset").collect()
    assert [(r["offset"], r["entries"]) for r in walked] == list(zip(offsets, (1, 900_000, 2), strict=True))


def test_export_by_segments(spark, tmp_path, monkeypatch):
    from blockvault.sources import sink

    monkeypatch.setattr(sink, "SEGMENT_BYTES", 1000)
    rows = [("a/x", k * 500, bytearray([65 + k] * 300)) for k in range(20)] + [("y", 0, bytearray())]
    sink.export_files(spark.createDataFrame(rows, "file string, offset long, data binary"), str(tmp_path / "o"))
    got = read_tree(str(tmp_path / "o"))
    assert got["y"] == b"" and len(got["a/x"]) == 19 * 500 + 300
    assert all(got["a/x"][k * 500 : k * 500 + 300] == bytes([65 + k] * 300) for k in range(20)) and got["a/x"][300:500] == b"\0" * 200
    with pytest.raises(Exception, match="leaves the export folder"):
        sink.export_files(spark.createDataFrame([("../z", 0, bytearray(b"x"))], "file string, offset long, data binary"), str(tmp_path / "o"))
    assert sorted(read_tree(str(tmp_path / "o"))) == ["a/x", "y"]


def test_repeated_paths_are_one(spark):
    from blockvault.operators import catalog

    file_map = spark.createDataFrame([("p", 1, 5, 2), ("p", 1, 4, 2), ("q", 1, 1, 4)], "path string, stream_id int, session_id long, status int")
    meta = spark.createDataFrame([(1, "p", 10), (2, "p", 20)], "fid long, path string, file_size long")
    found = catalog.locate_files(file_map.select("path").distinct(), file_map, meta).orderBy("path").collect()
    assert [(r["path"], r["session_id"], r["file_size"], r["state"]) for r in found] == [("p", 4, 10, "OK"), ("q", 1, None, "CORRUPT")]


def test_mail_keeps_what_it_does_not_fill():
    from blockvault.functions.documents import build_eml

    part = lambda ident, encoding, body: f"--b\r\nContent-Type: text/plain\r\nContent-Transfer-Encoding: {encoding}\r\nX-ABL-ID: {ident}\r\n\r\n{body}\r\n".encode()
    head, end = b"From: a\r\nSubject: s\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n", b"--b--\r\n"
    got = build_eml(head + part("p1", "base64", "") + part("p2", "quoted-printable", "old") + part("p3", "7bit", "kept") + end, {"p1": b"one", "p2": "é=".encode()})
    lines = got.split(b"\r\n")
    assert got.startswith(head) and got.endswith(end) and b"X-ABL-ID: p3" in lines and b"kept" in lines
    assert b"b25l" in got and b"=C3=A9=3D" in got and b"old" not in got and b"X-ABL-ID: p1" not in got
    assert build_eml(b"Subject: s\nX-ABL-ID: x\n\nold", {"x": b"new"}) == b"Subject: s\n\nnew"
