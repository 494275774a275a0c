"""Operators against brute force on small random inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from blockvault.functions import address as A
from blockvault.functions import documents as D
from blockvault.functions import formats as V
from blockvault.functions import names as N
from blockvault.operators import asof
from blockvault.operators import chunks as C
from blockvault.operators import intervals as I
from blockvault.operators import trees as T


@pytest.fixture(scope="module")
def fragments():
    rng = random.Random(5)
    out = []
    for key in range(6):
        for i in range(rng.randrange(1, 12)):
            a = rng.randrange(60)
            out.append((key, a, a + rng.randrange(0, 25), i))
    return out


def covered(fragments, key):
    return {x for k, a, b, _ in fragments if k == key for x in range(a, b)}


@pytest.mark.parametrize("width", [None, 7])
def test_merge(spark, fragments, width):
    df = spark.createDataFrame(fragments, "k int, start long, end long, idx int")
    got = I.merge_ranges(df, ["k"], width=width).collect()
    for key in range(6):
        mine = sorted((r["start"], r["end"]) for r in got if r["k"] == key)
        assert {x for a, b in mine for x in range(a, b)} == covered(fragments, key)
        assert all(b < c for (_, b), (c, _) in zip(mine, mine[1:], strict=False))


def test_gaps(spark, fragments):
    df = spark.createDataFrame(fragments, "k int, start long, end long, idx int")
    spans = spark.createDataFrame([(k, 10, 70) for k in range(8)], "k int, lo long, hi long")
    got = I.gaps_within(df, spans, ["k"]).collect()
    for key in range(8):
        free = {x for r in got if r["k"] == key for x in range(r["gap_start"], r["gap_end"])}
        assert free == set(range(10, 70)) - covered(fragments, key)


def test_winners(spark, fragments):
    df = spark.createDataFrame(fragments, "k int, start long, end long, idx int")
    got = {(r["k"], x): r["idx"] for r in I.winning_segments(df, ["k"], width=5).collect() for x in range(r["seg_start"], r["seg_end"])}
    want = {}
    for k, a, b, i in sorted(fragments, key=lambda f: (f[1], f[3])):
        want |= {(k, x): i for x in range(a, b)}
    assert got == want


def test_forward_asof(spark):
    generations = spark.createDataFrame([(1, 5), (1, 9), (2, 3)], "k int, g long")
    requests = spark.createDataFrame([(1, 5, 9), (1, 6, 8), (1, 6, 9), (2, 4, 9), (3, 1, 9)], "k int, want long, cap long")
    got = {(r["k"], r["want"], r["cap"]): r["nearest"] for r in asof.forward_asof(requests, generations, ["k"], "want", "g", "cap").collect()}
    assert got == {(1, 5, 9): 5, (1, 6, 8): None, (1, 6, 9): 9, (2, 4, 9): None, (3, 1, 9): None}


def test_generations(spark):
    files = spark.createDataFrame([("r", n) for n in ("db.3", "db.7", "db.9", "db", "bare", "none.99")], "k string, name string")
    txn = spark.createDataFrame([("r", 9)], "k string, txn long")
    got = {r["logical"]: r["physical"] for r in asof.committed_generation(files, ["k"], txn).collect()}
    assert got == {"db": "db.7", "bare": "bare", "none": None}
    assert {r["logical"]: r["physical"] for r in asof.latest_sequence(files, ["k"]).collect()} == {"db": "db.9", "bare": "bare", "none": "none.99"}


def test_addresses(spark):
    rows = [(200, 5, 8191, 3), (0, 0, 0, 8192), (1, (1 << 40) - 2, 8000, 192)]
    df = spark.createDataFrame(rows, "s long, b long, c long, k long").withColumn("a", A.pack(F.col("s"), F.col("b"), F.col("c")))
    moved = A.advance(F.col("a"), F.col("k"))
    for (s, b, c, k), r in zip(rows, df.select(A.stream_of(moved), A.bucket_of(moved), A.chunk_of(moved)).collect(), strict=True):
        n = b * 8192 + c + k
        assert tuple(r) == (s, n // 8192, n % 8192)
    paths = spark.createDataFrame([(5,), (1024,), (3 << 30,)], "i long").select(A.layer_path(F.col("i"))).collect()
    assert [r[0] for r in paths] == ["5", "1/1024", f"3/{3 << 10}/{3 << 20}/{3 << 30}"]


def against_sql(spark, tmp_path, name, **tables):
    """What a query has and its SQL has not, and the reverse, over these tables (rows, schema)."""
    import duckdb

    from blockvault import queries as Q

    from .support import rows

    con = duckdb.connect()
    for t, (values, schema) in tables.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    return rows(Q.queries()[name](spark, str(tmp_path)).toPandas()), rows(con.execute(Q.oracle_sql()[name]).df())


def test_layer_path_of_large_keys(spark, tmp_path):
    """Bucket numbers have three layers, also where a key is beyond their 40 bits."""
    keys = [0, 1, 30, 3000, 106466, 106467, 900000, 9000000]
    got, want = against_sql(spark, tmp_path, "layer_path", orders=([(k,) for k in keys], "o_orderkey long"))
    assert got == want and len(got) == len(keys)
    row = spark.range(1).select(A.layer_path(F.lit(3 << 40)), A.pool_path(F.lit(7), F.lit((1 << 40) - 1))).first()
    assert row[0].count("/") == 4 and row[1] == f"@data/Pool/7/{(1 << 10) - 1}/{(1 << 20) - 1}/{(1 << 30) - 1}/{(1 << 40) - 1}.buk"


def test_shown_values_of_large_keys(spark, tmp_path):
    """Times after the year 9999 are shown as the SQL has them; elsewhere they are still none."""
    values = [(k, k + 1, 1, 3, 1.0 + k % 50, "N", "O") for k in (0, 1, 2534022, 2534023, 2534024, 9000000)]
    got, want = against_sql(spark, tmp_path, "shown_values", lineitem=([(*v[:5],) for v in values], "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double"))
    assert got == want and any("30489-11-11" in r or "10000-" in r for r in got)
    assert spark.range(1).select(V.epoch_timestamp(F.lit("253402300800"))).first()[0] is None


@pytest.mark.parametrize("name", ["merge_ranges", "coalesce_reads"])
def test_odd_orders_merge_as_in_sql(spark, tmp_path, name):
    """Orders without a date, a key or a customer, and with negative keys, whose ranges are empty."""
    from datetime import datetime, timedelta

    rng = random.Random(7)
    date = lambda: None if rng.random() < 0.2 else datetime(1995, 1, 1) + timedelta(days=rng.randrange(900))
    orders = [(None if rng.random() < 0.1 else rng.randrange(-400, 400), None if k % 40 == 0 else k % 60, date()) for k in range(400)]
    orders += [(5, 100, None), (6, 100, None), (None, 101, datetime(1996, 1, 1)), (-3, 102, datetime(1996, 1, 1))]
    # No two ranges of a customer are the same, which the SQL's order would leave open.
    orders = list({(c, d, None if k is None else int(math.fmod(k, 7))): (k, c, d) for k, c, d in orders}.values())
    got, want = against_sql(spark, tmp_path, name, orders=(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"))
    assert got == want and "(None, 100, None)" in got


@pytest.mark.parametrize("name", ["merge_ranges", "coalesce_reads"])
def test_orders_within_a_second_merge_as_in_sql(spark, tmp_path, name):
    """Times with fractions of a second, halves among them; each customer has one order or two that meet or just do not."""
    from datetime import datetime, timedelta

    ten, gap = timedelta(days=10), timedelta(days=20 if name == "coalesce_reads" else 0)
    first = [datetime(year, 1, 1, 0, 0, s, micros) for year in (1960, 1995) for s in (0, 1) for micros in (0, 1, 499_999, 500_000, 500_001, 999_999)]
    orders = [(0, k, t) for k, t in enumerate(first)]
    orders += [(0, k, t + ten + gap + timedelta(microseconds=d)) for k, (t, d) in enumerate(zip(first, [0, 400_000, 500_000, 700_000] * 6, strict=True)) if k % 3]
    got, want = against_sql(spark, tmp_path, name, orders=(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"))
    assert got == want and len(first) < len(want) < len(orders)


@pytest.mark.parametrize("name", ["merge_ranges", "coalesce_reads"])
def test_same_ranges_merge_in_any_order(spark, tmp_path, monkeypatch, name):
    """Many orders of a customer with the same range: as the SQL whose two windows order them alike, by their keys."""
    from datetime import datetime, timedelta

    from blockvault import queries as Q

    rng = random.Random(11)
    orders = [(k, k % 9, datetime(1995, 1, 1) + timedelta(days=15 * rng.randrange(150))) for k in range(2000)]
    sql = Q.oracle_sql()
    alike = sql[name].replace('ORDER BY start, "end" ROWS', 'ORDER BY start, "end", o_orderkey ROWS')
    monkeypatch.setattr(Q, "oracle_sql", lambda: sql | {name: alike})
    got, want = against_sql(spark, tmp_path, name, orders=(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"))
    assert got == want and alike.count(", o_orderkey ROWS") == 2 and len({(c, d, k % 7) for k, c, d in orders}) < len(orders)


def test_runs_expand_like_single_chunks(spark):
    rng = random.Random(1)
    rows = [(i, (2 << 56) | (rng.randrange(3) << 16) | rng.randrange(8180, 8192), rng.randrange(1, 20), rng.randrange(4)) for i in range(30)]
    df = spark.createDataFrame([(i, a, t, r, lo, rng.randrange(lo, t * (r + 1))) for i, a, t, r in rows for lo in [rng.randrange(t * (r + 1))]], "i int, address long, template long, repeat long, first_k long, last_k long")
    got = {(r["i"], r["k"] + j): (r["bucket"], r["chunk"] + j) for r in C.chunk_runs(df, ["i"]).collect() for j in range(r["n"])}
    want = {}
    for r in df.collect():
        base = ((r["address"] >> 16) & ((1 << 40) - 1)) * 8192 + (r["address"] & 0xFFFF)
        want |= {(r["i"], k): divmod(base + k % r["template"], 8192) for k in range(r["first_k"], r["last_k"] + 1)}
    assert got == want


def test_numbered_is_dense_and_ordered(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("x"))
    got = C.numbered(df, ["x"], F.floor(F.col("x") / 100).cast("bigint")).orderBy("x").collect()
    assert [r["number"] for r in got] == list(range(1000))


def test_closure_and_pages(spark):
    nodes = spark.createDataFrame([(None, "a", "A", False), ("a", "b", "B", False), ("b", "c", "C", True), ("a", "d", "D", True)], "parent string, id string, name string, is_leaf boolean")
    got = {(r["ancestor"], r["id"], r["depth"]) for r in T.closure(nodes).collect()}
    assert got == {("a", "a", 0), ("b", "b", 0), ("c", "c", 0), ("d", "d", 0), ("a", "b", 1), ("b", "c", 1), ("a", "d", 1), ("a", "c", 2)}
    assert [r["id"] for r in T.children(nodes, "a").collect()] == ["b", "d"]
    assert [r["id"] for r in T.children(nodes, "a", 1, 5).collect()] == ["d"]


def test_depths(spark):
    """Also of a tree that is deeper, and of more rows, than a recursive query of Spark may have."""
    chain = spark.range(300).selectExpr("CAST(IF(id = 0, NULL, id - 1) AS STRING) AS parent", "CAST(id AS STRING) AS id")
    assert {(r["id"], r["depth"]) for r in T.depths(chain).collect()} == {(str(k), k) for k in range(300)}
    wide = spark.range(1_000_100).selectExpr("CAST(IF(id < 4, NULL, id DIV 1000) AS STRING) AS parent", "CAST(id AS STRING) AS id")
    assert T.depths(wide).count() == 1_000_100
    odd = [(None, "a"), ("a", "b"), ("a", "b"), ("b", "c"), ("lost", "d"), ("f", "e"), ("e", "f"), ("e", "g"), ("h", "h"), ("c", None)]
    nodes = spark.createDataFrame(odd, "parent string, id string")
    assert sorted(map(tuple, T.depths(nodes).collect()), key=str) == sorted([("a", 0), ("b", 1), ("b", 1), ("c", 2), ("c", 2), (None, 3), (None, 3)], key=str)
    assert sorted(map(tuple, T.depths(nodes, "c").collect()), key=str) == sorted([("c", 0), (None, 1)], key=str)
    assert T.depths(nodes.limit(0)).count() == 0


def test_names(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(N.join_path(F.lit("a/"), F.lit("/b"), F.lit(""))) == "a/b"
    assert value(N.join_path(F.lit("a"), F.lit("../b"))) is None
    assert [value(N.safe_file_name(F.lit(x))) for x in ("a:b", "con", "nul.txt", "x. ", "")] == ["a_b", "_con", "_nul.txt", "x", "_"]
    assert value(N.with_number(F.lit("a.tar.gz"), F.lit(2))) in ("a (2).tar.gz", "a.tar (2).gz")
    assert value(N.percent_decode(N.percent_encode(F.lit("a/b%c+d#")))) == "a/b%c+d#"
    assert value(N.contact_name(F.lit(""), F.lit("L"), F.lit("m"))) == "L"
    assert value(V.format_bytes(F.lit(1536).cast("bigint"))) == "1.5 KiB"
    assert value(V.format_duration(F.lit(3723))) == "01:02:03"
    assert value(V.mode_flags(F.lit(0x83))) == ["COMPRESS", "CHUNK_CRC", "VAULT_ENCRYPT"]
    assert value(V.epoch_timestamp(F.lit("99999999999999"))) is None


def test_documents():
    skeleton = b"MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain\r\nX-ABL-ID: 2\r\n\r\n\r\n--b\r\nContent-Type: text/plain\r\nContent-Transfer-Encoding: quoted-printable\r\nX-ABL-ID: 1\r\n\r\n\r\n--b--\r\n"
    mail = D.build_eml(skeleton, {"1": "é".encode(), "2": b"two"})
    assert b"X-ABL-ID" not in mail and b"two" in mail and b"=C3=A9" in mail
    ics = D.build_ics(b'{"subject":"a,b","start":{"date":"2024-02-03"},"organizer":{"emailAddress":{"address":"x@y"}}}', "e1").decode()
    assert "SUMMARY:a\\,b" in ics and "DTSTART;VALUE=DATE:20240203" in ics and "UID:e1" in ics and "ORGANIZER:mailto:x@y" in ics
    assert all(len(line.encode()) <= 75 for line in D.build_ics(b'{"subject":"' + b"x" * 500 + b'"}', "e").decode().split("\r\n"))
    assert D.sanitize('<b onclick=x>a<script>bad()</script><a href="javascript:1">l</a><img src=s>', {"s": "QQ=="}) == '<b>a<a>l</a><img src="data:image/png;base64,QQ=="></b>'


def test_link_names(spark):
    from blockvault.operators import catalog

    links = spark.createDataFrame([("a_b_x_y",), ("a_b_c_z",), ("c_o_",), ("d_o_n_m",), ("plain",)], "key string")
    got = {r["connection_id"]: r["display_name"] for r in catalog.link_names(links).collect()}
    assert got["a"] == "c_z" and got["a_b"] == "c_z" and got["d"] == "n_m" and "c" not in got and "plain" not in got
