"""Queries over ranges: extents, gaps, overlaps, reads and generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, intervals as I
from ..registry import query, table

DAY = 86400
_RANGES = """WITH i AS (
  SELECT o_custkey, o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS start, CAST(epoch(o_orderdate) AS BIGINT) + 864000 * (o_orderkey % 7 + 1) AS "end" FROM orders
)
"""
_MERGED = (
    _RANGES
    + """, b AS (SELECT *, max("end") OVER (PARTITION BY o_custkey ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM i),
n AS (SELECT *, sum(CASE WHEN reached IS NULL OR start > reached + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM b),
m AS (SELECT o_custkey, min(start) AS start, max("end") AS "end" FROM n GROUP BY o_custkey, island)
"""
)


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Fractions of a second are rounded, halves to even, as the SQL's cast does.
    at = F.rint(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000).cast("bigint")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", at.alias("start"), (at + 864000 * (F.col("o_orderkey") % 7 + 1)).alias("end"))


@query(_MERGED.format(gap=0) + 'SELECT o_custkey, start, "end" FROM m')
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge_ranges(_ranges(spark, sf_dir), ["o_custkey"], width=100 * DAY, odd=True)


@query(_MERGED.format(gap=20 * DAY) + 'SELECT o_custkey, start, "end" FROM m')
def coalesce_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that lie close enough become one: ranges whose distance is at most 20 days here."""
    return I.merge_ranges(_ranges(spark, sf_dir), ["o_custkey"], gap=20 * DAY, width=100 * DAY, odd=True)


@query(
    _MERGED.format(gap=0)
    + """, s AS (SELECT c_custkey AS o_custkey, CAST(epoch(TIMESTAMP '1995-01-01') AS BIGINT) AS lo, CAST(epoch(TIMESTAMP '1996-01-01') AS BIGINT) AS hi FROM customer),
c AS (SELECT s.o_custkey, lo, hi, greatest(start, lo) AS a, least("end", hi) AS b FROM s JOIN m ON s.o_custkey = m.o_custkey AND start < hi AND "end" > lo),
g AS (SELECT o_custkey, coalesce(lag(b) OVER (PARTITION BY o_custkey ORDER BY a), lo) AS gap_start, a AS gap_end FROM c
UNION ALL SELECT o_custkey, max(b), max(hi) FROM c GROUP BY o_custkey
UNION ALL SELECT o_custkey, lo, hi FROM s WHERE o_custkey NOT IN (SELECT o_custkey FROM c))
SELECT * FROM g WHERE gap_start < gap_end"""
)
def span_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = (F.unix_seconds(F.lit(f"{y}-01-01").cast("timestamp")) for y in (1995, 1996))
    spans = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), lo.alias("lo"), hi.alias("hi"))
    return I.gaps_within(_ranges(spark, sf_dir), spans, ["o_custkey"])


@query("""WITH e AS (SELECT l_orderkey, l_linenumber * 100 + l_partkey % 50 AS start, l_linenumber * 100 + l_partkey % 50 + CAST(l_quantity AS BIGINT) * 3 AS "end",
  CASE WHEN l_returnflag = 'N' THEN 'ZERO' ELSE 'DATA' END AS kind FROM lineitem),
z AS (SELECT o_orderkey AS l_orderkey, 900 + o_custkey % 100 AS size FROM orders),
b AS (SELECT *, coalesce(max("end") OVER (PARTITION BY l_orderkey ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM e),
l AS (SELECT z.l_orderkey, size, coalesce(max("end"), 0) AS reached FROM z LEFT JOIN e ON z.l_orderkey = e.l_orderkey GROUP BY z.l_orderkey, size)
SELECT l_orderkey, start, "end", kind FROM e UNION ALL SELECT l_orderkey, reached, start, 'HOLE' FROM b WHERE start > reached
UNION ALL SELECT l_orderkey, reached, size, 'HOLE' FROM l WHERE size > reached""")
def extents_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_linenumber") * 100 + F.col("l_partkey") % 50
    entries = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", start.alias("start"), (start + F.floor("l_quantity").cast("bigint") * 3).alias("end"), F.when(F.col("l_returnflag") == "N", "ZERO").otherwise("DATA").alias("kind")
    )
    sizes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (900 + F.col("o_custkey") % 100).alias("size"))
    return I.extents(entries, sizes, ["l_orderkey"])


@query(
    _RANGES
    + """, p AS (SELECT DISTINCT o_custkey, start AS a FROM i UNION SELECT o_custkey, "end" FROM i),
e AS (SELECT o_custkey, a, lead(a) OVER (PARTITION BY o_custkey ORDER BY a) AS b FROM p),
w AS (SELECT e.o_custkey, a, b, o_orderkey AS idx, row_number() OVER (PARTITION BY e.o_custkey, a ORDER BY start DESC, o_orderkey DESC) AS r
  FROM e JOIN i ON e.o_custkey = i.o_custkey AND start <= a AND "end" > a WHERE b IS NOT NULL),
x AS (SELECT *, lag(idx) OVER q AS p, lag(b) OVER q AS pe FROM w WHERE r = 1 WINDOW q AS (PARTITION BY o_custkey ORDER BY a)),
y AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> idx OR pe <> a THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY a) AS island FROM x)
SELECT o_custkey, idx, min(a) AS seg_start, max(b) AS seg_end FROM y GROUP BY o_custkey, island, idx"""
)
def winning_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.winning_segments(_ranges(spark, sf_dir).withColumnRenamed("o_orderkey", "idx"), ["o_custkey"], width=50 * DAY)


@query("""WITH e AS (SELECT l_partkey AS k, l_orderkey, l_linenumber, l_orderkey * 16 AS start, l_orderkey * 16 + CAST(l_quantity AS BIGINT) * 40 AS "end" FROM lineitem),
q AS (SELECT event_id, user_id AS k, CAST(floor(value * 100) AS BIGINT) + event_id % 1000 AS p FROM events)
SELECT event_id, l_orderkey, l_linenumber, p - start AS within FROM q JOIN e ON q.k = e.k AND start <= p AND p < "end" """)
def containment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that hold an offset, by cells of a grid."""
    entries = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("k"), "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 16).alias("start"), (F.col("l_orderkey") * 16 + F.floor("l_quantity").cast("bigint") * 40).alias("end")
    )
    points = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), (F.floor(F.col("value") * 100).cast("bigint") + F.col("event_id") % 1000).alias("at"))
    return I.covering(points, entries, ["k"], "at", 1024).select("event_id", "l_orderkey", "l_linenumber", (F.col("at") - F.col("start")).alias("within"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_partkey % 12 AS v FROM lineitem), i AS (SELECT *, v - row_number() OVER (PARTITION BY l_orderkey ORDER BY v) AS g FROM d)
SELECT l_orderkey, min(v) AS first, count(*) AS length FROM i GROUP BY l_orderkey, g""")
def ascending_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.ascending_runs(table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 12).alias("v")), ["l_orderkey"], "v")


@query(r"""WITH f AS (SELECT o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'db' || o_orderkey % 3 ELSE 'db' || o_orderkey % 3 || '.' || o_orderkey END AS name FROM orders),
s AS (SELECT o_custkey, regexp_replace(name, '\.[0-9]+$', '') AS logical, name, coalesce(CAST(nullif(regexp_extract(name, '\.([0-9]+)$', 1), '') AS BIGINT), -1) AS seq FROM f)
SELECT o_custkey, logical, arg_max(name, seq) AS physical, max(seq) AS seq FROM s GROUP BY o_custkey, logical""")
def latest_sequence_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.latest_sequence(_files(spark, sf_dir), ["o_custkey"])


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    stem = F.concat(F.lit("db"), (key % 3).cast("string"))
    return table(spark, sf_dir, "orders").select("o_custkey", F.when(key % 5 == 0, stem).otherwise(F.concat(stem, F.lit("."), key.cast("string"))).alias("name"))


_FILES = r"""WITH f AS (SELECT o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'db' || o_orderkey % 3 ELSE 'db' || o_orderkey % 3 || '.' || o_orderkey END AS name FROM orders),
s AS (SELECT o_custkey, regexp_replace(name, '\.[0-9]+$', '') AS logical, name, CAST(nullif(regexp_extract(name, '\.([0-9]+)$', 1), '') AS BIGINT) AS seq FROM f),
"""
_PICK = """g AS (SELECT o_custkey, logical, max(CASE WHEN ok THEN seq END) AS generation, count(seq) AS suffixed, max(CASE WHEN seq IS NULL THEN name END) AS bare FROM v GROUP BY o_custkey, logical)
SELECT o_custkey, logical, CASE WHEN generation IS NOT NULL THEN logical || '.' || generation WHEN suffixed = 0 THEN bare END AS physical, generation FROM g"""


@query(_FILES + "v AS (SELECT s.*, seq < 7 * (o_custkey % 2000) AS ok FROM s), " + _PICK)
def committed_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest generation strictly below the committed transaction."""
    txn = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (7 * (F.col("c_custkey") % 2000)).alias("txn"))
    return asof.committed_generation(_files(spark, sf_dir), ["o_custkey"], txn)


@query(_FILES + "v AS (SELECT s.*, seq % 2 = 0 AS ok FROM s), " + _PICK)
def marked_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest generation that has a marker; here even ones have."""
    files = _files(spark, sf_dir)
    markers = files.select("o_custkey", asof.logical_name(F.col("name")).alias("logical"), asof.sequence(F.col("name")).alias("n")).filter("n % 2 = 0")
    return asof.committed_generation(files, ["o_custkey"], None, markers)


@query("""WITH g AS (SELECT o_custkey AS k, o_orderkey AS gen FROM orders), r AS (SELECT c_custkey AS k, c_custkey * 7 AS want, c_custkey * 7 + 4000 AS cap FROM customer),
n AS (SELECT r.k, want, cap, min(gen) AS nearest FROM r LEFT JOIN g ON g.k = r.k AND gen >= want GROUP BY r.k, want, cap)
SELECT k, want, cap, CASE WHEN nearest <= cap THEN nearest END AS nearest FROM n""")
def forward_asof_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    generations = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("gen"))
    key = F.col("c_custkey")
    requests = table(spark, sf_dir, "customer").select(key.alias("k"), (key * 7).alias("want"), (key * 7 + 4000).alias("cap"))
    return asof.forward_asof(requests, generations, ["k"], "want", "gen", "cap")
