"""Queries over names and formatted values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats as V
from ..functions import names as N
from ..functions import refs as R
from ..registry import query, table

_LABELS = """WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'n' || (c_custkey % 40) END AS hint FROM customer),
h AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY c_nationkey, name) > 1 AND hint <> '' THEN name || ' · ' || hint ELSE name END AS candidate FROM c),
l AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY c_nationkey, candidate) > 1 THEN candidate || ' #' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 4) ELSE candidate END AS label FROM h)
"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    hint = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("n"), (key % 40).cast("string")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("name"), hint.alias("hint"))
    return N.disambiguate(rows, ["c_nationkey"], "name", "c_custkey", "hint")


@query(_LABELS + "SELECT c_custkey, c_nationkey, name, hint, label FROM l")
def disambiguate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)


@query(_LABELS + """SELECT 'BUILDING' AS target, CASE WHEN count_if(label = 'BUILDING') > 0 THEN CAST(count_if(label = 'BUILDING') AS BIGINT) ELSE CAST(count_if(name = 'BUILDING') AS BIGINT) END AS matches,
CASE WHEN count_if(label = 'BUILDING') > 0 THEN count_if(label = 'BUILDING') ELSE count_if(name = 'BUILDING') END > 1 AS ambiguous FROM l""")
def match_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.match_label(_labels(spark, sf_dir), "BUILDING", "name", "label")


@query("""WITH p AS (SELECT p_partkey, p_size, upper(substr(p_type, 1, 5)) || CASE WHEN p_partkey % 2 = 0 THEN '.eml' ELSE '' END AS name FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY p_size, lower(name) ORDER BY p_partkey) AS nth FROM p)
SELECT p_partkey, p_size, name, CASE WHEN nth > 1 THEN CASE WHEN p_partkey % 2 = 0 THEN regexp_replace(name, '\\.eml$', '') || ' (' || nth || ').eml' ELSE name || ' (' || nth || ')' END ELSE name END AS file_name FROM n""".replace("\\\\", "\\"))
def numbered_export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.upper(F.substring("p_type", 1, 5)), F.when(F.col("p_partkey") % 2 == 0, ".eml").otherwise(""))
    return N.numbered_names(table(spark, sf_dir, "part").select("p_partkey", "p_size", name.alias("name")), ["p_size"], "name", ["p_partkey"])


@query("""WITH s AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'con.txt' WHEN 1 THEN url || '. ' WHEN 2 THEN '' ELSE url END AS name FROM pages),
p AS (SELECT *, regexp_replace(regexp_replace(name, '[<>:"/\\|?*]', '_', 'g'), '[. ]+$', '') AS plain FROM s)
SELECT page_id, CASE WHEN plain = '' THEN '_' WHEN regexp_matches(lower(plain), '^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\\..*)?$') THEN '_' || plain ELSE plain END AS safe FROM p""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    name = F.when(k == 0, "con.txt").when(k == 1, F.concat(F.col("url"), F.lit(". "))).when(k == 2, "").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", N.safe_file_name(name).alias("safe"))


@query("""SELECT page_id, replace(replace(replace(replace(url, '%', '%25'), '/', '%2F'), '#', '%23'), '?', '%3F') AS encoded, url AS decoded FROM pages""")
def ref_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of references, percent-encoded and back."""
    rows = table(spark, sf_dir, "pages").select("page_id", N.percent_encode(F.col("url")).alias("encoded"))
    return rows.withColumn("decoded", N.percent_decode(F.col("encoded")))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_name WHEN 2 THEN 'mail' || c_custkey || '@example.com' ELSE 'SITE' END AS shown,
coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END, ''), '(no subject)') AS subject FROM customer""")
def display_name_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first usable name of a workload's spec, which is JSON."""
    k, text = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    spec = (
        F.when(k == 0, F.concat(F.lit('{"spec":{"workload_name":"'), "c_mktsegment", F.lit('"}}')))
        .when(k == 1, F.concat(F.lit('{"status":{"entity_meta":{"spec":{"user_info":{"name":"'), "c_name", F.lit('","email":"x"}}}}}')))
        .when(k == 2, F.concat(F.lit('{"status":{"entity_meta":{"spec":{"user_info":{"name":"","email":"mail'), text, F.lit('@example.com"}}}}}')))
        .otherwise('{"spec":{"workload_type":"SITE"}}')
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", spec.alias("spec"), F.when(k == 0, "VM").otherwise("M365").alias("type"))
    subject = N.mail_name(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(""))
    return rows.select("c_custkey", N.workload_name(F.col("spec"), F.col("type")).alias("shown"), subject.alias("subject"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * l_linenumber * l_linenumber * 37) AS BIGINT) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN n >= 1073741824 THEN printf('%.1f GiB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.1f MiB', n / 1048576.0::DOUBLE)
WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS size FROM s""")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.col("l_extendedprice") * F.col("l_linenumber") * F.col("l_linenumber") * 37).cast("bigint")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.format_bytes(n).alias("size"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 7) AS BIGINT) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN n >= 3600 THEN printf('%02d:%02d:%02d', n // 3600, n // 60 % 60, n % 60) ELSE printf('%02d:%02d', n // 60, n % 60) END AS duration,
n % 3 || CASE WHEN n % 3 = 1 THEN ' item' ELSE ' items' END AS items FROM s""")
def format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.col("l_extendedprice") / 7).cast("bigint")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.format_duration(n).alias("duration"), V.pluralize(n % 3, "item", "items").alias("items"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(NULL AS BIGINT) WHEN 1 THEN NULL WHEN 2 THEN event_id * 1000 ELSE nullif(user_id, 0) END AS epoch FROM events""")
def tolerant_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch seconds from texts and numbers; 0 and other texts are unset."""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, "0").when(k == 1, "soon").when(k == 2, (F.col("event_id") * 1000).cast("string")).otherwise(F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", V.epoch_seconds(raw).alias("epoch"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'FREQ=DAILY' || CASE WHEN user_id % 3 + 1 > 1 THEN ';INTERVAL=' || (user_id % 3 + 1) ELSE '' END
WHEN 1 THEN 'FREQ=WEEKLY' || CASE WHEN user_id % 3 + 1 > 1 THEN ';INTERVAL=' || (user_id % 3 + 1) ELSE '' END || ';BYDAY=MO,FR'
WHEN 2 THEN 'FREQ=MONTHLY' || CASE WHEN user_id % 3 + 1 > 1 THEN ';INTERVAL=' || (user_id % 3 + 1) ELSE '' END || ';BYMONTHDAY=' || (event_id % 28 + 1) END AS rule,
CASE event_id % 4 WHEN 0 THEN 'Daily' WHEN 1 THEN 'Weekly' WHEN 2 THEN 'Monthly' ELSE 'Recurring' END AS label FROM events""")
def recurrence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    kind = F.when(k == 0, "daily").when(k == 1, "weekly").when(k == 2, "absoluteMonthly").otherwise("lunar")
    days = F.when(k == 1, F.array(F.lit("monday"), F.lit("friday")))
    pattern = F.to_json(F.struct(kind.alias("type"), (F.col("user_id") % 3 + 1).alias("interval"), days.alias("daysOfWeek"), (F.col("event_id") % 28 + 1).alias("dayOfMonth")))
    rows = table(spark, sf_dir, "events").select("event_id", pattern.alias("pattern"))
    return rows.select("event_id", V.recurrence_rule(F.col("pattern")).alias("rule"), V.recurrence_label(F.col("pattern")).alias("label"))


@query("""SELECT doc_id, CASE WHEN length(text) = 0 THEN 'empty' WHEN left(ltrim(text), 1) IN ('{', '[') THEN 'json' ELSE 'data' END AS kind FROM documents
UNION ALL SELECT page_id + 1000000000, CASE WHEN starts_with(lower(html), '<!doctype html') OR starts_with(lower(html), '<html') THEN 'html' ELSE 'data' END FROM pages""")
def sniff_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", V.sniffed_kind(F.col("text").cast("binary")).alias("kind"))
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") + 1000000000).alias("doc_id"), V.sniffed_kind(F.col("html").cast("binary")).alias("kind"))
    return docs.union(pages)


@query("""SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'licen') OR contains(lower(source), 'src1')""")
def filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that hold a text, whatever its case; an empty text would keep all."""
    wanted = [("text", "LICEN"), ("source", "Src1")]
    hit = F.lit(False)
    for column, text in wanted:
        hit = hit | F.lower(column).contains(text.lower())
    return table(spark, sf_dir, "documents").filter(hit).select("doc_id", "lang", "source")


@query("""SELECT page_id, 'repo/a#' || CASE page_id % 3 WHEN 0 THEN '@cat:' || page_id || '/wl:2/ver:x' WHEN 1 THEN '@raw/' || replace(replace(replace(url, '%', '%25'), '#', '%23'), '/', '%2F') ELSE '%40b%23/' || replace(replace(replace(url, '%', '%25'), '#', '%23'), '/', '%2F') END AS ref,
CASE page_id % 3 WHEN 0 THEN 'CANONICAL' WHEN 1 THEN 'RAW' ELSE 'HUMAN' END AS kind, CASE page_id % 3 WHEN 0 THEN 'ver:x' ELSE url END AS last FROM pages""")
def node_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the three shapes, written and read again."""
    k = F.col("page_id") % 3
    segments = F.when(k == 0, R.canonical(F.col("page_id"), F.lit(2), F.lit("x"))).when(k == 1, F.array(F.lit("raw"), F.col("url"))).otherwise(F.array(F.lit("@b#"), F.col("url")))
    kind = F.when(k == 0, "CANONICAL").when(k == 1, "RAW").otherwise("HUMAN")
    rows = table(spark, sf_dir, "pages").select("page_id", R.format_ref(F.lit("repo/a"), segments, kind).alias("ref")).withColumn("p", R.parse_ref(F.col("ref")))
    return rows.select("page_id", "ref", "p.kind", F.element_at("p.segments", -1).alias("last"))
