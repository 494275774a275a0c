"""Queries over items and the documents that are built of them."""

from __future__ import annotations

import email
import email.policy

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import documents as D
from ..operators import saas as S
from ..registry import query, table

@query(
    '''SELECT c_custkey, chr(65279) || '"First Name","Middle Name","Last Name","E-mail Address","Business Phone","Home Phone","Mobile Phone","Job Title","Company","Business Street","Business City","Business State","Business Postal Code","Business Country/Region","Notes"'
|| chr(13) || chr(10) || '"' || c_name || '","","' || c_mktsegment || ' ""x""","m' || c_custkey || '@example.com","' || c_custkey || '","","","","","","' || c_mktsegment || '","","","N' || c_nationkey || '",""' || chr(13) || chr(10) AS csv FROM customer'''
)
def contact_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    client = F.struct(
        F.col("c_name").alias("givenName"), F.concat("c_mktsegment", F.lit(' "x"')).alias("surname"), F.array(key).alias("businessPhones"),
        F.array(F.struct(F.concat(F.lit("m"), key, F.lit("@example.com")).alias("address"))).alias("emailAddresses"),
        F.struct(F.col("c_mktsegment").alias("city"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("countryOrRegion")).alias("businessAddress"),
    )
    meta = F.to_json(F.struct(client.alias("client_metadata")))
    return table(spark, sf_dir, "customer").select("c_custkey", meta.alias("meta")).select("c_custkey", D.contact_csv(F.col("meta")).alias("csv"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment WHEN c_custkey % 4 = 1 THEN '(no title)' WHEN c_custkey % 4 = 2 THEN c_name || ', Guest' ELSE 'Bot' END AS label,
CASE c_custkey % 3 WHEN 0 THEN 'private' ELSE 'standard' END AS category FROM customer""")
def chat_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    one = lambda name, mail: F.struct(F.lit(mail).alias("userEmail"), name.alias("display_name"))
    members = F.to_json(F.array(one(F.lit("Me"), "me@example.com"), one(F.col("c_name"), "a@example.com"), one(F.lit(""), "b@example.com"), one(F.lit("Guest"), "c@example.com")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k == 0, F.col("c_mktsegment")).otherwise("").alias("topic"), F.when(k == 1, 2).otherwise(0).alias("kind"), F.when(k == 2, members).alias("members"))
    label = S.chat_label(F.col("topic"), F.col("kind"), F.col("members"), F.lit("Me@Example.com"))
    kind = F.when(F.col("c_custkey") % 3 == 0, "Private").when(F.col("c_custkey") % 3 == 1, "odd")
    return rows.select("c_custkey", label.alias("label"), S.channel_category(kind).alias("category"))


_THREAD = """WITH m AS (SELECT conv_id, turn AS msg_id, text AS body, CASE WHEN turn % 5 = 4 THEN NULL ELSE make_timestamp((turn * 40000 + conv_id % 1000) * 1000000) END AS created,
CASE WHEN turn % 3 = 1 THEN turn - 1 WHEN turn % 3 = 2 THEN 1000000 END AS reply_to_id, role = 'system' AS is_system, turn % 7 = 6 AS is_deleted FROM conversations),
p AS (SELECT *, row_number() OVER w AS place, created IS NOT NULL AND coalesce(lag(CAST(created AS DATE)) OVER w <> CAST(created AS DATE), true) AS new_day FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY created NULLS FIRST, msg_id))
SELECT p.conv_id, p.msg_id, CAST(p.place AS INTEGER) AS place, p.new_day, CASE WHEN p.reply_to_id IS NULL THEN NULL WHEN q.msg_id IS NULL THEN '(message not available)'
ELSE CASE WHEN length(q.body) > 80 THEN substr(q.body, 1, 79) || '…' ELSE coalesce(q.body, '') END END AS reply_to_text,
CASE WHEN p.is_deleted THEN '(deleted)' WHEN p.is_system THEN '* ' || coalesce(p.body, '') ELSE coalesce(p.body, '') END AS shown FROM p LEFT JOIN m q ON q.conv_id = p.conv_id AND q.msg_id = p.reply_to_id"""


@query(_THREAD)
def thread_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    created = F.when(t % 5 != 4, F.timestamp_seconds(t * 40000 + F.col("conv_id") % 1000))
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", t.alias("msg_id"), F.col("text").alias("body"), created.alias("created"), F.when(t % 3 == 1, t - 1).when(t % 3 == 2, 1000000).alias("reply_to_id"),
        (F.col("role") == "system").alias("is_system"), (t % 7 == 6).alias("is_deleted"),
    )
    return S.thread_rows(rows, "conv_id").select("conv_id", "msg_id", "place", "new_day", "reply_to_text", "shown")


@query("""SELECT doc_id, text AS body FROM documents""")
def eml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as the bodies of mails: taken out, put back by id, read again."""
    skeleton = "From: a@example.com\r\nSubject: s\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\nX-ABL-ID: p1\r\n\r\n\r\n--b--\r\n"

    @F.pandas_udf(T.StringType())
    def body(mails: pd.Series) -> pd.Series:
        read = lambda raw: email.message_from_bytes(raw, policy=email.policy.compat32).get_payload(0).get_payload(decode=True).decode()
        return mails.map(read)

    docs = table(spark, sf_dir, "documents")
    mails = docs.select("doc_id", D.eml(F.lit(skeleton).cast("binary"), F.array(F.lit("p0"), F.lit("p1")), F.array(F.lit(b""), F.encode("text", "utf-8"))).alias("eml"))
    return mails.select("doc_id", body("eml").alias("body"))


@query("""SELECT o_orderkey, 'DTSTART:' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS start, 'UID:' || o_orderkey AS uid, o_orderkey % 5 = 0 AS refused FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, NULL, NULL, true FROM orders WHERE o_orderkey % 5 = 0""")
def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    when = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("dateTime"), F.lit("UTC").alias("timeZone"))
    plain = F.to_json(F.struct(when.alias("start"), F.lit("A, b").alias("subject"), key.alias("iCalUId")))
    meta = F.when(F.col("o_orderkey") % 5 == 0, '{"client_metadata":{"RawXML":"<x/>"}}').otherwise(plain)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", D.ics(meta.cast("binary"), key).cast("string").alias("ics"))
    line = lambda name: F.nullif(F.regexp_extract("ics", f"(?m)^({name}:[^\\r]*)", 1), F.lit(""))
    return rows.select("o_orderkey", line("DTSTART").alias("start"), line("UID").alias("uid"), F.col("ics").isNull().alias("refused"))


@query("""SELECT page_id, true AS clean FROM pages""")
def sanitized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as message bodies: no script, style, or attribute but harmless ones is left."""
    rows = table(spark, sf_dir, "pages").select("page_id", D.sanitized("html").alias("h"))
    return rows.select("page_id", (~F.col("h").rlike(r"(?i)<(script|style|iframe)|\son\w+=|<\w+\s+(class|style|id)=")).alias("clean"))


@query("""SELECT conv_id, CAST(sum(turn) AS BIGINT) AS parts, 'k' || conv_id AS skeleton FROM (SELECT conv_id, max(turn) + 1 AS turn FROM conversations GROUP BY conv_id) GROUP BY conv_id""")
def mail_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content lists of mails: one skeleton and the parts."""
    one = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("most"))
    parts = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("most") + 1), lambda i: F.struct(F.when(i == 0, 0).otherwise(2).alias("type"), i.cast("string").alias("fragment_id"), F.concat(F.when(i == 0, "k").otherwise("p"), F.col("conv_id").cast("string")).alias("object_id")))
    rows = one.select(F.col("conv_id").alias("meta_object_id"), F.to_json(F.struct(parts.alias("content_list"))).alias("metadata"))
    found = S.mail_content(rows).groupBy(F.col("meta_object_id").alias("conv_id"))
    return found.agg(F.count_if(F.col("kind") == "part").alias("parts"), F.max(F.when(F.col("kind") == "skeleton", F.col("object_id"))).alias("skeleton"))
