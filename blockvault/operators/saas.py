"""Relations of mail, chat and calendar items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import blank_to_null, truncate

CATEGORIES = (("standard", "Standard channels"), ("private", "Private channels"), ("shared", "Shared channels"))


def channel_category(kind: Column) -> Column:
    """A channel's kind; one that is not known is standard."""
    known = F.lower(kind)
    return F.when(known.isin(*[k for k, _ in CATEGORIES]), known).otherwise("standard")


def member_names(members: Column, own: Column) -> Column:
    """The names of the other members, from a JSON array, in its order; null if there is none."""
    rows = F.from_json(members, "array<struct<userEmail:string,display_name:string>>")
    others = F.filter(rows, lambda m: ~F.lower(F.coalesce(m["userEmail"], F.lit(""))).eqNullSafe(F.lower(own)) & (F.coalesce(m["display_name"], F.lit("")) != ""))
    return blank_to_null(F.array_join(F.transform(others, lambda m: m["display_name"]), ", "))


def chat_label(topic: Column, kind: Column, members: Column, own: Column) -> Column:
    """A chat's label: its topic, ``(no title)`` for a meeting, the other members, else ``Bot``."""
    return F.coalesce(blank_to_null(topic), F.when(kind == 2, F.lit("(no title)")), member_names(members, own), F.lit("Bot"))


def with_stickers(messages: DataFrame, stickers: DataFrame) -> DataFrame:
    """Messages with a map from url to inline content, empty where there are none."""
    maps = stickers.groupBy("msg_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("url", "base64_content")))).alias("stickers"))
    return messages.join(maps, "msg_id", "left").withColumn("stickers", F.coalesce("stickers", F.create_map().cast("map<string,string>")))


def thread_rows(messages: DataFrame, channel: str, quote: int = 80) -> DataFrame:
    """Messages in the order in which a channel is shown, undated ones first.

    Adds place, new_day (a date separator stands before it), reply_to_text (the beginning of the message that it
    answers, or a note that it is missing) and shown (the body, or a note for deleted and system messages).
    """
    order = Window.partitionBy(channel).orderBy(F.col("created").asc_nulls_first(), F.col("msg_id"))
    day = F.to_date("created")
    parents = messages.select(F.col(channel).alias("_c"), F.col("msg_id").alias("_parent"), truncate(F.col("body"), quote).alias("_text"), F.lit(True).alias("_there"))
    rows = messages.withColumns({"place": F.row_number().over(order), "new_day": day.isNotNull() & ~F.coalesce(F.lag(day).over(order) == day, F.lit(False))})
    joined = rows.join(parents, (F.col(channel) == F.col("_c")) & (F.col("reply_to_id") == F.col("_parent")), "left")
    reply = F.when(F.col("reply_to_id").isNotNull(), F.when(F.col("_there"), F.coalesce("_text", F.lit(""))).otherwise("(message not available)"))
    shown = F.when(F.col("is_deleted"), "(deleted)").when(F.col("is_system"), F.concat(F.lit("* "), F.coalesce("body", F.lit("")))).otherwise(F.coalesce("body", F.lit("")))
    return joined.withColumns({"reply_to_text": reply, "shown": shown}).drop("_c", "_parent", "_text", "_there")


def calendar_group(kind: Column, number: Column) -> Column:
    """Whether a calendar is the user's own; only the number 1 marks another's, not the text '1'."""
    return F.when(number & (kind == "1"), "Other calendars").otherwise("My calendars")


def site_item_is_folder(item_type: Column) -> Column:
    return F.coalesce(item_type.cast("string").isin("FOLDER", "1"), F.lit(False))


def latest_object_db(copies: DataFrame, stream: str = "stream", offset: str = "offset") -> DataFrame:
    """Of the copies of an object table within a stream the one at the highest offset."""
    return copies.groupBy(stream).agg(F.max_by(F.struct(*[F.col(c) for c in copies.columns]), F.col(offset)).alias("r")).select("r.*")


def objects(ids: DataFrame, object_table: DataFrame, key: str = "object_id") -> DataFrame:
    """Where each object lies: (offset, length) in the stream's file; objects that are not there have nulls."""
    return ids.join(object_table.select(F.col("object_id").alias(key), "offset", "length"), key, "left")


def mail_content(items: DataFrame) -> DataFrame:
    """(meta_object_id, kind, fragment_id, object_id) of mails' content lists (JSON in ``metadata``); type 0 is the skeleton."""
    parts = F.from_json("metadata", "struct<content_list:array<struct<type:int,fragment_id:string,object_id:string>>>")["content_list"]
    rows = items.select("meta_object_id", F.explode(parts).alias("p"))
    return rows.select("meta_object_id", F.when(F.col("p.type") == 0, "skeleton").otherwise("part").alias("kind"), "p.fragment_id", "p.object_id")
