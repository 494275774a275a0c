"""Values as people read them, and tolerant readings of what databases hold, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")


def format_bytes(n: Column) -> Column:
    """``512 B``, ``1.5 MiB``; halves round to even, as in most languages' printf."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in list(enumerate(UNITS))[1:]:
        out = F.when(n >= 1 << (10 * k), F.printf(F.lit(f"%.1f {unit}"), F.bround(n / F.lit(float(1 << (10 * k))), 1))).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    """``MM:SS``, or ``HH:MM:SS`` from an hour on."""
    s = F.floor(seconds).cast("bigint")
    h, m, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.printf(F.lit("%02d:%02d:%02d"), h, m, rest)).otherwise(F.printf(F.lit("%02d:%02d"), m, rest))


def format_rate(rate: Column, unit: str) -> Column:
    return F.concat(F.printf(F.lit("%.1f"), F.bround(rate, 1)), F.lit(f" {unit}/s"))


def pluralize(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def format_timestamp(t: Column) -> Column:
    """In the session's time zone; null is a dash.  Years beyond 9999 have no sign."""
    return F.coalesce(F.ltrim(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.lit("+")), F.lit("-"))


def epoch_seconds(value: Column) -> Column:
    """Epoch seconds from a number or a decimal text; 0, blanks and other texts are null."""
    return F.nullif(value.cast("string").try_cast("bigint"), F.lit(0).cast("bigint"))


#: The last seconds of the year 9999, and of what a timestamp can hold.
YEAR_9999, LAST_SECOND = 253402300799, ((1 << 63) - 1) // 1_000_000


def epoch_timestamp(value: Column, last: int = YEAR_9999) -> Column:
    """The time of epoch seconds; null before the year 1 and after ``last``."""
    e = epoch_seconds(value)
    return F.when(e.between(-62135596800, last), F.timestamp_seconds(e))


#: Places of a weekday in a month, as rules write them: fixed values.
ORDINALS = {"first": "1", "second": "2", "third": "3", "fourth": "4", "last": "-1"}


def recurrence_rule(recurrence: Column, timed: bool = True) -> Column:
    """An RFC 5545 rule from a recurrence (JSON): ``pattern`` with type, interval, daysOfWeek, index, dayOfMonth and month,
    and ``range``, which ends at a date or after a number of times.  A pattern alone is a recurrence without an end.

    The end of a series whose events have a time of day is the end of that day.  Null where the type is none that is known.
    """
    pattern = F.coalesce(F.get_json_object(recurrence, "$.pattern"), recurrence)
    at = lambda p: F.get_json_object(pattern, p)
    until = lambda p: F.get_json_object(recurrence, f"$.range.{p}")
    kind = at("$.type")
    freq = (
        F.when(kind == "daily", "DAILY")
        .when(kind == "weekly", "WEEKLY")
        .when(kind.isin("absoluteMonthly", "relativeMonthly"), "MONTHLY")
        .when(kind.isin("absoluteYearly", "relativeYearly"), "YEARLY")
    )
    week = F.array(*map(F.lit, ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")))
    days = F.filter(F.from_json(at("$.daysOfWeek"), "array<string>"), lambda d: F.array_contains(week, d))
    place = F.create_map(*[F.lit(x) for kv in ORDINALS.items() for x in kv])[F.coalesce(at("$.index"), F.lit(""))]
    before = F.when(kind.startswith("relative"), place).when(kind == "weekly", "")
    by_day = F.when(F.size(days) > 0, F.array_join(F.transform(days, lambda d: F.concat(before, F.upper(F.substring(d, 1, 2)))), ","))
    interval = at("$.interval").try_cast("int")
    day, month, times = (x.try_cast("int") for x in (at("$.dayOfMonth"), at("$.month"), until("numberOfOccurrences")))
    last = F.date_format(F.substring(until("endDate"), 1, 10).try_cast("date"), "yyyyMMdd")
    parts = [
        F.concat(F.lit("FREQ="), freq),
        F.when(interval > 1, F.concat(F.lit("INTERVAL="), interval.cast("string"))),
        F.when(before.isNotNull() & by_day.isNotNull(), F.concat(F.lit("BYDAY="), by_day)),
        F.when(kind.startswith("absolute") & (day != 0), F.concat(F.lit("BYMONTHDAY="), day.cast("string"))),
        F.when(kind.endswith("Yearly") & (month != 0), F.concat(F.lit("BYMONTH="), month.cast("string"))),
        F.when((until("type") == "numbered") & (times > 0), F.concat(F.lit("COUNT="), times.cast("string"))),
        F.when(until("type") == "endDate", F.concat(F.lit("UNTIL="), last, F.lit("T235959Z" if timed else ""))),
    ]
    return F.when(freq.isNotNull(), F.concat_ws(";", *parts))


def recurrence_label(rule: Column) -> Column:
    """Daily, Weekly, Monthly or Yearly; Recurring for another pattern; blank for none."""
    kind = F.lower(F.coalesce(F.get_json_object(rule, "$.type"), F.lit("")))
    label = F.lit("Recurring")
    for word in ("yearly", "monthly", "weekly", "daily"):
        label = F.when(kind.endswith(word), word.capitalize()).otherwise(label)
    return F.when(F.coalesce(F.trim(rule), F.lit("")).isin("", "null", "{}"), "").otherwise(label)


def sniffed_kind(content: Column) -> Column:
    """What a piece of bytes is, by how it begins: fixed magics."""
    head = F.hex(F.substring(content, 1, 16))
    begin = F.lower(F.ltrim(F.substring(content, 1, 64).cast("string")))
    return (
        F.when(head.startswith("28B52FFD"), "zstd")
        .when(head.startswith("61486C54"), "encrypted")
        .when(head.startswith("53514C69746520666F726D6174203300"), "sqlite")
        .when(head.startswith("504B0304"), "zip")
        .when(head.startswith("25504446"), "pdf")
        .when(begin.startswith("<!doctype html") | begin.startswith("<html"), "html")
        .when(begin.startswith("{") | begin.startswith("["), "json")
        .when(F.length(content) == 0, "empty")
        .otherwise("data")
    )


#: Bits of a bucket's mode: fixed values of the format.
MODE_BITS = {0x01: "COMPRESS", 0x02: "CHUNK_CRC", 0x80: "VAULT_ENCRYPT"}


def mode_flags(mode: Column) -> Column:
    return F.array_compact(F.array(*[F.when(mode.bitwiseAND(F.lit(bit)) != 0, name) for bit, name in MODE_BITS.items()]))


def redundancy_size(size: Column, coverage: int) -> Column:
    return 16 + 4 * F.ceil(size / F.lit(coverage)) + F.least(size, F.lit(2 * coverage))


def record_length(map_num: Column, attr_length: Column, coverage: int = 8192) -> Column:
    """Bytes of a composition record: head, entries, attributes, redundancy."""
    return 32 + map_num * 20 + attr_length + redundancy_size(map_num * 20, coverage)
