"""Addresses of nodes, as column functions: ``<repository>#<segment>/<segment>/...``.

Machine-made addresses begin their fragment with ``@``: ``@cat:`` is canonical, ``@raw`` names a stored path.  All
others are names as people see them.  ``#``, ``/``, ``%`` and control characters within a segment are
percent-encoded; the repository's path is not, so it ends at the first ``#``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a segment never holds as it is: reserved characters and control characters.
RESERVED = [*"%#/", *(chr(i) for i in (*range(0x20), 0x7F))]


def encode_segment(segment: Column) -> Column:
    out = segment
    for c in RESERVED:  # the percent sign first
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def decode_segment(segment: Column) -> Column:
    """Null where the encoding is broken."""
    return F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B")))


def format_ref(repository: Column, segments: Column, kind: Column) -> Column:
    """kind is CANONICAL, RAW or HUMAN; a name that begins with @ is written so that it does not look machine-made."""
    body = F.array_join(F.transform(segments, encode_segment), "/")
    shown = F.when(kind != "HUMAN", F.concat(F.lit("@"), body)).when(body.startswith("@"), F.concat(F.lit("%40"), F.substring(body, 2, 1 << 30))).otherwise(body)
    return F.concat(repository, F.lit("#"), shown)


def parse_ref(ref: Column) -> Column:
    """struct(repository, kind, segments); null where the text has no # or an @ that starts neither machine-made form."""
    at = F.locate("#", ref)
    body = F.substring(ref, at + 1, F.length(ref))
    machine = body.startswith("@")
    head = F.substring_index(F.substring(body, 2, 1 << 30), "/", 1)
    kind = F.when(~machine, "HUMAN").when(head == "raw", "RAW").when(head.startswith("cat:"), "CANONICAL")
    inner = F.when(machine, F.substring(body, 2, 1 << 30)).otherwise(body)
    segments = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, "/"), decode_segment))
    good = (at > 0) & kind.isNotNull() & ~F.exists(segments, lambda s: s.isNull())
    return F.when(good, F.struct(F.substring(ref, F.lit(1), at - 1).alias("repository"), kind.alias("kind"), segments.alias("segments")))


def canonical(connection_id: Column, workload_id: Column, version_uid: Column, *keys: Column) -> Column:
    """Segments that do not change when display names do."""
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return F.array(text("cat:", connection_id), text("wl:", workload_id), text("ver:", version_uid), *keys)
