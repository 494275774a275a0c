"""Names that are shown, matched, encoded or written as files, as column functions and small operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Device names that Windows reserves, with or without an extension: fixed values.
RESERVED = "con|prn|aux|nul|com[1-9]|lpt[1-9]"


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _times(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows of a name, by a partial count and a join, so that a very common name is no large window."""
    columns = [*keys, name]
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_times"))
    counts = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)], "_times")
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(columns)]
    return df.join(counts, on, "left").drop(*[f"_k{i}" for i in range(len(columns))])


def disambiguate(df: DataFrame, keys: Sequence[str], name: str, ident: str, hint: str | None = None, out: str = "label") -> DataFrame:
    """A label for each row that differs from the others of its keys.

    A name that occurs once stays.  One that occurs more often gets `` · hint`` if there is a hint, and if the
    result is still not alone, `` #`` and the first four hex digits of the SHA-256 of the id.
    """
    first = _times(df, keys, name)
    with_hint = F.col(name)
    if hint:
        useful = blank_to_null(F.col(hint)).isNotNull()
        with_hint = F.when((F.col("_times") > 1) & useful, F.concat(F.col(name), F.lit(" · "), F.col(hint))).otherwise(F.col(name))
    second = _times(first.withColumn(out, with_hint).drop("_times"), keys, out)
    mark = F.concat(F.col(out), F.lit(" #"), F.substring(F.sha2(F.col(ident).cast("string").cast("binary"), 256), 1, 4))
    return second.withColumn(out, F.when(F.col("_times") > 1, mark).otherwise(F.col(out))).drop("_times")


def match_label(df: DataFrame, target: str, name: str, label: str) -> DataFrame:
    """How a typed name is resolved: the row whose label it is, else the only row whose plain name it is.

    One row: target, matches (rows whose label or else plain name it is) and ambiguous.
    """
    hits = df.filter((F.col(label) == target) | (F.col(name) == target))
    exact, loose = F.count_if(F.col(label) == target), F.count_if(F.col(name) == target)
    matches = F.when(exact > 0, exact).otherwise(loose)
    return hits.agg(F.lit(target).alias("target"), matches.alias("matches"), (matches > 1).alias("ambiguous"))


def percent_encode(text: Column, reserved: str = "%/#?") -> Column:
    """Each of the reserved characters and of the control characters as %XX; others stay."""
    out = F.replace(text, F.lit("%"), F.lit("%25")) if "%" in reserved else text
    for c in reserved:
        if c != "%":
            out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def percent_decode(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def join_path(*parts: Column) -> Column:
    """Parts joined by single slashes; null where a part climbs with .. or holds a backslash."""
    joined = F.concat_ws("/", *[F.when(F.regexp_replace(p, "^/+|/+$", "") != "", F.regexp_replace(p, "^/+|/+$", "")) for p in parts])
    return F.when(joined.rlike(r"(^|/)\.\.(/|$)|\\"), F.lit(None)).otherwise(joined)


def safe_file_name(name: Column) -> Column:
    """A name that is a file name on all systems: forbidden characters become _, trailing dots and blanks go, reserved
    device names get a leading _, an empty name is _."""
    plain = F.regexp_replace(name, r'[\x00-\x1F<>:"/\\|?*]', "_")
    plain = F.regexp_replace(plain, r"[. ]+$", "")
    reserved = F.lower(plain).rlike(rf"^({RESERVED})(\..*)?$")
    return F.when(plain == "", F.lit("_")).when(reserved, F.concat(F.lit("_"), plain)).otherwise(plain)


def with_number(name: Column, number: Column) -> Column:
    """``a.eml`` and 2 give ``a (2).eml``."""
    stem, extension = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)
    return F.concat(stem, F.lit(" ("), number.cast("string"), F.lit(")"), extension)


def numbered_names(df: DataFrame, keys: Sequence[str], name: str, order: Sequence[str], out: str = "file_name") -> DataFrame:
    """Names that differ within their keys, also on systems that ignore case: the first keeps its name, later ones are
    numbered from 2 on in order, with the first number that is free.  Equal names are numbered by one window for each
    (keys, name).  Only where a name that is numbered by itself could meet one that is numbered here, the names of
    that family are gone through one by one."""
    low = F.lower(name)
    # A name's family: without its numbers.  A number of its own counts only where the family has equal names.
    family = F.regexp_replace(low, r"( \([0-9]+\))+(\.[^.]*)?$", "$2")
    rows = df.withColumns({"_low": low, "_family": family})
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_low").orderBy(*order)))
    mixed = rows.groupBy(*keys, "_family").agg((F.max("_nth") > 1).alias("_a"), F.max(F.col("_low") != F.col("_family")).alias("_b"))
    mixed = mixed.filter("_a AND _b").select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_family").alias("_f"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)], F.col("_family") == F.col("_f"))
    plain = rows.join(mixed, same, "left_anti")
    plain = plain.withColumn(out, F.when(F.col("_nth") > 1, with_number(F.col(name), F.col("_nth"))).otherwise(F.col(name)))
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def one_by_one(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(list(order), kind="stable")
        taken: set[str] = set()
        given = []
        for text in found[name]:
            stem, dot, extension = text.rpartition(".")
            stem, extension = (stem, dot + extension) if dot and stem else (text, "")
            new, n = text, 1
            while new.lower() in taken:
                n += 1
                new = f"{stem} ({n}){extension}"
            taken.add(new.lower())
            given.append(new)
        return found.assign(**{out: given})[schema.names]

    odd = rows.join(mixed, same, "left_semi").groupBy(*keys, "_family").applyInPandas(one_by_one, schema)
    return plain.select(*schema.names).unionByName(odd).drop("_low", "_family", "_nth")


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def text_after_second_underscore(text: Column) -> Column:
    """``<connection>_<other>_<name>`` gives the name, which may hold underscores itself; else null."""
    return blank_to_null(F.regexp_extract(text, "^[^_]*_[^_]*_(.*)$", 1))


def mail_name(subject: Column) -> Column:
    return F.coalesce(blank_to_null(subject), F.lit("(no subject)"))


def event_name(summary: Column) -> Column:
    return F.coalesce(blank_to_null(summary), F.lit("(no title)"))


def contact_name(first: Column, last: Column, fallback: Column) -> Column:
    return F.coalesce(blank_to_null(F.concat_ws(" ", blank_to_null(first), blank_to_null(last))), blank_to_null(fallback), F.lit("(no name)"))


def site_item_name(title: Column, url: Column, item_id: Column) -> Column:
    return F.coalesce(blank_to_null(title), blank_to_null(F.element_at(F.split(url, "/"), -1)), item_id.cast("string"))


def workload_name(spec: Column, workload_type: Column) -> Column:
    """A workload's name: of a device the spec's ``workload_name``; of a SaaS workload the name in the one entity that
    its status has (user, site, group, shared drive or team), then the address, then the application's name."""
    at = lambda path: blank_to_null(F.get_json_object(spec, path))
    entity = "$.status.entity_meta.spec."
    paths = ("user_info.name", "user_info.email", "site_info.site_name", "group_info.display_name", "group_info.mail", "team_drive_info.name", "team_info.name")
    saas = F.coalesce(*[at(entity + p) for p in paths], at("$.spec.workload_type"))
    device = F.coalesce(at("$.spec.workload_name"), workload_type)
    return F.when(workload_type.isin("M365", "GW"), F.coalesce(saas, workload_type)).otherwise(device)


def masked(detail: Column) -> Column:
    """A message with what varies masked: quoted texts first, digits last."""
    out = F.regexp_replace(detail, r"'[^']*'|\"[^\"]*\"", "<s>")
    out = F.regexp_replace(out, r"ref:\S+", "<ref>")
    return F.regexp_replace(out, "[0-9]+", "<n>")
