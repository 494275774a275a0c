"""Picking one of several generations of a thing: latest sequence, committed generation, forward as-of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def logical_name(physical: Column) -> Column:
    """The name without a numeric suffix."""
    return F.regexp_replace(physical, r"\.[0-9]+$", "")


def sequence(physical: Column) -> Column:
    """The numeric suffix, or null."""
    return F.nullif(F.regexp_extract(physical, r"\.([0-9]+)$", 1), F.lit("")).cast("bigint")


def latest_sequence(files: DataFrame, keys: Sequence[str], name: str = "name") -> DataFrame:
    """Of the physical files of a logical name the one with the highest suffix; a bare name wins only alone."""
    rows = files.withColumns({"logical": logical_name(F.col(name)), "_seq": F.coalesce(sequence(F.col(name)), F.lit(-1))})
    return rows.groupBy(*keys, "logical").agg(F.max_by(name, "_seq").alias("physical"), F.max("_seq").alias("seq"))


def committed_generation(files: DataFrame, keys: Sequence[str], committed: DataFrame, markers: DataFrame | None = None, name: str = "name") -> DataFrame:
    """The generation of each logical name that a reader may use.

    Without ``markers``: the largest suffix strictly below the committed transaction of the key (column ``txn``).
    With ``markers`` (key, logical, n): the largest suffix that has a marker.  A bare name counts only if the
    logical name has no suffixed file at all; without any valid file the result is null, which is corruption.
    """
    rows = files.withColumns({"logical": logical_name(F.col(name)), "_seq": sequence(F.col(name))})
    if markers is None:
        valid = rows.join(committed, list(keys), "left").withColumn("_ok", F.col("_seq") < F.col("txn"))
    else:
        marked = markers.select(*keys, "logical", F.col("n").alias("_seq"), F.lit(True).alias("_ok")).distinct()
        valid = rows.join(marked, [*keys, "logical", "_seq"], "left")
    usable = F.when(F.coalesce("_ok", F.lit(False)) & F.col("_seq").isNotNull(), F.col("_seq"))
    out = valid.groupBy(*keys, "logical").agg(
        F.max_by(F.col(name), usable).alias("_best"), F.max(usable).alias("generation"), F.count("_seq").alias("_suffixed"), F.max(F.when(F.col("_seq").isNull(), F.col(name))).alias("_bare")
    )
    physical = F.when(F.col("generation").isNotNull(), F.col("_best")).when(F.col("_suffixed") == 0, F.col("_bare"))
    return out.select(*keys, "logical", physical.alias("physical"), "generation")


def forward_asof(requests: DataFrame, generations: DataFrame, keys: Sequence[str], requested: str, generation: str, cap: str | None = None) -> DataFrame:
    """For each request the smallest generation of its key that is at least the requested one, or null.

    With ``cap`` (a column of the requests) a nearest generation beyond it is refused: the nearest is taken first
    and then judged.  Both sides meet in one sorted pass per key, without pairing them.
    """
    cols = requests.columns
    left = requests.select(*keys, F.col(requested).alias("_at"), F.lit(1).alias("_tag"), F.struct(*[F.col(c) for c in cols]).alias("_row"), F.lit(None).cast("bigint").alias("_gen"))
    right = generations.select(*keys, F.col(generation).alias("_at"), F.lit(0).alias("_tag"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(generation).cast("bigint").alias("_gen"))
    # From the highest down; at the same value generations come first, so that they count as reached.
    w = Window.partitionBy(*keys).orderBy(F.col("_at").desc(), F.col("_tag")).rowsBetween(Window.unboundedPreceding, 0)
    met = left.unionByName(right).withColumn("nearest", F.last("_gen", ignorenulls=True).over(w)).filter("_tag = 1")
    out = met.select(*[F.col(f"_row.{c}").alias(c) for c in cols], "nearest")
    return out if cap is None else out.withColumn("nearest", F.when(F.col("nearest") <= F.col(cap), F.col("nearest")))
