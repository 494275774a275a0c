"""Interval algebra on half-open ranges [start, end), per key.

Joins of points with intervals go through cells of a grid, so that they are equi-joins on (key, cell) with a
residual condition; windows are partitioned by the key, and where a key may hold very many ranges they are first
merged per cell, which makes the rest small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cell_of(x: Column, width: int) -> Column:
    return F.floor(x / F.lit(width)).cast("bigint")


def _islands(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], new: Column) -> DataFrame:
    """Number the runs that begin where ``new`` is true."""
    return df.withColumn("_island", F.sum(new.cast("int")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def _merge(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int) -> DataFrame:
    order = [F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last()]
    before = F.max(end).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_before", before)
    new = F.col("_before").isNull() | (F.col(start) > F.col("_before") + gap)
    return _islands(marked, keys, order, new).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def merge_ranges(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", gap: int = 0, width: int | None = None, odd: bool = False) -> DataFrame:
    """The union of ranges per key as disjoint ranges in order: overlapping and touching ones merge, and ones whose
    distance is at most ``gap``.  Empty ranges and nulls are passed over; with ``odd`` they merge like others, those
    without a start last, and one that meets no other is a row.  With ``width``, ranges that begin in the same cell of
    that width are merged first, so that a key with very many ranges is not sorted in one task."""
    rows = df.select(*keys, start, end)
    if not odd:
        rows = rows.filter(F.col(end) > F.col(start))
    if width:
        rows = _merge(rows.withColumn("_cell", cell_of(F.col(start), width)), [*keys, "_cell"], start, end, gap).drop("_cell")
    return _merge(rows, keys, start, end, gap)


def gaps_within(df: DataFrame, spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The parts of each key's span [lo, hi) that its ranges do not cover.  A key without ranges is one gap."""
    merged = merge_ranges(df, keys, start, end)
    clipped = spans.join(merged, list(keys)).select(*keys, F.greatest(start, lo).alias("_s"), F.least(end, hi).alias("_e")).filter("_s < _e")
    # A span that no range meets keeps one row with nulls.
    whole = spans.join(clipped, list(keys), "left")
    w = Window.partitionBy(*keys).orderBy("_s")
    edges = whole.withColumns({"_from": F.coalesce(F.lag("_e").over(w), F.col(lo)), "_last": F.lead("_s").over(w).isNull()})
    head = edges.select(*keys, F.col("_from").alias("gap_start"), F.coalesce("_s", F.col(hi)).alias("gap_end"))
    tail = edges.filter(F.col("_last") & F.col("_e").isNotNull()).select(*keys, F.col("_e").alias("gap_start"), F.col(hi).alias("gap_end"))
    return head.union(tail).filter(F.col("gap_start") < F.col("gap_end"))


def extents(entries: DataFrame, sizes: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", kind: str = "kind", size: str = "size") -> DataFrame:
    """A file's extents in order: its entries as they are, and a HOLE before, between and after them up to the size.

    Entries of length 0 are passed over; an entry may run past the size and is not cut, the reader does that.
    """
    rows = entries.filter(F.col(end) > F.col(start)).select(*keys, start, end, kind)
    w = Window.partitionBy(*keys).orderBy(start, end)
    reached = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = rows.withColumn("_reached", reached).filter(F.col(start) > F.col("_reached"))
    holes = before.select(*keys, F.col("_reached").alias(start), F.col(start).alias(end), F.lit("HOLE").alias(kind))
    last = rows.groupBy(*keys).agg(F.max(end).alias("_last"))
    tail = sizes.join(last, list(keys), "left").select(*keys, F.coalesce("_last", F.lit(0)).alias(start), F.col(size).alias(end), F.lit("HOLE").alias(kind))
    return rows.unionByName(holes).unionByName(tail.filter(F.col(end) > F.col(start)))


def covering(points: DataFrame, ranges: DataFrame, keys: Sequence[str], point: str, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Points joined with the ranges of their key that hold them: an equi-join on (key, cell) with a residual condition."""
    placed = ranges.withColumn("_cell", F.explode(F.sequence(cell_of(F.col(start), width), cell_of(F.col(end) - 1, width))))
    placed = placed.filter(F.col(end) > F.col(start))
    at = points.withColumn("_cell", cell_of(F.col(point), width))
    return at.join(placed, [*keys, "_cell"]).filter((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end))).drop("_cell")


def winning_segments(df: DataFrame, keys: Sequence[str], width: int, start: str = "start", end: str = "end", index: str = "idx") -> DataFrame:
    """Which of overlapping fragments wins where: the highest start, then the highest index.

    Neighbouring pieces of one winner are merged; empty fragments are passed over.
    """
    rows = df.select(*keys, start, end, index).filter(F.col(end) > F.col(start))
    bounds = rows.select(*keys, F.col(start).alias("_a")).union(rows.select(*keys, F.col(end))).distinct()
    pieces = bounds.withColumn("_b", F.lead("_a").over(Window.partitionBy(*keys).orderBy("_a"))).filter(F.col("_b").isNotNull())
    held = covering(pieces, rows, keys, "_a", width, start, end)
    won = held.groupBy(*keys, "_a", "_b").agg(F.max(F.struct(F.col(start), F.col(index))).alias("_w")).select(*keys, "_a", "_b", F.col(f"_w.{index}").alias(index))
    w = Window.partitionBy(*keys).orderBy("_a")
    marked = won.withColumns({"_same": F.lag(index).over(w), "_end": F.lag("_b").over(w)})
    new = F.col("_same").isNull() | (F.col("_same") != F.col(index)) | (F.col("_end") != F.col("_a"))
    return _islands(marked, keys, ["_a"], new).groupBy(*keys, "_island", index).agg(F.min("_a").alias("seg_start"), F.max("_b").alias("seg_end")).drop("_island")


def ascending_runs(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct integers per key as runs of consecutive ones: (first, length)."""
    rows = df.select(*keys, value).distinct()
    island = F.col(value) - F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return rows.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(value).alias("first"), F.count(F.lit(1)).alias("length")).drop("_island")
