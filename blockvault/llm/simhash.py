"""SimHash near-dedup by pigeonhole blocks.

A fingerprint of 64 bits is split into b blocks.  Two fingerprints that differ in at most d bits agree in at
least b - d whole blocks, so they meet in the table of one of the choices of b - d blocks.  b grows with the
number of distinct fingerprints, so that chance meetings stay few for each of them.  The members of a table's
key are compared by their Hamming distances; a breadth-first search writes a spanning forest of their links,
not all pairs.  A key with very many members is not compared as a whole: its members go on to a finer table,
where the bits that the key left free are split again, which bounds a key's members after a few rounds.

Components of the links come from rounds in which every vertex joins its smallest neighbour, chains are
followed to their ends and the graph is contracted; nothing of it goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Distinct fingerprints that may meet one by chance, on average, before blocks become more.
CHANCE = 8
#: Members of a key that are compared in one go; a key with more goes on to a finer table.
MOST = 20_000
#: Runs of up to so many members are compared with shifted copies of the whole batch.
FEW = 12
ONES = (1 << 64) - 1


def fingerprint(text: str | None, words_in_shingle: int = 4, seed: int = 42) -> int:
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    n = len(words)
    whole = b" ".join(words)
    if n <= words_in_shingle:
        digests, count = xxhash.xxh64_digest(whole, seed), 1
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        begins = (ends - lengths)[: n - words_in_shingle + 1].tolist()
        digest, count = xxhash.xxh64_digest, n - words_in_shingle + 1
        digests = b"".join([digest(whole[p:q], seed) for p, q in zip(begins, ends[words_in_shingle - 1 :].tolist(), strict=True)])
    totals = np.zeros(64, np.int64)
    raw = np.frombuffer(digests, np.uint8).reshape(count, 8)
    for k in range(0, count, 65_536):  # a digest is big-endian: the first bit is the highest
        totals += np.unpackbits(raw[k : k + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * totals > count).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 4) -> DataFrame:
    """id and fp (a signed 64-bit integer) of each row; a text without words, or null, has fp 0."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words_in_shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def masks(free: int, blocks: int, distance: int) -> list[int]:
    """For each choice of all but ``distance`` blocks of the free bits, the mask of the bits that must agree."""
    bits = [i for i in range(64) if free >> i & 1]
    blocks = min(blocks, len(bits))
    parts = [sum(1 << i for i in part.tolist()) for part in np.array_split(np.array(bits, np.int64), blocks)] if bits else []
    fixed = ONES & ~free
    return [fixed | sum(chosen) for chosen in combinations(parts, max(0, blocks - distance))]


def blocks_for(n: int, distance: int) -> int:
    for b in range(distance + 1, 17):
        tables = len(list(combinations(range(b), distance)))
        if n * tables / 2 ** (64 * (b - distance) / b) <= CHANCE:
            return b
    return 16


def _forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (from, to) of a spanning forest of the graph of fingerprints within the distance."""
    rest, source, target = np.arange(len(fps)), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= distance
            if near.any():
                found = rest[near]
                source.append(np.full(len(found), at))
                target.append(found)
                queue.extend(found.tolist())
                rest = rest[~near]
    return (np.concatenate(source), np.concatenate(target)) if source else (np.zeros(0, np.int64),) * 2


def _runs(begins: np.ndarray, ends: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs [begin, end) of members that share a key."""
    sizes = ends - begins
    run = np.repeat(np.arange(len(begins)), sizes)
    few = np.repeat(sizes <= FEW, sizes)
    source, target = [], []
    for shift in range(1, min(FEW, len(fps))):
        k = np.flatnonzero((run[:-shift] == run[shift:]) & few[:-shift])
        if not len(k):
            break
        k = k[np.bitwise_count(fps[k] ^ fps[k + shift]) <= distance]
        source.append(k)
        target.append(k + shift)
    for r in np.flatnonzero(sizes > FEW).tolist():
        a, b = _forest(fps[begins[r] : ends[r]], distance)
        source.append(a + begins[r])
        target.append(b + begins[r])
    return (np.concatenate(source), np.concatenate(target)) if source else (np.zeros(0, np.int64),) * 2


def _link_keys(distance: int):
    """Members sorted by (mask, part): links of each key as (src, dst), or the members of a very large key as
    (fp, vertex, mask), to be compared in a finer table."""

    def table(source, target, fp, vertex, mask) -> pa.RecordBatch:
        n, m = len(source), len(fp)
        ints = lambda x, before, after: pa.concat_arrays([pa.nulls(before, pa.int64()), pa.array(x, pa.int64()), pa.nulls(after, pa.int64())])
        return pa.RecordBatch.from_arrays([ints(source, 0, m), ints(target, 0, m), ints(fp, n, 0), ints(vertex, n, 0), ints(mask, n, 0)], ["src", "dst", "fp", "vertex", "mask"])

    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [none] * 4
        large: tuple | None = None  # the key that goes on to a finer table

        def compare(mask, part, fp, vertex) -> Iterator[pa.RecordBatch]:
            if len(fp):
                cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
                a, b = _runs(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]]), fp.view(np.uint64), distance)
                if len(a):
                    yield table(np.maximum(vertex[a], vertex[b]), np.minimum(vertex[a], vertex[b]), none, none, none)

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "part", "fp", "vertex")]
            mask, part, fp, vertex = rows = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if large is not None:
                n = int(np.argmin(np.append((mask == large[0]) & (part == large[1]), False)))
                if n:
                    yield table(none, none, fp[:n], vertex[:n], mask[:n])
                    mask, part, fp, vertex = rows = [x[n:] for x in rows]
            if not len(fp):
                held = [none] * 4
                continue
            large = None if (large is not None and (mask[0], part[0]) != large) else large
            last = len(fp) - int(np.argmin(np.append(((mask == mask[-1]) & (part == part[-1]))[::-1], False)))
            if len(fp) - last > MOST:
                large = (mask[-1], part[-1])
                yield table(none, none, fp[last:], vertex[last:], mask[last:])
                held = [none] * 4
            else:
                held = [x[last:] for x in rows]
            yield from compare(mask[:last], part[:last], fp[:last], vertex[:last])
        yield from compare(*held)

    return run


def links(vertices: DataFrame, distance: int = 4) -> DataFrame:
    """Links (src, dst), src > dst, between vertices (fp, vertex) with distinct fingerprints: enough of them that
    their components are those of all pairs within the distance."""
    spark = vertices.sparkSession
    n = vertices.count()
    members = vertices.select("fp", "vertex")
    tables = {None: masks(ONES, blocks_for(n, distance), distance)}
    out = None
    while True:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        if None in tables:
            keys = members.withColumn("mask", F.explode(F.array(*[F.lit(signed(m)) for m in tables[None]])))
        else:
            finer = F.create_map(*[x for m, more in tables.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(k)) for k in more]))])
            keys = members.withColumn("mask", F.explode(finer[F.col("mask")]))
        keys = keys.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        met = keys.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp").mapInArrow(_link_keys(distance), "src long, dst long, fp long, vertex long, mask long")
        met = cut(met)
        found = met.filter("src IS NOT NULL").select("src", "dst")
        out = found if out is None else out.union(found)
        # Masks of keys that were too large: as few as tables.  Their free bits are split anew.
        deep = [r[0] & ONES for r in met.filter("fp IS NOT NULL").select("mask").distinct().collect()]
        if not deep:
            break
        members = met.filter("fp IS NOT NULL").select("fp", "vertex", "mask")
        tables = {m: masks(ONES & ~m, 2 * distance, distance) for m in deep}
    return out.distinct()


def _to_roots(parents: DataFrame) -> DataFrame:
    """(vertex, parent) with every parent replaced by the end of its chain, whose length halves in each round."""
    while True:
        up = parents.select(F.col("vertex").alias("parent"), F.col("parent").alias("grand"))
        jumped = cut(parents.join(up, "parent", "left").select("vertex", F.coalesce("grand", "parent").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")))
        parents = jumped.select("vertex", "parent")
        if jumped.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for each vertex of the edges (src, dst): the smallest vertex that it reaches.

    In a round each vertex joins its smallest neighbour, if that is smaller; the chains that arise are followed to
    their ends, and the graph of the ends goes on.  Every tree of a round has two vertices at least.
    """
    edges = cut(edges.filter("src <> dst"))
    names = None
    while not edges.isEmpty():
        least = edges.select(F.col("src").alias("vertex"), F.col("dst").alias("other")).union(edges.select("dst", "src"))
        least = _to_roots(cut(least.groupBy("vertex").agg(F.min("other").alias("other")).select("vertex", F.least("vertex", "other").alias("parent"))))
        names = least.withColumnRenamed("parent", "component") if names is None else names.join(
            least.select(F.col("vertex").alias("component"), "parent"), "component", "left"
        ).select("vertex", F.coalesce("parent", "component").alias("component"))
        a = least.select(F.col("vertex").alias("src"), F.col("parent").alias("a"))
        b = least.select(F.col("vertex").alias("dst"), F.col("parent").alias("b"))
        moved = edges.join(a, "src").join(b, "dst").filter("a <> b").select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst"))
        names, edges = cut(names), cut(moved.distinct())
    return edges.select(F.col("src").alias("vertex"), F.col("dst").alias("component")) if names is None else names


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per row of ``df``: id, fp and component_id, the smallest id that links reach, itself included.

    Links are between fingerprints that differ in at most ``distance`` bits.  Null, empty and blank texts have
    fingerprint 0, which is linked like any other.  Rows that repeat an id or a text are no special case.  A
    row with a null id takes part through its text; its component is the smallest id there, or null.  An empty
    table gives an empty result; other columns are not read.  Ids are integers.
    """
    rows = cut(fingerprints(df, id_col, text_col, words_in_shingle))
    vertices = rows.groupBy("fp").agg(F.min("doc_id").alias("vertex"))
    # A fingerprint of null ids only has a name that no id has.
    vertices = cut(vertices.withColumn("vertex", F.coalesce("vertex", F.lit((1 << 63) - 1) - F.pmod("fp", F.lit(1 << 62)))))
    named = components(links(vertices, distance))
    classes = vertices.join(named, "vertex", "left").select("fp", F.coalesce("component", "vertex").alias("component_id"))
    whole = rows.join(classes, "fp", "left")
    known = F.when(F.col("component_id") < (1 << 63) - 1 - (1 << 62), F.col("component_id"))
    return whole.select(F.col("doc_id").alias(id_col), "fp", known.alias("component_id"))
