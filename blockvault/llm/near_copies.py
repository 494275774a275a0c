"""Near copies by SimHash and the similarity of texts: links where the sets of five-word shingles have a Jaccard index of 0.8.

Texts whose SimHash fingerprints differ in at most ``DISTANCE`` bits are candidates by SimHash's blocks.  Fingerprints
of texts of that similarity differ in 3 to 17 of 64 bits, which no table of whole blocks can look up, so those that lie
farther apart are found by min-hashes: texts that agree in all ``ROWS`` values of one of ``BANDS`` bands meet, which
two texts of similarity s do with probability 1 - (1 - s**5)**32 (0.999997 at 0.8).  Every candidate is verified
by its two whole sets.  A band's key with few members gives all their pairs.  One with many gives each member's
pairs with its next neighbours and with the members nearest to the majority of the fingerprints, which joins most of
a large group.  Members of such a key that are then still in different components are compared by their signatures,
all of them, in blocks: of pairs that agree in ``AGREE`` of all the min-hashes (which all but two in a million of
similarity 0.8 do) the whole sets are compared on the spot, and only links that join components are written.  So no
key loses a link by its size, and none writes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .simhash import components, fingerprint
from .simhash import links as simhash_links

WORDS = 5
#: Bits in which fingerprints of candidates by SimHash may differ.
DISTANCE = 4
BANDS, ROWS = 32, 5
#: Pairs of a key's members that lie at most so far apart are candidates; a key with more members has hubs too.
FEW = 8
HUBS = 2
#: Members of a large key are compared in blocks of about so many, or of so many shingles; pairs that agree so often
#: are compared as a whole.
BLOCK, SHINGLES = 4096, 1 << 22
AGREE = 104
_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of five words; a shorter text is one run, one without words none."""
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[k : k + WORDS])) for k in range(max(1, len(words) - WORDS + 1))] if words else [], np.uint64))


def mark(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def min_hashes(found: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set; equal sets have equal ones."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for k in range(0, len(found), 4096):
        least = np.minimum(least, (found[k : k + 4096] * _FACTORS + _TERMS).min(axis=1))
    return least


def bands(least: np.ndarray) -> list[int]:
    """The key of each band of min-hashes."""
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def _pairs(begins: np.ndarray, sizes: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    run = np.repeat(np.arange(len(begins)), sizes)
    for shift in range(1, min(FEW, len(run) - 1) + 1):
        k = np.flatnonzero(run[:-shift] == run[shift:])
        if not len(k):
            break
        yield k, k + shift
    for r in np.flatnonzero(sizes > FEW + 1).tolist():
        own = np.arange(begins[r], begins[r] + sizes[r])
        bits = np.unpackbits(fps[own].view(np.uint8).reshape(-1, 8), axis=1)
        far = (bits ^ (2 * bits.sum(axis=0, dtype=np.int64) > len(own))).sum(axis=1)
        for hub in own[np.argsort(far, kind="stable")[:HUBS]].tolist():
            yield np.full(len(own) - 1, hub), own[own != hub]


def _able(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can have the similarity."""
    return 5 * np.minimum(x, y) >= 4 * np.maximum(x, y)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of marks from rows (key, mark, size, fp) that are sorted by key, and the members (mark, null, key)
    of the keys whose pairs are not all there."""
    held = [np.zeros(0, np.int64)] * 4

    def out(key, marks, size, fp) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(begins, append=len(key))
        for a, b in _pairs(begins, sizes, fp):
            able = _able(size[a], size[b])
            x, y = marks[a[able]], marks[b[able]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.nulls(len(x), pa.int64())], ["a", "b", "key"])
        large = np.repeat(sizes > FEW + 1, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(marks[large]), pa.nulls(int(large.sum()), pa.int64()), pa.array(key[large])], ["a", "b", "key"])

    for batch in batches:
        rows = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
        last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        held = [x[last:] for x in rows]
        yield from out(*(x[:last] for x in rows))
    yield from out(*held)


def _alike(vertices: DataFrame) -> DataFrame:
    """Candidates (a, b) of (mark, fp) by SimHash: sets of one fingerprint with its first, and the first ones of fingerprints
    that differ in at most ``DISTANCE`` bits, as a forest."""
    first = cut(vertices.groupBy("fp").agg(F.min("mark").alias("vertex")))
    same = vertices.join(first, "fp").filter("mark > vertex").select(F.col("vertex").alias("a"), F.col("mark").alias("b"))
    return same.union(simhash_links(first, DISTANCE).select(F.col("dst").alias("a"), F.col("src").alias("b")))


def _compared(group: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) that join the components of the members of one or two blocks of a key: a forest, not all links."""
    marks, block = group["mark"].to_numpy(), group["block"].to_numpy()
    signature = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(len(group), BANDS * ROWS)
    sizes = group["set"].map(len).to_numpy()
    words = np.unique(np.concatenate(group["set"].tolist()), return_inverse=True)[1]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    component = np.unique(group["component_id"].to_numpy(), return_inverse=True)[1]
    # Pairs within the largest component need no look, and each other pair has a member outside it.
    outside = component != np.bincount(component).argmax()
    first = block == block.min()
    sides = [(outside & first, ~first), (~outside & first, outside & ~first)] if not first.all() else [(outside, np.ones(len(group), bool))]
    own = np.zeros(words.max() + 1, bool)
    found = []
    for left, right in sides:
        others = np.flatnonzero(right)
        for x in np.flatnonzero(left).tolist():
            near = others[(component[others] != component[x]) & _able(sizes[others], sizes[x])]
            near = near[np.count_nonzero(signature[near] == signature[x], axis=1) >= AGREE].tolist()
            mine = words[begins[x] : begins[x + 1]]
            own[mine] = True
            for y in near:
                both = np.count_nonzero(own[words[begins[y] : begins[y + 1]]]) if component[y] != component[x] else 0
                if 5 * both >= 4 * (sizes[x] + sizes[y] - both):
                    found.append((min(marks[x], marks[y]), max(marks[x], marks[y])))
                    component[component == component[y]] = component[x]
            own[mine] = False
    return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])


def _left_over(members: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the different components of a key's members: of (key, mark), (mark, component_id) and
    (mark, set, signature).  A group of the comparison holds two blocks of a key at most, whatever the key's size."""
    known = members.join(classes, "mark").join(texts.select("mark", F.size("set").alias("_size")), "mark")
    mixed = known.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_sum"), F.min("component_id").alias("_a"), F.max("component_id").alias("_b")).filter("_a < _b")
    mixed = mixed.select("key", F.ceil(F.greatest(F.col("_n") / BLOCK, F.col("_sum") / SHINGLES)).cast("int").alias("_blocks"))
    placed = known.drop("_size").join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("mark"), F.col("_blocks")).cast("int"))
    dealt = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumns({"_i": F.least("block", "_other"), "_j": F.greatest("block", "_other")})
    groups = dealt.join(texts, "mark").select("key", "_i", "_j", "mark", "component_id", "set", "signature", "block").groupBy("key", "_i", "_j")
    return groups.applyInPandas(_compared, "a long, b long").distinct()


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id and component_id, the smallest id that links reach, itself included.

    Texts without words are equal to each other.  A row with a null id takes part through its text; its component
    is the smallest id there, or null.  Ids are integers; an empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    text = F.col(text_col)
    # A row without an id has a name that no id has.
    name = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1) - F.pmod(F.xxhash64(text), F.lit(1 << 62)))
    named = df.select(name.alias("name"), text.alias("text"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [shingles(t) for t in texts]
            fps = np.array([fingerprint(t, WORDS) for t in texts], np.uint64).view(np.int64)
            columns = [pa.array([mark(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(fps), pa.array([bands(min_hashes(x)) for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["name", "mark", "size", "fp", "bands"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(m, s.view(np.int64), b) for t, m, b in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True) if mark(s := shingles(t)) == m]
            found, large = [r[:2] for r in rows], [r[2] for r in rows]
            columns = [pa.array([m for m, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.int64()))]
            columns.append(pa.array([min_hashes(s.view(np.uint64)).astype(np.uint8).tobytes() if b else None for (_, s), b in zip(found, large, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["mark", "set", "signature"])

    rows = cut(named.mapInArrow(signed, "name long, mark long, size long, fp long, bands array<long>"))
    vertices = cut(rows.groupBy("mark").agg(F.min("name").alias("vertex"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    ids = vertices.select("mark", "vertex")
    keys = vertices.filter("size > 0").select(F.explode("bands").alias("key"), "mark", "size", "fp")
    alike = _alike(vertices.filter("size > 0").select("mark", "fp")).select("a", "b", F.lit(None).cast("long").alias("key"))
    found = keys.repartition("key").sortWithinPartitions("key", "mark").mapInArrow(_candidates, "a long, b long, key long")
    found = cut(found.union(alike).distinct())
    pairs, members = found.filter("key IS NULL").select("a", "b"), found.filter("key IS NOT NULL").select("key", F.col("a").alias("mark"))

    met = found.select(F.col("a").alias("mark"), F.col("key").isNotNull().alias("large")).union(pairs.select("b", F.lit(False))).groupBy("mark").agg(F.max("large").alias("large"))
    wanted = vertices.join(met, "mark").select("mark", F.col("vertex").alias("name"), "large")
    texts = named.join(wanted, "name").select("name", "text", "mark", "large").mapInArrow(sets, "mark long, set array<long>, signature binary")
    texts = cut(texts.dropDuplicates(["mark"]))
    first = texts.select(F.col("mark").alias("a"), F.col("set").alias("_a"))
    second = texts.select(F.col("mark").alias("b"), F.col("set").alias("_b"))
    both = pairs.join(first, "a").join(second, "b")
    overlap = F.size(F.array_intersect("_a", "_b"))
    near = both.filter(5 * overlap >= 4 * (F.size("_a") + F.size("_b") - overlap)).select("a", "b")

    def edges(links: DataFrame) -> DataFrame:
        ends = links.join(ids.select(F.col("mark").alias("a"), F.col("vertex").alias("x")), "a").join(ids.select(F.col("mark").alias("b"), F.col("vertex").alias("y")), "b")
        return ends.select(F.greatest("x", "y").alias("src"), F.least("x", "y").alias("dst"))

    def joined(links: DataFrame) -> DataFrame:
        return ids.join(components(links), "vertex", "left").select("mark", F.coalesce("component", "vertex").alias("component_id"))

    linked = cut(edges(near))
    classes = cut(joined(linked))
    left = cut(_left_over(members, classes, texts))
    if not left.isEmpty():
        classes = joined(linked.union(edges(left)))
    known = lambda c: F.when(F.col(c) < (1 << 63) - 1 - (1 << 62), F.col(c))
    return rows.select("name", "mark").join(classes, "mark", "left").select(known("name").alias(id_col), known("component_id").alias("component_id"))
