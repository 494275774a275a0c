import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockvault.llm import simhash as S

from .cases import both, components, documents, frame


def by_definition(text):
    import xxhash

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    for _, text, _ in documents(20):
        assert S.fingerprint(text) == by_definition(text)
    one = spark.createDataFrame([("a b c d",)], "t string").select(F.xxhash64("t")).first()[0]
    assert S.fingerprint("a b c d") == one % (1 << 64)


def test_components_by_brute_force(spark):
    rows = documents() + [(500 + k, " ".join(["w"] * k + ["v"]), "en") for k in range(60)] + [(None, "alone here now", "en")]
    fps = {i: by_definition(t) for i, t, _ in rows if i is not None}
    want = components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    for df in both(spark, rows):
        got = S.simhash_components(df).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
        assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


@pytest.mark.parametrize("most,few", [(20_000, 12), (30, 4)])
def test_links_on_dense_groups(spark, monkeypatch, most, few):
    monkeypatch.setattr(S, "MOST", most)
    monkeypatch.setattr(S, "FEW", few)
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 300:
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))))
    while len(fps) < 600:
        fps.add(rng.getrandbits(64))
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)), i) for i, x in enumerate(fps)], "fp long, vertex long")
    found = S.links(df).collect()
    assert all((fps[r["src"]] ^ fps[r["dst"]]).bit_count() <= 4 for r in found)
    want = components(list(range(len(fps))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    named = {r["vertex"]: r["component"] for r in S.components(S.links(df)).collect()}
    assert {i: named.get(i, i) for i in range(len(fps))} == want
    assert len(found) < 40 * len(fps)  # not all pairs


def test_masks_catch_every_close_pair():
    rng = random.Random(6)
    for blocks in (5, 6, 7):
        masks = S.masks(S.ONES, blocks, 4)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(diff & m == 0 for m in masks)


def test_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(40)] + [(200, 100 + i) for i in range(30)] + [(301, 300)]
    got = {r["vertex"]: r["component"] for r in S.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 100, 300: 300, 301: 300}


def test_empty_table(spark):
    assert S.simhash_components(frame(spark, [])).count() == 0
