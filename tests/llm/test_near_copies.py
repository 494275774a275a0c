import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline as P
from blockvault.llm import near_copies as N

from .cases import both, components, documents, frame


def near(a, b):
    x, y = N.shingles(a), N.shingles(b)
    both = len(np.intersect1d(x, y))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def copies():
    """Groups whose members lie near similarity 0.8, and a large group of near copies."""
    rng = random.Random(9)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(3):
            words = list(base)
            for at in rng.sample(range(120), rng.randrange(1, 5)):
                words[at] = f"v{rng.randrange(500)}"
            rows.append((1000 + len(rows), " ".join(words), "en"))
    base = [f"w{rng.randrange(500)}" for _ in range(100)]
    for k in range(40):
        rows.append((2000 + k, " ".join([*base[:k], "x", *base[k + 1 :]]), "en"))
    return rows


def test_components_by_brute_force(spark):
    rows = documents() + copies() + [(None, "alone here now", "en")]
    text = {i: t for i, t, _ in rows if i is not None}
    linked = {(a, b) for a, b in combinations(sorted(text), 2) if near(text[a], text[b])}
    assert any((N.fingerprint(text[a]) ^ N.fingerprint(text[b])).bit_count() > 4 for a, b in linked)
    want = components(sorted(text), lambda a, b: (min(a, b), max(a, b)) in linked)
    for df in both(spark, rows):
        got = N.near_components(df).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
        assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    kept = P.simhash_stage(spark, frame(spark, rows), "").collect()
    assert {r["doc_id"] for r in kept} == {None} | {i for i, c in want.items() if i == c}


@pytest.mark.parametrize("block", [7, 1000])
def test_members_of_large_keys_are_all_compared(spark, monkeypatch, block):
    """Links join a key's members as all links between its components would, whatever the blocks."""
    monkeypatch.setattr(N, "BLOCK", block)
    rows = copies()[40:]
    texts = {1 + k: t for k, (_, t, _) in enumerate(rows)}
    found = {m: N.shingles(t) for m, t in texts.items()}
    sets = [(m, s.view(np.int64).tolist(), N.min_hashes(s).astype(np.uint8).tobytes()) for m, s in found.items()]
    # Two keys; of some groups of copies two members are in one component already.
    key = {m: 1 + (m - 1) // 45 for m in texts}
    component = {m: m - 1 if m % 9 == 2 else m for m in texts}
    members = spark.createDataFrame([(key[m], m) for m in texts], "key long, mark long")
    classes = spark.createDataFrame(list(component.items()), "mark long, component_id long")
    got = [(r["a"], r["b"]) for r in N._left_over(members, classes, spark.createDataFrame(sets, "mark long, set array<long>, signature binary")).collect()]
    linked = {(a, b) for a, b in combinations(texts, 2) if near(texts[a], texts[b]) and key[a] == key[b] and component[a] != component[b]}
    assert len(linked) > 20 and set(got) <= linked
    known = {(min(a, b), max(a, b)) for a, b in component.items() if a != b}
    join = lambda links: components(sorted(texts), lambda a, b: (min(a, b), max(a, b)) in links)
    assert join(set(got) | known) == join(linked | known)


def test_links_within_a_crowd_of_similar_texts(spark):
    """Many texts that share most of a passage and yet are no copies, with copies of some among them."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(90):
        own = [f"o{k}x{j}" for j in range(45)]
        rows.append((k, " ".join(base + own), "en"))
        if k % 3 == 0:
            own[3::12] = [f"n{rng.randrange(9)}" for _ in own[3::12]]
            rows.append((500 + k, " ".join(base + own), "en"))
    text = {i: t for i, t, _ in rows}
    linked = {(a, b) for a, b in combinations(sorted(text), 2) if near(text[a], text[b])}
    want = components(sorted(text), lambda a, b: (min(a, b), max(a, b)) in linked)
    assert 20 < len(linked) < 100
    assert {r["doc_id"]: r["component_id"] for r in N.near_components(frame(spark, rows)).collect()} == want


def test_simhash_finds_copies_by_itself(spark, monkeypatch):
    """Without min-hashes, the links within SimHash's distance are there, and no others."""
    monkeypatch.setattr(N, "_candidates", lambda batches: iter(()))
    rows = copies()
    text = {i: t for i, t, _ in rows}
    prints = {i: N.fingerprint(t, N.WORDS) for i, t in text.items()}
    linked = {(a, b) for a, b in combinations(sorted(text), 2) if near(text[a], text[b]) and (prints[a] ^ prints[b]).bit_count() <= N.DISTANCE}
    got = {r["doc_id"]: r["component_id"] for r in N.near_components(frame(spark, rows)).collect()}
    whole = components(sorted(text), lambda a, b: (min(a, b), max(a, b)) in linked)
    assert sum(i != c for i, c in got.items()) > 5
    assert all(whole[i] == whole[c] for i, c in got.items())


def test_empty_table(spark):
    assert N.near_components(frame(spark, [])).count() == 0
