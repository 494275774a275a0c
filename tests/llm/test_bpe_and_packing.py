import hashlib
import random
import sys
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from blockvault.llm import best_fit_packing as B
from blockvault.llm import bpe
from blockvault.llm import retrieval_packing as R

from .cases import both, documents, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encoded(raw):
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="aeiounstr 'sdΣσ́\x1c\x85\n", max_size=400))
def test_same_as_library(text):
    t, v = Tokenizer.from_file(PATH) if "t" not in CACHE else CACHE["t"], bpe.load(PATH)
    CACHE["t"] = t
    want = t.encode(text, add_special_tokens=False).ids
    assert encoded(v.encode_batch([text])[0]) == want
    assert v.decode(want) == t.decode(want, skip_special_tokens=False)


CACHE: dict = {}


def test_marks_as_library(library):
    """Every mark with a class, in contexts where it may be reordered or composed, and every composition."""
    marks = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    contexts = ("a\u0301{}", "a{}\u0323", "a\u08e5{}", "a{}\u0345", "a\u0345{}", "a{}\u3099", "\u0915\u094d{}", "a{}\u0338", "a\u302a{}", "a{}\u0301")
    texts = [c.format(m) for m in marks for c in contexts]
    texts += [unicodedata.normalize("NFD", chr(c)) for c in range(sys.maxunicode + 1) if unicodedata.decomposition(chr(c)) and not 0xAC00 <= c < 0xD7A4]
    got = bpe.load(PATH).encode_batch(texts)
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [t for t, a, b in zip(texts, got, want, strict=True) if encoded(a) != b.ids] == []


def test_long_and_short_trees_agree(library):
    rng = random.Random(2)
    for size in (1, 2, 63, 64, 65, 127, 128, 129, 3000):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
        assert encoded(bpe.load(PATH).encode_batch([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_table_stays_bounded(library):
    v = bpe.Vocabulary(PATH, kept=50)
    rng = random.Random(3)
    for _ in range(10):
        texts = [" ".join("".join(rng.choice("abcde") for _ in range(6)) for _ in range(40)) for _ in range(3)]
        assert [encoded(x) for x in v.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(v.table) + len(v.older) <= 2 * 50 + 120


def test_digests_over_awkward_rows(spark, library):
    rows = documents()
    want = {}
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    for df in both(spark, rows):
        got = bpe.round_trip_digests(df, PATH).collect()
        assert len(got) == len(rows) and {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want
    decoded = bpe.decode(bpe.encode(frame(spark, rows), PATH), PATH)
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in decoded.collect()} == {i: x[2] for i, x in want.items()}
    assert bpe.round_trip_digests(frame(spark, []), PATH).count() == 0


def test_retrieval_packing(spark, library):
    rows = documents()
    want = sorted([*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t, _ in rows)
    for df in both(spark, rows):
        pieces = [r.asDict() for r in R.pack_by_retrieval(df, PATH).collect()]
        assert all(zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"] > 0 for p in pieces)
        sequences: dict = {}
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert sequences.get(p["sequence_id"], 0) == p["offset"]
            sequences[p["sequence_id"]] = p["offset"] + p["length"]
        assert all(n <= 4096 and n & (n - 1) == 0 for n in sequences.values())
        whole: dict = {}
        for p in sorted(pieces, key=lambda p: p["start"]):
            whole.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        got = []
        for (_, size), parts in whole.items():
            copies = sum(p["length"] for p in parts) // size  # a repeated row is packed as often as it is there
            ids = [i for p in parts for i in encoded(p["ids"])]
            assert len(ids) == copies * size
            got += [ids] if copies == 1 else [want[k] for k in range(len(want)) if len(want[k]) == size][:copies]
        assert sorted(got) == want
    assert R.pack_by_retrieval(frame(spark, []), PATH).count() == 0


def test_neighbours_come_by_score():
    docs = [np.array(x, np.uint32) for x in ([1, 2, 3, 9], [4, 5, 6, 9], [1, 2, 7, 9], [4, 8, 8, 9], [5, 1, 10, 9])]
    index = R.Index(docs)
    n = len(docs)
    sizes = np.array([len(d) for d in docs])

    def bm25(q, d):
        score = 0.0
        for term in set(docs[q].tolist()):
            df = sum(term in x for x in docs)
            tf = int((docs[d] == term).sum())
            idf = max(np.log((n - df + 0.5) / (df + 0.5)), 0.0)
            score += idf * tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * sizes[d] / sizes.mean())) if tf else 0.0
        return score

    for q in range(n):
        assert np.allclose(index.scores(q), [bm25(q, d) for d in range(n)])
    windows = R.Windows(8, 0)
    R.pack_shard(list(range(n)), docs, windows)
    windows.close()
    first = [p[0] for p in windows.done if p[4] == 0]
    assert first == [0, 2]  # document 2 shares two rare tokens with document 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_best_fit_places_everything_once(lengths):
    windows = B.best_fit(lengths, 64)
    assert all(sum(n for *_, n in w) <= 64 for w in windows)
    placed = {(d, at + k) for w in windows for d, at, n in w for k in range(n)}
    assert len(placed) == sum(lengths) == sum(n for w in windows for *_, n in w)
    # Best fit: against a plain search over all windows.
    rooms, expected = [], 0
    for n in sorted((x % 64 for x in lengths if x % 64), reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(64 - n)
            expected += 1
    assert len(windows) == expected + sum(x // 64 for x in lengths)


def test_best_fit_windows(spark, library):
    rows = [r for r in documents() if r[0] != 5] + [(5, "five", "en")]
    for df in both(spark, rows):
        windows = B.pack_best_fit(df, PATH, width=256).collect()
        for w in windows:
            positions = encoded(w["position_ids"])
            assert len(positions) == 256 == len(encoded(w["input_ids"])) and w["cu_seqlens"][-1] == w["n_tokens"]
            assert [positions[a] for a in w["cu_seqlens"][:-1]] == [0] * len(w["doc_ids"])
        back = B.unpack([w.asDict() for w in windows])
        assert {d: x.tolist() for d, x in back.items()} == {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in rows}
        assert B.digests(B.pack_best_fit(df, PATH, width=256)).count() == len(windows)
    assert B.pack_best_fit(frame(spark, []), PATH).count() == 0
