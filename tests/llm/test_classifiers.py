import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockvault.llm import language as L
from blockvault.llm import quality as Q
from blockvault.llm.common import read_table

from .cases import both, documents, frame

SMALL = "/root/testdata/sf0.01"


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_discriminant_is_the_gaussian_log_ratio():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(2, 0.5, (200, 3))])
    y = np.repeat([0, 1], [300, 200])
    model = Q.fit(x, y)
    logs = []
    for k in (0, 1):
        inverse = model.factors[k].T @ model.factors[k]
        c = np.linalg.inv(inverse)
        d = x[:5] - model.means[k]
        logs.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, inverse, d))
    assert np.allclose(model.score(x[:5]), 1 / (1 + np.exp(0.5 * (logs[0] - logs[1]))))
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97
    assert Q.fit(x[:300], y[:300]).score(x[:2]).tolist() == [0, 0] and Q.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_held_out_accuracy(spark):
    labels = read_table(spark, SMALL, "labels")
    found = Q.classify(read_table(spark, SMALL, "documents"), labels).join(labels, "doc_id").toPandas()
    assert (found["held_out"] == found["doc_id"].map(is_held)).all()
    held = found[found["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    assert ((found["score"] >= 0.7).astype(int) == found["predicted"]).all() and found["score"].between(0, 1).all()


def test_held_out_labels_do_not_matter(spark):
    docs, labels = read_table(spark, SMALL, "documents"), read_table(spark, SMALL, "labels")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.learn(docs, labels), Q.learn(docs, flipped)
    assert np.allclose(a.means, b.means) and np.allclose(a.factors, b.factors)


def test_quality_awkward_rows(spark):
    rows = documents()
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)] + [(1, None, "x"), (None, 1, "x"), (3, 0, "x"), (999, 1, "x")], "doc_id long, quality int, score string")
    for df in both(spark, rows):
        got = Q.classify(df, labels).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in Q.classify(frame(spark, rows), labels.limit(0)).collect()} == {0.5}
    assert Q.classify(frame(spark, []), labels).count() == 0
    kept = Q.score(frame(spark, rows, True), Q.learn(frame(spark, rows), labels), carry=["score", "text", "doc_id"], least=0.0)
    assert kept.count() == len(rows)


def test_language_held_out_accuracy(spark):
    docs = read_table(spark, SMALL, "documents")
    found = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97 and found["score"].between(0, 1).all()
    # Calibrated: the mean confidence is near the accuracy.
    assert abs(held["score"].mean() - (held["lang_pred"] == held["lang"]).mean()) < 0.05


def test_logits_of_a_batch_are_those_of_single_texts():
    rng = np.random.default_rng(1)
    model = L.Model(["a", "b"], rng.normal(size=(1 << L.BITS, 2)).astype(np.float32), np.zeros(2), 1.0)
    texts = ["Hello there", "x", "äöü ß " * 50, "z" * 3000]
    together = model._logits(texts)
    for t, row in zip(texts, together, strict=True):
        ids, tf = L.counts(t)
        want = (tf[:, None] * model.weights[ids]).sum(axis=0) / tf.sum()
        assert np.allclose(row, want, atol=1e-4)


def test_very_long_text_is_whole(monkeypatch):
    rng = np.random.default_rng(1)
    model = L.Model(["a", "b"], rng.normal(size=(1 << L.BITS, 2)).astype(np.float32), np.zeros(2), 1.0)
    text = "".join(rng.choice(list("abcdefg "), 5000))
    want = model._logits([text, "tail"])
    monkeypatch.setattr(L, "GROUP", 100)
    assert np.allclose(model._logits([text, "tail"]), want, atol=1e-5)


def test_language_awkward_rows(spark):
    rows = documents()
    for df in both(spark, rows):
        got = {r["doc_id"]: r for r in L.identify(df).collect()}
        for i, t, _ in rows:
            unknown = not any(c.isalpha() for c in t or "")
            assert (got[i]["lang_pred"] == "und") == unknown and (not unknown or got[i]["score"] == 0)
    nothing = frame(spark, rows).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in L.identify(nothing).collect()} == {"und"}
    assert L.identify(frame(spark, [])).count() == 0


def test_document_frequencies_by_counting(spark, monkeypatch):
    rows = documents() + [(900, "äb " * 700, "en"), (901, "", "en"), (902, "12 34", "en")]
    want, n = np.zeros(1 << L.BITS, np.int64), 0
    for _, text, _ in rows:
        if any(c.isalpha() for c in text or ""):
            want[L.counts(text)[0]] += 1
            n += 1
    for df in both(spark, rows):
        got, documents_ = L.document_frequencies(df.repartition(5))
        assert documents_ == n and (got == want).all()
    got, documents_ = L.document_frequencies(frame(spark, []))
    assert documents_ == 0 and not got.any()
    # A text in pieces has the features of the whole.
    monkeypatch.setattr(L, "GROUP", 100)
    one = np.zeros(1 << L.BITS, np.int64)
    L.add_document(rows[-3][1], np.zeros(1 << L.BITS, bool), one)
    assert (np.flatnonzero(one) == L.counts(rows[-3][1])[0]).all() and one.max() == 1


def test_learning_takes_frequencies_of_all_rows_but_those_held_out(spark, monkeypatch):
    docs = read_table(spark, SMALL, "documents")
    usable = docs.filter("lang is not null and not coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, false)")
    want, n = L.document_frequencies(usable)
    given = []
    monkeypatch.setattr(L, "train", lambda rows, corpus=None: given.append((rows, corpus)))
    L.learn(docs, fit_rows=20)
    (rows, (df, documents_)), = given
    assert documents_ == n > len(rows) > 0 and (df == want).all()


@pytest.mark.parametrize("k", [1, 3])
def test_training_is_sparse_and_learns(k):
    rng = np.random.default_rng(2)
    rows = [(f"l{j % k}", *L.counts("".join(rng.choice(list("abc" if j % k == 0 else "xyz" if j % k == 1 else "mno"), 60)))) for j in range(60)]
    model = L.train(rows)
    assert model.languages == sorted({r[0] for r in rows})
    assert (model.weights != 0).any(axis=1).mean() < 0.05
    assert model.predict(["abcabcabc"])[0] == ["l0"]


def test_shrinkage_by_loops():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (40, 3)), rng.normal(1, 2, (7, 3))])
    y = np.repeat([0, 1], [40, 7])
    means, covariances = [], []
    for k in (0, 1):
        rows = [r for r, c in zip(x.tolist(), y, strict=True) if c == k]
        mean = [sum(r[j] for r in rows) / len(rows) for j in range(3)]
        means.append(mean)
        covariances.append([[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in rows) / len(rows) for j in range(3)] for i in range(3)])
    logs = []
    for k, n in ((0, 40), (1, 7)):
        lean = max(Q.TO_POOLED, 3 / (3 + n))
        shrunk = np.zeros((3, 3))
        for i in range(3):
            for j in range(3):
                pooled = (40 * covariances[0][i][j] + 7 * covariances[1][i][j]) / 47
                shrunk[i, j] = (1 - Q.TO_DIAGONAL) * ((1 - lean) * covariances[k][i][j] + lean * pooled) + (Q.TO_DIAGONAL * pooled + Q.FLOOR if i == j else 0)
        d = x - np.array(means[k])
        logs.append(np.log(n / 47) - 0.5 * np.log(np.linalg.det(shrunk)) - 0.5 * (d @ np.linalg.inv(shrunk) * d).sum(axis=1))
    assert np.allclose(Q.fit(x, y).score(x), 1 / (1 + np.exp(0.5 * (logs[0] - logs[1]))))


def test_training_by_coordinates():
    """Follow-the-regularised-leader in plain numbers, one coordinate at a time, and the temperature by a fine grid."""
    texts = ["das ist ein haus", "der hund und die katze", "ein baum im wald", "wir gehen nach hause", "und noch ein satz", "kaltes wasser", "the house is old", "a dog and the cat", "trees in a forest", "we are going home", "and one more line", "cold das water"]
    rows = [("de" if i < 6 else "en", *L.counts(t)) for i, t in enumerate(texts)]
    rows = rows[::2] + rows[1::2]
    model = L.train(rows)
    frequency: dict = {}
    for _, ids, _ in rows:
        for f in ids.tolist():
            frequency[f] = frequency.get(f, 0) + 1
    idf = {f: math.log((1 + len(rows)) / (1 + n)) + 1 for f, n in frequency.items()}
    z, n, zb, nb, seen, fitted, apart = {}, {}, [0.0, 0.0], [0.0, 0.0], {}, [], []
    for name, ids, tf in rows:
        vector = {f: L.SCALE * t / tf.sum() * idf[f] for f, t in zip(ids.tolist(), tf.tolist(), strict=True)}
        seen[name] = seen.get(name, 0) + 1
        (apart if seen[name] % 5 == 0 else fitted).append((["de", "en"].index(name), vector))

    def weight(f, k):
        a, b = z.get((f, k), 0.0), n.get((f, k), 0.0)
        return 0.0 if abs(a) <= L.L1 else -(a - math.copysign(L.L1, a)) / ((L.BETA + math.sqrt(b)) / L.ALPHA + L.L2)

    def bias(k):
        return -zb[k] / ((L.BETA + math.sqrt(nb[k])) / L.ALPHA + L.L2)

    def logits(vector):
        return [sum(v * weight(f, k) for f, v in vector.items()) + bias(k) for k in (0, 1)]

    for _ in range(L.EPOCHS):
        for y, vector in fitted:
            e = [math.exp(x) for x in logits(vector)]
            g = [e[k] / sum(e) - (k == y) for k in (0, 1)]
            old = {(f, k): weight(f, k) for f in vector for k in (0, 1)}
            for (f, k), w in old.items():
                step = vector[f] * g[k]
                before = n.get((f, k), 0.0)
                n[f, k] = before + step * step
                z[f, k] = z.get((f, k), 0.0) + step - (math.sqrt(n[f, k]) - math.sqrt(before)) / L.ALPHA * w
            for k in (0, 1):
                w, before = bias(k), nb[k]
                nb[k] += g[k] * g[k]
                zb[k] += g[k] - (math.sqrt(nb[k]) - math.sqrt(before)) / L.ALPHA * w
    assert model.languages == ["de", "en"] and np.allclose(model.bias, [bias(0), bias(1)])
    for f in frequency:
        assert np.allclose(model.weights[f], [weight(f, k) * idf[f] * L.SCALE for k in (0, 1)], rtol=1e-4, atol=1e-6)
    assert any(weight(f, 0) == 0 for f in frequency)

    def loss(log_t):
        total = 0.0
        for y, vector in apart:
            a = [x / math.exp(log_t) for x in logits(vector)]
            total += math.log(sum(math.exp(x - max(a)) for x in a)) + max(a) - a[y]
        return total

    assert apart and loss(math.log(model.temperature)) <= min(loss(math.log(0.05) + k * math.log(400) / 2000) for k in range(2001)) + 1e-6
