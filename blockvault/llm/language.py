"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of the lower-cased text.  A feature's value is its share of the text's n-grams
times its inverse document frequency, so that a text's logits are means over its n-grams of weights that
already hold the frequencies.  The weights are trained by follow-the-regularised-leader (proximal, per
coordinate) with elastic-net penalties, then one temperature is fitted on rows kept apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, small_batches

#: The model is fitted on about so many rows of each language at most, chosen by a hash of the id.
FIT_ROWS = 500
ORDERS = (1, 2, 3)
BITS = 16
#: Learning rates and penalties of the training, and the features' common scale.
ALPHA, BETA, L1, L2, SCALE, EPOCHS = 0.3, 1.0, 0.02, 0.02, 40.0, 4
UNKNOWN = "und"
#: Texts are worked off in groups of about so many characters.
GROUP = 500_000
_LETTER = regex.compile(r"\p{L}")


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """The hashed n-gram that begins at each place that has one."""
    h = np.full(len(codes) - n + 1, n, np.uint32)
    for k in range(n):
        h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint32(0x9E3779B1)
    return (h ^ (h >> np.uint32(15))) >> np.uint32(32 - BITS) if BITS < 17 else h >> np.uint32(32 - BITS)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a whole text and how often each occurs."""
    codes = _codes(text)
    found = np.concatenate([_hashes(codes, n) for n in ORDERS if len(codes) >= n])
    return np.unique(found, return_counts=True)


def add_document(text: str, seen: np.ndarray, frequencies: np.ndarray) -> None:
    """Add 1 to the frequency of each feature of a whole text; ``seen`` is room for one mark a feature."""
    codes = _codes(text)
    seen[:] = False
    for n in ORDERS:
        for at in range(0, len(codes) - n + 1, 4 * GROUP):
            seen[_hashes(codes[at : at + 4 * GROUP + n - 1], n)] = True
    frequencies += seen


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # features by languages; inverse document frequencies and scale are in them
    bias: np.ndarray
    temperature: float

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        begin = weight = 0
        for k, i in enumerate(known):
            weight += len(texts[i])
            if weight >= GROUP or k == len(known) - 1:
                part = known[begin : k + 1]
                best = self.probabilities(self._logits([texts[j] for j in part]))
                for j, row in zip(part, best, strict=True):
                    at = int(row.argmax())
                    names[j], scores[j] = self.languages[at], float(row[at])
                begin, weight = k + 1, 0
        return names, scores

    def _logits(self, texts: list[str]) -> np.ndarray:
        lowered = [" " + t.lower() + " " for t in texts]
        ends = np.cumsum([len(t) for t in lowered])
        begins = np.concatenate([[0], ends[:-1]])
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        total, number = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for n in ORDERS:
            for at in range(0, len(codes), 4 * GROUP):  # one text alone may be very long
                part = codes[at : at + 4 * GROUP + n - 1]
                if len(part) < n:
                    break
                found = self.weights[_hashes(part, n)]
                sums = np.concatenate([np.zeros((1, found.shape[1])), np.cumsum(found, axis=0, dtype=np.float64)])
                a, b = np.clip(begins - at, 0, len(found)), np.clip(ends - n + 1 - at, 0, len(found))
                total += sums[np.maximum(a, b)] - sums[a]
                number += np.maximum(b - a, 0)
        return total / np.maximum(number, 1)[:, None] + self.bias


def train(rows: Sequence[tuple[str, np.ndarray, np.ndarray]], corpus: tuple[np.ndarray, int] | None = None) -> Model:
    """Fit on rows of a language and the counts of its features, in the order given; every fifth row of a
    language serves for the temperature only.  ``corpus`` holds each feature's document frequency and the number of
    documents; without it the rows are the corpus.  With no rows there is no language to predict."""
    languages = sorted({r[0] for r in rows})
    number, seen = {x: i for i, x in enumerate(languages)}, {x: 0 for x in languages}
    df, documents = corpus or (np.bincount(np.concatenate([ids for _, ids, _ in rows] or [[]]).astype(np.int64), minlength=1 << BITS), len(rows))
    idf = np.log((1 + documents) / (1 + df)) + 1
    k = len(languages)
    z, n, w = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    zb, nb = np.zeros(k), np.zeros(k)
    bias = np.zeros(k)
    fitted, apart = [], []
    for name, ids, tf in rows:
        (apart if seen[name] % 5 == 4 else fitted).append((number[name], ids, SCALE * tf / tf.sum() * idf[ids]))
        seen[name] += 1
    for _ in range(EPOCHS if k > 1 else 0):
        for y, ids, x in fitted:
            zi, ni = z[ids], n[ids]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            bias = -zb / ((BETA + np.sqrt(nb)) / ALPHA + L2)
            logits = x @ wi + bias
            e = np.exp(logits - logits.max())
            g = e / e.sum()
            g[y] -= 1
            gx = x[:, None] * g
            sigma = (np.sqrt(ni + gx * gx) - np.sqrt(ni)) / ALPHA
            z[ids] = zi + gx - sigma * wi
            n[ids] = ni + gx * gx
            sb = (np.sqrt(nb + g * g) - np.sqrt(nb)) / ALPHA
            zb, nb = zb + g - sb * bias, nb + g * g
    if k > 1:
        w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
        bias = -zb / ((BETA + np.sqrt(nb)) / ALPHA + L2)
    rest = apart or fitted
    logits = np.array([x @ w[ids] + bias for _, ids, x in rest]).reshape(len(rest), k)
    answers = np.array([y for y, _, _ in rest], int)
    return Model(languages, (w * idf[:, None] * SCALE).astype(np.float32), bias, _temperature(logits, answers))


def _temperature(logits: np.ndarray, answers: np.ndarray) -> float:
    """The temperature of the least negative log likelihood, by golden-section search over its logarithm."""
    if not len(answers):
        return 1.0

    def loss(t: float) -> float:
        a = logits / math.exp(t)
        a = a - a.max(axis=1, keepdims=True)
        return float((np.log(np.exp(a).sum(axis=1)) - a[np.arange(len(answers)), answers]).mean())

    low, high, ratio = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many rows of ``docs`` each feature is, and the number of rows; those without a letter do not count.

    Each partition adds up its own texts, so at most 2**BITS rows of it are shuffled and as many reach the driver.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, frequencies, documents = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if text and _LETTER.search(text):
                    add_document(text, seen, frequencies)
                    documents += 1
        ids = np.flatnonzero(frequencies)
        # The number of rows stands at a feature that does not exist.
        yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, 1 << BITS).astype(np.int32)), pa.array(np.append(frequencies[ids], documents))], ["feature", "n"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros((1 << BITS) + 1, np.int64)
    df[found["feature"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return df[:-1], int(df[-1])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on about ``fit_rows`` rows of each language at most, chosen by a hash of the id among the rows that may
    be learned from.  Rows with a null language or id, or without a letter, are passed over; of rows
    that repeat an id the least counts.  Document frequencies are those of all rows that may be learned from."""
    small_batches(docs.sparkSession)
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).filter(~held_out(id_col))
    sizes = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}  # a row for each language
    chance = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000))
    wanted = F.lit(False)
    for name, size in sizes.items():
        wanted = wanted | ((F.col(lang_col) == name) & (chance < math.ceil(1_000_000 * min(1.0, fit_rows / size))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(i, x, t) for i, x, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t and _LETTER.search(t)]
            found = [counts(t) for _, _, t in kept]
            columns = [[i for i, _, _ in kept], [x for _, x, _ in kept], [a.astype("<u4").tobytes() for a, _ in found], [b.astype("<u4").tobytes() for _, b in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["h", "lang", "ids", "tf"])

    rows = usable.filter(wanted).select(F.xxhash64(F.col(id_col)).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.groupBy("h").agg(F.min(F.struct("lang", "text")).alias("row")).select("h", "row.lang", "row.text")
    found = rows.mapInArrow(run, "h long, lang string, ids binary, tf binary").collect()
    # Always in the same order, whatever the partitions.
    found.sort(key=lambda r: (r["h"], r["lang"], bytes(r["ids"])))
    fitted = [(r["lang"], np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["tf"], "<u4").astype(float)) for r in found]
    return train(fitted, document_frequencies(usable, text_col) if fitted else None)


def predict(df: DataFrame, model: Model, text_col: str = "text", carry: Sequence[str] = (), least: float | None = None) -> DataFrame:
    """The columns named in ``carry``, lang_pred and score of each row; with ``least``, only rows whose language
    is known with at least that score.  A null text, or one without a letter, is ``und`` with score 0."""
    small_batches(df.sparkSession)
    at = carry.index(text_col) if text_col in carry else len(carry)
    rows = df.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate([*carry, text_col][: max(len(carry), at + 1)])])
    schema = T.StructType(
        [*[T.StructField(f"_c{i}", rows.schema[f"_c{i}"].dataType) for i in range(len(carry))], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict(batch.column(at).to_pylist())
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema.names)
            yield out if least is None else out.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(names, scores, strict=True)], pa.bool_()))

    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "lang_pred", "score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred and score of each row of ``docs``, repeated rows included.

    Without rows to learn from, every language is ``und``.  An empty table gives an empty result.
    """
    done = predict(docs, learn(docs, id_col, text_col, lang_col), text_col, [id_col])
    return done.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
