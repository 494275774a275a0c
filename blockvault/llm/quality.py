"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each class has a Gaussian over transformed statistics of a document, with a covariance shrunk towards the
pooled one and its diagonal.  The score is the logistic of the difference of the classes' log densities, each
from a Mahalanobis distance by a Cholesky factor that is computed once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, small_batches

#: The model is fitted on about so many labelled rows at most, chosen by a hash of the id.
FIT_ROWS = 20_000
#: A document is predicted to be good from this score on.
THRESHOLD = 0.7
#: Weights of the pooled covariance, of its diagonal, and a floor for variances.
TO_POOLED, TO_DIAGONAL, FLOOR = 0.3, 0.1, 1e-3

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_CLASS = np.zeros(256, np.uint8)  # 0 control, 1 lower, 2 upper, 3 digit, 4 space, 5 beyond ASCII, then marks
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[_SPACES] = 4
_CLASS[128:] = 5
_MARKS = {6: ".", 7: ",;:", 8: "!?", 9: "#$%&*@^~+=<>", 10: "|_/\\-", 11: "()[]{}\"'`"}
for _k, _chars in _MARKS.items():
    for _c in _chars:
        _CLASS[ord(_c)] = _k
FEATURES = (
    "log_words", "mean_word", "sd_word", "upper", "digits", "others", "full_stops", "commas", "exclamations", "symbols", "bars",
    "brackets", "controls", "distinct_words", "top_word", "same_neighbour", "log_lines", "distinct_lines", "word_entropy", "marked_words", "short_words",
)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of FEATURES; shares go through a square root."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(raw)
    share = np.bincount(_CLASS[raw], minlength=12) / chars
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    times = np.fromiter(counts.values(), np.int64, len(counts))
    same = sum(map(str.__eq__, words, words[1:])) if n > 1 else 0
    lines = [x for x in (text or "").split("\n") if x.strip()]
    p = times / n
    entropy = float(-(p * np.log(p)).sum()) / math.log(n) if n > 1 else 1.0
    # Words that end in a symbol or bar, of all words.
    marked = sum(x[-1] in "#$%&*@^~+=<>|_!" for x in words) / n
    root = math.sqrt
    return [
        math.log1p(n), math.log1p(lengths.mean()), math.log1p(lengths.std()), root(share[2]), root(share[3]), root(share[5]), root(share[6]), root(share[7]),
        root(share[8]), root(share[9]), root(share[10]), root(share[11]), root(share[0]), len(counts) / n, root(times.max() / n), root(same / max(n - 1, 1)),
        math.log1p(len(lines)), len(set(lines)) / max(len(lines), 1), entropy, root(marked), float((lengths <= 3).mean()),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Two classes with means, inverse Cholesky factors, log determinants and log priors."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    only: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.factors[k].T
            density.append(self.constants[k] - 0.5 * (z * z).sum(axis=1))
        # Halved distances: statistics of a document are not independent, and densities too sure of themselves.
        return 1 / (1 + np.exp(np.clip(0.5 * (density[0] - density[1]), -700, 700)))


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant:
    """Fit on statistics and labels 0 or 1.  With one class only, every score is that class; with none, 0.5."""
    d = x.shape[1]
    sizes = np.array([(y == 0).sum(), (y == 1).sum()])
    if not sizes.all():
        none = np.zeros((2, d))
        return Discriminant(none, none, none, 0.5 if not sizes.any() else float(sizes[1] > 0))
    means = np.stack([x[y == k].mean(axis=0) for k in (0, 1)])
    own = [np.cov(x[y == k].T, bias=True).reshape(d, d) for k in (0, 1)]
    pooled = (own[0] * sizes[0] + own[1] * sizes[1]) / sizes.sum()
    factors, constants = [], []
    for k in (0, 1):
        # Small classes lean on the pooled covariance more.
        w = max(TO_POOLED, d / (d + sizes[k]))
        c = (1 - w) * own[k] + w * pooled
        c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(pooled)) + FLOOR * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        constants.append(math.log(sizes[k] / sizes.sum()) - np.log(np.diag(low)).sum())
    return Discriminant(means, np.stack(factors), np.array(constants))


def _features(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    return rows.mapInArrow(run, "label int, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Discriminant:
    """Fit on about ``fit_rows`` labelled rows at most: those with the least hashes of their ids, of the rows that
    may be learned from.  Null labels, null ids and labels without a document are passed over; of several labels
    or texts of an id the smallest counts."""
    small_batches(docs.sparkSession)
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).filter(~held_out(id_col))
    usable = usable.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    rate = min(1.0, fit_rows / max(usable.count(), 1))
    chosen = usable.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < math.ceil(rate * 1_000_000))
    # About fit_rows rows of an id and a number at most: small whatever the size of the input.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    texts = texts.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    found = _features(texts.select("_label", "_text")).collect()
    x = np.array([r["x"] for r in found], float).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r["label"] for r in found], int))


def score(df: DataFrame, model: Discriminant, text_col: str = "text", carry: Sequence[str] = (), least: float | None = None) -> DataFrame:
    """The columns named in ``carry`` and score (0 to 1) of each row; with ``least``, only rows that reach it.

    A null or empty text is scored as a text without words.  One pass, no shuffle.
    """
    small_batches(df.sparkSession)
    at = carry.index(text_col) if text_col in carry else len(carry)
    rows = df.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate([*carry, text_col][: max(len(carry), at + 1)])])
    schema = T.StructType([*[T.StructField(f"_c{i}", rows.schema[f"_c{i}"].dataType) for i in range(len(carry))], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(at).to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            scores = model.score(x)
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(scores)], schema.names)
            yield out if least is None else out.filter(pa.array(scores >= least))

    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "score")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted (1 from THRESHOLD on) of each row of ``docs``, repeated rows included.

    Without usable labels every score is 0.5.  An empty table gives an empty result.
    """
    scored = score(docs, learn(docs, labels, id_col, text_col), text_col, [id_col])
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
