"""Quality classifier learnt from trusted positives and unlabelled text (non-negative positive-unlabelled risk)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import short_batches, slices

MOST_POSITIVES, MOST_UNLABELLED = 20_000, 40_000  # bounds of the sample that the model is fitted on
THRESHOLD, FOLDS = 0.3, 5

_CLASSES = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "stop": ".,;:!?", "quote": "'\"()-", "mark": "#$%&*+/<=>@\\^_`{|}~[]"}
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _i, _chars in enumerate(_CLASSES.values()):
    _CLASS_OF[[ord(c) for c in _chars]] = _i
N_FEATURES = 20


def features(text: str | None) -> list[float]:
    """Shape of a text, each value near 0..1, whole text read: shares of character classes, how words repeat, how lines repeat."""
    text = text or ""
    data = text.encode()
    words = text.split()
    n_bytes, n_words = max(len(data), 1), max(len(words), 1)
    classes = np.bincount(_CLASS_OF[np.frombuffer(data, np.uint8)], minlength=len(_CLASSES) + 1)[:len(_CLASSES)] / n_bytes
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    lines = [line for line in text.split("\n") if line]
    n_lines = max(len(lines), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    ends = sum(w[-1] in ".!?" for w in words)
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?)\"'" for w in words)
    bare = sum(not w[0].isalnum() and len(w) < 4 for w in words)
    return [
        *classes.tolist(),
        repeats / n_words, len(set(words)) / n_words, len(set(zip(words, words[1:]))) / n_words,
        ends / n_words, marked / n_words, bare / n_words,
        1 - len(set(lines)) / n_lines, min(n_lines / n_words, 1.0),
        lengths.mean() / 20, lengths.std() / 20, min(lengths.max() / 100, 1.0),
        np.log1p(len(text)) / 12, np.log1p(n_words) / 10, text.count(" ") / max(len(text), 1), float(not words),
    ]


def feature_rows(texts: list) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), N_FEATURES)


class Model:
    """A logistic model on standardised shape features and their squares."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    @staticmethod
    def expand(x, mean, scale):
        z = np.clip((x - mean) / scale, -8, 8)
        return np.hstack((np.ones((len(z), 1)), z, z * z / 4))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.expand(x, self.mean, self.scale) @ self.weights, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 600, rate: float = 0.05, ridge: float = 1e-4) -> Model:
    """Minimise prior * R(positive as 1) + max(0, R(unlabelled as 0) - prior * R(positive as 0)) with logistic loss.

    Where the second part falls below 0, the step goes up its slope instead, as the non-negative estimator asks for.
    """
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = Model.expand(positive, mean, scale), Model.expand(unlabelled, mean, scale)
    w, first, second = np.zeros(p.shape[1]), 0.0, 0.0
    w[0] = np.log(prior / (1 - prior))
    sigmoid = lambda f: 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    for step in range(1, rounds + 1):
        fp, fu = p @ w, u @ w
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        up_negative = u.T @ sigmoid(fu) / len(u) - prior * (p.T @ sigmoid(fp)) / len(p)
        up_positive = -prior * (p.T @ sigmoid(-fp)) / len(p)
        slope = up_positive + up_negative if negative >= 0 else -up_negative
        slope = slope + ridge * np.concatenate(([0.0], w[1:]))
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope ** 2
        w = w - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, w)


def fold(key: Column) -> Column:
    return (F.crc32(F.encode(key.cast("string"), "UTF-8")) % FOLDS).cast("int")


def _hash_share(key: Column) -> Column:
    """A number from 0 to 1 for each key, the same in every run."""
    return F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def train(docs: DataFrame, labels: DataFrame, most_positives: int = MOST_POSITIVES, most_unlabelled: int = MOST_UNLABELLED,
          key: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """Fit on rows outside the held-out fold only; None if they hold no positive label.

    The class prior is the share of label 1 among all labelled rows outside that fold. The model sees a sample by hash of the key: about
    ``most_positives`` rows of label 1 and, whatever their labels, ``most_unlabelled`` of all documents.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).filter(F.col("k").isNotNull() & F.col("y").isNotNull() & (fold(F.col("k")) != 0))
    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0))).first()
    if not ones:
        return None
    prior = min(max(ones / n, 0.01), 0.99)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    learnable = rows.filter(F.col("k").isNotNull() & (fold(F.col("k")) != 0))
    n_all = docs.count()
    chosen = (known.filter((F.col("y") == 1) & (_hash_share(F.col("k")) < most_positives / ones)).select("k").distinct()
              .orderBy(F.xxhash64("k")).limit(2 * most_positives).withColumn("positive", F.lit(True)))  # a bounded list of keys
    drawn = _hash_share(F.hash("k")) < most_unlabelled / max(n_all, 1)
    sample = (learnable.join(F.broadcast(chosen), "k", "left")
              .select("text", F.coalesce("positive", F.lit(False)).alias("positive"), drawn.alias("drawn")).filter("positive OR drawn"))

    def run(batches):
        for batch in batches:
            x = np.vstack([feature_rows(part.column(0).to_pylist()) for part in slices(batch)] or [np.zeros((0, N_FEATURES))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "positive", "drawn"])

    got = short_batches(sample).mapInArrow(run, "x array<double>, positive boolean, drawn boolean").toArrow()
    if not got.num_rows:
        return None
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(got.num_rows, N_FEATURES)
    is_positive, is_drawn = got.column("positive").to_numpy(), got.column("drawn").to_numpy()
    order = np.lexsort(x.T)  # the same sums in every run, whatever order the rows came in
    x, is_positive, is_drawn = x[order], is_positive[order], is_drawn[order]
    if not is_positive.any() or not is_drawn.any():
        return None
    return fit(x[is_positive], x[is_drawn], prior)


def score_documents(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, score): every row of ``docs`` as a struct, with the chance of label 1 from its whole text. Null and empty texts get the
    score of a text without words; without a model every score is 0.5."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(i, 256).to_pylist() for i in range(0, len(texts), 256))
        scores = [model.score(feature_rows(part)) if model else np.full(len(part), 0.5) for part in parts]
        return pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())

    return short_batches(docs).select(F.struct("*").alias("row"), score(F.col(text)).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. A null key is never held out. No rows: no rows."""
    model = train(docs, labels, key=key, text=text)
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    scored = score_documents(slim, model, "doc_id", "text")
    doc = F.col("row.doc_id")
    return scored.select(doc.alias("doc_id"), F.coalesce(fold(doc) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with their columns."""
    scored = score_documents(docs, train(docs, labels))
    return scored.filter(F.col("score") >= threshold).select("row.*")
