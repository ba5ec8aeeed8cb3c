"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), in time linear in the features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm import common

WORD_BUCKETS = 1 << 15
BINS = 16  # of each statistic
LABELLED_ROWS = 12_000  # rows the model is fitted on, about
FACTORS = 8
EPOCHS = 12
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STATS = ("words", "word_length", "upper", "digits", "signs", "distinct", "lines", "repeated_lines", "line_length", "chars", "ends", "top_word")
FEATURES = WORD_BUCKETS + BINS * len(_STATS)
_ENDS = re.compile(rb"[.!?:;\"')\]]\s*$")


def _statistics(text: bytes, n_words: int, distinct: int, top: int) -> list[float]:
    """Each as a number from 0 to 1."""
    byte = np.frombuffer(text, np.uint8)
    size = max(1, len(byte))
    counts = np.bincount(byte, minlength=256)
    blank = int(counts[9:14].sum() + counts[32])
    letters = int(counts[_LETTER].sum())
    upper, digits = int(counts[65:91].sum()), int(counts[48:58].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    log = lambda x, most: min(1.0, np.log1p(x) / np.log1p(most))
    return [
        log(n_words, 20_000),
        min(1.0, (size - blank) / max(1, n_words) / 16),
        upper / max(1, letters),
        min(1.0, 4 * digits / size),
        min(1.0, 3 * (size - blank - letters - digits) / size),
        distinct / max(1, n_words),
        log(len(lines), 2_000),
        1 - len(set(lines)) / max(1, len(lines)),
        log(n_words / max(1, len(lines)), 2_000),
        log(len(text), 200_000),
        sum(1 for x in lines if _ENDS.search(x)) / max(1, len(lines)),
        top / max(1, n_words),
    ]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the features: words with unit length together, and one bin of each statistic."""
    rows, columns, values = [], [], []
    for lo, hi in common.text_slices(texts):
        words = common.Words(texts[lo:hi], lower=True)
        doc = np.repeat(np.arange(hi - lo), words.counts())
        pair, n = np.unique(doc * WORD_BUCKETS + (words.hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), return_counts=True)
        row, column = pair // WORD_BUCKETS, pair % WORD_BUCKETS
        length = np.sqrt(np.bincount(row, n.astype(float) ** 2, minlength=hi - lo))
        distinct = np.bincount(row, minlength=hi - lo)
        top = np.zeros(hi - lo, np.int64)
        np.maximum.at(top, row, n)
        rows.append(row + lo)
        columns.append(column)
        values.append(n / np.maximum(length, 1e-9)[row])
        counts = words.counts()
        stats = np.array([_statistics(t, int(counts[i]), int(distinct[i]), int(top[i])) for i, t in enumerate(texts[lo:hi])])
        bins = np.minimum((stats * BINS).astype(np.int64), BINS - 1)
        rows.append(np.repeat(np.arange(lo, hi), len(_STATS)))
        columns.append((WORD_BUCKETS + np.arange(len(_STATS)) * BINS + bins).reshape(-1))
        values.append(np.full(bins.size, 0.5))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(values)


class Machine:
    """Weights of a factorisation machine."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def margins(self, n: int, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of n rows, and their sums of weighted factors."""
        linear = np.bincount(rows, self.weights[columns] * values, minlength=n)
        sums, squares = np.zeros((n, self.factors.shape[1])), np.zeros(n)
        for f in range(self.factors.shape[1]):
            part = self.factors[columns, f] * values
            sums[:, f] = np.bincount(rows, part, minlength=n)
            squares += np.bincount(rows, part * part, minlength=n)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums


def fit(labels: np.ndarray, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad on small batches. Without rows of both labels the score is their share, 0.5 with none."""
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    random = np.random.default_rng(seed)
    model = Machine(float(np.log(share / (1 - share))), np.zeros(FEATURES), random.normal(0, 0.02, (FEATURES, FACTORS)))
    if len(set(labels.tolist())) < 2:
        return Machine(model.bias, model.weights, np.zeros((FEATURES, FACTORS)))
    order = np.argsort(rows, kind="stable")
    columns, values = columns[order], values[order]
    first = np.searchsorted(rows[order], np.arange(len(labels) + 1))
    seen_w, seen_v, seen_b = np.full(FEATURES, 1e-6), np.full((FEATURES, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        shuffled = random.permutation(len(labels))
        for lo in range(0, len(labels), 64):
            batch = shuffled[lo : lo + 64]
            sizes = first[batch + 1] - first[batch]
            at = np.repeat(first[batch] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            r, c, x = np.repeat(np.arange(len(batch)), sizes), columns[at], values[at]
            margin, sums = model.margins(len(batch), r, c, x)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[batch]) / len(batch)
            touched, inverse = np.unique(c, return_inverse=True)
            pull = error[r] * x
            slope = np.bincount(inverse, pull, minlength=len(touched)) + 1e-6 * model.weights[touched]
            seen_w[touched] += slope**2
            held = model.factors[c]
            bend = np.empty((len(touched), FACTORS))
            for f in range(FACTORS):
                bend[:, f] = np.bincount(inverse, pull * (sums[r, f] - held[:, f] * x), minlength=len(touched))
            bend += 1e-5 * model.factors[touched]
            seen_v[touched] += bend**2
            model.weights[touched] -= 0.1 * slope / np.sqrt(seen_w[touched])
            model.factors[touched] -= 0.02 * bend / np.sqrt(seen_v[touched])
            seen_b += error.sum() ** 2
            model.bias -= 0.02 * error.sum() / np.sqrt(seen_b)
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Machine:
    """Fit on about rows labelled rows of whole texts, chosen by a hash of doc_id; only their features come to the driver.

    docs: (doc_id, text); labels: (doc_id, quality). Rows that are held out, have no label or no document teach nothing.
    """
    known = labels.filter(F.col("quality").isNotNull() & (common.third() != 1)).select("doc_id", "quality")
    share = rows / max(known.count(), 1)
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20))
    # The sample is bounded by its share, so it can be sent to the documents.
    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            r, c, x = features(common.as_bytes(batch.column("text")))
            order = np.argsort(r, kind="stable")
            ends = np.searchsorted(r[order], np.arange(batch.num_rows + 1))
            c, x = c[order].astype(np.int32), x[order].astype(np.float32)
            cut = [slice(a, b) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("quality").cast(pa.int32()),
                    pa.array([c[s].tobytes() for s in cut], pa.binary()),
                    pa.array([x[s].tobytes() for s in cut], pa.binary()),
                ],
                names=["doc_id", "quality", "columns", "values"],
            )

    found = chosen.mapInArrow(work, "doc_id long, quality int, columns binary, values binary").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("quality", "ascending")])  # the fit depends on the order of rows
    columns = [np.frombuffer(b, np.int32) for b in found["columns"].to_pylist()]
    values = [np.frombuffer(b, np.float32) for b in found["values"].to_pylist()]
    rows_ = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    y = np.array([float(q > 0) for q in found["quality"].to_pylist()])
    empty = np.zeros(0)
    return fit(y, rows_, np.concatenate([*columns, empty.astype(np.int32)]), np.concatenate([*values, empty]).astype(float))


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """(doc_id, score, predicted) of every row of (doc_id, text): how likely label 1 is, and whether that is 0.5 or more.

    Only the text is looked at, whole; null reads as empty and is scored by its statistics. Equal texts get equal scores. Rows stay
    where they are.
    """
    common.small_batches(docs.sparkSession)
    held = Machine(model.bias, model.weights.astype(np.float32), model.factors.astype(np.float32))
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for batch in common.sliced(batches, 500):
            margin, _ = machine.margins(batch.num_rows, *features(common.as_bytes(batch.column("text"))))
            likely = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(likely), pa.array((likely >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(work, "doc_id long, score double, predicted int")
