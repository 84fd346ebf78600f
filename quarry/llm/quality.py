"""Quality: Bradley-Terry ranking from preference pairs, thresholded by a quantile of the scores.

A document's strength is linear in features of its whole text.  Training pairs a preferred document with
another one and minimises the logistic loss of the difference of their features, so that only relative
quality is learnt; the share of rejected documents among the labelled ones then gives the quantile of
the strengths at which documents are told apart, and that quantile maps to the score ``THRESHOLD``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.llm.store import Store
from quarry.llm.toxicity import labelled_sample
from quarry.llm.words import LETTERS_DIGITS, WORD_BYTES, byte_runs, row_chunks, text_buffer

#: Labelled rows that are learnt from at most, and documents of the other class that each is paired with.
MAX_TRAIN, PARTNERS = 200_000, 8
#: Pairs whose differences are held at once.
_PAIRS = 1 << 16
THRESHOLD = 0.3
FEATURES = ("upper", "log_upper", "symbols", "log_symbols", "digits", "word_bytes", "log_words", "distinct", "repeats", "line_repeats", "marked_words", "short")
_CHUNK = 1 << 20
_LINE = np.ones(256, bool)
_LINE[10] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = ~LETTERS_DIGITS & WORD_BYTES


def _distinct(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distinct hashes of each row."""
    return np.fromiter((len(np.unique(hashes[a:b])) for a, b in zip(rows[:-1], rows[1:], strict=True)), np.float64, len(rows) - 1)


def text_features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; empty and null texts have none of anything."""
    buf, off = text_buffer(column)
    out = np.zeros((len(column), len(FEATURES)))
    for a, b in row_chunks(off, _CHUNK):
        part, at = buf[off[a] : off[b]], off[a : b + 1] - off[a]

        def share(table: np.ndarray, part=part, at=at) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(table[part], dtype=np.int64)])
            return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)

        starts, ends, words, rows = byte_runs(part, at, WORD_BYTES)
        n = np.maximum(np.diff(rows), 1)
        same = np.zeros(len(words) + 1, np.int64)
        if len(words) > 1:
            same[2:] = np.cumsum(words[1:] == words[:-1])
        first = np.minimum(rows[:-1] + 1, rows[1:])
        _, _, lines, line_rows = byte_runs(part, at, _LINE)
        n_lines = np.maximum(np.diff(line_rows), 1)
        marked = np.concatenate([[0], np.cumsum(_SYMBOL[part[ends - 1]] & _SYMBOL[part[np.maximum(ends - 2, 0)]], dtype=np.int64)])
        upper, symbols = share(_UPPER), share(_SYMBOL)
        out[a:b] = np.stack(
            [
                upper,
                np.log(upper + 0.005),
                symbols,
                np.log(symbols + 0.005),
                share(_DIGIT),
                np.minimum(np.diff(at) / n, 40),
                np.log1p(np.diff(rows)),
                _distinct(words, rows) / n,
                (same[rows[1:]] - same[first]) / n,
                1 - np.maximum(_distinct(lines, line_rows), 1) / n_lines,
                (marked[rows[1:]] - marked[rows[:-1]]) / n,
                np.exp(-np.diff(rows) / 10),
            ],
            1,
        )
    return out


def bradley_terry(x: np.ndarray, preferred: np.ndarray, other: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights w that minimise sum log(1 + exp(-w.(x_i - x_j))) + ridge/2 |w|^2 over pairs (i preferred to j)."""
    w = np.zeros(x.shape[1])
    for _ in range(100):
        slope, bend = ridge * w, ridge * np.eye(len(w))
        for at in range(0, len(preferred), _PAIRS):
            d = x[preferred[at : at + _PAIRS]] - x[other[at : at + _PAIRS]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            slope -= d.T @ p
            bend += (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(bend, slope)
        w -= step * min(1, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


class QualityModel:
    """Strengths and the score that a quantile of them anchors."""

    def __init__(self, x: np.ndarray, y: np.ndarray, partners: int = PARTNERS) -> None:
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
        z = (x - self.mean) / self.scale
        self.weights = np.zeros(len(FEATURES))
        self.cut = 0.0
        if len(good) and len(bad):
            random = np.random.default_rng(7)
            # every labelled document meets as many of the other class, drawn anew for each
            preferred = np.concatenate([np.repeat(good, partners), random.choice(good, partners * len(bad))])
            other = np.concatenate([random.choice(bad, partners * len(good)), np.repeat(bad, partners)])
            self.weights = bradley_terry(z, preferred, other)
            strength = z @ self.weights
            self.cut = float(np.quantile(strength, len(bad) / len(y)))
        elif len(y):
            self.cut = -20.0 if len(good) else 20.0

    def score(self, features: np.ndarray) -> np.ndarray:
        strength = (features - self.mean) / self.scale @ self.weights
        return 1 / (1 + np.exp(-np.clip(strength - self.cut + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 5, held_out: int = 0, max_train: int = MAX_TRAIN) -> QualityModel:
    """Learn from labelled documents outside the held-out fold (crc32 of the id as text, modulo).

    Null ids and labels teach nothing; null and empty texts count as texts without words; of several labels
    of one id the largest counts, and repeated rows count each; with labels of one class alone, or none,
    every score is on that class's side, or at the threshold; other columns are ignored.
    """
    store = Store(docs.sparkSession, "quality")
    sample = store.put(labelled_sample(labels, id_col, label_col, modulus, held_out, max_train), "sample")
    text = docs.select(F.col(id_col).cast("long").alias("lid"), F.col(text_col).alias("text"))
    names = [f"f{i}" for i in range(len(FEATURES))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_features(batch.column(1))
            yield pa.record_batch([batch.column(0), *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(names)))], ["label", *names])

    joined = text.join(F.broadcast(sample), "lid").select("label", "text")  # at most max_train rows of two numbers
    table = joined.mapInArrow(measure, "label int, " + ", ".join(f"{n} double" for n in names)).toArrow()
    x = np.stack([table.column(n).to_numpy() for n in names], 1) if len(table) else np.zeros((0, len(names)))
    y = table.column("label").to_numpy()
    order = np.lexsort(np.c_[x, y].T)  # pairs must not depend on the order in which rows arrive
    return QualityModel(x[order], y[order])


def with_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and the quality score of each text.

    Null and empty texts score as texts without words; whole texts count whatever their length; a
    column already named ``score_col`` is replaced; repeated rows score alike; an empty table gives no
    rows.
    """
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(model.score(text_features(batch.column(at))))], [*batch.schema.names, score_col])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))
