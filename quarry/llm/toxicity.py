"""Toxicity: class-conditional Kneser-Ney models compared by length-normalised log-likelihood.

Two models spell words (``kneser_ney``), one from toxic and one from ordinary documents.  A document's
evidence is the log-likelihood ratio per symbol of the whole text and of its most toxic word and
four-word expression, plus the total of what single words give beyond a margin; a logistic fit on
labelled documents that the counts did not see turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.llm.cache import HashCache, held
from quarry.llm.kneser_ney import ClassModels, spelt
from quarry.llm.store import Store
from quarry.llm.words import LETTERS, byte_runs, row_chunks, text_buffer

#: Labelled rows that are learnt from at most: a hashed sample of them beyond that.
MAX_TRAIN = 200_000
#: N-grams that the driver fetches at once; the models keep all of them.
GRAMS_AT_ONCE = 1 << 21
THRESHOLD = 0.3
EXPRESSION = 4
_MARGIN = 3.0
_CHUNK = 1 << 20


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, modulus: int, held_out: int, most: int) -> DataFrame:
    """At most about ``most`` labelled ids outside the held-out fold, as ``lid``, ``label``, ``fold``.
    An id with several labels takes the largest; null ids and labels are ignored."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("lid")).agg(F.max(F.col(label_col)).cast("int").alias("label"))
    rows = rows.withColumn("fold", F.pmod(F.crc32(F.col("lid").cast("string")), F.lit(modulus)).cast("int")).where(F.col("fold") != held_out)
    found = rows.count()
    if found > most:
        rows = rows.where(F.pmod(F.xxhash64("lid"), F.lit(1_000_000)) < int(1_000_000 * 0.98 * most / found))
    return rows


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts by class of a partition's documents (columns: label, text)."""
    counts_of: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64)

    for batch in batches:
        label = batch.column(0).to_numpy()
        buf, off = text_buffer(batch.column(1))
        for a, b in row_chunks(off, _CHUNK):
            part, at = buf[off[a] : off[b]], off[a : b + 1] - off[a]
            starts, ends, hashes, rows = byte_runs(part, at, LETTERS)
            which = np.repeat(label[a:b], np.diff(rows))
            for k in (0, 1):
                own = np.flatnonzero(which == k)
                if len(own):
                    _, first, times = np.unique(hashes[own], return_index=True, return_counts=True)
                    keys, koff = spelt(part, starts[own[first]], ends[own[first]])
                    grams, inverse = np.unique(keys, return_inverse=True)
                    counts_of[k].append((grams, np.bincount(inverse, np.repeat(times, np.diff(koff))).astype(np.int64)))
                    if len(counts_of[k]) > 16:
                        counts_of[k] = [merged(counts_of[k])]
    for k, parts in counts_of.items():
        if parts:
            keys, counts = merged(parts)
            yield pa.record_batch([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], ["label", "gram", "n"])


def features(models: ClassModels, column: pa.Array, cache: HashCache) -> np.ndarray:
    """Four features per row; a text without letters has zeros."""
    buf, off = text_buffer(column)
    out = np.zeros((len(column), 4))
    for a, b in row_chunks(off, _CHUNK):
        part, at = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        starts, ends, hashes, rows = byte_runs(part, at, LETTERS)
        if not len(starts):
            continue
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)

        def spell(missing: np.ndarray, part=part, starts=starts, ends=ends, first=first) -> np.ndarray:
            keys, koff = spelt(part, starts[first[missing]], ends[first[missing]])
            grams, back = np.unique(keys, return_inverse=True)
            sums = np.concatenate([[0], np.cumsum(models.ratio(grams)[back])])
            return sums[koff[1:]] - sums[koff[:-1]]

        word = cache.get(unique, spell)[:, 0][inverse]
        size = ends - starts + 1
        total, length = np.concatenate([[0], np.cumsum(word)]), np.concatenate([[0], np.cumsum(size)])
        beyond = np.concatenate([[0], np.cumsum(np.maximum(word - _MARGIN, 0))])
        row = np.repeat(np.arange(b - a), np.diff(rows))
        last = np.minimum(np.arange(len(word)) + EXPRESSION, rows[1:][row])
        spans = (total[last] - total[:-1]) / (length[last] - length[:-1])
        full = np.flatnonzero(np.diff(rows))
        out[a + full, 0] = ((total[rows[1:]] - total[rows[:-1]]) / np.maximum(length[rows[1:]] - length[rows[:-1]], 1))[full]
        out[a + full, 1] = np.maximum.reduceat(word / size, rows[:-1][full])
        out[a + full, 2] = np.maximum.reduceat(spans, rows[:-1][full])
        out[a : b, 3] = np.log1p(np.maximum(beyond[rows[1:]] - beyond[rows[:-1]], 0))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by damped Newton steps: weights with the constant last, means, scales."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step * min(1, 2 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w, mean, scale


class ToxicityModel:
    """Models on the executors and the calibration."""

    def __init__(self, spark, models: ClassModels, weights: tuple[np.ndarray, np.ndarray, np.ndarray], name: str) -> None:
        self.models = spark.sparkContext.broadcast(models)
        self.weights, self.name = weights, name

    def features(self, column: pa.Array) -> np.ndarray:
        return features(self.models.value, column, held(self.name, lambda: HashCache(np.float64)))

    def score(self, column: pa.Array) -> np.ndarray:
        w, mean, scale = self.weights
        z = (self.features(column) - mean) / scale @ w[:-1] + w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 4, held_out: int = 2, max_train: int = MAX_TRAIN) -> ToxicityModel:
    """Learn from labelled documents outside the held-out fold (crc32 of the id as text, modulo).

    Counts come from two thirds of the folds that are left, the calibration from the rest.  Null ids and
    labels teach nothing, null and empty texts are documents without evidence, of several labels of one id
    the largest counts and repeated rows count each.  Where the calibration lacks a class, ten documents
    without evidence, one of them toxic, join it: without any labels every score is about 0.1.  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    store = Store(spark, "toxicity")
    sample = store.put(labelled_sample(labels, id_col, label_col, modulus, held_out, max_train), "sample")
    calibrating = (held_out + 1) % modulus
    text = docs.select(F.col(id_col).cast("long").alias("lid"), F.col(text_col).alias("text"))
    joined = text.join(F.broadcast(sample), "lid")  # at most max_train rows of two numbers
    counted = joined.where(F.col("fold") != calibrating).select("label", "text").mapInArrow(_count, "label int, gram long, n long")
    grams = store.put(counted.groupBy("label", "gram").agg(F.sum("n").alias("n")), "grams")
    tables = []
    for k in (0, 1):
        own = grams.where(F.col("label") == k).select("gram", "n")
        slices = max(1, -(-own.count() // GRAMS_AT_ONCE))
        parts = [own.where(F.pmod(F.xxhash64("gram"), F.lit(slices)) == i).toArrow() for i in range(slices)]
        keys, n = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("gram", "n"))
        del parts
        keys = keys.view(np.uint64)
        order = np.argsort(keys)
        tables.append((keys[order], n[order]))
    models = ClassModels(tables)
    model = ToxicityModel(spark, models, (np.zeros(5), np.zeros(4), np.ones(4)), store.root)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.features(batch.column(1))
            yield pa.record_batch([batch.column(0), *(pa.array(found[:, i]) for i in range(4))], ["label", "f0", "f1", "f2", "f3"])

    seen = joined.where(F.col("fold") == calibrating).select("label", "text").mapInArrow(measure, "label int, f0 double, f1 double, f2 double, f3 double").toArrow()
    x, y = np.stack([seen.column(f"f{i}").to_numpy() for i in range(4)], 1), seen.column("label").to_numpy()
    order = np.lexsort(np.c_[x, y].T)  # sums must not depend on the order in which rows arrive
    x, y = x[order], y[order]
    if not 0 < y.sum() < len(y):  # nothing to tell classes apart by: ten rows without evidence, one of them toxic
        x, y = np.r_[x, np.zeros((10, 4))], np.r_[y, np.zeros(9, int), 1]
    model.weights = logistic(x, y)
    return model


def with_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "toxicity_score") -> DataFrame:
    """All columns of ``docs`` and the probability that each text is toxic.

    Null and empty texts and texts without letters score as a document with no evidence; whole texts
    are read whatever their length; a column already named ``score_col`` is replaced; repeated rows
    score alike; an empty table gives no rows.
    """
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(model.score(batch.column(at)))], [*batch.schema.names, score_col])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))
