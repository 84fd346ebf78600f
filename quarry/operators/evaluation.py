"""Evaluation of labelled questions: hit rate, reciprocal rank, latency, strata, paired differences."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEPTH = 8
SEED, RESAMPLES = 20261021, 2_000
#: Draws of a resample that a task hashes at once, and in how many lanes.
DRAWS, LANES = 1 << 16, 1 << 13


def measures(rank: str, elapsed: str, depth: int = DEPTH) -> list[Column]:
    hit = F.coalesce(F.col(rank) <= depth, F.lit(False))
    return [
        F.count("*").alias("questions"),
        F.count_if(hit).alias("hits"),
        F.round(F.avg(hit.cast("double")), 6).alias("recall"),
        F.round(F.sum(F.when(hit, 1 / F.col(rank)).otherwise(0.0)) / F.count("*"), 6).alias("mrr"),
        F.round(F.percentile(elapsed, 0.5), 6).alias("p50_ms"),
        F.round(F.percentile(elapsed, 0.95), 6).alias("p95_ms"),
    ]


def summary(results: DataFrame, group: list[str], rank: str = "rank", elapsed: str = "elapsed_ms") -> DataFrame:
    """Measures by group."""
    return results.groupBy(*group).agg(*measures(rank, elapsed))


def strata(results: DataFrame, columns: list[str], rank: str = "rank") -> DataFrame:
    """Hits by each stratum column on its own and over all, in one pass (grouping sets)."""
    hit = F.coalesce(F.col(rank) <= DEPTH, F.lit(False))
    sets = [[F.col(c)] for c in columns] + [[]]
    return results.groupingSets(sets, *columns).agg(F.count("*").alias("questions"), F.count_if(hit).alias("hits"))


def paired_difference(results: DataFrame, key: str, left: str, right: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Mean difference of two systems over the same questions, wins, losses and a bootstrap interval.

    A resample draws as many questions as there are, with replacement.  Only the difference of a drawn
    question counts, so draws (numbers hashed from seed, resample and draw) fall on the questions in the
    order of their differences, of which the few distinct ones with their counts are all that is needed.
    Every number is hashed, in tasks of a range of draws of some resamples that return counts.
    """
    rows = results.select((F.col(left).cast("double") - F.col(right).cast("double")).alias("d")).where("d IS NOT NULL")
    plain = rows.agg(F.count("*").alias("questions"), F.round(F.avg("d"), 6).alias("delta"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"))
    kinds = rows.groupBy("d").agg(F.count("*").alias("n"))
    upto = kinds.select("d", F.sum("n").over(W.orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("upto"))  # one row per distinct difference
    scale = upto.agg(F.sort_array(F.collect_list(F.struct("upto", "d"))).alias("scale"), F.max("upto").alias("n"))
    spark = results.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    step = max(1, -(-resamples // tasks))  # resamples of a row of work
    ranges = scale.where("n > 0").select("scale", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(DRAWS).cast("long"))).alias("first"))
    parts = ranges.select("*", F.explode(F.sequence(F.lit(1), F.lit(resamples), F.lit(step))).alias("b"))
    work = parts.select("n", F.transform("scale", lambda x: x["upto"]).alias("upto"), "first", "b").repartition(tasks, "first", "b")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                resampled = range(row["b"], min(row["b"] + step, resamples + 1))
                edges, last = np.array(row["upto"]), min(row["first"] + DRAWS - 1, row["n"])
                counts = np.array([np.bincount(np.searchsorted(edges, x % row["n"], "right"), minlength=len(edges)) for x in drawn_numbers(seed, resampled, row["first"], last)])
                kind, b = np.meshgrid(np.arange(len(edges)), np.array(resampled))
                yield pa.record_batch([pa.array(b.ravel(), pa.int32()), pa.array(kind.ravel(), pa.int32()), pa.array(counts.ravel(), pa.int64())], ["b", "kind", "drawn"])

    drawn = work.mapInArrow(counted, "b int, kind int, drawn long").groupBy("b", "kind").agg(F.sum("drawn").alias("drawn"))
    of_kind = scale.select("n", F.posexplode("scale").alias("kind", "of")).select("kind", "n", F.col("of.d").alias("d"))
    means = drawn.join(F.broadcast(of_kind), "kind").groupBy("b").agg((F.sum(F.col("drawn") * F.col("d")) / F.first("n")).alias("m"))  # one row per distinct difference
    interval = means.agg(F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"))
    return plain.crossJoin(F.broadcast(interval))  # one row each


#: MD5's turns and constants (RFC 1321).
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def _md5_words(words: list) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of single-block messages, given as sixteen words: arrays, or numbers
    where all messages share them."""
    shape = next(w.shape for w in words if isinstance(w, np.ndarray))
    start = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    a, b, c, d = (np.full(shape, x, np.uint32) for x in start)
    for i in range(64):
        turn, n = divmod(i, 16)
        if turn == 0:
            f, at = d ^ (b & (c ^ d)), n
        elif turn == 1:
            f, at = c ^ (d & (b ^ c)), (5 * n + 1) % 16
        elif turn == 2:
            f, at = b ^ c ^ d, (3 * n + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * n % 16
        f += a
        word = words[at]
        if isinstance(word, np.ndarray):
            f += word
            f += np.uint32(_SINES[i])
        else:
            f += np.uint32((_SINES[i] + word) & 0xFFFFFFFF)
        left = _TURNS[turn][i % 4]
        high = f >> np.uint32(32 - left)
        f <<= np.uint32(left)
        f |= high
        f += b
        a, b, c, d = d, f, b, c
    return a + np.uint32(start[0]), b + np.uint32(start[1])


def drawn_numbers(seed: int, resamples: Iterable[int], first: int, last: int) -> Iterator[np.ndarray]:
    """For each resample the numbers of its draws from ``first`` to ``last``: the leading 48 bits of the MD5
    of ``seed:resample:draw``.  The words of the draws' digits are made once for all resamples of one length."""
    spans = [(max(first, 10 ** (k - 1)), min(last, 10**k - 1), k) for k in range(len(str(first)), len(str(last)) + 1)]
    made: dict[tuple[int, int, int], list] = {}
    for b in resamples:
        head = f"{seed}:{b}:".encode()
        out = []
        for low, high, digits in spans:
            for begin in range(low, high + 1, LANES):
                end, size = min(begin + LANES, high + 1), len(head) + digits
                if size > 55:
                    raise ValueError("a message of more than one block")
                if (begin, end, len(head)) not in made:
                    text = np.zeros((end - begin, 64), np.uint8)
                    rest = np.arange(begin, end)
                    for place in range(digits):
                        text[:, size - 1 - place] = rest % 10 + 48
                        rest = rest // 10
                    text[:, size] = 128
                    made[begin, end, len(head)] = [np.ascontiguousarray(w) if w.any() else 0 for w in text.view("<u4").T]
                before = np.frombuffer(head.ljust(56, b"\0") + struct.pack("<Q", 8 * size), "<u4")
                words = [w | own if isinstance(w, np.ndarray) else int(w | int(own)) for w, own in zip(made[begin, end, len(head)], before, strict=True)]
                one, two = _md5_words(words)
                out.append((one.byteswap().astype(np.int64) << 16) | (two.byteswap() >> np.uint32(16)))
        yield np.concatenate(out)


def first_hits(questions: DataFrame, answers: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The rank, among an answer's distinct sources, of the first source that a question accepts; null
    beyond ``depth``.

    questions: question, accepted (array of sources); answers: question, position, source."""
    seen = answers.groupBy("question", "source").agg(F.min("position").alias("position"))
    ranked = seen.withColumn("rank", F.row_number().over(W.partitionBy("question").orderBy("position", "source"))).where(F.col("rank") <= depth)
    wanted = questions.select("question", F.explode(F.array_distinct("accepted")).alias("source"))
    hits = ranked.join(wanted, ["question", "source"]).groupBy("question").agg(F.min("rank").alias("rank"))
    return questions.select("question").join(hits, "question", "left")


def outcomes(results: DataFrame, group: list[str], rank: str = "rank", depth: int = DEPTH) -> DataFrame:
    """Questions, those that failed, warnings given, and hits of those that did not fail.  Columns: error
    (null if none), warnings (array)."""
    hit = F.coalesce(F.col(rank) <= depth, F.lit(False)) & F.col("error").isNull()
    return results.groupBy(*group).agg(F.count("*").alias("questions"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.sum(F.size(F.coalesce("warnings", F.array().cast("array<string>")))).cast("long").alias("warnings"), F.count_if(hit).alias("hits"))
