"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND.

Every passage of every document is a query.  Items of like length (up to the same power of two words) are
searched together, in windows of twice that length and steps of it, so that a copied item lies whole in
one window and no item widens the passages of others.  Counts of documents, mean length and inverse
document frequencies are those of all items, however many indexes they are dealt over.  Impacts are divided by what an item scores on
itself; a window retrieves all items of at least ``RETRIEVE`` of that.  A window whose rare words
cannot add up to that is skipped before the search: an item's rarest terms that carry ``ESSENTIAL`` of
its own score must give at least ``RETRIEVE - (1 - ESSENTIAL)``.  Retrieved items are verified by the
shares of five-word shingles and of the words of their question and answer.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.store import Store
from quarry.llm.words import LETTERS_DIGITS, byte_runs, row_chunks, shingles, text_buffer

K1, B = 1.2, 0.75
RETRIEVE, ESSENTIAL = 0.5, 0.75
SHINGLE, OVERLAP = 5, 0.75
#: The answer is the last part of an item's words; its least share of words in a passage.
ANSWER_SHARE, ANSWER_OVERLAP = 1 / 3, 0.5
#: Postings of a block with a maximum of its own.
BLOCK = 32
#: Items that are indexed and broadcast at once; further items make further indexes of the same statistics.
ITEMS_AT_ONCE = 50_000


class Statistics:
    """What BM25 knows of all items: their number, mean length in words, and in how many each word is."""

    def __init__(self, items: int, mean: float, words: np.ndarray, counts: np.ndarray) -> None:
        self.items, self.mean = items, max(mean, 1.0)
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]

    @classmethod
    def of(cls, texts: list[str | None]) -> Statistics:
        buf, off = text_buffer(pa.array(texts, pa.string()))
        _, _, words, rows = byte_runs(buf, off, LETTERS_DIGITS)
        found, counts = _document_counts(words, rows)
        full = int((np.diff(rows) > 0).sum())
        return cls(len(texts), len(words) / max(full, 1), found, counts)

    def idf(self, words: np.ndarray) -> np.ndarray:
        df = self.counts[np.searchsorted(self.words, words)]
        return np.log1p((self.items - df + 0.5) / (df + 0.5))


def _document_counts(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and the number of rows that hold each."""
    distinct = [np.unique(words[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)]
    return np.unique(np.concatenate(distinct) if distinct else words, return_counts=True)


class ItemIndex:
    """Inverted index of items of like length: postings by term in item order, with impacts and block maxima."""

    def __init__(self, ids: list[int], texts: list[str | None], known: Statistics | None = None) -> None:
        known = known or Statistics.of(texts)
        buf, off = text_buffer(pa.array(texts, pa.string()))
        _, _, words, rows = byte_runs(buf, off, LETTERS_DIGITS)
        self.ids = np.array(ids, np.int64)
        sizes = np.diff(rows)
        self.step = 1 << int(max(sizes.max() if len(sizes) else 1, 1) - 1).bit_length()
        item = np.repeat(np.arange(len(ids)), sizes)
        self.vocabulary, term = np.unique(words, return_inverse=True)
        pair, tf = np.unique(term.astype(np.int64) * max(len(ids), 1) + item, return_counts=True)
        term, item = pair // max(len(ids), 1), pair % max(len(ids), 1)
        df = np.bincount(term, minlength=len(self.vocabulary))
        idf = known.idf(self.vocabulary)
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / known.mean))
        own = np.bincount(item, impact, len(ids))
        self.impact = impact / own[item]
        self.item = item
        self.item_list, self.impact_list = item.tolist(), self.impact.tolist()
        self.bounds = np.concatenate([[0], np.cumsum(df)])
        self.most = np.maximum.reduceat(self.impact, self.bounds[:-1]) if len(term) else np.zeros(0)
        # the rarest terms of each item up to ESSENTIAL of its score, as postings of their own
        order = np.lexsort((self.vocabulary[term], -self.impact, -idf[term], item))
        run = np.cumsum(self.impact[order])
        first = np.concatenate([[0], np.cumsum(np.bincount(item, minlength=len(ids)))])[:-1]
        before = run - self.impact[order] - np.concatenate([[0], run])[first[item[order]]]
        essential = np.zeros(len(term), bool)
        essential[order] = before < ESSENTIAL
        self.rare_item, self.rare_impact = item[essential], self.impact[essential]
        self.rare_bounds = np.concatenate([[0], np.cumsum(np.bincount(term[essential], minlength=len(self.vocabulary)))])
        self.block_most = [[float(self.impact[i : min(i + BLOCK, b)].max()) for i in range(a, b, BLOCK)] for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)]
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        grams, goff = shingles(words, rows, SHINGLE)
        self.shingles = [np.unique(grams[a:b]) for a, b in zip(goff[:-1], goff[1:], strict=True)]
        cut = rows[1:] - np.ceil(sizes * ANSWER_SHARE).astype(np.int64)
        self.question = [np.unique(words[a:b]) for a, b in zip(rows[:-1], cut, strict=True)]
        self.answer = [np.unique(words[a:b]) for a, b in zip(cut, rows[1:], strict=True)]

    def terms(self, words: np.ndarray) -> np.ndarray:
        """Term numbers of words, -1 for words that no item has."""
        out = np.full(len(words), -1, np.int64)
        maybe = np.flatnonzero(self.filter[(words >> np.uint64(48)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.vocabulary, words[maybe]), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == words[maybe]
            out[maybe[hit]] = at[hit]
        return out

    def search(self, terms: np.ndarray, least: float = RETRIEVE) -> list[tuple[int, float]]:
        """All items of a score of at least ``least`` for a query of distinct terms (block-max WAND)."""
        bounds, item, impact, most, block_most = self.bounds, self.item_list, self.impact_list, self.most, self.block_most
        ends = [int(bounds[t + 1]) for t in terms]
        begin = [int(bounds[t]) for t in terms]
        place = begin.copy()
        current = [item[p] for p in place]
        top = [float(most[t]) for t in terms]
        slack = least - 1e-9
        live = list(range(len(terms)))
        found: list[tuple[int, float]] = []

        def advance(k: int, to: int) -> bool:
            """Move list k to its first posting of an item >= to; False at its end."""
            place[k] = bisect_left(item, to, place[k], ends[k])
            if place[k] >= ends[k]:
                return False
            current[k] = item[place[k]]
            return True

        while live:
            live.sort(key=current.__getitem__)
            total, pivot = 0.0, -1
            for i, k in enumerate(live):
                total += top[k]
                if total >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            target = current[live[pivot]]
            while pivot + 1 < len(live) and current[live[pivot + 1]] == target:
                pivot += 1
            # the maxima of the blocks that would hold the pivot item
            total, until = 0.0, len(self.ids)
            for k in live[: pivot + 1]:
                p = bisect_left(item, target, place[k], ends[k])
                if p < ends[k]:
                    b = (p - begin[k]) // BLOCK
                    total += block_most[terms[k]][b]
                    last = min(begin[k] + (b + 1) * BLOCK, ends[k])
                    until = min(until, item[last - 1] + 1)
            if total < slack:
                to = max(target + 1, until)
                if pivot + 1 < len(live):
                    to = min(to, max(current[live[pivot + 1]], target + 1))
                live = [k for i, k in enumerate(live) if i > pivot or advance(k, to)]
                continue
            if current[live[0]] == target:
                score = sum(impact[place[k]] for k in live[: pivot + 1])
                if score >= slack:
                    found.append((target, score))
                live = [k for i, k in enumerate(live) if i > pivot or advance(k, target + 1)]
            else:
                live = [k for i, k in enumerate(live) if i > pivot or current[k] == target or advance(k, target)]
        return found

    def verified(self, i: int, words: np.ndarray, grams: np.ndarray) -> tuple[float, float, float]:
        """Shares of an item's shingles, question words and answer words in a passage (sorted sets)."""

        def share(own: np.ndarray, there: np.ndarray) -> float:
            return len(np.intersect1d(own, there, assume_unique=True)) / len(own) if len(own) else 1.0

        return share(self.shingles[i], grams), share(self.question[i], words), share(self.answer[i], words)

    def _candidates(self, term: np.ndarray, cell: np.ndarray, cell_row: np.ndarray) -> np.ndarray:
        """Cells that with the next cell of their row may reach an item, by its rarest terms in either."""
        at = np.flatnonzero(term >= 0)
        n = np.diff(self.rare_bounds)[term[at]]
        place = np.repeat(self.rare_bounds[term[at]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pair, inverse = np.unique(np.repeat(cell[at], n) * len(self.ids) + self.rare_item[place], return_inverse=True)
        if not len(pair):
            return pair
        total = np.bincount(inverse, self.rare_impact[place], len(pair))
        # what the next cell adds for the same item
        after = np.minimum(np.searchsorted(pair, pair + len(self.ids)), len(pair) - 1)
        same = (pair[after] == pair + len(self.ids)) & (cell_row[pair[after] // len(self.ids)] == cell_row[pair // len(self.ids)])
        reach = total + np.where(same, total[after], 0)
        least = RETRIEVE - (1 - ESSENTIAL) - 1e-9
        # an item whose rare words all lie in one cell may begin in the cell before
        alone = pair[total >= least] // len(self.ids)
        alone = alone[alone > 0]
        before = alone[cell_row[alone - 1] == cell_row[alone]] - 1
        return np.unique(np.concatenate([pair[reach >= least] // len(self.ids), before]))

    def held(self, words: np.ndarray, rows: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float, float]]:
        """The three shares and the score of every item (row, item number) that rows of words hold; the
        passage of the largest shares speaks for a row."""
        step, best = self.step, {}
        term = self.terms(words) if len(self.vocabulary) else np.full(len(words), -1)
        cells = -(-np.diff(rows) // step)
        first_cell = np.concatenate([[0], np.cumsum(cells)])
        cell_row = np.repeat(np.arange(len(rows) - 1), cells)
        start = rows[cell_row] + (np.arange(len(cell_row)) - first_cell[cell_row]) * step
        end = np.minimum(start + 2 * step, rows[cell_row + 1])
        for w in self._candidates(term, np.searchsorted(start, np.arange(len(words)), "right") - 1, cell_row):
            window = words[start[w] : end[w]]
            own = term[start[w] : end[w]]
            retrieved = self.search(np.unique(own[own >= 0]))
            if not retrieved:
                continue
            seen, grams = np.unique(window), np.unique(shingles(window, np.array([0, len(window)]), SHINGLE)[0])
            for i, score in retrieved:
                shares = self.verified(i, seen, grams)
                if shares[0] >= OVERLAP and shares[1] >= OVERLAP and shares[2] >= ANSWER_OVERLAP:
                    key = (int(cell_row[w]), i)
                    best[key] = max(best.get(key, (0.0, 0.0, 0.0, 0.0)), (*shares, score))
        return best


class ItemIndexes:
    """Indexes of a block of items, one for each class of lengths."""

    def __init__(self, ids: list[int], texts: list[str], known: Statistics | None = None) -> None:
        known = known or Statistics.of(texts)
        buf, off = text_buffer(pa.array(texts, pa.string()))
        sizes = np.diff(byte_runs(buf, off, LETTERS_DIGITS)[3])
        kind = np.array([max(int(n) - 1, 0).bit_length() for n in sizes])
        self.indexes = []
        for k in np.unique(kind[sizes > 0]):
            own = np.flatnonzero((kind == k) & (sizes > 0))
            self.indexes.append(ItemIndex([ids[i] for i in own], [texts[i] for i in own], known))

    def leaks(self, column: pa.Array) -> Iterator[tuple[int, int, float, float, float, float]]:
        """Row, item id, score and the three shares of every item that a row holds."""
        buf, off = text_buffer(column)
        for a, b in row_chunks(off):
            _, _, words, rows = byte_runs(buf[off[a] : off[b]], off[a : b + 1] - off[a], LETTERS_DIGITS)
            found = [(a + r, int(index.ids[i]), score, s, q, x) for index in self.indexes for (r, i), (s, q, x, score) in index.held(words, rows).items()]
            yield from sorted(found)


def _indexes(items: DataFrame, id_col: str, text_col: str) -> Iterator[ItemIndexes]:
    """Indexes of all items with an id and words, a block of about ``ITEMS_AT_ONCE`` at a time.

    The driver holds one block; statistics are gathered over all items first, and a block is given the
    counts of its own words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            buf, off = text_buffer(batch.column(1))
            _, _, words, rows = byte_runs(buf, off, LETTERS_DIGITS)
            sizes = np.diff(rows)
            for k in np.unique(block):
                # of each block: its words, and under no word its items, those of them with words, and all their words
                own = np.flatnonzero(block == k)
                found, counts = _document_counts(np.concatenate([words[rows[i] : rows[i + 1]] for i in own]), np.concatenate([[0], np.cumsum(sizes[own])]))
                n = len(found) + 1
                totals = ([0] * (n - 1) + [int(x)] for x in (len(own), (sizes[own] > 0).sum(), sizes[own].sum()))
                yield pa.record_batch([pa.array(np.full(n, k, np.int32)), pa.array([*found.view(np.int64).tolist(), None], pa.int64()), pa.array([*counts.tolist(), 0], pa.int64()), *(pa.array(x, pa.int64()) for x in totals)], ["block", "word", "n", "items", "full", "words"])

    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").distinct()
    blocks = max(1, -(-rows.count() // ITEMS_AT_ONCE))
    store = Store(items.sparkSession, "items")
    rows = store.put(rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")), "items")
    counted = store.put(rows.select("block", "text").mapInArrow(count, "block int, word long, n long, items long, full long, words long"), "counts")
    totals = counted.agg(*(F.sum(c) for c in ("items", "full", "words"))).first()
    if not totals[0]:
        return
    of_word = store.put(counted.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "words")
    for k in range(blocks):
        own = of_word.join(counted.where(F.col("block") == k).select("word"), "word", "left_semi").toArrow()
        known = Statistics(totals[0], totals[2] / max(totals[1], 1), own.column("word").to_numpy().view(np.uint64), own.column("n").to_numpy())
        block = rows.where(F.col("block") == k).orderBy("id", "text").toArrow()
        yield ItemIndexes(block.column("id").to_pylist(), block.column("text").to_pylist(), known)


def benchmark_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and a test item that it holds: ``score``, ``overlap``, ``question_overlap``,
    ``answer_overlap``.

    Null and empty texts hold nothing and null or empty items are in no document; items and texts of
    any length are read whole; repeated documents give repeated pairs and repeated items one; empty
    tables give no rows; other columns are ignored.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text"))
    for index in _indexes(items, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(shared.value.leaks(batch.column(1)))
                at, item, score, s, q, x = (list(c) for c in zip(*found, strict=True)) if found else ([],) * 6
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), *(pa.array(c, pa.float64()) for c in (score, s, q, x))]
                yield pa.record_batch(columns, [id_col, item_id_col, "score", "overlap", "question_overlap", "answer_overlap"])

        part = rows.mapInArrow(search, f"{id_col} long, {item_id_col} long, score double, overlap double, question_overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"{id_col} long, {item_id_col} long, score double, overlap double, question_overlap double, answer_overlap double")


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Documents that hold no test item, with all their columns.

    Null and empty texts hold nothing and stay; null, empty and wordless items are in no document; items
    and texts of any length are read whole; repeated documents stay or go alike; without documents there
    are no rows, without items all of them; columns of any name are carried along.
    """
    at = docs.columns.index(text_col)
    schema = StructType(docs.schema.fields)
    for index in _indexes(items, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                clean[[r for r, *_ in shared.value.leaks(batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, schema)
    return docs
