"""The engine's facade: the verbs of search, context, curation and lifecycle over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import in_scope, population_scope
from quarry.functions.text import excerpt
from quarry.operators import context, dense, fusion, lexical, lifecycle
from quarry.operators.word_index import WordIndex

LANES = ("auto", "words", "substring", "dense")
HISTORY_WEIGHT, CURATED_WEIGHT = 0.5, 0.3


@dataclass
class Engine:
    """Records (record_id, role, text, workspace, authored_at) and, if there are any, their vectors
    (record_id, vector)."""

    records: DataFrame
    vectors: DataFrame | None = None
    #: A persisted index of the records' texts; without one, the word lane scans them.
    index: WordIndex | None = None

    def _words(self, rows: DataFrame, query: str, depth: int, all_rows: bool) -> DataFrame:
        """The word lane over some rows: record_id, lane_pass, score."""
        checked = lexical.verified(rows, "text", query)
        if self.index is None:
            return lexical.search_words(checked, "record_id", "text", query, depth)
        eligible = None if all_rows and checked is rows else checked.select(F.col("record_id").alias("id"))
        return self.index.search(lexical.query_terms(query), depth, eligible).withColumnRenamed("id", "record_id")

    def _scoped(self, scope: str | None) -> DataFrame:
        return self.records if scope is None else self.records.where(in_scope(F.col("workspace"), scope))

    def search(self, query: str, lane: str = "auto", limit: int = 10, scope: str | None = None, vector: list[float] | None = None) -> DataFrame:
        """The best records for a query: record_id, score."""
        _check(query, limit, 1000, lane)
        rows = self._scoped(scope)
        if lane == "substring":
            return lexical.search_substring(rows, "record_id", "text", query, limit).select("record_id", "score")
        depth = max(limit, fusion.DEPTH)
        words = self._words(rows, query, depth, scope is None)
        if lane == "words" or self.vectors is None or vector is None:
            if lane == "dense":
                raise ValueError("the dense lane needs vectors and a query vector")
            return words.orderBy("lane_pass", F.desc("score"), "record_id").limit(limit).select("record_id", "score")
        own = self.vectors.join(rows.select("record_id"), "record_id", "left_semi")
        near = dense.dense_topk(own, vector, "record_id", "vector", depth)
        if lane == "dense":
            return near.limit(limit)
        return fusion.adaptive(words, near, "record_id", limit).select("record_id", "score")

    def _population(self, name: str, query: str, scope: str | None, depth: int, weight: float, lane: str, vector: list[float] | None) -> DataFrame:
        """Ranked rows of one population: population, id, rank.  The two lanes are fused by the population's
        own weight; one lane alone answers where the other has nothing."""
        rows = self.records.where(population_scope(F.col("role"), F.col("workspace"), name, scope))
        if lane == "substring":
            hits = lexical.search_substring(rows, "record_id", "text", query, depth)
        else:
            words = self._words(rows, query, max(depth, fusion.DEPTH), False)
            if lane == "words" or self.vectors is None or vector is None:
                # rows with all words come first: their lane is worth more than any score
                hits = words.select("record_id", (F.col("score") - 1e6 * F.col("lane_pass")).alias("score"))
            else:
                own = self.vectors.join(rows.select("record_id"), "record_id", "left_semi")
                hits = fusion.adaptive(words, dense.dense_topk(own, vector, "record_id", "vector", max(depth, fusion.DEPTH)), "record_id", depth, weight)
        return fusion.ranked(hits, "record_id", depth=depth).select(F.lit("history" if name == "history" else "note").alias("population"), F.col("record_id").alias("id"), "rank")

    def context(
        self,
        query: str,
        scope: str | None = None,
        limit: int = 8,
        max_chars: int = 16_000,
        vector: list[float] | None = None,
        retirements: list[tuple[list[str], str]] = (),
        lane: str = "auto",
        links: DataFrame | None = None,
        supersessions: DataFrame | None = None,
        hosts: DataFrame | None = None,
        reranker: Callable[[Column, str], Column] | None = None,
        rerank_budget: int = 64,
    ) -> DataFrame:
        """Evidence for a question from history and notes: distinct texts, current before outdated before
        superseded, cut to a fair budget.

        links: parent, id, ordinal; supersessions: id, superseded_by, at; hosts: id, hosts; reranker: a score
        of a text column for the query, given to the head of both populations in turn; its rows are merged by
        score, and without one the populations alternate.  Every note is followed by its links."""
        _check(query, limit, 50, lane)
        if not 1 <= max_chars <= 100_000:
            raise ValueError("max_chars must be 1 to 100000")
        spark, depth = self.records.sparkSession, 4 * limit
        found = self._population("history", query, scope, depth, HISTORY_WEIGHT, lane, vector).unionByName(self._population("curated", query, scope, depth, CURATED_WEIGHT, lane, vector))
        kind = dict(self.records.dtypes)["record_id"]
        if reranker is None:
            ordered = fusion.interleaved(found)
        else:
            texts = self.records.select(F.col("record_id").alias("id"), "text")
            judged = fusion.scored_within(found, F.lit(0.0), rerank_budget).drop("score").join(texts, "id").withColumn("score", reranker(F.col("text"), query)).drop("text")
            ordered = fusion.merged(judged)
        links = links if links is not None else spark.createDataFrame([], f"parent {kind}, id {kind}, ordinal int")
        supersessions = supersessions if supersessions is not None else spark.createDataFrame([], f"id {kind}, superseded_by {kind}, at string")
        hosts = hosts if hosts is not None else spark.createDataFrame([], f"id {kind}, hosts array<string>")
        hops = links.join(found.where("population = 'note' AND rank <= %d" % limit).select(F.col("id").alias("parent")), "parent", "left_semi")
        placed = fusion.with_links(ordered.select("population", "id", "position"), hops)
        rows = self.records.where("role <> 'source'").withColumnRenamed("record_id", "id").join(F.broadcast(placed), "id")  # at most an answer's candidates
        if not context.query_names(query, list(retirements)):
            rows = context.outdated(rows, "text", "authored_at", list(retirements))
        else:
            rows = rows.withColumn("outdated", F.lit(False))
        rows = rows.join(supersessions.select("id").distinct().withColumn("superseded", F.lit(True)), "id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))
        current = context.demoted(rows, "place", "superseded").withColumnRenamed("new_position", "position").drop("place")
        chosen = context.selected(current, "text", limit, max_chars).withColumn("size", F.length("text"))
        given = context.fair_budget(chosen, "place", "size", max_chars)
        cut = given.withColumn("excerpt", F.when(F.col("given") >= F.col("size"), F.col("text")).otherwise(excerpt(F.col("text"), F.lit(query), F.col("given").cast("int"))))
        marked = context.annotated(context.rendered(cut, "excerpt", "text"), supersessions, hosts)
        return marked.select(
            F.col("id").alias("record_id"), "role", "authored_at", "excerpt", "trust", "date_status", "outdated", "truncated", F.col("population").alias("via"), "parent", "superseded_by", "superseded_at", "hosts", F.col("place").alias("position")
        ).orderBy("position")

    def recall(self, scope: str | None = None, limit: int = 12) -> DataFrame:
        """The newest records of a scope that fit into a snapshot."""
        top = context.recent(self._scoped(scope), [F.desc("authored_at"), F.col("record_id")], limit)
        return context.within_budget(top.withColumn("size", F.length("text")), "position", "size")

    def file_context(self, path: str, limit: int = 3, supersessions: DataFrame | None = None) -> DataFrame:
        """The newest records that name a file, with what replaced them; nothing for a generic name at the
        root."""
        name = lexical.file_phrase(path)
        if name is None:
            return context.recent(self.records.limit(0), [F.desc("authored_at"), F.col("record_id")], limit)
        hits = lexical.search_phrase(self.records, "record_id", "text", name).select("record_id")
        rows = context.recent(self.records.join(hits, "record_id", "left_semi"), [F.desc("authored_at"), F.col("record_id")], limit)
        if supersessions is None:
            return rows
        return rows.join(supersessions.select(F.col("id").alias("record_id"), "superseded_by", F.col("at").alias("superseded_at")), "record_id", "left")

    def remember(self, payloads: DataFrame) -> tuple[Engine, DataFrame]:
        """The engine with new records (without an index, which knows the old ones alone), and each payload's outcome.  Payloads have the columns of records and
        ``supersedes``; one that replaces what does not exist is refused as a whole."""
        outcome = lifecycle.remembered(self.records, payloads)
        kept = outcome.where("outcome = 'remembered'").select(self.records.columns)
        return Engine(self.records.unionByName(kept), self.vectors), outcome.select("record_id", "outcome", "missing")

    def excerpts(self, query: str, budget: int = 300) -> DataFrame:
        return self.records.select("record_id", excerpt(F.col("text"), F.lit(query), budget).alias("excerpt"))


def _check(query: str, limit: int, most: int, lane: str) -> None:
    if not query.strip():
        raise ValueError("the query is blank")
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be 1 to {most}")
    if lane not in LANES:
        raise ValueError(f"unknown lane {lane!r}")
