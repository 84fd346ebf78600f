"""Reports over logs and registries: daily totals, gaps, lanes, populations, passes, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import question_key
from quarry.functions.times import exit_state

UNLISTED = 1_000_000


def daily_totals(rows: DataFrame, stamp: str, totals: dict[str, Column]) -> DataFrame:
    """Totals per day of every day from the first to the last, zero where there is nothing."""
    per_day = rows.where(F.col(stamp).isNotNull()).groupBy(F.to_date(stamp).alias("day")).agg(F.count("*").alias("records"), *(c.alias(n) for n, c in totals.items()))
    days = per_day.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(per_day, "day", "left").fillna(0)


def gaps(events: DataFrame, top: int = 25) -> DataFrame:
    """Questions that went without an answer, most asked first.

    Columns: question, asked_at, order (tie key), workspace, best_score (null without a reranked
    answer) and has_evidence.  A question is a gap without evidence or with a negative best score.
    """
    rows = events.where(~F.col("has_evidence") | (F.col("best_score") < 0)).withColumn("key", question_key(F.col("question")))
    spots = rows.where(F.col("workspace").isNotNull()).groupBy("key", "workspace").agg(F.min(F.struct("asked_at", "order")).alias("first"))
    seen = spots.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "workspace"))), lambda s: s["workspace"]).alias("workspaces"))
    asked = rows.groupBy("key").agg(F.count("*").alias("asked"), F.max("asked_at").alias("last_asked"), F.max("best_score").alias("best"))
    return asked.join(seen, "key", "left").orderBy(F.desc("asked"), "last_asked", "key").limit(top)


def served(evidence: DataFrame, id_col: str, top: int = 25) -> DataFrame:
    """Records by how often they were handed out."""
    return evidence.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("times")).orderBy(F.desc("times"), id_col).limit(top)


def lane_usage(events: DataFrame, lanes: list[str], lane: str, entrypoint: str, stamp: str) -> DataFrame:
    """Uses of every known lane, used or not, by entry point, with their first and last time."""
    known = events.sparkSession.createDataFrame([(x,) for x in lanes], f"{lane} string")
    used = events.groupBy(lane).agg(F.count("*").alias("uses"), F.countDistinct(entrypoint).alias("entrypoints"), F.min(stamp).alias("first_used"), F.max(stamp).alias("last_used"))
    rows = F.broadcast(known).join(used, lane, "left").fillna(0, ["uses", "entrypoints"])  # one row per known lane
    return rows.withColumn("coverage", F.when(F.col("uses") == 0, "unused").when(F.col("entrypoints") == 1, "single").otherwise("shared"))


def prioritised(rows: DataFrame, key: str, value: str, priority: list[str], order: str) -> DataFrame:
    """One row per key: that of the value listed first, unlisted values last, the first in order on ties."""
    rank = F.lit(UNLISTED)
    for i, name in reversed(list(enumerate(priority))):
        rank = F.when(F.col(value) == name, i).otherwise(rank)
    best = rows.groupBy(key).agg(F.min(F.struct(rank.alias("rank"), F.col(order).alias("order"), F.col(value).alias("value"))).alias("_best"))
    return best.select(key, F.col("_best.value").alias(value), F.col("_best.order").alias(order))


def populations(records: DataFrame, episode: str, model: str, order: str, priority: list[str], excluded: Column, forgotten: Column) -> DataFrame:
    """Records, episodes, intended, excluded and forgotten episodes of every model."""
    flagged = records.select(F.col(episode).alias("e"), F.coalesce(model, F.lit("unknown")).alias("m"), F.col(order).alias("o"), F.coalesce(excluded, F.lit(False)).alias("x"), F.coalesce(~excluded & forgotten, F.lit(False)).alias("f"))
    # episodes first, so that the distinct counts are sums
    per = flagged.groupBy("m", "e").agg(F.count("*").alias("n"), F.max("x").alias("x"), F.max("f").alias("f"))
    counted = per.groupBy("m").agg(F.sum("n").alias("records"), F.count("*").alias("episodes"), F.count_if("x").alias("excluded"), F.count_if("f").alias("forgotten"))
    chosen = prioritised(flagged.where("NOT x AND NOT f"), "e", "m", priority, "o").groupBy("m").agg(F.count("*").alias("intended"))
    return counted.join(chosen, "m", "left").fillna(0, ["intended"]).withColumn("listed", F.col("m").isin(priority)).withColumnRenamed("m", "model")


def passes(log: DataFrame, lane: str, stamp: str, order: str, kind: str, code: str) -> DataFrame:
    """Passes of each lane from their ``start`` and ``done`` lines: a start that another start follows
    was interrupted, one that nothing follows is running, and a done line without a start is nothing."""
    w = W.partitionBy(lane).orderBy(stamp, order)
    lines = log.where(F.col(kind).isin("start", "done"))
    nexts = lines.withColumns({"_kind": F.lead(kind).over(w), "_at": F.lead(stamp).over(w), "_code": F.lead(code).over(w)})
    state = F.when(F.col("_kind") == "start", "interrupted").when(F.col("_kind") == "done", exit_state(F.col("_code"))).otherwise("running")
    ended = F.when(F.col("_kind") == "done", F.col("_at"))
    return nexts.where(F.col(kind) == "start").select(lane, F.col(stamp).alias("started"), F.col(order), ended.alias("ended"), state.alias("state"))


def unsuccessful_streak(runs: DataFrame, lane: str, started: str, order: str) -> DataFrame:
    """Passes of each lane that failed since its last success; running passes do not count."""
    done = runs.where("state <> 'running'")
    last = done.where("state = 'ok'").groupBy(lane).agg(F.max(F.struct(started, order)).alias("_ok"))
    later = done.join(last, lane, "left").where("_ok IS NULL OR struct({0}, {1}) > _ok".format(started, order))
    streak = later.groupBy(lane).agg(F.count("*").alias("streak"))
    return done.select(lane).distinct().join(streak, lane, "left").fillna(0, ["streak"])


def finding(check: str, measure: DataFrame, value: str, warn: float, broken: float) -> DataFrame:
    """One health finding from a one-row measure: ok, warn or broken by its value."""
    severity = F.when(F.col(value) > broken, "broken").when(F.col(value) > warn, "warn").otherwise("ok")
    return measure.select(F.lit(check).alias("check"), severity.alias("severity"), F.round(F.col(value).cast("double"), 6).alias("value"))


#: Lines of a pass that is running.
DONE_LINE = r"^\s+\[\d+/(\d+)\] \S+ \+(\d+) \(skipped \d+\)$"
FAILED_LINE = r"^\s+\[\d+/(\d+)\] \S+ FAILED: "
WALL_LINE = r"^\s+\[\d+/\d+\] (quota wall|queue full)"


def pass_progress(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Counts of each pass from the lines it has printed, never their texts: the latest total, finished and
    failed conversations, records made, and whether it met a wall."""
    done, failed = F.col(line).rlike(DONE_LINE), F.col(line).rlike(FAILED_LINE)
    number = lambda shape, n: F.regexp_extract(line, shape, n).cast("long")
    total = F.when(done, number(DONE_LINE, 1)).when(failed, number(FAILED_LINE, 1))
    last = F.max(F.when(total.isNotNull(), F.struct(F.col(order).alias("at"), total.alias("total"))))
    return lines.groupBy(key).agg(F.coalesce(last["total"], F.lit(0)).alias("conversations"), F.count_if(done).alias("finished"), F.count_if(failed).alias("failed"), F.coalesce(F.sum(F.when(done, number(DONE_LINE, 2))), F.lit(0)).alias("synthesized"), F.max(F.col(line).rlike(WALL_LINE)).alias("walled"))


def ranked_with_ties(rows: DataFrame, score: str, id_col: str, limit: int) -> DataFrame:
    """The best rows and all that tie with the last of them, in order.  The cutoff is the score of the last
    of the top rows, so only rows at or above it are ranked."""
    from pyspark.sql import Window as W

    cutoff = rows.orderBy(F.desc(score)).limit(limit).agg(F.min(score).alias("_cut"), F.count("*").alias("_n"))
    kept = rows.crossJoin(F.broadcast(cutoff)).where(F.col(score) >= F.col("_cut")).drop("_cut", "_n")  # one row
    return kept.withColumn("position", F.row_number().over(W.orderBy(F.desc(score), id_col)))


def providers(rows: DataFrame, name: str, size: str) -> DataFrame:
    """Records and characters of each provider, numbered by size."""
    from pyspark.sql import Window as W

    counts = rows.groupBy(F.col(name).alias("provider")).agg(F.count("*").alias("records"), F.sum(size).cast("long").alias("chars"))
    return counts.withColumn("by_size", F.row_number().over(W.orderBy(F.desc("records"), "provider")))  # a row per provider


def lane_freshness(events: DataFrame, lane: str, stamp: str, malformed) -> DataFrame:
    """Newest use of each lane, nulls aside, with its uses and malformed ones."""
    return events.groupBy(lane).agg(F.max(stamp).alias("newest"), F.count_if(malformed).alias("malformed"), F.count("*").alias("n"))
