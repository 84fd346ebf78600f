"""Synthesis of episodes: map chunks under a ceiling, a pluggable producer, kept partials, reduction.

A producer is any function of a DataFrame of chunks (``key``, ``transcript``) that gives one with ``key``,
``title`` and ``facts``; an Arrow function around a model fits, and ``extract`` stands in offline.  What it
gives is kept under a hash of all that it depends on, so that a pass that ended early goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.episodes import TOKEN_CEILING

Producer = Callable[[DataFrame], DataFrame]


def map_chunks(events: DataFrame, episode: str, ceiling: int = TOKEN_CEILING) -> DataFrame:
    """Events of episodes with their ``chunk``: an episode over the ceiling is cut where a chunk has passed
    it, at the next block of a person, or at any event once it has passed twice the ceiling.

    Columns: the episode's, event_index, text, opens (whether a block begins).  An episode folds over three
    numbers per event, never over its texts."""
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    rows = events.select(episode, F.struct("event_index", words.alias("words"), F.length(text).alias("chars"), F.coalesce("opens", F.lit(False)).alias("opens")).alias("e"))
    listed = rows.groupBy(episode).agg(F.sort_array(F.collect_list("e")).alias("all"))
    tokens = lambda w, c: F.greatest(w, F.floor(c / 4))
    whole = tokens(F.aggregate("all", F.lit(0).cast("bigint"), lambda s, e: s + e["words"]), F.aggregate("all", F.lit(0).cast("bigint"), lambda s, e: s + e["chars"]))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("bigint").alias("w"), F.lit(0).cast("bigint").alias("c"), F.array().cast("array<struct<event_index:int,chunk:int>>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        held = tokens(s["w"], s["c"])
        cut = (F.size(s["out"]) > 0) & (held > ceiling) & (e["opens"] | (held > 2 * ceiling))
        chunk = F.when(cut, s["chunk"] + 1).otherwise(s["chunk"])
        kept = lambda name, more: F.when(cut, F.lit(0).cast("bigint")).otherwise(s[name]) + more
        return F.struct(chunk.alias("chunk"), kept("w", e["words"]).alias("w"), kept("c", e["chars"]).alias("c"), F.concat(s["out"], F.array(F.struct(e["event_index"].cast("int").alias("event_index"), chunk.cast("int").alias("chunk")))).alias("out"))

    placed = F.when(whole <= ceiling, F.transform("all", lambda e: F.struct(e["event_index"].cast("int").alias("event_index"), F.lit(0).alias("chunk")))).otherwise(F.aggregate("all", start, step)["out"])
    return listed.select(episode, F.explode(placed).alias("p")).select(episode, "p.event_index", "p.chunk")


def partial_key(model: Column, system: Column, transcript: Column) -> Column:
    """The name of what a producer gives for an input: a hash of everything that it depends on."""
    return F.sha2(F.concat_ws("\x1f", model, system, transcript), 256)


def extract(chunks: DataFrame) -> DataFrame:
    """An offline producer: the first line as title, and each distinct line of thirty characters or more
    that ends a sentence as a fact, in order."""
    lines = F.filter(F.transform(F.split("transcript", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    facts = F.array_distinct(F.filter(lines, lambda x: (F.length(x) >= 30) & x.rlike(r"[.!?]$")))
    return chunks.select("key", F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), 1, 80).alias("title"), facts.alias("facts"))


def produced(chunks: DataFrame, partials: DataFrame | None, producer: Producer = extract) -> tuple[DataFrame, DataFrame]:
    """What the producer gives for each chunk, with what was kept taken as it is; and what is new to keep.

    chunks: key, transcript; equal inputs are produced once."""
    wanted = chunks.select("key", "transcript").dropDuplicates(["key"])
    if partials is not None:
        wanted = wanted.join(partials.select("key"), "key", "left_anti")
    fresh = producer(wanted)
    known = fresh if partials is None else fresh.unionByName(partials.select(fresh.columns).join(chunks.select("key").distinct(), "key", "left_semi"))
    return chunks.join(known, "key"), fresh


def reduced(maps: DataFrame, episode: str, chunk: str) -> DataFrame:
    """One synthesis per episode: the first chunk's title and the distinct facts of all in order."""
    listed = maps.groupBy(episode).agg(F.sort_array(F.collect_list(F.struct(F.col(chunk).alias("chunk"), "title", "facts"))).alias("all"))
    facts = F.array_distinct(F.flatten(F.transform("all", lambda x: x["facts"])))
    return listed.select(episode, F.size("all").alias("map_chunks"), F.get("all", F.lit(0))["title"].alias("title"), facts.alias("facts"))


def record_metadata(records: DataFrame) -> DataFrame:
    """What a status reader may keep of synthesis records: names, models and counts, never texts."""
    size = lambda a: F.size(F.coalesce(a, F.array().cast("array<string>")))
    duration = F.when(F.col("duration_ms") >= 0, F.col("duration_ms"))
    return records.select("job_key", "conversation_id", "model_requested", "model_resolved", size(F.col("event_ids")).alias("events"), "usage.input_tokens", "usage.output_tokens", duration.alias("duration_ms"), size(F.col("output.facts")).alias("facts"), size(F.col("output.open_ends")).alias("open_ends"))


def sanitised(evidence: DataFrame) -> DataFrame:
    """Evidence of a service that may not have redacted it: texts are redacted and never grow, and a cut
    text whose basis is unknown is withheld, as what its label was cannot be seen.

    Columns: text, truncated, excerpt_basis, excerpt_start, excerpt_end; adds ``withheld``."""
    from quarry.functions.redaction import redacted

    unsafe = F.coalesce(F.col("truncated"), F.lit(False)) & ~F.coalesce(F.col("excerpt_basis") == "redacted_text", F.lit(False))
    clean = F.when(unsafe, F.lit("[REDACTED:unverified-excerpt]")).otherwise(redacted(F.col("text")))
    rows = evidence.withColumn("_clean", F.left(clean, F.length("text"))).withColumn("withheld", unsafe)
    changed = F.col("_clean") != F.col("text")
    return rows.select(
        *[c for c in evidence.columns if c not in ("text", "excerpt_basis", "excerpt_start", "excerpt_end")],
        F.col("_clean").alias("text"),
        F.when(changed, "redacted_text").otherwise(F.col("excerpt_basis")).alias("excerpt_basis"),
        F.when(~changed, F.col("excerpt_start")).alias("excerpt_start"),
        F.when(~changed, F.col("excerpt_end")).alias("excerpt_end"),
        "withheld",
    )


def erasure_findings(plan: DataFrame, archive: DataFrame, lineage: DataFrame) -> DataFrame:
    """Whether an erasure may go on: plans whose conversations are all known and whose generation the
    archive descends from.  plan: plan, from_generation, conversation_id; archive: conversation_id;
    lineage: generation."""
    known = archive.select("conversation_id").distinct().withColumn("_known", F.lit(1))
    ancestors = lineage.select(F.col("generation").alias("from_generation")).distinct().withColumn("_ancestor", F.lit(1))
    rows = plan.join(known, "conversation_id", "left").join(ancestors, "from_generation", "left")
    return rows.groupBy("plan").agg(F.count("*").alias("conversations"), F.count_if(F.col("_known").isNull()).alias("unknown"), F.min(F.coalesce("_ancestor", F.lit(0))).alias("_descends")).select(
        "plan", "conversations", "unknown", F.when(F.col("_descends") == 0, "other lineage").when(F.col("unknown") > 0, "unknown conversations").otherwise("ready").alias("finding")
    )


def job_owners(journal: DataFrame) -> DataFrame:
    """The conversation that each submitted job belongs to, by its last line, and whether it is still
    pending.  journal: job_id, conversation_id, event (submitted or collected), at."""
    last = journal.groupBy("job_id").agg(F.max(F.struct("at", "event", "conversation_id")).alias("l"), F.max_by("conversation_id", F.when(F.col("event") == "submitted", F.col("at"))).alias("conversation_id"))
    return last.select("job_id", "conversation_id", (F.col("l.event") == "submitted").alias("pending"))


def checkpoints(events: DataFrame) -> DataFrame:
    """The state of every checkpoint of a session from its events: frozen, reissued, consumed or resolved,
    the last one counting; and whether its session waits for it.  events: session, checkpoint, event, at."""
    last = events.groupBy("session", "checkpoint").agg(F.max_by("event", F.struct("at", "event")).alias("state"), F.count_if(F.col("event") == "reissued").alias("reissues"))
    return last.withColumn("waiting", F.col("state").isin("frozen", "reissued"))
