"""Sessions of work: transcripts, their boundaries and the limits after which they are recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Limits of an unrecorded session, tools that change files, and commits.
MIN_PROMPTS, MIN_BYTES, MAX_SECONDS = 10, 4 * 1024, 7_200
WORK_TOOLS = ("Edit", "MultiEdit", "NotebookEdit", "Write")
COMMIT = r"\bgit\s+(?:-C\s+\S+\s+)?commit\b"


def is_prompt(kind: Column, parts: Column) -> Column:
    """Whether a transcript line is a user's prompt: text and no tool result."""
    has = lambda t: F.exists(parts, lambda p: p["type"] == t)
    return F.coalesce((kind == "user") & has("text") & ~has("tool_result"), F.lit(False))


def work_uses(parts: Column) -> Column:
    """How many parts of a line change files or commit."""
    return F.size(F.filter(F.coalesce(parts, F.array().cast("array<struct<type:string,name:string,command:string>>")), lambda p: (p["type"] == "tool_use") & (p["name"].isin(*WORK_TOOLS) | ((p["name"] == "Bash") & F.coalesce(p["command"].rlike(COMMIT), F.lit(False))))))


def scanned(lines: DataFrame) -> DataFrame:
    """Per session: prompts, bytes, edits, last line and model.  Columns: session, offset, kind, model,
    size, parts (array of type, name, command)."""
    last_model = F.max(F.when(F.col("model").isNotNull(), F.struct("offset", "model")))
    return lines.groupBy("session").agg(
        F.count_if(is_prompt(F.col("kind"), F.col("parts"))).alias("prompts"), F.sum("size").alias("bytes"), F.sum(work_uses(F.col("parts"))).cast("long").alias("edits"), F.max("offset").alias("boundary"), last_model["model"].alias("model")
    )


def over_limits(prompts: Column, size: Column, baseline: Column, now: Column) -> Column:
    """Whether a session must be recorded: many prompts, or some bytes for long enough."""
    aged = (size >= MIN_BYTES) & (F.unix_timestamp(now) - F.unix_timestamp(baseline) >= MAX_SECONDS)
    return F.coalesce((prompts > 0) & ((prompts >= MIN_PROMPTS) | F.coalesce(aged, F.lit(False))), F.lit(False))


def machine_job_episodes(events: DataFrame, jobs: tuple[str, ...], prompts: tuple[str, ...]) -> DataFrame:
    """Episodes whose user openings are all machine prompts and one at least a job's.  Columns:
    episode, role, text."""
    opening = F.trim(F.regexp_replace(F.substring("text", 1, 240), r"\s+", " "))

    def opens(known: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for k in known:
            out = out | F.startswith(opening, F.lit(k))
        return out

    users = events.where("role = 'user'")
    return users.groupBy("episode").agg(F.bool_or(opens(jobs)).alias("j"), F.bool_and(opens(jobs + prompts)).alias("m")).where("j AND m").select("episode")


def covered(conversations: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Conversations without a session record of their own."""
    return conversations.join(records.select(key), key, "left_anti")


#: Lone messages of a harness, and the shape of one whose end varies.
HARNESS_ECHOES = ("Structured output provided successfully", "[Request interrupted by user]")
HARNESS_ECHO = r"^/remote-control is active · Continue here, on your phone, or at https://claude\.ai/code/session_\w+$"
#: Tools whose results are documents and no logs; how a call names its tool.
DOCUMENT_TOOLS = ("Read", "WebFetch")
CALL_NAME = r"(?m)^tool: ([A-Za-z0-9_.:-]+)$"


def is_echo(text: Column) -> Column:
    """Whether a whole text is a message that a harness writes by itself."""
    return F.coalesce(F.trim(text).isin(*HARNESS_ECHOES) | F.trim(text).rlike(HARNESS_ECHO), F.lit(False))


def trivial_episodes(events: DataFrame, episode: str) -> DataFrame:
    """Episodes whose only event is a harness echo.  Columns: the episode's and ``text``."""
    sizes = events.groupBy(episode).agg(F.count("*").alias("n"), F.min("text").alias("text"))
    return sizes.where((F.col("n") == 1) & is_echo(F.col("text"))).select(episode)


def echo_candidates(cited: DataFrame, archive: DataFrame, episode: str) -> DataFrame:
    """Episodes that cite one event, which the archive holds as an echo, with its text.  cited: the
    episode's column, conversation_id, event_id; archive: conversation_id, event_id, text."""
    single = cited.groupBy(episode).agg(F.count("*").alias("n"), F.min(F.struct("conversation_id", "event_id")).alias("e")).where("n = 1").select(episode, "e.*")
    return single.join(archive.where(is_echo(F.col("text"))), ["conversation_id", "event_id"]).select(episode, F.trim("text").alias("text"))


def tool_outputs(events: DataFrame) -> DataFrame:
    """Events with ``answers``, the tool whose call a result answers, and ``tool_output``, whether they are
    tool traffic and no document.  Columns: conversation_id, event_index, role, text, tool_rule.

    Results answer calls in order, and a result without an open call answers none: of r results and c calls
    so far, the most that r ever led c by were in vain.  So the result's ordinal among the answering ones is
    a running sum less a running maximum, and it meets its call by equality."""
    order = W.partitionBy("conversation_id").orderBy("event_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    named = F.when(F.col("tool_rule") == "rendered tool call", F.regexp_extract_all("text", F.lit(CALL_NAME), F.lit(1))).otherwise(F.array().cast("array<string>"))
    result = F.coalesce((F.col("tool_rule") == "rendered tool result") | (F.col("role") == "tool"), F.lit(False))
    rows = events.withColumn("_names", F.coalesce(named, F.array().cast("array<string>"))).withColumn("_result", result)
    rows = rows.withColumn("_calls", F.sum(F.size("_names")).over(order)).withColumn("_results", F.sum(F.col("_result").cast("int")).over(order))
    rows = rows.withColumn("_vain", F.greatest(F.lit(0), F.max(F.col("_results") - F.col("_calls")).over(order)))
    before = W.partitionBy("conversation_id").orderBy("event_index")
    answering = F.col("_result") & (F.col("_vain") == F.coalesce(F.lag("_vain").over(before), F.lit(0)))
    rows = rows.withColumn("_nth", F.when(answering, F.col("_results") - F.col("_vain")))
    calls = rows.select("conversation_id", (F.col("_calls") - F.size("_names")).alias("_base"), F.posexplode("_names").alias("_at", "answers")).select("conversation_id", (F.col("_base") + F.col("_at") + 1).alias("_nth"), "answers")
    joined = rows.join(calls, ["conversation_id", "_nth"], "left")
    traffic = F.col("tool_rule").isNotNull() | ~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    output = traffic & ~F.coalesce(F.col("answers").isin(*DOCUMENT_TOOLS), F.lit(False))
    return joined.withColumn("tool_output", output).drop("_names", "_result", "_calls", "_results", "_vain", "_nth")


def transcripts(events: DataFrame, key: str, most: int = 60_000, tool_most: int = 4_000) -> DataFrame:
    """Each episode's text for a reader: lines of role and text, texts cut in the middle, tool traffic
    shorter.  Columns: key, event_index, role, text, tool_output.  An episode is bounded by its ceiling."""
    from quarry.functions.text import head_and_tail

    whole = F.trim(F.coalesce("text", F.lit("")))
    cut = F.when(F.col("tool_output"), head_and_tail(whole, tool_most)).otherwise(head_and_tail(whole, most))
    lines = events.where(whole != "").select(key, "event_index", F.concat(F.lit("["), F.coalesce("role", F.lit("unknown")), F.lit("] "), cut).alias("line"))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_index", "line"))), lambda x: x["line"]), "\n").alias("transcript"))


def work_order(conversations: DataFrame, holding: str, finished: str, updated: str) -> DataFrame:
    """Conversations with their ``position`` in a pass: those held first, then unfinished ones, then the
    newest.  Rows of one pass."""
    order = W.orderBy(F.desc(F.coalesce(holding, F.lit(False))), F.coalesce(finished, F.lit(False)), F.desc_nulls_last(updated), "conversation_id")
    return conversations.withColumn("position", F.row_number().over(order))


def unfinished(conversations: DataFrame, markers: DataFrame) -> DataFrame:
    """Conversations without a marker of their own id, update and fingerprint."""
    return conversations.join(markers.select("conversation_id", "updated", "fingerprint").distinct(), ["conversation_id", "updated", "fingerprint"], "left_anti")


def in_workspace(conversations: DataFrame, target: str, home: str) -> DataFrame:
    """Conversations at or below a workspace, both in canonical form."""
    from quarry.functions.paths import canonical, in_scope

    wanted = target if target.startswith("[HOME]") or not target.startswith(home.rstrip("/")) else "[HOME]" + target[len(home.rstrip("/")) :]
    return conversations.where(in_scope(canonical(F.col("workspace"), home), wanted))
