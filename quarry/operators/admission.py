"""Admission of archive events: the rule cascade, the pairing of tool calls with results, the tally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.identity import record_id

#: Acknowledgements that are no record, and how a rendered tool call opens.
ACKNOWLEDGEMENT = (
    r"(?i)^(ok|okay|vale|dale|adelante|s[ií]|no|gracias|perfecto|genial|"
    r"contin[uú]a|continua|sigue|listo|hecho|bien|correcto|exacto|claro)"
    r"[\s.,!¡¿?]*$"
)
RENDERED_CALL = r"^tool: [A-Za-z0-9_.:-]+(?:\n|$)"
TRAILING_CALLS = r"(?:\ntool: [A-Za-z0-9_.:-]+)+\s*$"
#: How prompts written by a harness open, white space collapsed.
MACHINE_PROMPTS = (
    "<recommended_plugins> Here is a list of plugins that are available but not installed.",
    "# AGENTS.md instructions",
    "Base directory for this skill:",
    "[SYSTEM NOTIFICATION - NOT USER INPUT] This is an automated background-task event",
    "[Workflow harness \u2014 computed task] The task text below was computed at runtime",
    "You structure one already-extracted statement into fields.",
    "You decide what a statement is, not whether it is true.",
)
OPENING = 240
#: Temporary folders in which programs of one provider run jobs, not people.
AUTOMATION_PROVIDER = "codex"
AUTOMATION_WORKSPACES = (
    r"^(?:/private)?/var/folders/[^/]+/[^/]+/T/[a-z]+-codex-[^/]+/?$",
    r"^(?:/private)?/var/folders/[^/]+/[^/]+/T/brain-ingest-[^/]+/[0-9A-HJKMNP-TV-Z]{26}/?$",
    r"^(?:/private)?/var/folders/[^/]+/[^/]+/T/worker-task-[^/]+/workspace/?$",
    r"^(?:/private)?/var/folders/[^/]+/[^/]+/T/clips-triage-[A-Za-z0-9]{6}/?$",
    r"^(?:/private)?/var/folders/[^/]+/[^/]+/T/(?:bench|judge)-[a-z0-9_]{8}/?$",
)
RESULT_KINDS = ("tool-result", "tool_result")
ROLES = ("user", "assistant")


def is_machine_prompt(role: Column, text: Column, prompts: tuple[str, ...] = MACHINE_PROMPTS) -> Column:
    opening = F.trim(F.regexp_replace(F.substring(text, 1, OPENING), r"\s+", " "))
    known = F.lit(False)
    for prompt in prompts:
        known = known | F.startswith(opening, F.lit(prompt))
    return F.coalesce((role == "user") & known, F.lit(False))


def is_automation(provider: Column, workspace: Column, shapes: tuple[str, ...] = AUTOMATION_WORKSPACES) -> Column:
    """Whether a conversation is a program's own traffic: provider and raw workspace both say so."""
    return F.coalesce((provider == AUTOMATION_PROVIDER) & workspace.rlike("|".join(shapes)), F.lit(False))


def pair_tool_rounds(events: DataFrame, call_pattern: str = RENDERED_CALL, trailing_pattern: str | None = TRAILING_CALLS) -> DataFrame:
    """Events with ``tool_rule``: a rendered call, a user message that answers one, or null.

    The owed results of a conversation are a counter that calls raise, results lower but not below
    zero, and other assistant messages set anew.  Between two of these settings the counter is its sum
    less its lowest sum so far, which windows over the event order give without holding a conversation
    in memory.  Columns: conversation_id, event_index, role, kind, text (trimmed).
    """
    message = F.col("kind") == "message"
    result = F.coalesce((F.col("role") == "tool") | F.col("kind").isin(*RESULT_KINDS), F.lit(False))
    call = F.coalesce(message & ~result & (F.col("role") == "assistant") & F.col("text").rlike(call_pattern), F.lit(False))
    resets = F.coalesce(message & ~result & (F.col("role") == "assistant") & ~F.col("text").rlike(call_pattern), F.lit(False))
    answers = F.coalesce(message & ~result & (F.col("role") == "user"), F.lit(False))
    owed = F.size(F.split(F.regexp_extract("text", trailing_pattern, 0), "\ntool: ")) - 1 if trailing_pattern else F.lit(0)
    step = F.when(resets, owed).when(call, 1).when(answers | result, -1).otherwise(0)
    order = W.partitionBy("conversation_id").orderBy("event_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = events.withColumns({"_call": call, "_answers": answers, "_step": step, "_part": F.sum(resets.cast("int")).over(order)})
    inside = W.partitionBy("conversation_id", "_part").orderBy("event_index")
    total = F.sum("_step").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("_sum", total)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    pending = F.coalesce(F.last("_sum").over(before), F.lit(0)) - F.least(F.lit(0), F.coalesce(F.min("_sum").over(before), F.lit(0)))
    rule = F.when(F.col("_call"), "rendered tool call").when(F.col("_answers") & (F.col("_pending") > 0), "rendered tool result")
    return rows.withColumn("_pending", pending).withColumn("tool_rule", rule).drop("_call", "_answers", "_step", "_part", "_sum", "_pending")


def admission_rules(events: DataFrame, forgotten: DataFrame | None = None, acknowledgement: str = ACKNOWLEDGEMENT, prompts: tuple[str, ...] = MACHINE_PROMPTS) -> DataFrame:
    """Events with their ``rule``, the first that turns them away, or ``admit``.

    Columns: conversation_id, event_index, event_id, role, kind, text; null texts count as empty.
    forgotten: ``record_id`` of records that stay away.
    """
    rows = pair_tool_rounds(events.withColumn("text", F.trim(F.coalesce("text", F.lit("")))))
    rows = rows.withColumn("record_id", record_id(F.col("conversation_id"), F.col("event_id")))
    if forgotten is not None:
        rows = rows.join(forgotten.select("record_id").distinct().withColumn("_gone", F.lit(True)), "record_id", "left")
    else:
        rows = rows.withColumn("_gone", F.lit(False))
    rule = (
        F.when(F.col("tool_rule").isNotNull(), F.col("tool_rule"))
        .when(~(F.coalesce("kind", F.lit("")) == "message"), F.concat(F.lit("kind "), F.coalesce("kind", F.lit("absent"))))
        .when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), F.concat(F.lit("role "), F.coalesce("role", F.lit("absent"))))
        .when(is_machine_prompt(F.col("role"), F.col("text"), prompts), "machine prompt")
        .when((F.col("text") == "") | F.col("text").rlike(acknowledgement), "empty or acknowledgement")
        .when(F.col("record_id").isNull(), "missing event id")
        .when(F.coalesce("_gone", F.lit(False)), "forgotten")
        .otherwise("admit")
    )
    return rows.withColumn("rule", rule).drop("tool_rule", "_gone")


def tally(rules: DataFrame) -> DataFrame:
    """Events admitted by role and rejected by rule."""
    return rules.groupBy("rule", F.when(F.col("rule") == "admit", F.col("role")).alias("admitted_role")).agg(F.count("*").alias("events"))
